"""Operator 10 (native): URL filtering by listed rules and mined associations.

Listed rules name a host (with its subdomains) and a path prefix; the longest
rule that fits decides.  For all other URLs the verdict comes from association
rules: URLs that the list blocks, or that given labels name, are the labelled positives, Spark's FP-growth
mines the token combinations that are frequent among them, and a combination
blocks if its confidence (labelled positives among all URLs that hold it)
reaches ``min_confidence`` and its support ``min_support``.  Combinations that
hold a smaller rule are pruned.

Both lookups are equi joins: listed rules by (host suffix, path prefix), mined
rules by an inverted index on the rarest token of each, after URLs with the
same tokens have been counted together.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; without labelled positives nothing is mined and the verdict
is ``allow``; ids play no part in the verdict, so null and repeated ids are
carried through; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import lower_ascii, written

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: every label of the host by place from the right, and
    the words of the path without those that hold a digit."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(lower_ascii(path), "[/._-]+"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    return F.array_sort(F.array_distinct(F.concat(labels, words)))


def listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` with the longest listed rule that fits, for URLs that some rule fits.

    ``urls`` has distinct ``url``, ``host``, ``path``; ``rules`` has
    ``verdict``, ``rule_host``, ``rule_path``.  Ties go to the longer host.
    """
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]  # of paths: a few at most
    labels = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().collect()]  # of hosts, likewise
    # only suffixes of as many labels as some rule has: a host of any length gives a few
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size("parts")), lambda n: F.array_join(F.slice("parts", -n, n), "."))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")),
                                            lambda n: F.substring(F.col("path"), F.lit(1), n)))
    parts = (urls.filter("host <> ''").withColumn("parts", F.split("host", r"\.")).select("url", F.explode(suffixes).alias("rule_host"), prefixes.alias("prefixes"))
             .select("url", "rule_host", F.explode("prefixes").alias("rule_path")))
    best = F.max_by(F.struct("verdict", F.concat("rule_host", "rule_path").alias("rule")),
                    F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "verdict"))
    return parts.join(rules, ["rule_host", "rule_path"]).groupBy("url").agg(best.alias("r")).select("url", "r.rule", F.col("r.verdict").alias("listed"))


def mined(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``tokens`` of the token sets that a mined rule blocks.

    ``labelled`` has distinct ``tokens`` with ``n`` (URLs) and ``bad`` (of them
    labelled positives).  Tokens that block alone are rules already and are not
    mined, as rules that hold them would be pruned.  Of the others, tokens that
    the same positives hold are one item, which a URL holds if it has them all: so
    words that always occur together do not multiply the itemsets.
    """
    total = labelled.agg(F.sum("bad")).first()[0]
    each = labelled.select("tokens", "n", "bad", F.explode("tokens").alias("token"))
    rows_of = [F.bit_xor(F.when(F.col("bad") > 0, F.xxhash64("tokens", F.lit(i)))).alias(f"x{i}") for i in (0, 1)]
    often = written(each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("b"), *rows_of).filter(F.col("b") >= min_support * total).filter("b > 0"), "often")
    surely = F.col("b") >= min_confidence * F.col("n")
    blocked = each.join(often.filter(surely), "token", "left_semi").select("tokens")
    alike = often.filter(~surely).groupBy("b", "x0", "x1").agg(F.min("token").alias("item"), F.count(F.lit(1)).alias("k"), F.collect_list("token").alias("all"))
    items = written(alike.select("item", "k", F.explode("all").alias("token")), "items")
    held = each.join(items, "token").groupBy("tokens", "n", "bad", "item", "k").agg(F.count(F.lit(1)).alias("c")).filter("c = k")
    baskets = written(held.groupBy("tokens", "n", "bad").agg(F.array_sort(F.collect_set("item")).alias("items")), "baskets")
    rows = baskets.filter("bad > 0").select(F.explode(F.array_repeat(F.col("items"), F.col("bad").cast("int"))).alias("items"))
    several = rows.count()
    if not several:
        return blocked.distinct()
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * total / several), minConfidence=1.0).fit(rows).freqItemsets
    sets = written(found.select(F.array_sort("items").alias("rule"), F.col("freq").alias("bad_all")), "itemsets")
    frequent = baskets.select("n", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n").alias("uses"))
    indexed = (sets.select("rule", "bad_all", F.explode("rule").alias("token")).join(frequent, "token")
               .groupBy("rule", "bad_all").agg(F.min_by("token", F.struct("uses", "token")).alias("token")))
    index = baskets.select("tokens", "items", "n", F.explode("items").alias("token"))
    hits = index.join(indexed, "token").filter(F.size(F.array_except("rule", "items")) == 0)
    good = hits.groupBy("rule").agg(F.sum("n").alias("n"), F.max("bad_all").alias("bad")).filter(F.col("bad") >= min_confidence * F.col("n"))
    # a rule that holds a smaller rule blocks nothing more: drop it, by the smaller rule's tokens
    good = written(good.select("rule"), "rules")
    token_of = good.select(F.col("rule").alias("large"), F.explode("rule").alias("token"))
    small = good.select(F.col("rule").alias("small"), F.element_at("rule", 1).alias("token"))
    larger = token_of.join(small, "token").filter((F.size("small") < F.size("large")) & (F.size(F.array_except("small", "large")) == 0)).select(F.col("large").alias("rule"))
    kept = good.join(larger.distinct(), "rule", "left_anti")
    kept = kept.join(indexed.select("rule", "token"), "rule")
    return index.join(kept, "token").filter(F.size(F.array_except("rule", "items")) == 0).select("tokens").unionByName(blocked).distinct()


def judged(pages: DataFrame, rules=RULES, min_support: float = 0.01, min_confidence: float = 0.95, labels: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` of every page.

    ``labels`` (``page_id``, ``bad``) names more positives than the list blocks; a
    page is one if any of its rows says so.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    plain = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    marked = plain.withColumn("mark", F.lit(0))
    if labels is not None:
        bad = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("mark"))
        marked = plain.join(bad, "page_id", "left").select("page_id", "url", F.coalesce("mark", F.lit(0)).alias("mark"))
    urls = marked.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("marked")).select("url", "n", "marked", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    seen = written(urls.join(listed(urls.select("url", "host", "path"), table), "url", "left")
                   .select("*", tokens(F.col("host"), F.col("path")).alias("tokens")), "urls")
    sets = written(seen.filter("host <> ''").groupBy("tokens").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("listed") == "block", F.col("n")).otherwise(F.col("marked"))).alias("bad")), "tokens")
    if sets.filter("bad > 0").isEmpty():
        blocked = sets.select("tokens").limit(0)
    else:
        blocked = mined(sets, min_support, min_confidence)
    seen = seen.join(blocked.withColumn("mined", F.lit("block")), "tokens", "left").select(
        "url", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"))
    return plain.join(seen, "url").select("page_id", "host", "path", "rule", "verdict")
