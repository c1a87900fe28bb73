"""Pairwise record matching with lossless blocking.

The original compares a record with every record of its entity type.  Here
candidate pairs come from an equi join on the entity type plus *blocking
keys* derived from the match config:

A binary rule (``exact``, ``exactCaseInsensitive``, ``normalized``: score 0
or 1) is *necessary* when the other rules together cannot reach the
threshold: ``(W - w_r) / W < threshold``.  Any pair it scores 0 can never
match, so its normalised value is a null-safe join key that loses no match
(two NULLs score 1, hence ``<=>``).  All necessary rules together form one
composite key.

Inside the blocks of these keys (or without any), a necessary ``fuzzy`` rule gives candidates: a match needs a least
similarity, so an edit distance of at most k, and of two texts that far apart the
k + 1 segments of one leave a segment unchanged in the other, near its place.
Distinct values meet by an equi join on such segments and are compared and scored, then
records join by value.  These joins are sorted, never broadcast: what is read says
little about the size of texts and segments in memory.  Records where both values are NULL score 1 in that rule;
they are matched by what the other rules still need, in the same way.

Without any such rule the caller must name blocking columns (lossy, their
choice) or pass ``allow_all_pairs`` explicitly.

Hot blocks are split by adaptive execution's skew-join handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.values import TypedCol, resolve
from .scores import BINARY_TYPES, comparable_exact, feature, fuzzy_similarity, pair_score, weighted_score

EPS = 1e-9
DEFAULT_THRESHOLD = 0.7


class MatchConfigError(ValueError):
    pass


def necessary_rules(config: dict) -> list[dict]:
    rules = config["rules"]
    total = sum(float(r["weight"]) for r in rules)
    if total <= 0 or any(float(r["weight"]) < 0 for r in rules):
        return []
    thr = float(config.get("threshold", DEFAULT_THRESHOLD))
    return [r for r in rules if r["type"] in BINARY_TYPES
            and (total - float(r["weight"])) / total < thr - EPS]


def needed_fuzzy(rules: list[dict], need: float) -> tuple[int, float] | None:
    """The ``fuzzy`` rule that demands the greatest similarity of a match, and that similarity.

    ``need`` is the weight that the rules have to give together.
    """
    total = sum(float(r["weight"]) for r in rules)
    least = [((need - (total - float(r["weight"]))) / float(r["weight"]), -i) for i, r in enumerate(rules) if r["type"] == "fuzzy" and float(r["weight"]) > 0]
    best = max(least, default=(0.0, 0))
    return (-best[1], best[0] - EPS) if best[0] > EPS else None


def similar_values(left: DataFrame, right: DataFrame, similarity: float, max_distance: int | None = None) -> DataFrame:
    """Pairs ``(g, a, b)`` of ``left(g, v)`` and ``right(g, v)`` with an edit distance of at most
    ``1 - similarity`` of the longer text (and ``max_distance``); none is lost.

    ``similarity`` is above 0.  A text of length l is at most ``k`` edits from any
    such partner, k = l (1 - similarity) / similarity.  It is cut into k + 1
    segments; one of them is in the partner, shifted by no more than the edits
    allow on either side.  Texts of no more than k characters have no such
    segments and meet all texts of the lengths in reach.
    """
    def most(n):
        k = F.floor(n * ((1 - similarity) / similarity) + EPS)
        return (k if max_distance is None else F.least(k, F.lit(int(max_distance)))).cast("int")

    ls = left.where("v is not null").distinct().select("g", F.col("v").alias("a"), F.length("v").alias("m"))
    rs = right.where("v is not null").distinct().select("g", F.col("v").alias("b"), F.length("v").alias("l")).withColumn("k", most(F.col("l")))
    # lengths l in reach of a text of m characters
    reach = F.sequence(F.greatest(F.lit(0), F.floor(F.col("m") * similarity - EPS).cast("int")), F.ceil(F.col("m") / similarity + EPS).cast("int"))
    probes = ls.withColumn("l", F.explode(reach)).withColumn("k", most(F.col("l"))).where(F.abs(F.col("m") - F.col("l")) <= F.col("k"))
    short = probes.where("l <= k").join(rs.where("l <= k").drop("k").hint("merge"), ["g", "l"]).select("g", "a", "b", "k")
    parts, base = F.col("k") + 1, F.floor(F.col("l") / (F.col("k") + 1)).cast("int")
    longer = F.col("l") - base * parts  # that many segments, the last ones, are a character longer
    i = F.col("i")
    size = (base + F.when(i >= parts - longer, 1).otherwise(0)).cast("int")
    start = (i * base + F.greatest(F.lit(0), i - (parts - longer))).cast("int")
    cut = lambda df: df.where("l > k").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("size", size).withColumn("start", start)
    index = cut(rs).select("g", "l", "i", "b", F.substring(F.col("b"), F.col("start") + 1, F.col("size")).alias("segment"))
    more = F.col("m") - F.col("l")
    first = F.greatest(F.lit(0), F.col("start") - F.floor((F.col("k") - more) / 2).cast("int"))
    last = F.least(F.col("m") - F.col("size"), F.col("start") + F.floor((F.col("k") + more) / 2).cast("int"))
    asked = (cut(probes).withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("p", F.explode(F.sequence("first", "last")))
             .select("g", "l", "i", "k", "a", F.substring(F.col("a"), F.col("p") + 1, F.col("size")).alias("segment")))
    near = asked.join(index.hint("merge"), ["g", "l", "i", "segment"]).select("g", "a", "b", "k").unionByName(short).distinct()
    return near.where(F.levenshtein("a", "b") <= F.col("k")).select("g", "a", "b")


def _field(df: DataFrame, path: str) -> TypedCol:
    return resolve(df.schema, "data." + path)


def prepare(df: DataFrame, config: dict, side: str) -> DataFrame:
    """Record struct plus, per rule, the prepared feature and its null flag.

    Features (normalised text, Soundex code, parsed number / time) are
    computed once per record here, before any pairing.
    """
    cols = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side),
            F.col("entityType").alias(f"__{side}et")]
    for i, rule in enumerate(config["rules"]):
        tc = _field(df, rule["field"])
        cols.append(feature(tc, rule).alias(f"__{side}f{i}"))
        cols.append(tc.col.isNull().alias(f"__{side}n{i}"))
    return df.select(*cols)


def _types(left: DataFrame, right: DataFrame, config: dict) -> list[bool]:
    return [comparable_exact(_field(left, r["field"]), _field(right, r["field"])) for r in config["rules"]]


def candidate_pairs(left: DataFrame, right: DataFrame, config: dict, *, exclude_self: bool = False,
                    blocking: list[str] | None = None, allow_all_pairs: bool = False) -> DataFrame:
    """Prepared pairs ``(s, t, features...)`` that may match under ``config``."""
    comparable = _types(left, right, config)
    ls, rs = prepare(left, config, "s"), prepare(right, config, "t")
    extra = []
    for j, path in enumerate(blocking or []):
        ls = ls.withColumn(f"__sx{j}", resolve(ls.schema, "s." + path).col)
        rs = rs.withColumn(f"__tx{j}", resolve(rs.schema, "t." + path).col)
        extra.append(j)
    total = sum(float(r["weight"]) for r in config["rules"])
    rules = {i: r for i, r in enumerate(config["rules"])}
    need = float(config.get("threshold", DEFAULT_THRESHOLD)) * total
    if total <= 0 or any(float(r["weight"]) < 0 for r in config["rules"]):
        rules, need = {}, float("inf")
    pairs = _pairs(ls, rs, rules, need, comparable, extra, allow_all_pairs)
    if exclude_self:
        pairs = pairs.where(F.col("s.id") != F.col("t.id"))
    return pairs


def _pairs(ls: DataFrame, rs: DataFrame, rules: dict[int, dict], need: float, comparable: list[bool], extra: list[int], all_pairs: bool) -> DataFrame:
    """Pairs for which ``rules`` may give the weight ``need``."""
    total = sum(float(r["weight"]) for r in rules.values())
    keys = [i for i, r in rules.items() if r["type"] in BINARY_TYPES and total - float(r["weight"]) < need - EPS * max(1.0, total)]
    fuzzy = None if extra else needed_fuzzy(list(rules.values()), need)
    if not keys and not fuzzy and not extra and not all_pairs and need > EPS:
        raise MatchConfigError(
            "no rule is necessary for a match under this threshold; pass blocking=[...] "
            "(explicit, possibly lossy keys) or allow_all_pairs=True")
    on = []
    for i in keys:
        if rules[i]["type"] == "exact" and not comparable[i]:
            # incomparable types: only two NULLs score 1
            ls, rs = ls.where(F.col(f"__sn{i}")), rs.where(F.col(f"__tn{i}"))
            continue
        # NULL keeps its own key: two NULLs score 1, NULL vs "" scores 0
        on.append((F.when(~F.col(f"__sn{i}"), F.col(f"__sf{i}")), F.when(~F.col(f"__tn{i}"), F.col(f"__tf{i}"))))
    on += [(F.col(f"__sx{j}"), F.col(f"__tx{j}")) for j in extra]
    if fuzzy:
        i, similarity = list(rules)[fuzzy[0]], fuzzy[1]
        distance = (rules[i].get("options") or {}).get("maxDistance")
        # few records and values make many pairs where values are shared, so both are dealt out, however small they are
        tasks = int(ls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ls = ls.where("__set is not null").repartition(tasks, F.col("s.id"))
        lv, rv = ls.where(~F.col(f"__sn{i}")), rs.where(~F.col(f"__tn{i}")).where("__tet is not null")
        # values meet inside a block of the keys; NULL keys are equal inside a struct
        block = lambda et, side: F.struct(F.col(et).alias("et"), *[k[side].alias(f"k{n}") for n, k in enumerate(on)])
        lv, rv = lv.withColumn("__sg", block("__set", 0)), rv.withColumn("__tg", block("__tet", 1))
        values = similar_values(lv.select(F.col("__sg").alias("g"), F.col(f"__sf{i}").alias("v")),
                                rv.select(F.col("__tg").alias("g"), F.col(f"__tf{i}").alias("v")), similarity, distance)
        # the rule is scored here, as record pairs outnumber those of values
        values = values.withColumn(f"__p{i}", fuzzy_similarity(F.col("a"), F.col("b"), rules[i])).repartition(tasks, "g", "a", "b")
        some = (lv.join(values.hint("merge"), (F.col("__sg") == F.col("g")) & (F.col(f"__sf{i}") == F.col("a"))).drop("g", "a")
                .join(rv.hint("merge"), (F.col("__sg") == F.col("__tg")) & (F.col(f"__tf{i}") == F.col("b"))).drop("__sg", "__tg", "b"))
        rest = {j: r for j, r in rules.items() if j != i}
        nulls = _pairs(ls.where(F.col(f"__sn{i}")), rs.where(F.col(f"__tn{i}")).hint("merge"), rest, need - float(rules[i]["weight"]), comparable, extra, all_pairs)
        return some.unionByName(nulls, allowMissingColumns=True)
    conds = [F.col("__set") == F.col("__tet"), *[a.eqNullSafe(b) for a, b in on]]
    return ls.join(rs, reduce(lambda a, b: a & b, conds), "inner")


def score_columns(pairs: DataFrame, config: dict, comparable: list[bool] | None = None):
    """Per-rule score structs and the weighted score from prepared features."""
    per_rule, weighted = [], []
    for i, rule in enumerate(config["rules"]):
        ok = True if comparable is None else comparable[i]
        known = F.col(f"__p{i}") if f"__p{i}" in pairs.columns else None
        sc = pair_score(rule, F.col(f"__sf{i}"), F.col(f"__tf{i}"), F.col(f"__sn{i}"), F.col(f"__tn{i}"), ok, known)
        w = float(rule["weight"])
        weighted.append((sc, w))
        per_rule.append(F.struct(F.lit(rule["field"]).alias("field"), F.lit(rule["type"]).alias("matchType"),
                                 sc.alias("score"), (sc * w).alias("weightedScore")))
    return per_rule, weighted_score(weighted)


def score(pairs: DataFrame, config: dict, target_type: str) -> DataFrame:
    comparable = [comparable_exact(resolve(pairs.schema, "s.data." + r["field"]),
                                   resolve(pairs.schema, "t.data." + r["field"])) for r in config["rules"]]
    per_rule, overall = score_columns(pairs, config, comparable)
    thr = float(config.get("threshold", DEFAULT_THRESHOLD))
    scored = pairs.select(
        F.col("s.id").alias("sourceRecordId"), F.col("t.id").alias("matchedRecordId"),
        F.lit(target_type).alias("matchedRecordType"), overall.alias("score"), F.array(*per_rule).alias("ruleScores"))
    return scored.select("sourceRecordId", "matchedRecordId", "matchedRecordType", "score",
                         (F.col("score") >= thr).alias("isMatch"), "ruleScores")


def find_matches(sources: DataFrame, targets: DataFrame, config: dict, target_type: str = "golden",
                 **kw) -> DataFrame:
    """Matches (score >= threshold) of each source among ``targets`` of its
    entity type; source-to-source matching excludes the record itself."""
    pairs = candidate_pairs(sources, targets, config, exclude_self=(target_type == "source"), **kw)
    return score(pairs, config, target_type).where("isMatch")


def find_all_matches(sources: DataFrame, goldens: DataFrame, all_sources: DataFrame, config: dict,
                     **kw) -> DataFrame:
    return (find_matches(sources, goldens, config, "golden", **kw)
            .unionByName(find_matches(sources, all_sources, config, "source", **kw)))


def score_given_pairs(pairs: DataFrame, sources: DataFrame, targets: DataFrame, config: dict,
                      target_type: str = "golden") -> DataFrame:
    """Score explicit ``(sourceRecordId, targetRecordId)`` pairs; unknown ids drop out."""
    s = prepare(sources, config, "s")
    t = prepare(targets, config, "t")
    joined = (pairs.join(s, pairs["sourceRecordId"] == F.col("s.id"))
              .join(t, pairs["targetRecordId"] == F.col("t.id")))
    return score(joined, config, target_type)


def block_report(records: DataFrame, config: dict, top: int = 20,
                 blocking: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sizes of the blocks ``candidate_pairs`` would join, before joining.

    Returns ``(largest blocks, totals)``: the ``top`` biggest blocks with
    their record count, and one row with the number of blocks, records and
    the exact number of directed candidate pairs (sum of n * (n - 1)).  One
    hash aggregate; use it to spot a block whose pairs would dominate.
    """
    keys = [i for i, r in enumerate(config["rules"]) if r in necessary_rules(config)]
    p = prepare(records, config, "s")
    cols = [F.col("__set").alias("entityType")]
    for i in keys:
        cols.append(F.when(~F.col(f"__sn{i}"), F.col(f"__sf{i}")).cast("string").alias(f"key{i}"))
    for j, path in enumerate(blocking or []):
        cols.append(resolve(p.schema, "s." + path).col.cast("string").alias(f"extra{j}"))
    sel = p.select(*cols)
    sizes = sel.groupBy(*sel.columns).agg(F.count(F.lit(1)).alias("records"))
    largest = sizes.orderBy(F.col("records").desc()).limit(top)
    totals = sizes.agg(F.count(F.lit(1)).alias("blocks"), F.sum("records").alias("records"),
                       F.sum(F.col("records") * (F.col("records") - 1)).alias("candidate_pairs"))
    return largest, totals


def active_config(configs: list[dict], entity_type: str, kind: str = "match") -> dict:
    """The first active configuration of an entity type, with the original's
    defaults (match threshold 0.7, survivorship strategy ``mostRecent``)."""
    for c in configs:
        if c.get("entityType") == entity_type and c.get("active", True):
            out = dict(c)
            if kind == "match":
                out.setdefault("threshold", DEFAULT_THRESHOLD)
            else:
                out.setdefault("defaultStrategy", "mostRecent")
                out.setdefault("rules", [])
            return out
    raise MatchConfigError(f"no active {kind} configuration for entity type {entity_type!r}")
