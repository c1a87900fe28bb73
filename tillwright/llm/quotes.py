"""Operator 2 (native): linking quotations to the messages they come from.

A line that starts with ``>`` marks is quoted, one level a mark (blanks
between marks are allowed).  A passage is a run of lines of one level, 0 for
own lines; its lines are normalised (marks off, white space collapsed, A-Z in
lower case; blank lines do not count) and hashed, one hash a passage.  A
passage of level n comes from the latest earlier message of the scope that has
it at level n - 1, so that of two copies the last is answered; if no message
has, from one that has it at the next lower level, in the end from the one that
wrote it.  A passage without an origin (quoted in part, or edited) is looked up
line by line in the same way.

A message replies to the origin found at its lowest quoted level, that of most
lines (lines of passages found whole, and lines that one message only has, come
before repeated lines; the later message on a tie, as quotes are of the last
one).  Root and depth follow by pointer doubling.  Conversations are read in
the order of ``root``, ``depth``, ``message_id``, without quotes.

Holders of a passage or line are reduced to the first and the last message
before the join.  Only where a quote lies between the two is the latest earlier
one searched, in ranges of the sorted rows, so neither a common line nor a
large scope meets in one task.

Defined results: a null or empty text is a message without lines; blank lines
and passages and lines without an origin link nothing; a message never is its own origin;
only earlier messages (by id) of the same ``scope`` are origins; a null scope is a
scope of its own; messages that repeat an id within a scope count as one for
links and keep their rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import lower_ascii, written

_MARKS = r"^((?:[ \t]*>)+)"
BLANK = "d41d8cd98f00b204e9800998ecf8427e"  # hash of a blank line


def level(line: Column) -> Column:
    """Number of quotation marks before the line."""
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(F.translate(marks, " \t", ""))


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(lower_ascii(F.regexp_replace(line, _MARKS, "")), r"[\x20\x09-\x0D]+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """Lines of every message: scope, message_id, ``lines`` (level, ``key``: 128-bit hash of the normalised line)."""
    each = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return messages.select("scope", "message_id", F.transform(each, lambda x: F.struct(level(x).alias("level"), F.md5(normalised(x)).alias("key"))).alias("lines"))


def passages(each: DataFrame) -> DataFrame:
    """Runs of lines of one level in a message: scope, message_id, level, start, n_lines, ``keys`` (of lines that are not blank), ``hash``."""
    first = F.filter(F.transform("lines", lambda v, i: F.when((i == 0) | (F.get("lines", i - 1)["level"] != v["level"]), i)), lambda i: i.isNotNull())
    cut = F.transform("b", lambda at, k: F.struct(at.alias("start"), F.slice("lines", at + 1, F.coalesce(F.get("b", k + 1), F.size("lines")) - at).alias("run")))
    runs = each.withColumn("b", first).select("scope", "message_id", F.explode(cut).alias("r"))
    keys = F.filter(F.transform("r.run", lambda v: v["key"]), lambda k: k != BLANK)
    return runs.select("scope", "message_id", F.element_at("r.run", 1)["level"].alias("level"), F.col("r.start").alias("start"),
                       F.size("r.run").alias("n_lines"), keys.alias("keys")).withColumn("hash", F.md5(F.array_join("keys", ",")))


def origins(quoted: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of ``quoted`` that have an origin, with ``origin`` and ``only`` (one message has the key at that level).

    ``quoted`` has scope, message_id, level, key, each once, and ``n``;
    ``held`` has scope, message_id, level, key, in any number.
    """
    ends = held.groupBy("scope", "key", "level").agg(F.min("message_id").alias("first"), F.max("message_id").alias("last"))
    ends = ends.groupBy("scope", "key").agg(F.sort_array(F.collect_list(F.struct("level", "first", "last")), asc=False).alias("ends"))
    fit = F.get(F.filter("ends", lambda e: (e["level"] < F.col("level")) & (e["first"] < F.col("message_id"))), 0)
    met = written(quoted.join(ends, ["scope", "key"]).withColumn("e", fit).filter("e is not null")
                  .select("scope", "message_id", "level", "key", "n", F.col("e.level").alias("at"), F.col("e.first").alias("first"), F.col("e.last").alias("last")), "met")
    found = met.filter("last < message_id").select("scope", "message_id", "level", "key", "n", F.col("last").alias("origin"), (F.col("first") == F.col("last")).alias("only"))
    between = met.filter("last >= message_id")
    if between.isEmpty():
        return found
    at = latest(between.select("scope", "key", "at", "message_id").distinct(), held.withColumnRenamed("level", "at"))
    return found.unionByName(between.join(at, ["scope", "key", "at", "message_id"])
                             .select("scope", "message_id", "level", "key", "n", "origin", F.lit(False).alias("only")))


def latest(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """``wanted`` (scope, key, at, message_id) with ``origin``, the latest earlier message of ``held`` (same columns); each has one."""
    group = ["scope", "key", "at"]
    both = (held.select(*group, "message_id").distinct().join(wanted.select(*group).distinct(), group, "left_semi").withColumn("held", F.lit(1))
            .unionByName(wanted.withColumn("held", F.lit(0))))
    ranged = written(both.repartitionByRange(*group, "message_id").withColumn("part", F.spark_partition_id()), "ranged")
    # the last holder so far, in this range and, one row a range, in those before
    holder = F.max(F.when(F.col("held") == 1, F.struct(*group, "message_id")))
    start = Window.unboundedPreceding
    here = ranged.withColumn("here", holder.over(Window.partitionBy("part").orderBy(*group, "message_id", "held").rowsBetween(start, 0)))
    before = ranged.groupBy("part").agg(holder.alias("x")).select("part", F.max("x").over(Window.orderBy("part").rowsBetween(start, -1)).alias("before"))
    return (here.filter("held = 0").join(F.broadcast(before), "part")
            .select(*group, "message_id", F.coalesce("here", "before")["message_id"].alias("origin")))


def linked(messages: DataFrame) -> DataFrame:
    """``scope``, ``message_id``, ``parent``, ``root``, ``depth``, ``n_quoted``, ``own`` for every message.

    ``messages`` has ``scope`` (any type), ``message_id`` (ordered as sent)
    and ``text``.
    """
    # scopes as text that tells null from every value
    plain = messages.select(F.coalesce(F.concat(F.lit("="), F.col("scope").cast("string")), F.lit("")).alias("scope"), F.col("message_id").cast("long").alias("message_id"), "text")
    each = written(passages(lines(plain)).filter(F.size("keys") > 0), "passages")
    place = ["scope", "message_id", "level"]
    whole = each.select(*place, F.col("hash").alias("key"), F.size("keys").alias("n"))
    found = written(origins(whole.filter("level > 0").groupBy(*place, "key").agg(F.sum("n").alias("n")), whole.drop("n")), "found")
    votes = found.select(*place, "origin", "n", F.col("n").alias("sure"))
    rest = written(each.filter("level > 0").join(found.select(*place, F.col("key").alias("hash")), [*place, "hash"], "left_anti")
                   .select(*place, F.explode("keys").alias("key")).groupBy(*place, "key").agg(F.count(F.lit(1)).alias("n")), "rest")
    if not rest.isEmpty():
        held = each.select(*place, F.explode("keys").alias("key")).join(rest.select("scope", "key").distinct(), ["scope", "key"], "left_semi")
        votes = votes.unionByName(origins(rest, held).select(*place, "origin", "n", F.when(F.col("only"), F.col("n")).otherwise(0).alias("sure")))
    parents = votes.groupBy(*place, "origin").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure")).groupBy("scope", "message_id").agg(
        F.max_by("origin", F.struct(-F.col("level"), "sure", "n", "origin")).alias("parent"))
    links = written(parents, "parents")
    # pointer doubling: where each message's pointer leads, and over how many
    # replies; a pointer that has reached a root is settled and not joined again
    top = links.select("scope", F.col("parent").alias("to")).distinct().join(links.select("scope", F.col("message_id").alias("to")), ["scope", "to"], "left_anti")
    open_ = written(links.select("scope", "message_id", F.col("parent").alias("to"), F.lit(1).alias("depth"))
                    .join(top.withColumn("settled", F.lit(True)), ["scope", "to"], "left"), "pointers")
    settled = [open_.filter("settled").drop("settled")]
    open_ = open_.filter("settled is null").drop("settled")
    known = links.select("scope", "message_id", F.col("parent").alias("to"), F.lit(1).alias("depth"))
    while not open_.isEmpty():
        onward = known.select("scope", F.col("message_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        step = written(open_.join(onward, ["scope", "to"]).select("scope", "message_id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
                       .join(top.withColumn("settled", F.lit(True)), ["scope", "to"], "left"), "pointers")
        settled.append(step.filter("settled").drop("settled"))
        open_ = step.filter("settled is null").drop("settled")
        known = step.drop("settled").unionByName(reduce(DataFrame.unionByName, settled[:-1]))
    at = reduce(DataFrame.unionByName, settled)
    own = plain.select("scope", "message_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: ~x.rlike(_MARKS)).alias("own"),
                       F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(_MARKS))).alias("n_quoted"))
    return (own.join(links, ["scope", "message_id"], "left").join(at.select("scope", "message_id", F.col("to").alias("root"), "depth"), ["scope", "message_id"], "left")
            .select(F.when(F.col("scope") != "", F.substring("scope", 2, 2**31 - 1)).cast(messages.schema["scope"].dataType).alias("scope"),
                    "message_id", "parent", F.coalesce("root", "message_id").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
                    F.col("n_quoted").cast("long").alias("n_quoted"), F.btrim(F.array_join("own", "\n"), F.lit("\n")).alias("own")))


def conversations(messages: DataFrame) -> DataFrame:
    """Conversations to read: ``linked`` messages without quotes, replies after what they answer.

    One row a message, in the order of scope, conversation (its root), depth and
    message; sorted in ranges, so a conversation of any length is no one row or task.
    """
    found = linked(messages)
    return found.select("scope", F.col("root").alias("conversation"), "depth", "message_id", F.col("parent").alias("answers"), F.col("own").alias("text")).orderBy(
        "scope", "conversation", "depth", "message_id")


def quoting(conversations: DataFrame) -> DataFrame:
    """Mail-like messages made from a table of conversations.

    Each turn quotes the turn before it, which quotes the one before that:
    two levels, as mail programs write them.
    """
    plain = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    before = plain.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    back = lambda n, c: before.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(c))
    mark = lambda c, m: F.concat(F.lit(m), F.replace(c, F.lit("\n"), F.lit("\n" + m)), F.lit("\n"))
    return plain.join(back(1, "one"), ["conv_id", "turn"], "left").join(back(2, "two"), ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("scope"), F.col("turn").alias("message_id"),
        F.concat(F.coalesce(mark(F.col("two"), "> > "), F.lit("")), F.coalesce(mark(F.col("one"), "> "), F.lit("")), F.col("text")).alias("text"))
