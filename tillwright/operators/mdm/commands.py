"""An ordered log of golden-record commands, applied as a batch.

``link``, ``unlink``, ``merge`` and ``refresh`` change golden records one
after the other, and a command may be refused because of an earlier one (its
golden record is gone by then).  The log is not replayed row by row: every
command gets a guess (carried out or refused), the history that follows from
the guesses is built with joins, and each command is judged again in it.  A
command's verdict hangs on earlier commands only, so guesses that stay the same
are the one sequential history.

Refusals that follow from merges alone are settled before a history is built:
a merge is decided as soon as no undecided earlier one could delete either of
its records, and only the undecided ones go on to the next pass.  A further
history is needed only where it deletes records that a last unlink emptied, or
refuses commands for want of members, and others hang on that.

The history of a round:

* merges carried out are edges from a golden record to the one it went into.
  Their times rise along a chain, so they form trees; ``2**k`` steps up are one
  join of two tables of ``2**(k-1)`` steps (pointer doubling), which gives the
  record that an id stands for at any time, and sums over subtrees;
* a source's own links and unlinks cut its life into stretches, each in one
  tree; where a stretch ends is looked up by the doubled pointers;
* per golden record, arrivals and departures in order of time are a running
  count.  An unlink that brings it to zero deletes the record.

Keys that hold a large share of the log are cut into stretches of ``STRETCH``
commands, summed before they meet.  Every step is a join, a grouped aggregate
or a window over such a stretch; rounds cut lineage with written tables.

Rules (per command, in order of ``seq``, which must be unique):

* ``link(sourceRecordId, goldenRecordId)``: both exist; the source moves, with
  score 1.0, and the golden record is merged again.  The record it left stays
  as it was, without being merged again;
* ``unlink(sourceRecordId)``: the source has a golden record; it leaves, and the
  record is merged again, or deleted if it was the last member;
* ``merge(goldenRecordId, otherId)``: two records of one entity type, with a
  member between them; the members of the other move, the other is deleted, the
  first is merged again.  Merging a record into itself is refused;
* ``refresh(goldenRecordId)``: it has a member; it is merged again.

An entity type without survivorship rules refuses all but ``unlink``, which then
only cuts the link.  Records are merged again once, with the members and manual
values they have at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...session import checkpoint_dir, written
from .merge import merge_golden

STRETCH = 1 << 16
START = -(1 << 62)  # before every command
KINDS = ("link", "unlink", "merge", "refresh")


def stored(df: DataFrame) -> DataFrame:
    return written(df, "commands")


def doubled(edges: DataFrame, rounds: int | None = None) -> list[DataFrame]:
    """Tables ``(node, to, t)`` of 1, 2, 4, ... steps along ``edges``; ``t`` is that of the last step.

    Stops when no node has as many steps; ``rounds`` bounds it for graphs that may have cycles.
    """
    out = [stored(edges.select("node", "to", "t"))]
    while (rounds is None or len(out) <= rounds) and not out[-1].isEmpty():
        up = out[-1].select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("t").alias("_t"))
        out.append(stored(out[-1].drop("t").join(up, "to").select("node", F.col("_to").alias("to"), F.col("_t").alias("t"))))
    return out


def lifted(rows: DataFrame, at: str, steps: list[DataFrame], until: str | None = None) -> DataFrame:
    """``rows`` with ``at`` moved up along all steps (those earlier than the column ``until``)."""
    for table in reversed(steps):
        up = table.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("t").alias("_t"))
        on = F.col(at) == F.col("_n")
        rows = rows.join(up, on & (F.col("_t") < F.col(until)) if until else on, "left").withColumn(at, F.coalesce("_to", at)).drop("_n", "_to", "_t")
    return rows


def resolve_redirects(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The end of every chain of ``mapping(fromId, toId)``, and the ids that lead into a cycle.

    Of rows that repeat a ``fromId`` the smallest ``toId`` counts; an id that maps to itself is a cycle.
    """
    checkpoint_dir(mapping.sparkSession)
    edges = stored(mapping.where(F.col("fromId").isNotNull() & F.col("toId").isNotNull()).groupBy(F.col("fromId").alias("node"))
                   .agg(F.min("toId").alias("to")).withColumn("t", F.lit(0).cast("long")))
    n = edges.count()
    steps = doubled(edges, max(1, n).bit_length())
    # as many steps as there are edges, and still a step to go: the chain has no end
    looped = stored(steps[-1].select("node").distinct()) if len(steps) > max(1, n).bit_length() else edges.select("node").limit(0)
    ends = lifted(edges.join(looped, "node", "left_anti").select("node", "to"), "to", [t.join(looped, "node", "left_anti") for t in steps])
    return ends.select(F.col("node").alias("fromId"), F.col("to").alias("toId")), looped.select(F.col("node").alias("fromId"))


def _stretch(seq: str) -> Column:
    return F.floor(F.col(seq) / STRETCH).alias("_b")


def _running(events: DataFrame) -> DataFrame:
    """``events(g, t, delta, ...)``, one row a (g, t), with ``total`` up to and with each; read twice, so a stored table."""
    cut = events.withColumn("_b", _stretch("t"))
    parts = cut.groupBy("g", "_b").agg(F.sum("delta").alias("_s"))
    before = parts.select("g", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("delta").over(Window.partitionBy("g", "_b").orderBy("t"))
    return cut.withColumn("_in", inside).join(before, ["g", "_b"]).withColumn("total", F.col("_in") + F.col("_before")).drop("_in", "_before", "_b")


def _lives(own: DataFrame) -> DataFrame:
    """``own(s, t, ok, to)`` with ``had`` (whether the source has a record just before) and ``until`` (the next own change); read twice."""
    sets = F.when(F.col("ok"), F.col("to").isNotNull())
    changed = F.when(F.col("ok"), F.col("t"))
    cut = own.withColumn("_b", _stretch("t")).withColumn("_set", sets).withColumn("_at", changed)
    parts = cut.groupBy("s", "_b").agg(F.max_by("_set", "_at").alias("_last"), F.min("_at").alias("_first"))
    each = Window.partitionBy("s").orderBy("_b")
    parts = parts.select("s", "_b", F.last("_last", ignorenulls=True).over(each.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
                         F.min("_first").over(each.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    inside = Window.partitionBy("s", "_b").orderBy("t")
    return (cut.withColumn("_near", F.last("_set", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_next", F.min("_at").over(inside.rowsBetween(1, Window.unboundedFollowing)))
            .join(parts, ["s", "_b"]).withColumn("had", F.coalesce("_near", "_earlier", F.lit(False))).withColumn("until", F.coalesce("_next", "_later"))
            .select("s", "t", "ok", "to", "had", "until"))


@dataclass
class CommandResult:
    sources: DataFrame   # all source records with their links as they are after the log
    goldens: DataFrame   # golden records that are left, merged again where a command asked for it
    log: DataFrame       # seq, kind, ok, reason


@dataclass
class _History:
    steps: list[DataFrame]  # doubled merges
    lives: DataFrame        # own changes of sources
    ends: DataFrame         # s, until, g: the record a stretch ended in
    deaths: DataFrame       # g, t
    emptied: DataFrame      # g, t: deleted with its last member
    counts: DataFrame       # g, t, total, delta


def _settled_merges(merges: DataFrame, emptied: DataFrame) -> DataFrame:
    """``seq, other, ok`` of ``merges(seq, golden, other)``: refused if an earlier one, or ``emptied(g, t)``, deletes one of its records."""
    none = F.lit(None).cast("long")
    left, kills, done = stored(merges.select("seq", "golden", "other")), emptied.select("g", "t"), []
    while True:
        # per record, the first merge still open that may delete it, and the first deletion decided in the last pass
        near = (left.select(F.col("other").alias("g"), F.col("seq").alias("p"), none.alias("k"))
                .unionByName(kills.select("g", none.alias("p"), F.col("t").alias("k")))
                .groupBy("g").agg(F.min("p").alias("p"), F.min("k").alias("k")))
        out = left
        for side in ("golden", "other"):
            out = out.join(near.select(F.col("g").alias(side), F.col("p").alias(f"{side}_p"), F.col("k").alias(f"{side}_k")), side, "left")
        before = lambda x: F.coalesce(F.least(f"golden_{x}", f"other_{x}") < F.col("seq"), F.lit(False))
        out = stored(out.select("seq", "golden", "other", F.when(before("k"), False).when(~before("p"), True).alias("ok")))
        done.append(out.where("ok is not null").select("seq", "other", "ok"))
        if len(done) > 16:
            done = [stored(reduce(DataFrame.unionByName, done))]
        left, kills = out.where("ok is null").drop("ok"), out.where("ok").select(F.col("other").alias("g"), F.col("seq").alias("t"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _guessed(cmds: DataFrame, emptied: DataFrame, refused: DataFrame) -> DataFrame:
    """``cmds`` with ``ok``, from what merges and ``emptied`` delete; ``refused(seq)`` are out."""
    named = cmds.join(refused.withColumn("_out", F.lit(True)), "seq", "left").withColumn("_in", F.col("static").isNull() & F.col("_out").isNull()).drop("_out")
    settled = stored(_settled_merges(named.where("_in and kind = 'merge'"), emptied))
    dead = settled.where("ok").select(F.col("other").alias("g"), F.col("seq").alias("t")).unionByName(emptied).groupBy(F.col("g").alias("golden")).agg(F.min("t").alias("_t"))
    other = named.where("kind <> 'merge' or kind is null").join(dead, "golden", "left")
    other = other.withColumn("ok", F.col("_in") & ((F.col("kind") == "unlink") | F.col("_t").isNull() | (F.col("_t") > F.col("seq"))))
    merges = named.where("kind = 'merge'").join(settled.select("seq", "ok"), "seq", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    columns = [*cmds.columns, "ok"]
    return merges.select(*columns).unionByName(other.select(*columns))


def _history(cmds: DataFrame, emptied: DataFrame, own: DataFrame, at_start: DataFrame) -> _History:
    """The history of ``cmds`` with guesses ``ok``."""
    done, ok = cmds, cmds.select("seq", "ok")
    first = done.where("ok and kind = 'merge'").groupBy(F.col("other").alias("node")).agg(F.min_by("golden", "seq").alias("to"), F.min("seq").alias("t"))
    gone = emptied.select(F.col("g").alias("_g"), F.col("t").alias("_e"))
    deaths = first.select(F.col("node").alias("g"), "t").unionByName(emptied).groupBy("g").agg(F.min("t").alias("t"))
    there = deaths.select(F.col("g").alias("to"), F.col("t").alias("_d"))
    edges = (first.join(gone, F.col("node") == F.col("_g"), "left").where("_e is null or _e > t").join(there, "to", "left").where("_d is null or _d > t"))
    steps = doubled(edges)
    deaths = stored(steps[0].select(F.col("node").alias("g"), "t").unionByName(emptied).groupBy("g").agg(F.min("t").alias("t")))
    lives = stored(_lives(stored(own.join(ok.withColumnRenamed("seq", "t"), "t", "left").select("s", "t", F.coalesce("ok", F.lit(True)).alias("ok"), "to"))))
    stretches = lives.where("ok and to is not null")
    ends = stored(lifted(stretches.where("until is not null").select("s", "until", F.col("to").alias("g")), "g", steps, "until"))
    unlinked = cmds.where("kind = 'unlink'").select(F.col("seq").alias("until"), F.lit(1).alias("u"))
    moves = (at_start.select("g", F.lit(START).alias("t"), F.col("n").alias("delta"), F.lit(0).alias("u"))
             .unionByName(stretches.where(F.col("t") > START).select(F.col("to").alias("g"), "t", F.lit(1).cast("long").alias("delta"), F.lit(0).alias("u")))
             .unionByName(ends.join(unlinked, "until", "left").select("g", F.col("until").alias("t"), F.lit(-1).cast("long").alias("delta"), F.coalesce("u", F.lit(0)).alias("u"))))
    moves = stored(moves.groupBy("g", "t").agg(F.sum("delta").alias("delta"), F.max("u").alias("u")))
    # members that a record brings along when it goes into another: all its subtree
    total = stored(moves.groupBy(F.col("g").alias("node")).agg(F.sum("delta").alias("n")))
    for table in steps:
        below = table.join(total, "node").select(F.col("to").alias("node"), "n")
        total = stored(total.unionByName(below).groupBy("node").agg(F.sum("n").alias("n")))
    brought = steps[0].join(total, "node", "left").select(F.col("to").alias("g"), "t", F.coalesce("n", F.lit(0)).alias("delta"), F.lit(0).alias("u"))
    asked = cmds.where("kind in ('merge', 'refresh')")
    asked = asked.select("seq", F.explode(F.array("golden", "other")).alias("g")).where("g is not null").select("g", F.col("seq").alias("t"), F.lit(0).cast("long").alias("delta"), F.lit(0).alias("u"))
    events = reduce(DataFrame.unionByName, (moves, brought, asked)).groupBy("g", "t").agg(F.sum("delta").alias("delta"), F.max("u").alias("u"))
    counts = stored(_running(stored(events)))
    empty = stored(counts.where("u = 1 and total = 0").groupBy("g").agg(F.min("t").alias("t")))
    return _History(steps, lives, ends, deaths, empty, counts)


def _judged(cmds: DataFrame, past: _History) -> DataFrame:
    """``seq``, ``ok``, ``reason`` of every command in the history ``past``, and its ``guess``."""
    out = cmds.withColumnRenamed("ok", "guess")
    for side in ("golden", "other"):
        dead = past.deaths.select(F.col("g").alias(side), F.col("t").alias(f"{side}_end"))
        held = past.counts.select(F.col("g").alias(side), F.col("t").alias("seq"), (F.col("total") - F.col("delta")).alias(f"{side}_n"))
        out = out.join(dead, side, "left").join(held, [side, "seq"], "left")
    had = past.lives.where(F.col("t") > START).select(F.col("t").alias("seq"), "had")
    out = out.join(had, "seq", "left")
    gone = lambda side: F.coalesce(F.col(f"{side}_end") < F.col("seq"), F.lit(False))
    n = F.coalesce("golden_n", F.lit(0)) + F.when(F.col("kind") == "merge", F.coalesce("other_n", F.lit(0))).otherwise(0)
    why = (F.when(F.col("static").isNotNull(), F.col("static"))
           .when((F.col("kind") == "unlink") & ~F.coalesce("had", F.lit(False)), "not linked")
           .when((F.col("kind") != "unlink") & gone("golden"), "golden record is gone")
           .when((F.col("kind") == "merge") & gone("other"), "golden record is gone")
           .when(F.col("kind").isin("merge", "refresh") & (n <= 0), "no source records"))
    return out.select("seq", why.isNull().alias("ok"), why.alias("reason"), "guess")


def apply_commands(sources: DataFrame, goldens: DataFrame, commands: DataFrame, survivorship: dict[str, dict],
                   batch_ts=None) -> CommandResult:
    """Apply ``commands(seq, kind, sourceRecordId, goldenRecordId, otherId)``; ``survivorship`` has a config an entity type."""
    checkpoint_dir(sources.sparkSession)
    types = F.array(*map(F.lit, survivorship)) if survivorship else F.array().cast("array<string>")
    src = sources.select(F.col("id").alias("source"), F.col("entityType").alias("s_type"))
    typed = stored(goldens.select("id", "entityType"))
    gold = typed.select(F.col("id").alias("golden"), F.col("entityType").alias("g_type"))
    rest = gold.select(F.col("golden").alias("other"), F.col("g_type").alias("o_type"))
    cmds = commands.select(F.col("seq").cast("long").alias("seq"), "kind", F.when(F.col("kind").isin("link", "unlink"), F.col("sourceRecordId")).alias("source"),
                           F.when(F.col("kind") != "unlink", F.col("goldenRecordId")).alias("golden"), F.when(F.col("kind") == "merge", F.col("otherId")).alias("other"))
    cmds = cmds.join(src, "source", "left").join(gold, "golden", "left").join(rest, "other", "left")
    kind = F.col("kind")
    by_source = kind.isin("link", "unlink")
    static = (F.when(~kind.isin(*KINDS) | kind.isNull(), "unknown command")
              .when(by_source & F.col("s_type").isNull(), "unknown source record")
              .when((kind != "unlink") & F.col("g_type").isNull(), "unknown golden record")
              .when((kind == "merge") & F.col("o_type").isNull(), "unknown golden record")
              .when((kind == "merge") & (F.col("golden") == F.col("other")), "a golden record and itself")
              .when((kind == "merge") & (F.col("g_type") != F.col("o_type")), "different entity types")
              .when((kind == "link") & ~F.array_contains(types, F.col("s_type")), "no survivorship rules")
              .when(kind.isin("merge", "refresh") & ~F.array_contains(types, F.col("g_type")), "no survivorship rules"))
    cmds = stored(cmds.withColumn("static", static))

    linked = F.when(F.col("goldenRecordId") != "", F.col("goldenRecordId"))
    at_start = stored(sources.select(linked.alias("g")).where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    named = cmds.where(by_source & F.col("static").isNull())
    first = sources.join(named.select(F.col("source").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("s"), F.lit(START).alias("t"), linked.alias("to"))
    own = stored(first.unionByName(named.select(F.col("source").alias("s"), F.col("seq").alias("t"), F.when(kind == "link", F.col("golden")).alias("to"))))

    empty_type = goldens.schema["id"].dataType
    emptied = stored(cmds.select(F.lit(None).cast(empty_type).alias("g"), F.col("seq").alias("t")).limit(0))
    refused = emptied.select(F.col("t").alias("seq"))
    # a record of an entity type without rules is never deleted
    ruled = typed.where(F.array_contains(types, F.col("entityType"))).select(F.col("id").alias("g"))
    while True:
        guessed = stored(_guessed(cmds, emptied, refused))
        past = _history(guessed, emptied, own, at_start)
        verdict = stored(_judged(guessed, past))
        now = stored(past.emptied.join(ruled, "g", "left_semi"))
        changed = verdict.where("ok <> guess").select("seq").limit(1).unionAll(
            now.exceptAll(emptied).unionAll(emptied.exceptAll(now)).select(F.col("t").alias("seq")).limit(1))
        if changed.isEmpty():
            break
        emptied, refused = now, verdict.where("reason in ('not linked', 'no source records')").select("seq")

    # where every source is at the end
    last = past.lives.where("ok and until is null").select(F.col("s").alias("id"), F.col("to").alias("_to"), (F.col("t") > START).alias("_own"), F.lit(True).alias("_named"))
    roots = stored(lifted(past.steps[0].select("node", "to"), "to", past.steps).select(F.col("node").alias("_from"), F.col("to").alias("_root")))
    moved = sources.join(last, "id", "left")
    now = F.when(F.col("_named"), F.col("_to")).otherwise(linked)
    moved = moved.withColumn("_now", now).join(roots, F.col("_now") == F.col("_from"), "left").withColumn("goldenRecordId", F.coalesce("_root", "_now"))
    score = F.when(F.col("_own") & F.col("_to").isNull(), F.lit(None)).when(F.col("_own"), F.lit(1.0)).otherwise(F.col("matchScore"))
    final = moved.withColumn("matchScore", score.cast(sources.schema["matchScore"].dataType)).select(*sources.columns)

    done = guessed.where("ok")
    unlinks = done.where("kind = 'unlink'").select(F.col("source").alias("s"), F.col("seq").alias("until"))
    asked = done.where("kind <> 'unlink'").select(F.col("golden").alias("g")).unionAll(past.ends.join(unlinks, ["s", "until"]).select("g"))
    asked = stored(lifted(asked.distinct(), "g", past.steps).distinct().join(past.deaths.select("g"), "g", "left_anti"))
    left = goldens.join(past.deaths.select(F.col("g").alias("id")), "id", "left_anti")
    again = left.join(asked.select(F.col("g").alias("id")), "id", "left_semi")
    held = final.select(F.col("goldenRecordId").alias("id")).distinct().join(again.where(F.array_contains(types, F.col("entityType"))).select("id"), "id", "left_semi")
    out = left
    if survivorship:
        new = refresh_goldens(final, again, survivorship, batch_ts)
        out = left.join(held, "id", "left_anti").unionByName(new, allowMissingColumns=True)
    return CommandResult(final, out, cmds.select("seq", "kind").join(verdict.drop("guess"), "seq"))


def refresh_goldens(sources: DataFrame, goldens: DataFrame, survivorship: dict[str, dict], batch_ts=None) -> DataFrame:
    """The given golden records merged again from their members; records without members, or of a type without rules, drop out."""
    ids = goldens.select(F.col("id").alias("goldenRecordId"), F.col("entityType").alias("_type"))
    members = sources.join(ids, "goldenRecordId").drop("_type")
    typed = [merge_golden(members.join(ids.where(F.col("_type") == t).drop("_type"), "goldenRecordId", "left_semi").select(*sources.columns), config, existing=goldens, batch_ts=batch_ts)
             for t, config in survivorship.items()]
    return reduce(lambda a, b: a.unionByName(b), typed)
