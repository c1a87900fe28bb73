"""Command logs on golden records against a model that carries them out one after the other."""

import datetime as dt
import random

import pytest

from tillwright.operators.mdm import commands
from tillwright.operators.mdm.commands import apply_commands, refresh_goldens, resolve_redirects
from tillwright.operators.mdm.ingest import merge_goldens
from tillwright.operators.mdm.merge import merge_golden

T0 = dt.datetime(2024, 1, 1)
RULES = {"person": {"defaultStrategy": "mostRecent"}}
SOURCE = ("id string, entityType string, sourceSystem string, sourceId string, data struct<name:string>, confidence double, "
          "sourceUpdatedAt timestamp, ingestedAt timestamp, goldenRecordId string, matchScore double")
COMMAND = "seq long, kind string, sourceRecordId string, goldenRecordId string, otherId string"


def sources(spark, links, kind="person"):
    """``links``: source id -> golden id; names follow the ids, later ids are more recent."""
    rows = [(s, kind, "crm", s, (f"name of {s}",), 1.0, T0 + dt.timedelta(hours=i), T0, g, None if g is None else 0.8) for i, (s, g) in enumerate(sorted(links.items()))]
    return spark.createDataFrame(rows, SOURCE)


def goldens(spark, ids, kinds=None):
    rows = [(g, (kinds or {}).get(g, "person"), (f"old {g}",)) for g in ids]
    frame = spark.createDataFrame(rows, "id string, entityType string, data struct<name:string>")
    base = merge_golden(sources(spark, {"x": "none"}), RULES["person"], batch_ts=T0).limit(0)
    return base.unionByName(frame, allowMissingColumns=True)


def model(links, ids, commands, kinds=None):
    """links, golden ids, merged-again ids and verdicts, one command after the other."""
    links, alive, again, verdicts, kinds = dict(links), set(ids), set(), {}, kinds or {}
    scores = {}
    for seq, kind, s, g, o in sorted(commands):
        members = lambda x: [k for k, v in links.items() if v == x]
        ok = False
        if kind == "link" and s in links and g in alive:
            links[s], scores[s], ok = g, 1.0, True
            again.add(g)
        elif kind == "unlink" and links.get(s):
            was, links[s], scores[s], ok = links[s], None, None, True
            if was in alive:
                if members(was):
                    again.add(was)
                else:
                    alive.discard(was)
        elif kind == "merge" and g in alive and o in alive and g != o and kinds.get(g) == kinds.get(o) and members(g) + members(o):
            for k in members(o):
                links[k] = g
            alive.discard(o)
            again.add(g)
            ok = True
        elif kind == "refresh" and g in alive and members(g):
            again.add(g)
            ok = True
        verdicts[seq] = ok
    return links, alive, again & alive, verdicts, scores


def compare(spark, links, ids, commands, kinds=None):
    want_links, alive, again, verdicts, scores = model(links, ids, commands, kinds)
    got = apply_commands(sources(spark, links), goldens(spark, ids, kinds), spark.createDataFrame(commands, COMMAND), RULES, T0)
    found = {r["id"]: (r["goldenRecordId"], r["matchScore"]) for r in got.sources.collect()}
    assert {r["seq"]: r["ok"] for r in got.log.collect()} == verdicts
    assert {k: v[0] for k, v in found.items()} == want_links
    for k, v in want_links.items():
        assert found[k][1] == scores.get(k, 0.8 if links[k] is not None else None)
    names = {r["id"]: r["data"]["name"] for r in got.goldens.collect()}
    assert set(names) == alive
    for g in alive:
        members = [k for k, v in want_links.items() if v == g]
        # of golden records merged again those with members at the end have the most recent name
        assert names[g] == (f"name of {max(members)}" if g in again and members else f"old {g}")


@pytest.mark.parametrize("seed", range(6))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    ids = [f"g{i}" for i in range(rng.choice([3, 6, 12]))]
    links = {f"s{i:02d}": rng.choice([*ids, None, None]) for i in range(rng.choice([6, 15]))}
    everyone, records = [*links, "nobody"], [*ids, "nothing"]
    commands = []
    for seq in range(1, rng.choice([15, 45])):
        kind = rng.choices(["link", "unlink", "merge", "refresh", "other"], [4, 5, 4, 1, 0.3])[0]
        commands.append((seq * 3, kind, rng.choice(everyone), rng.choice(records), rng.choice(records)))
    rng.shuffle(commands)
    compare(spark, links, ids, commands, {g: "person" for g in ids})


def test_chains_and_refusals(spark):
    """A merge is refused because its record was merged before, and allows a later one."""
    links = {f"s{i}": f"g{i}" for i in range(6)}
    ids = [f"g{i}" for i in range(6)]
    log = [(1, "merge", None, "g1", "g0"), (2, "merge", None, "g2", "g1"),    # g0 -> g1 -> g2
           (3, "merge", None, "g0", "g3"),                                    # refused: g0 is gone
           (4, "merge", None, "g3", "g2"), (5, "link", "s4", "g1", None),     # refused: g1 is gone
           (6, "unlink", "s4", None, None),                                   # g4 is empty: deleted
           (7, "link", "s0", "g4", None), (8, "merge", None, "g4", "g3"),     # both refused
           (9, "merge", None, "g5", "g3"), (10, "merge", None, "g3", "g5"),   # the second refused
           (11, "unlink", "s0", None, None), (12, "unlink", "s0", None, None), (13, "refresh", None, "g5", None), (14, "refresh", None, "g4", None)]
    compare(spark, links, ids, log, {g: "person" for g in ids})


def test_a_chain_of_a_thousand_merges(spark):
    n = 1000
    links = {f"s{i:04d}": f"g{i:04d}" for i in range(n)}
    log = [(i + 1, "merge", None, f"g{i + 1:04d}", f"g{i:04d}") for i in range(n - 1)]
    got = apply_commands(sources(spark, links), goldens(spark, sorted(links.values())), spark.createDataFrame(log, COMMAND), RULES, T0)
    assert {r["goldenRecordId"] for r in got.sources.select("goldenRecordId").distinct().collect()} == {f"g{n - 1:04d}"}
    only = got.goldens.collect()
    assert [(r["id"], r["data"]["name"]) for r in only] == [(f"g{n - 1:04d}", f"name of s{n - 1:04d}")]


def test_refusals_that_follow_from_each_other_need_one_history(spark, monkeypatch):
    """Every second merge is refused because the one before it was not: no further history for that; one for an emptied record."""
    n, calls, history = 12, [], commands._history
    monkeypatch.setattr(commands, "_history", lambda *a: calls.append(1) or history(*a))
    ids = [f"g{i:02d}" for i in range(n + 1)]
    links = {f"s{i:02d}": g for i, g in enumerate(ids)}
    log = [(2 * (n - i), "merge", None, ids[i + 1], ids[i]) for i in range(n)]
    compare(spark, links, ids, log, dict.fromkeys(ids, "person"))
    assert len(calls) == 1
    calls.clear()
    compare(spark, links, ids, [(1, "unlink", f"s{n:02d}", None, None), *log], dict.fromkeys(ids, "person"))
    assert len(calls) == 2


def test_many_commands_for_one_key(spark, monkeypatch):
    """Stretches of a busy key add up."""
    monkeypatch.setattr("tillwright.operators.mdm.commands.STRETCH", 8)
    rng = random.Random(1)
    links = {f"s{i}": "g0" if i < 2 else None for i in range(4)}
    log = [(i + 1, rng.choice(["link", "unlink"]), rng.choice(["s0", "s0", "s1", "s2"]), rng.choice(["g0", "g0", "g1"]), None) for i in range(60)]
    compare(spark, links, ["g0", "g1"], log, {"g0": "person", "g1": "person"})


def test_types_rules_and_reasons(spark):
    kinds = {"a": "person", "b": "company", "c": "person"}
    log = [(1, "merge", None, "a", "b"), (2, "merge", None, "a", "a"), (3, "link", "s9", "a", None), (4, "link", "s1", "z", None),
           (5, "drop", "s1", "a", None), (6, "unlink", "s2", None, None), (7, "refresh", None, "c", None), (8, "refresh", None, "b", None)]
    got = apply_commands(sources(spark, {"s1": "a", "s2": None, "s3": "b"}), goldens(spark, "abc", kinds), spark.createDataFrame(log, COMMAND), RULES, T0)
    assert [r["reason"] for r in sorted(got.log.collect())] == [
        "different entity types", "a golden record and itself", "unknown source record", "unknown golden record", "unknown command",
        "not linked", "no source records", "no survivorship rules"]
    assert got.log.where("ok").count() == 0


def test_empty_log(spark):
    got = apply_commands(sources(spark, {"s1": "a"}), goldens(spark, "a"), spark.createDataFrame([], COMMAND), RULES, T0)
    assert [(r["id"], r["goldenRecordId"]) for r in got.sources.collect()] == [("s1", "a")]
    assert [(r["id"], r["data"]["name"]) for r in got.goldens.collect()] == [("a", "old a")]


def test_redirects(spark):
    """Chains end at their last record; what leads into a cycle is refused."""
    mapping = [("g1", "g2"), ("g2", "g3"), ("x", "y"), ("y", "x"), ("w", "x"), ("self", "self"), (None, "g1"), ("g9", None)]
    mapping += [(f"c{i}", f"c{i + 1}") for i in range(1000)]
    ends, looped = resolve_redirects(spark.createDataFrame(mapping, "fromId string, toId string"))
    found = {r["fromId"]: r["toId"] for r in ends.collect()}
    assert found["g1"] == found["g2"] == "g3" and {found[f"c{i}"] for i in range(1000)} == {"c1000"} and len(found) == 1002
    assert {r["fromId"] for r in looped.collect()} == {"x", "y", "w", "self"}
    members = sources(spark, {"s1": "g1", "s2": "g2", "s3": "g3", "s4": "x", "s5": None})
    moved = {r["id"]: r["goldenRecordId"] for r in merge_goldens(members, spark.createDataFrame(mapping, "fromId string, toId string")).collect()}
    assert moved == {"s1": "g3", "s2": "g3", "s3": "g3", "s4": "x", "s5": None}


def test_refresh(spark):
    links = {"s1": "a", "s2": "a", "s3": "b"}
    got = refresh_goldens(sources(spark, links), goldens(spark, "abc"), RULES, T0)
    assert {r["id"]: r["data"]["name"] for r in got.collect()} == {"a": "name of s2", "b": "name of s3"}
