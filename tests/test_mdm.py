"""Entity resolution: score functions on the original's literal cases,
survivorship strategies, lossless blocking and batch ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwright.functions.values import TypedCol
from tillwright.operators.mdm.ingest import connected_components, ingest_batch
from tillwright.operators.mdm.match import MatchConfigError, candidate_pairs, find_matches, necessary_rules
from tillwright.operators.mdm.merge import merge_golden
from tillwright.operators.mdm.scores import levenshtein_similarity, rule_score, soundex
from tillwright.session import written


def test_levenshtein_and_soundex(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("saturday", "sunday"), ("Hello", "hello"),
                                ("hello", "hallo"), ("", "")], "a string, b string")
    got = [(r["d"], r["s"]) for r in df.select(F.levenshtein("a", "b").alias("d"),
                                               levenshtein_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert [d for d, _ in got] == [3, 3, 1, 1, 0]
    assert got[3][1] == pytest.approx(0.8) and got[4][1] == 1.0
    names = ["", "a", "Robert", "Rupert", "Smith", "Smyth", "O'Brien", "Tymczak"]
    codes = spark.createDataFrame([(n,) for n in names], "n string").select(soundex(F.col("n")).alias("c")).collect()
    assert [c["c"] for c in codes] == ["0000", "A000", "R163", "R163", "S530", "S530", "O165", "T520"]


def _score(spark, a, b, rule, schema="a string, b string"):
    df = spark.createDataFrame([(a, b)], schema)
    ta = TypedCol(F.col("a"), df.schema["a"].dataType)
    tb = TypedCol(F.col("b"), df.schema["b"].dataType)
    return df.select(rule_score(ta, tb, rule).alias("s")).first()["s"]


def test_rule_scores(spark):
    assert _score(spark, None, None, {"type": "exact"}) == 1.0
    assert _score(spark, None, "x", {"type": "exact"}) == 0.0
    assert _score(spark, "ABC", "abc", {"type": "exactCaseInsensitive"}) == 1.0
    assert _score(spark, "  a   b ", "A B", {"type": "normalized"}) == 1.0
    assert _score(spark, "hello", "hallo", {"type": "fuzzy", "options": {"maxDistance": 0}}) == 0.0
    assert _score(spark, "Smith", "Smyth", {"type": "phonetic"}) == 1.0
    assert _score(spark, "Smith", "Smart", {"type": "phonetic"}) == 0.5  # S530 vs S563: two positions agree
    assert _score(spark, 10.0, 12.0, {"type": "numeric", "options": {"numericTolerance": 3}},
                  "a double, b double") == pytest.approx(0.5)
    assert _score(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), {"type": "date", "options": {"dateTolerance": 3}},
                  "a timestamp, b timestamp") == pytest.approx(0.5)


def _records(spark, rows):
    schema = ("id string, entityType string, sourceSystem string, sourceId string, "
              "data struct<firstName:string,lastName:string,email:string,phone:string>, confidence double, "
              "sourceUpdatedAt timestamp, ingestedAt timestamp, goldenRecordId string, matchScore double")
    return spark.createDataFrame(rows, schema)


T0 = dt.datetime(2024, 2, 1)


def test_merge_strategies(spark):
    recs = _records(spark, [
        ("s1", "person", "crm", "1", ("John", "Smith", "john@crm.com", "123-456-7890"), 0.9,
         dt.datetime(2024, 1, 15), T0, "g1", 1.0),
        ("s2", "person", "erp", "2", ("Johnny", "Smith", "john@erp.com", None), 0.8, dt.datetime(2024, 1, 10), T0, "g1", 1.0),
        ("s3", "person", "manual", "3", ("Jonathan", None, "", None), 1.0, dt.datetime(2024, 1, 1), T0, "g1", 1.0),
    ])

    def win(strategy, **kw):
        cfg = {"defaultStrategy": "mostRecent", "rules": [{"field": "firstName", "strategy": strategy, **kw}]}
        return merge_golden(recs, cfg, batch_ts=T0).first()["data"]["firstName"]

    assert win("highestConfidence") == "Jonathan"
    assert win("longestValue") == "Jonathan"
    assert win("mostRecent") == "John"
    assert win("sourceRanking", sourceRanking=[]) == "John"
    assert win("sourceRanking", sourceRanking=["erp", "crm"]) == "Johnny"
    cfg = {"defaultStrategy": "mostRecent", "rules": [
        {"field": "email", "strategy": "sourceRanking", "sourceRanking": ["crm", "erp"]},
        {"field": "phone", "strategy": "longestValue"}]}
    g = merge_golden(recs, cfg, batch_ts=T0).first()
    assert g["data"]["email"] == "john@crm.com" and g["data"]["phone"] == "123-456-7890"
    assert 0 < g["confidence"] <= 1 and g["needsReview"] is False


def test_most_frequent_and_default(spark):
    recs = _records(spark, [
        ("a", "p", "x", "1", ("Ann", None, None, None), 1.0, T0, T0, "g", 1.0),
        ("b", "p", "y", "2", ("Bea", None, None, None), 1.0, T0, T0, "g", 1.0),
        ("c", "p", "z", "3", ("Bea", None, None, None), 1.0, T0, T0, "g", 1.0),
    ])
    cfg = {"defaultStrategy": "mostRecent", "rules": [{"field": "firstName", "strategy": "mostFrequent"},
                                                      {"field": "email", "strategy": "mostRecent",
                                                       "defaultValue": "none@example.com"}]}
    g = merge_golden(recs, cfg, batch_ts=T0).first()
    assert g["data"]["firstName"] == "Bea" and g["data"]["email"] == "none@example.com"


MATCH = {"threshold": 0.7, "rules": [{"field": "firstName", "type": "fuzzy", "weight": 0.3},
                                     {"field": "lastName", "type": "phonetic", "weight": 0.3},
                                     {"field": "email", "type": "exactCaseInsensitive", "weight": 0.4}]}


def test_blocking_is_lossless_and_required(spark):
    assert [r["field"] for r in necessary_rules(MATCH)] == ["email"]
    recs = _records(spark, [
        ("s1", "person", "crm", "1", ("John", "Smith", "J@X.COM", None), 1.0, T0, T0, None, None),
        ("s2", "person", "erp", "2", ("Jon", "Smyth", "j@x.com", None), 1.0, T0, T0, None, None),
        ("s3", "person", "erp", "3", ("John", "Smith", "other@x.com", None), 1.0, T0, T0, None, None),
        ("s4", "person", "erp", "4", ("Ann", "Lee", None, None), 1.0, T0, T0, None, None),
        ("s5", "person", "erp", "5", ("Ann", "Lee", None, None), 1.0, T0, T0, None, None),
    ])
    blocked = {(r["sourceRecordId"], r["matchedRecordId"]) for r in find_matches(recs, recs, MATCH, "source").collect()}
    brute = {(r["sourceRecordId"], r["matchedRecordId"])
             for r in find_matches(recs, recs, {**MATCH, "rules": MATCH["rules"]}, "source",
                                   allow_all_pairs=True).collect()}
    assert blocked == brute == {("s1", "s2"), ("s2", "s1"), ("s4", "s5"), ("s5", "s4")}
    with pytest.raises(MatchConfigError):
        candidate_pairs(recs, recs, {"threshold": 0.5, "rules": [{"field": "firstName", "type": "exact", "weight": 1},
                                                                 {"field": "lastName", "type": "exact", "weight": 1}]})


def test_connected_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("e", "f")], "a string, b string")
    got = {r["id"]: r["component"] for r in connected_components(spark, nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}


def test_ingest_batch(spark):
    golden_members = _records(spark, [
        ("s1", "person", "crm", "1", ("John", "Smith", "j@x.com", None), 0.9, T0, T0, "g1", 1.0)])
    goldens = merge_golden(golden_members, {"defaultStrategy": "mostRecent"}, batch_ts=T0)
    new = _records(spark, [
        ("s2", "person", "erp", "2", ("Jon", "Smyth", "J@X.COM", None), None, None, None, None, None),
        ("s3", "person", "erp", "3", ("Ann", "Lee", "a@x.com", None), None, None, None, None, None),
        ("s4", "person", "web", "4", ("Anne", "Lee", "A@x.com", None), None, None, None, None, None),
    ]).drop("ingestedAt")
    res = ingest_batch(spark, new, goldens, golden_members, MATCH, {"defaultStrategy": "mostRecent"}, T0)
    links = {r["id"]: r["goldenRecordId"] for r in res.sources.collect()}
    assert links["s2"] == "g1"
    assert links["s3"] == links["s4"] == "golden-s3"
    assert res.goldens.count() == 2


def test_block_report_counts_candidate_pairs(spark):
    from tillwright.operators.mdm.match import block_report

    recs = _records(spark, [
        ("a", "person", "x", "1", ("A", "B", "same@x.com", None), 1.0, T0, T0, None, None),
        ("b", "person", "x", "2", ("A", "B", "SAME@x.com", None), 1.0, T0, T0, None, None),
        ("c", "person", "x", "3", ("A", "B", "same@x.com", None), 1.0, T0, T0, None, None),
        ("d", "person", "x", "4", ("A", "B", "other@x.com", None), 1.0, T0, T0, None, None),
    ])
    largest, totals = block_report(recs, MATCH)
    t = totals.first()
    assert (t["blocks"], t["records"], t["candidate_pairs"]) == (2, 4, 6)
    assert largest.first()["records"] == 3
    pairs = candidate_pairs(recs, recs, MATCH, exclude_self=True).count()
    assert pairs == t["candidate_pairs"]


def test_active_config_selection():
    from tillwright.operators.mdm.match import active_config

    cfgs = [{"entityType": "person", "active": False, "rules": [], "threshold": 0.9},
            {"entityType": "person", "rules": [{"field": "email", "type": "exact", "weight": 1}]},
            {"entityType": "person", "rules": [], "threshold": 0.1}]
    assert active_config(cfgs, "person")["threshold"] == 0.7
    assert active_config([{"entityType": "person"}], "person", "survivorship")["defaultStrategy"] == "mostRecent"
    with pytest.raises(MatchConfigError):
        active_config(cfgs, "company")


def test_similar_values_are_those_of_all_pairs(spark):
    """Every pair in reach, for short, equal, empty and long texts and several bounds."""
    import random

    from tillwright.operators.mdm.match import similar_values

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    rng = random.Random(4)
    base = ["".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(60)]
    texts = base + ["".join(c if rng.random() > 0.12 else rng.choice(["", "x", c + "y"]) for c in t) for t in base] + ["", "a", "ab", None]
    frame = spark.createDataFrame([("g" if i % 3 else "h", t) for i, t in enumerate(texts)], "g string, v string")
    by = {}
    for i, t in enumerate(texts):
        if t is not None:
            by.setdefault("g" if i % 3 else "h", set()).add(t)
    for similarity, most in ((0.9, None), (0.7, None), (0.5, None), (0.6, 2), (0.34, 3)):
        got = {tuple(r) for r in similar_values(frame, frame, similarity, most).collect()}
        want = {(g, a, b) for g, s in by.items() for a in s for b in s
                if distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9 and (most is None or distance(a, b) <= most)}
        assert want <= got and all(distance(a, b) <= max(len(a), len(b)) for _, a, b in got), similarity
        assert len(got) <= 3 * len(want) + 10  # candidates are compared before they are given


def test_fuzzy_rule_alone_gives_candidates(spark):
    """No binary rule is needed; NULL values fall back on what the other rules still need."""
    rng = __import__("random").Random(2)
    names = ["jonathan smith", "jonathon smith", "jonathan smyth", "mary jones", "marie jones", "bob", "rob", None, None, ""]
    rows = [(f"r{i}", "person", "crm", str(i), (rng.choice(names), "Smith", rng.choice(["a@x.com", "b@x.com", None]), None), 1.0, T0, T0, None, None) for i in range(60)]
    recs = _records(spark, rows)
    config = {"threshold": 0.8, "rules": [{"field": "firstName", "type": "fuzzy", "weight": 0.6}, {"field": "email", "type": "exact", "weight": 0.3},
                                          {"field": "lastName", "type": "phonetic", "weight": 0.1}]}
    flat = {"threshold": 0.8, "rules": [{"field": "firstName", "type": "fuzzy", "weight": 0.9}, {"field": "lastName", "type": "phonetic", "weight": 0.1}]}
    for c in (config, flat):
        key = lambda df: sorted((r["sourceRecordId"], r["matchedRecordId"], round(r["score"], 9)) for r in df.where("isMatch").collect())
        every = [(a, b) for a in rows for b in rows if a[0] != b[0]]
        pairs = spark.createDataFrame([(a[0], b[0]) for a, b in every], "sourceRecordId string, targetRecordId string")
        from tillwright.operators.mdm.match import score_given_pairs
        assert key(find_matches(recs, recs, c, "source")) == key(score_given_pairs(pairs, recs, recs, c, "source"))


def test_fuzzy_candidates_inside_the_blocks_of_a_key(spark):
    """A key shared by many records does not make pairs of all of them; the matches, NULL keys and texts included, are those of all pairs."""
    from pyspark.sql import functions as F

    names = [None, "abcdefghij", "abcdefghiX", "qrstuvwxyz", *(f"{k:02d}" * 5 for k in range(40))]
    rows = [(f"{c}-{i}", "part", (n, k)) for c, k in enumerate((1.5, 2.5, None)) for i, n in enumerate(names)]
    recs = spark.createDataFrame(rows, "id string, entityType string, data struct<name:string,price:double>")
    config = {"threshold": 0.9, "rules": [{"field": "name", "type": "fuzzy", "weight": 0.75}, {"field": "price", "type": "exact", "weight": 0.25}]}
    pairs = candidate_pairs(recs, recs, config).select(F.col("s.id").alias("a"), F.col("t.id").alias("b"))
    assert pairs.count() == pairs.distinct().count() < len(rows) * len(names) / 5
    got = {(r.sourceRecordId, r.matchedRecordId) for r in find_matches(recs, recs, config, "source").collect()}
    every = find_matches(recs.withColumn("x", F.lit(1)), recs.withColumn("x", F.lit(1)), config, "source", blocking=["x"])
    assert got == {(r.sourceRecordId, r.matchedRecordId) for r in every.collect()} and ("2-1", "2-2") in got


def test_candidates_are_sorted_in_parts_of_bounded_size(spark):
    """One scan task may hold any number of members: they are spread before their candidates are ranked."""
    rows = spark.range(0, 300, numPartitions=1).select(
        F.col("id").cast("string").alias("id"), F.lit("person").alias("entityType"), F.lit("crm").alias("sourceSystem"),
        F.struct(F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id"))).alias("name")).alias("data"), F.lit(1.0).alias("confidence"),
        F.timestamp_seconds("id").alias("sourceUpdatedAt"), F.timestamp_seconds("id").alias("ingestedAt"), F.when(F.col("id") < 200, "hot").otherwise("cold").alias("goldenRecordId"))
    out = merge_golden(rows, {}, batch_ts=dt.datetime(2024, 1, 1), candidates=2)
    found = {r["id"]: [c["value"] for c in r["mergeDecisions"][0]["candidates"]] for r in out.collect()}
    assert found == {"hot": ["n1", "n2"], "cold": ["n200", "n202"]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "RebalancePartitions" in plan[plan.index("WindowGroupLimit"):]


def test_fuzzy_records_are_scored_by_value_and_never_broadcast(spark):
    """A table that is small as it is read may be large in memory: no join of its records, values or segments is a broadcast."""
    names = [None, "", "abcdefghij", "abcdefghiX", "abcdefgXYZ", "qrstuvwxyz", "qrstuvwxy"]
    rows = [(f"{c}-{i}", "part", (n, k)) for c, k in enumerate((1.5, 1.5, None)) for i, n in enumerate(names)]
    recs = written(spark.createDataFrame(rows, "id string, entityType string, data struct<name:string,price:double>"), "records")
    rule = {"field": "name", "type": "fuzzy", "weight": 0.75, "options": {"maxDistance": 1}}
    config = {"threshold": 0.9, "rules": [rule, {"field": "price", "type": "exact", "weight": 0.25}]}
    found = find_matches(recs, recs, config, "source")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.sourceRecordId, r.matchedRecordId): (r.score, [x.score for x in r.ruleScores]) for r in found.collect()}
    every = find_matches(recs.withColumn("x", F.lit(1)), recs.withColumn("x", F.lit(1)), config, "source", blocking=["x"])
    assert got == {(r.sourceRecordId, r.matchedRecordId): (r.score, [x.score for x in r.ruleScores]) for r in every.collect()}
    assert got["0-2", "1-3"][1] == [0.9, 1.0] and ("0-2", "1-4") not in got and got["0-0", "1-0"][0] == 1.0
