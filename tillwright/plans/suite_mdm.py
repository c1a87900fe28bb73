"""Registered entity-resolution queries.

Source records of three systems are derived from the whole ``customer``
table by Spark (crm: as stored; erp: upper-cased padded names, lower-case
segments, rounded balances, shifted dates, a different nation for negative
balances; web: the AUTOMOBILE customers with a small balance offset).
Weights are powers of two so float sums are exact on both engines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mdm.commands import apply_commands
from ..operators.mdm.ingest import ingest_batch
from ..operators.mdm.match import find_matches, score_given_pairs
from ..operators.mdm.merge import candidate_rows, contribution_rows, merge_golden

INGEST_TS = dt.datetime(2024, 6, 1)

MATCH_CONFIG = {
    "entityType": "customer", "threshold": 0.7,
    "rules": [
        {"field": "name", "type": "normalized", "weight": 0.5},
        {"field": "nation", "type": "exact", "weight": 0.125},
        {"field": "segment", "type": "exactCaseInsensitive", "weight": 0.0625},
        {"field": "balance", "type": "numeric", "weight": 0.125, "options": {"numericTolerance": 5}},
        {"field": "name", "type": "fuzzy", "weight": 0.0625, "options": {"maxDistance": 10}},
        {"field": "name", "type": "phonetic", "weight": 0.0625},
        {"field": "since", "type": "date", "weight": 0.0625, "options": {"dateTolerance": 3}},
    ],
}

SURVIVORSHIP_CONFIG = {
    "entityType": "customer", "defaultStrategy": "mostRecent",
    "rules": [
        {"field": "name", "strategy": "longestValue"},
        {"field": "segment", "strategy": "sourceRanking", "sourceRanking": ["erp", "crm"]},
        {"field": "balance", "strategy": "highestConfidence"},
        {"field": "nation", "strategy": "mostFrequent"},
    ],
}


def mdm_sources(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    upd = F.timestamp_seconds(F.lit(1704067200) + key * 3600)
    since = F.timestamp_seconds(F.lit(1577836800) + key * 86400)

    def envelope(system, data, conf, updated):
        return (F.concat(F.lit(system + "-"), key.cast("string")).alias("id"),
                F.lit("customer").alias("entityType"), F.lit(system).alias("sourceSystem"),
                key.cast("string").alias("sourceId"), data.alias("data"), F.lit(conf).alias("confidence"),
                updated.alias("sourceUpdatedAt"), F.lit(INGEST_TS).cast("timestamp").alias("ingestedAt"))

    crm = c.select(*envelope("crm", F.struct(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), since.alias("since")), 0.9, upd))
    erp = c.select(*envelope("erp", F.struct(
        F.concat(F.lit("  "), F.upper("c_name")).alias("name"),
        F.when(F.col("c_acctbal") < 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).alias("nation"),
        F.lower("c_mktsegment").alias("segment"), F.round("c_acctbal").alias("balance"),
        F.timestamp_seconds(F.lit(1577836800) + key * 86400 + F.when(F.col("c_acctbal") > 0, 2 * 86400).otherwise(0))
        .alias("since")), 0.8,
        F.timestamp_seconds(F.lit(1704067200) + key * 3600 + F.when(F.col("c_acctbal") > 5000, 86400).otherwise(-86400))))
    web = c.where(F.col("c_mktsegment") == "AUTOMOBILE").select(*envelope("web", F.struct(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") + 3).alias("balance"), since.alias("since")),
        0.9, upd))
    return crm.unionByName(erp).unionByName(web)


SOURCES_SQL = """
src AS (
  SELECT 'crm-' || c_custkey AS id, 'customer' AS entityType, 'crm' AS sourceSystem, CAST(c_custkey AS VARCHAR) AS sourceId,
         c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance,
         TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey AS INTEGER)) AS since, 0.9::DOUBLE AS confidence,
         TIMESTAMP '2024-01-01' + to_hours(c_custkey) AS upd
  FROM customer
  UNION ALL
  SELECT 'erp-' || c_custkey, 'customer', 'erp', CAST(c_custkey AS VARCHAR), '  ' || upper(c_name),
         CASE WHEN c_acctbal < 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END, lower(c_mktsegment), round(c_acctbal),
         TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey AS INTEGER) + CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END), 0.8::DOUBLE,
         TIMESTAMP '2024-01-01' + to_hours(c_custkey) + CASE WHEN c_acctbal > 5000 THEN to_days(1) ELSE to_days(-1) END
  FROM customer
  UNION ALL
  SELECT 'web-' || c_custkey, 'customer', 'web', CAST(c_custkey AS VARCHAR), c_name, c_nationkey, c_mktsegment,
         c_acctbal + 3, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey AS INTEGER)), 0.9::DOUBLE,
         TIMESTAMP '2024-01-01' + to_hours(c_custkey)
  FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
"""


def _sql_soundex(x: str) -> str:
    s = f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"
    d = f"translate({s}, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556')"
    for digit in "123456":
        d = f"regexp_replace({d}, '{digit}+', '{digit}', 'g')"
    first = f"left({s}, 1)"
    rest = f"CASE WHEN translate({first}, 'BFPVCGJKQSXZDTLMNR', '') = '' THEN substr({d}, 2) ELSE {d} END"
    return f"CASE WHEN {s} = '' THEN '0000' ELSE left({first} || {rest} || '000', 4) END"


def _sql_scores(a: str, b: str) -> dict[str, str]:
    na = f"regexp_replace(trim(lower({a}.name)), '\\s+', ' ', 'g')"
    nb = f"regexp_replace(trim(lower({b}.name)), '\\s+', ' ', 'g')"
    diff = f"abs({a}.balance - {b}.balance)"
    mx = f"greatest(length({a}.name), length({b}.name))"
    lev = f"levenshtein({a}.name, {b}.name)"
    sa, sb = _sql_soundex(f"{a}.name"), _sql_soundex(f"{b}.name")
    same = " + ".join(f"CAST(substr({sa}, {i}, 1) = substr({sb}, {i}, 1) AS DOUBLE)" for i in range(1, 5))
    days = f"(abs(epoch_ms({a}.since) - epoch_ms({b}.since)) / 86400000.0::DOUBLE)"
    return {
        "s_name": f"CASE WHEN {na} = {nb} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "s_nation": f"CASE WHEN {a}.nation = {b}.nation THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "s_segment": f"CASE WHEN lower({a}.segment) = lower({b}.segment) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "s_balance": (f"CASE WHEN {a}.balance = {b}.balance THEN 1.0::DOUBLE WHEN {diff} <= 5 "
                      f"THEN 1.0::DOUBLE - {diff} / 6.0::DOUBLE ELSE 0.0::DOUBLE END"),
        "s_fuzzy": (f"CASE WHEN {lev} > 10 THEN 0.0::DOUBLE WHEN {mx} = 0 THEN 1.0::DOUBLE "
                    f"ELSE 1.0::DOUBLE - {lev} / CAST({mx} AS DOUBLE) END"),
        "s_phonetic": f"CASE WHEN {sa} = {sb} THEN 1.0::DOUBLE ELSE ({same}) / 4.0::DOUBLE END",
        "s_since": (f"CASE WHEN {days} = 0 THEN 1.0::DOUBLE WHEN {days} <= 3 "
                    f"THEN 1.0::DOUBLE - {days} / 4.0::DOUBLE ELSE 0.0::DOUBLE END"),
    }


_WEIGHTS = {"s_name": "0.5", "s_nation": "0.125", "s_segment": "0.0625", "s_balance": "0.125",
            "s_fuzzy": "0.0625", "s_phonetic": "0.0625", "s_since": "0.0625"}


def _sql_total(sc: dict[str, str]) -> str:
    terms = [f"({sc[k]}) * {w}::DOUBLE" for k, w in _WEIGHTS.items()]
    expr = terms[0]
    for t in terms[1:]:
        expr = f"({expr} + {t})"
    return f"({expr} / 1.0::DOUBLE)"


_SQL_NAME = "regexp_replace(trim(lower({}.name)), '\\\\s+', ' ', 'g')"

_RULE_COLS = ["s_name", "s_nation", "s_segment", "s_balance", "s_fuzzy", "s_phonetic", "s_since"]


# -- M1-M9, M12b: scores of given pairs (each crm record vs the erp record of the same key) -----

def mdm_scores(spark, sf_dir):
    src = mdm_sources(spark, sf_dir)
    crm = src.where("sourceSystem = 'crm'")
    erp = src.where("sourceSystem = 'erp'")
    pairs = crm.select(F.col("id").alias("sourceRecordId"), "sourceId").join(
        erp.select(F.col("id").alias("targetRecordId"), "sourceId"), "sourceId").drop("sourceId")
    scored = score_given_pairs(pairs, crm, erp, MATCH_CONFIG, "source")
    rs = F.col("ruleScores")
    return scored.select("sourceRecordId", "matchedRecordId", F.round("score", 6).alias("score"), "isMatch",
                         *[F.round(rs[i]["score"], 6).alias(n) for i, n in enumerate(_RULE_COLS)])


def _mdm_scores_sql():
    sc = _sql_scores("a", "b")
    cols = ", ".join(f"round({sc[n]}, 6) AS {n}" for n in _RULE_COLS)
    return f"""
WITH {SOURCES_SQL}
SELECT a.id AS "sourceRecordId", b.id AS "matchedRecordId", round({_sql_total(sc)}, 6) AS score,
       {_sql_total(sc)} >= 0.7 AS "isMatch", {cols}
FROM src a JOIN src b ON a.sourceId = b.sourceId
WHERE a.sourceSystem = 'crm' AND b.sourceSystem = 'erp'
"""


# -- M10-M12: all directed source-to-source matches, blocked losslessly -------------------

def mdm_matches(spark, sf_dir):
    src = mdm_sources(spark, sf_dir)
    m = find_matches(src, src, MATCH_CONFIG, "source")
    return m.select("sourceRecordId", "matchedRecordId", "matchedRecordType", F.round("score", 6).alias("score"))


def _mdm_matches_sql():
    sc = _sql_scores("a", "b")
    return f"""
WITH {SOURCES_SQL},
scored AS (
  SELECT a.id AS "sourceRecordId", b.id AS "matchedRecordId", {_sql_total(sc)} AS score
  FROM src a JOIN src b ON a.entityType = b.entityType AND a.id <> b.id
    AND {_SQL_NAME.format('a')} = {_SQL_NAME.format('b')})  -- 0.5 of 1.0 is lost otherwise, and 0.7 is needed
SELECT "sourceRecordId", "matchedRecordId", 'source' AS "matchedRecordType", round(score, 6) AS score
FROM scored WHERE score >= 0.7
"""


# -- J10 without a binary rule: candidates by the segments of similar texts -------------------

FUZZY_CONFIG = {"entityType": "part", "threshold": 0.9, "rules": [
    {"field": "label", "type": "fuzzy", "weight": 0.75}, {"field": "price", "type": "exact", "weight": 0.25}]}


def mdm_fuzzy_matches(spark, sf_dir):
    """Parts whose labels are a character or two apart, every 20th of them without a label."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.when(F.col("p_partkey") % 20 > 0, F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    rows = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("part").alias("entityType"), F.struct(label.alias("label"), F.col("p_retailprice").alias("price")).alias("data"))
    return find_matches(rows, rows, FUZZY_CONFIG, "source").select("sourceRecordId", "matchedRecordId", F.round("score", 6).alias("score"))


MDM_FUZZY_SQL = """
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 20 > 0 THEN p_name || ' ' || p_brand || ' ' || p_type END AS label, p_retailprice AS price FROM part),
s AS (SELECT a.id AS x, b.id AS y, CASE WHEN a.label IS NULL AND b.label IS NULL THEN 1.0::DOUBLE WHEN a.label IS NULL OR b.label IS NULL THEN 0.0::DOUBLE
        ELSE 1.0::DOUBLE - levenshtein(a.label, b.label) / CAST(greatest(length(a.label), length(b.label)) AS DOUBLE) END * 0.75::DOUBLE
        + CASE WHEN a.price = b.price THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score
      FROM r a JOIN r b ON a.id <> b.id)
SELECT x AS "sourceRecordId", y AS "matchedRecordId", round(score, 6) AS score FROM s WHERE score >= 0.9
"""


# -- M14-M23: survivorship over the records of one customer key ------------------------------

def _golden(spark, sf_dir):
    src = mdm_sources(spark, sf_dir)
    members = src.withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId")))
    return merge_golden(members, SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS)


def mdm_survivorship(spark, sf_dir):
    g = _golden(spark, sf_dir)
    return g.select("id", "entityType", "data.name", "data.nation", "data.segment", "data.balance",
                    "data.since", F.round("confidence", 6).alias("confidence"),
                    F.size("mergeDecisions").cast("long").alias("n_decisions"))


_SURV_CTE = f"""
{SOURCES_SQL},
m AS (SELECT *, 'g-' || sourceId AS gid FROM src),
rk AS (SELECT *, CASE sourceSystem WHEN 'erp' THEN 1 WHEN 'crm' THEN 2 ELSE 1073741824 END AS rank FROM m),
w AS (
  SELECT gid,
    first(entityType ORDER BY id) AS entityType,
    first(name ORDER BY length(name) DESC, id) AS name, first(sourceSystem ORDER BY length(name) DESC, id) AS name_sys,
    first(segment ORDER BY rank, id) AS segment, first(sourceSystem ORDER BY rank, id) AS segment_sys,
    first(balance ORDER BY confidence DESC, id) AS balance, first(sourceSystem ORDER BY confidence DESC, id) AS balance_sys,
    first(since ORDER BY upd DESC, id) AS since, first(sourceSystem ORDER BY upd DESC, id) AS since_sys
  FROM rk GROUP BY gid),
nf AS (
  SELECT gid, first(nation ORDER BY n DESC, first_id) AS nation, first(sys ORDER BY n DESC, first_id) AS nation_sys
  FROM (SELECT gid, nation, count(*) AS n, min(id) AS first_id, first(sourceSystem ORDER BY id) AS sys
        FROM m GROUP BY gid, nation) GROUP BY gid),
won AS (
  SELECT gid, sys, count(*) AS fc FROM (
    SELECT gid, name_sys AS sys FROM w UNION ALL SELECT gid, segment_sys FROM w UNION ALL
    SELECT gid, balance_sys FROM w UNION ALL SELECT gid, since_sys FROM w UNION ALL SELECT gid, nation_sys FROM nf)
  GROUP BY gid, sys),
conf AS (
  SELECT m.gid, sum(m.confidence * won.fc) / sum(won.fc) AS confidence
  FROM m JOIN won ON m.gid = won.gid AND m.sourceSystem = won.sys GROUP BY m.gid)
"""


def _mdm_survivorship_sql():
    return f"""
WITH {_SURV_CTE}
SELECT w.gid AS id, w.entityType AS "entityType", w.name, nf.nation, w.segment, w.balance, w.since,
       round(coalesce(conf.confidence, 0.5), 6) AS confidence, CAST(5 AS BIGINT) AS n_decisions
FROM w JOIN nf USING (gid) LEFT JOIN conf USING (gid)
"""


def mdm_confidence(spark, sf_dir):
    g = _golden(spark, sf_dir)
    return g.select("id", F.explode("sources").alias("s")).select(
        "id", F.col("s.sourceSystem").alias("sourceSystem"),
        F.size("s.contributedFields").cast("long").alias("n_fields"), F.col("s.sourceRecords").alias("n_records"))


def _mdm_confidence_sql():
    return f"""
WITH {_SURV_CTE}
SELECT won.gid AS id, won.sys AS "sourceSystem", won.fc AS n_fields, count(*) AS n_records
FROM won JOIN m ON m.gid = won.gid AND m.sourceSystem = won.sys
GROUP BY won.gid, won.sys, won.fc
"""


# -- M25: batch ingest of erp + web records against goldens built from crm ------------------

def mdm_ingest(spark, sf_dir):
    src = mdm_sources(spark, sf_dir)
    crm = src.where("sourceSystem = 'crm'").withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId"))) \
        .withColumn("matchScore", F.lit(1.0))
    goldens = merge_golden(crm, SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS)
    batch = src.where("sourceSystem <> 'crm'").drop("ingestedAt")
    res = ingest_batch(spark, batch, goldens, crm, MATCH_CONFIG, SURVIVORSHIP_CONFIG, INGEST_TS)
    return res.sources.select("id", "goldenRecordId", F.round("matchScore", 6).alias("matchScore"))


def _mdm_ingest_sql():
    """Each record's best golden record, else the component of the records left that match each other."""
    sc = _sql_scores("a", "b")
    same = f"{_SQL_NAME.format('a')} = {_SQL_NAME.format('b')}"
    return f"""
WITH RECURSIVE {SOURCES_SQL},
batch AS (SELECT * FROM src WHERE sourceSystem <> 'crm'),
golden AS (SELECT * REPLACE ('g-' || sourceId AS id) FROM src WHERE sourceSystem = 'crm'),
best AS (
  SELECT a.id, b.id AS gid, {_sql_total(sc)} AS score FROM batch a JOIN golden b ON {same} WHERE {_sql_total(sc)} >= 0.7
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_sql_total(sc)} DESC, b.id) = 1),
alone AS (SELECT * FROM batch WHERE id NOT IN (SELECT id FROM best)),
edge AS (SELECT a.id AS x, b.id AS y FROM alone a JOIN alone b ON a.id <> b.id AND {same} WHERE {_sql_total(sc)} >= 0.7),
reach AS (SELECT id AS x, id AS y FROM alone UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y)
SELECT id, gid AS "goldenRecordId", round(score, 6) AS "matchScore" FROM best
UNION ALL SELECT x, 'golden-' || min(y), 1.0::DOUBLE FROM reach GROUP BY x
"""


# -- M23: what each field was chosen from, and which records gave it ------------------------

def _members_by_key(spark, sf_dir):
    return mdm_sources(spark, sf_dir).withColumn("goldenRecordId", F.concat(F.lit("g-"), F.col("sourceId")))


def mdm_candidates(spark, sf_dir):
    """Every candidate of every field of every golden record."""
    return candidate_rows(_members_by_key(spark, sf_dir)).select("id", "field", "sourceSystem", "sourceRecordId", "value", F.round("confidence", 6).alias("confidence"))


def _mdm_candidates_sql():
    number = "regexp_replace(CAST(balance AS VARCHAR), '[.]0$', '')"
    fields = {"name": "name", "nation": "CAST(nation AS VARCHAR)", "segment": "segment", "balance": number,
              "since": "strftime(since, '%Y-%m-%dT%H:%M:%S.000Z')"}
    rows = " UNION ALL ".join(f"""SELECT 'g-' || sourceId AS id, '{f}' AS field, sourceSystem AS "sourceSystem", id AS "sourceRecordId", {v} AS value,
  round(confidence, 6) AS confidence FROM src WHERE {f} IS NOT NULL AND {v} <> ''""" for f, v in fields.items())
    return f"WITH {SOURCES_SQL} {rows}"


def mdm_contributions(spark, sf_dir):
    """The records each golden record was matched from, with the number of fields that their system gave."""
    m = _members_by_key(spark, sf_dir)
    rows = contribution_rows(merge_golden(m, SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS), m)
    return rows.select("id", "sourceRecordId", "sourceSystem", F.size("contributedFields").cast("long").alias("n_fields"), "lastUpdatedAt")


def _mdm_contributions_sql():
    return f"""
WITH {_SURV_CTE}
SELECT m.gid AS id, m.id AS "sourceRecordId", m.sourceSystem AS "sourceSystem", coalesce(won.fc, 0) AS n_fields, m.upd AS "lastUpdatedAt"
FROM m LEFT JOIN won ON m.gid = won.gid AND m.sourceSystem = won.sys
"""


def mdm_decisions(spark, sf_dir):
    """Each decision with the record that won and the first two values it was chosen from."""
    g = merge_golden(_members_by_key(spark, sf_dir), SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS, candidates=2)
    return g.select("id", F.explode("mergeDecisions").alias("d")).select(
        "id", "d.field", "d.strategy", "d.sourceSystem", "d.sourceRecordId",
        F.array_join(F.transform("d.candidates", lambda c: c["sourceRecordId"]), ",").alias("candidates"))


def _mdm_decisions_sql():
    picks = {"name": ("longestValue", "w.name_sys"), "segment": ("sourceRanking", "w.segment_sys"), "balance": ("highestConfidence", "w.balance_sys"),
             "since": ("mostRecent", "w.since_sys"), "nation": ("mostFrequent", "nf.nation_sys")}
    rows = " UNION ALL ".join(f"""SELECT w.gid AS id, '{f}' AS field, '{s}' AS strategy, {sys} AS "sourceSystem",
  {sys} || substr(w.gid, 2) AS "sourceRecordId", few.candidates FROM w JOIN nf USING (gid) JOIN few USING (gid)""" for f, (s, sys) in picks.items())
    return f"""
WITH {_SURV_CTE},
few AS (SELECT gid, array_to_string(list(id ORDER BY id)[:2], ',') AS candidates FROM m GROUP BY gid)
{rows}"""


# -- M26-M28: a log of commands, one after the other --------------------------------------------

COMMAND_RULES = {"customer": SURVIVORSHIP_CONFIG}


def command_log(spark, sf_dir) -> DataFrame:
    """Two commands a customer, from the whole table: chains of merges, links and unlinks that empty
    records, commands on records that are gone by then, refreshes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"))
    g = lambda x: F.concat(F.lit("g-"), x.cast("string"))
    own = lambda system: F.concat(F.lit(system + "-"), F.col("k").cast("string"))
    kind = F.when(F.col("n") < 8, "merge").when(F.col("n") < 14, "unlink").when(F.col("n") < 22, "link").otherwise("refresh")
    first = c.select((F.col("k") * 2).alias("seq"), kind.alias("kind"), own("crm").alias("sourceRecordId"),
                     F.when(F.col("n") < 8, g(F.col("k") + F.col("n") % 3)).otherwise(g(F.col("k") + F.col("n") % 5 - 2)).alias("goldenRecordId"),
                     F.when(F.col("n") < 8, g(F.col("k") + 1 - F.col("n") % 2)).alias("otherId"))
    kind = F.when(F.col("b") < 0, "unlink").when(F.col("b") < 5000, "merge").otherwise("link")
    second = c.select((F.lit(10_000_000_000) - F.col("k")).alias("seq"), kind.alias("kind"), own("erp").alias("sourceRecordId"), g(F.col("k") + 7).alias("goldenRecordId"), g(F.col("k")).alias("otherId"))
    return first.unionByName(second)


COMMAND_LOG_SQL = """
cmd AS (
  SELECT c_custkey * 2 AS seq, CASE WHEN c_nationkey < 8 THEN 'merge' WHEN c_nationkey < 14 THEN 'unlink' WHEN c_nationkey < 22 THEN 'link' ELSE 'refresh' END AS kind,
         'crm-' || c_custkey AS s, CASE WHEN c_nationkey < 8 THEN c_custkey + c_nationkey % 3 ELSE c_custkey + c_nationkey % 5 - 2 END AS g,
         CASE WHEN c_nationkey < 8 THEN c_custkey + 1 - c_nationkey % 2 END AS o FROM customer
  UNION ALL
  SELECT 10000000000 - c_custkey, CASE WHEN c_acctbal < 0 THEN 'unlink' WHEN c_acctbal < 5000 THEN 'merge' ELSE 'link' END,
         'erp-' || c_custkey, c_custkey + 7, c_custkey FROM customer)
"""

# One command after the other: the state is the golden record of every source and the records that are left, as maps.
COMMANDS_SQL = f"""
WITH RECURSIVE {SOURCES_SQL},
{COMMAND_LOG_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM cmd),
start AS (SELECT list(id ORDER BY id) AS ids, list(CAST(sourceId AS BIGINT) ORDER BY id) AS place FROM src),
ids AS (SELECT unnest(ids) AS s, generate_subscripts(ids, 1) AS p FROM start),
run AS (
  SELECT CAST(0 AS BIGINT) AS i, place, (SELECT list(DISTINCT CAST(sourceId AS BIGINT)) FROM src) AS alive, true AS ok, CAST(NULL AS BIGINT) AS again FROM start
  UNION ALL
  SELECT i + 1,
         CASE WHEN NOT good THEN place
              WHEN kind = 'link' THEN list_concat(place[:p - 1], [g], place[p + 1:])
              WHEN kind = 'unlink' THEN list_concat(place[:p - 1], [CAST(NULL AS BIGINT)], place[p + 1:])
              WHEN kind = 'merge' THEN list_transform(place, lambda x: CASE WHEN x = o THEN g ELSE x END)
              ELSE place END,
         CASE WHEN good AND kind = 'merge' THEN list_filter(alive, lambda x: x <> o)
              WHEN good AND kind = 'unlink' AND len(list_filter(place, lambda x: x = was)) = 1 THEN list_filter(alive, lambda x: x <> was)
              ELSE alive END,
         good,
         CASE WHEN NOT good THEN NULL WHEN kind = 'unlink' THEN was ELSE g END
  FROM (
    SELECT *, CASE kind WHEN 'unlink' THEN was IS NOT NULL
                        WHEN 'link' THEN p IS NOT NULL AND list_contains(alive, g)
                        WHEN 'merge' THEN list_contains(alive, g) AND list_contains(alive, o) AND g <> o AND (list_contains(place, g) OR list_contains(place, o))
                        ELSE list_contains(alive, g) AND list_contains(place, g) END AS good
    FROM (SELECT run.i, run.place, run.alive, n.kind, n.g, n.o, ids.p, run.place[ids.p] AS was
          FROM run JOIN numbered n ON n.i = run.i + 1 LEFT JOIN ids ON ids.s = n.s)))
"""


def _commanded(spark, sf_dir):
    m = _members_by_key(spark, sf_dir).withColumn("matchScore", F.lit(0.75))
    goldens = merge_golden(m, SURVIVORSHIP_CONFIG, batch_ts=INGEST_TS)
    return apply_commands(m, goldens, command_log(spark, sf_dir), COMMAND_RULES, INGEST_TS)


def mdm_commands(spark, sf_dir):
    """Where every source record is after the log."""
    return _commanded(spark, sf_dir).sources.select("id", "goldenRecordId", "matchScore")


def _mdm_commands_sql():
    return f"""{COMMANDS_SQL},
ended AS (SELECT place FROM run ORDER BY i DESC LIMIT 1),
own AS (SELECT n.s, max_by(n.kind, n.i) AS kind FROM numbered n JOIN run USING (i) WHERE run.ok AND n.kind IN ('link', 'unlink') GROUP BY n.s)
SELECT ids.s AS id, 'g-' || ended.place[ids.p] AS "goldenRecordId",
       CASE own.kind WHEN 'link' THEN 1.0::DOUBLE WHEN 'unlink' THEN NULL ELSE 0.75::DOUBLE END AS "matchScore"
FROM ids CROSS JOIN ended LEFT JOIN own ON own.s = ids.s
"""


def mdm_command_log(spark, sf_dir):
    """Which commands were carried out."""
    return _commanded(spark, sf_dir).log.select("seq", "kind", "ok")


def _mdm_command_log_sql():
    return f"{COMMANDS_SQL} SELECT n.seq, n.kind, run.ok FROM run JOIN numbered n USING (i)"


QUERIES = {
    "mdm_fuzzy_matches": mdm_fuzzy_matches,
    "mdm_candidates": mdm_candidates,
    "mdm_contributions": mdm_contributions,
    "mdm_decisions": mdm_decisions,
    "mdm_commands": mdm_commands,
    "mdm_command_log": mdm_command_log,
    "mdm_scores": mdm_scores,
    "mdm_matches": mdm_matches,
    "mdm_survivorship": mdm_survivorship,
    "mdm_confidence": mdm_confidence,
    "mdm_ingest": mdm_ingest,
}

ORACLE = {
    "mdm_fuzzy_matches": MDM_FUZZY_SQL,
    "mdm_candidates": _mdm_candidates_sql(),
    "mdm_contributions": _mdm_contributions_sql(),
    "mdm_decisions": _mdm_decisions_sql(),
    "mdm_commands": _mdm_commands_sql(),
    "mdm_command_log": _mdm_command_log_sql(),
    "mdm_ingest": _mdm_ingest_sql(),
    "mdm_scores": _mdm_scores_sql(),
    "mdm_matches": _mdm_matches_sql(),
    "mdm_survivorship": _mdm_survivorship_sql(),
    "mdm_confidence": _mdm_confidence_sql(),
}
