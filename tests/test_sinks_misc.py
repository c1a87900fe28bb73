"""Sinks, message log, run history, manual goldens and emitted actions."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tillwright.operators.mdm.ingest import manual_goldens, unmatched_sources
from tillwright.operators.rules import action_rows, actions_of, route
from tillwright.plans.pipeline import run_pipeline
from tillwright.sources.sinks import query_log, runs_frame, runs_of, update_status, write_table


def test_overwrite_a_table_that_is_being_read(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tw-sink-", dir="/tmp"), "t")
    spark.range(5).write.parquet(path)
    df = spark.read.parquet(path).withColumn("id", F.col("id") * 10)
    write_table(df, path)  # source == output is legal
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 10, 20, 30, 40]


def test_message_log(spark):
    log = spark.createDataFrame([("m1", "a@x", "t1", "pending"), ("m2", "b@x", "t1", "pending")],
                                "id string, recipient string, templateId string, status string")
    upd = update_status(log, spark.createDataFrame([("m2", "failed", "bounced")], "id string, status string, error string"),
                        at=dt.datetime(2024, 1, 1))
    got = {r["id"]: (r["status"], r["error"], r["updatedAt"]) for r in upd.collect()}
    assert got["m2"] == ("failed", "bounced", dt.datetime(2024, 1, 1)) and got["m1"] == ("pending", None, None)
    assert query_log(upd, status=["failed"]).count() == 1 and query_log(upd, recipient="a@x").count() == 1


def test_run_history(cat):
    cat.register("t", cat.spark.range(3), order_key=("id",))
    run = run_pipeline(cat, {"id": "p1", "name": "p", "steps": [
        {"id": "s", "type": "filter", "config": {"source": "t", "output": "o", "conditions": []}}]}, observe=True)
    run.outputs["o"].write.format("noop").mode("overwrite").save()
    hist = runs_frame(cat.spark, [run])
    r = runs_of(hist, "p1").first()
    assert r["status"] == "completed" and r["steps"][0]["outputRows"] == 3


def test_manual_goldens_and_unmatched(spark):
    rows = spark.createDataFrame([("g9", "person", ("Zed",))], "id string, entityType string, data struct<name:string>")
    g = manual_goldens(rows, created_at=dt.datetime(2024, 1, 1)).first()
    assert g["confidence"] == 1.0 and g["sources"] == [] and g["needsReview"] is False
    src = spark.createDataFrame([("a", "person", None), ("b", "person", ""), ("c", "person", "g1")],
                                "id string, entityType string, goldenRecordId string")
    assert sorted(r["id"] for r in unmatched_sources(src, "person").collect()) == ["a", "b"]


def test_emitted_actions(cat):
    ctx = cat.spark.createDataFrame([("o1", 5.0), ("o2", 50.0)], "id string, amount double")
    wf = {"steps": [
        {"id": "c", "type": "condition", "condition": {"type": "compare", "left": {"type": "field", "path": "amount"},
                                                       "operator": ">", "right": {"type": "constant", "value": 10}},
         "onTrue": "mk", "onFalse": None},
        {"id": "mk", "type": "action", "next": "end", "action": {
            "type": "createEntity", "collection": "alerts",
            "data": {"orderId": {"type": "field", "path": "id"}, "level": {"type": "constant", "value": "high"}}}},
        {"id": "end", "type": "end"}]}
    routed = route(cat, ctx, wf)
    acts = actions_of(routed, "id")
    rows = action_rows(acts, "createEntity", "alerts", "orderId string, level string").collect()
    assert [(r["orderId"], r["level"]) for r in rows] == [("o2", "high")]


def test_repeated_and_missing_keys(spark):
    from tillwright.operators import tables
    from tillwright.operators.mdm.ingest import apply_links

    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3)], "k long, v string, at int")
    out, rejected = tables.insert(target, batch.drop("at"), "k")
    assert out.count() == 2 and sorted(r["reason"] for r in rejected.collect()) == ["already exists"] * 2 + ["missing key"]
    text = spark.createDataFrame([("a", 1)], "k string, v int")
    out, rejected = tables.insert(text, spark.createDataFrame([(None, 2), (None, 3)], text.schema), "k")
    assert rejected.count() == 0 and out.where("k is not null").select("k").distinct().count() == 3
    out, unknown = tables.replace(target, batch, "k", order_key=("at",))
    assert sorted(tuple(r)[:2] for r in out.select("k", "v").collect()) == [(1, "y"), (2, "b")] and unknown.count() == 1
    out = tables.patch(target, batch, "k", order_key=("at",))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "y"), (2, "b")]
    members = spark.createDataFrame([("s1", "g1", 1.0)], "id string, goldenRecordId string, matchScore double")
    twice = spark.createDataFrame([("s1", "g2"), ("s1", "g2")], "sourceRecordId string, goldenRecordId string")
    assert [tuple(r) for r in apply_links(members, twice).collect()] == [("s1", "g2", 1.0)]


def test_every_owner_gets_a_code(spark):
    import pytest

    from tillwright.operators.pricing.codes import CodeGenerationError, generate_codes

    owners = spark.range(90).withColumnRenamed("id", "owner")
    got = generate_codes(owners, length=2, pattern="numeric").collect()
    assert len({r["owner"] for r in got}) == len({r["code"] for r in got}) == len(got) == 90
    with pytest.raises(CodeGenerationError):
        generate_codes(spark.range(101).withColumnRenamed("id", "owner"), length=2, pattern="numeric")


def test_schema_of_a_registered_table(cat):
    """A table keeps its JSON Schema, takes its relations from it and refuses rows that break it."""
    schema = {"type": "object", "required": ["name"], "properties": {
        "id": {"type": "string"}, "name": {"type": "string", "minLength": 2}, "nation": {"type": "integer", "x-link-to": "nation"},
        "tags": {"type": "array", "items": {"type": "string", "x-link-to": "tag"}}}}
    fields = "id string, name string, nation long, tags array<string>"
    cat.register("people", cat.spark.createDataFrame([("a", "Anna", 1, ["x"])], fields), schema=schema)
    assert cat.schema_of("people") == schema and cat.info("people").relations == {"nation": ("nation", False), "tags": ("tag", True)}
    rows = cat.spark.createDataFrame([("a", "Again", 1, None), ("b", "Bea", 2, None), ("c", None, 3, None), ("d", "D", 3, None)], fields)
    grown, refused = cat.insert("people", rows)
    assert sorted(r["id"] for r in cat.get("people").collect()) == ["a", "b"] == sorted(r["id"] for r in grown.collect())
    assert sorted(r["id"] for r in refused.collect()) == ["a", "c", "d"]
    assert cat.schema_of("people") == schema


def test_write_fills_ids_and_sees_what_it_reads(cat, tmp_path):
    spark, path = cat.spark, str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "id string, n long")
    write_table(df, path, id_col="id")
    assert len({r["id"] for r in spark.read.parquet(path).collect()}) == 3
    write_table(spark.read.parquet(path).where("n > 1").join(spark.range(2, 3).withColumnRenamed("id", "n"), "n"), path)
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [2]


def test_one_row_an_update(cat):
    from pyspark.sql import functions as F
    log = cat.spark.createDataFrame([("m1", "sent"), ("m2", "sent")], "id string, status string")
    updates = cat.spark.createDataFrame([("m1", "opened", 2), ("m1", "delivered", 1), ("m3", "opened", 1)], "id string, status string, at int")
    assert sorted((r["id"], r["status"]) for r in update_status(log, updates.withColumn("at", F.timestamp_seconds("at"))).collect()) == [("m1", "opened"), ("m2", "sent")]


def test_clear_keeps_the_columns(cat):
    from tillwright.operators.tables import clear
    df = cat.spark.createDataFrame([("a", 1)], "id string, n long")
    assert clear(df).count() == 0 and clear(df).schema == df.schema
