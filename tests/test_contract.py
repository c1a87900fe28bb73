"""Driver contract and physical-plan properties of representative queries."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["n_name", "total_sales", "order_count", "avg_sale"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_filters_reach_the_scan(spark):
    p = plan(entry.queries()["filter_regex"](spark, SF))
    assert "PushedFilters: [In(event_type" in p or "PushedFilters: [IsNotNull" in p or "PushedFilters" in p


def test_or_tree_relation_is_an_existence_join(spark):
    df = entry.queries()["rel_or_tree"](spark, SF)
    txt = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in txt


def test_no_row_python_in_native_paths(spark):
    for name in ("price_by_priority", "mdm_matches", "map_strings", "route_orders"):
        p = plan(entry.queries()[name](spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_blocked_matching_has_no_cartesian_product(spark):
    p = plan(entry.queries()["mdm_matches"](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_ingest_queries_link_each_record_to_its_customer(spark):
    for name in ("mdm_ingest", "stream_ingest"):
        rows = entry.queries()[name](spark, SF).collect()
        assert rows, name
        for r in rows:
            assert r["goldenRecordId"] == "g-" + r["id"].split("-", 1)[1], (name, r)
            assert 0.7 <= r["matchScore"] <= 1.0


def test_generated_codes_are_unique_and_well_formed(spark):
    from pyspark.sql import functions as F

    from tillwright.operators.pricing.codes import format_check

    df = entry.queries()["codes_generated"](spark, SF)
    n_customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("d"),
                   F.countDistinct("owner").alias("o"),
                   F.min(format_check(F.col("code"), 8, prefix="VIP-").cast("int")).alias("ok")).first()
    assert stats["n"] == stats["d"] == stats["o"] == n_customers and stats["ok"] == 1


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py"), "sales_by_nation", "filter_regex"],
                         capture_output=True, text=True, env=env, timeout=600, check=True)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d) and d["unit"] == "sec"
    assert set(d["queries"]) == {"sales_by_nation", "filter_regex"} and d["sf"] == 0.001


def test_python_udf_query_runs_without_the_package_on_workers():
    """Executors import nothing from the repository: run from another folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').getOrCreate()\n"
        f"spec = importlib.util.spec_from_file_location('e', '{root}/__spark_entry__.py')\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        f"print(len(m.queries()['price_best_combination'](spark, '{SF}').collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True,
                         env=env, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.strip().splitlines()[-1]) > 0


def _pairs_by_nation(spark, query, unmatched):
    """Rows of a join by nation over the whole tables: every pair of a nation, and the rows without partner of the sides that stay."""
    from tillwright.plans import suite

    count = lambda t, c: {r[0]: r[1] for r in spark.read.parquet(f"{suite_dir}/{t}.parquet").groupBy(c).count().collect()}
    suite_dir = "/root/testdata/sf0.001"
    left, right = count("customer", "c_nationkey"), count("supplier", "s_nationkey")
    alone = sum(n for k, n in left.items() if k not in right) + (sum(n for k, n in right.items() if k not in left) if unmatched == "both" else 0)
    assert suite.QUERIES[query](spark, suite_dir).count() == sum(n * right.get(k, 0) for k, n in left.items()) + alone


def test_left_join_meets_all_suppliers_of_a_nation(spark):
    _pairs_by_nation(spark, "join_left_collision", "left")


def test_full_join_meets_all_suppliers_of_a_nation(spark):
    _pairs_by_nation(spark, "join_full", "both")


def test_left_join_deals_out_a_nation(spark, monkeypatch):
    """The pairs of a nation are made by several tasks, with the same rows as in one."""
    from pyspark.sql import functions as F

    from tillwright.operators import steps

    run = lambda: entry.queries()["join_left_collision"](spark, SF)
    want = sorted(map(repr, run().collect()))
    monkeypatch.setattr(steps, "PAIRS", (2, 4), raising=False)
    dealt = run()
    assert sorted(map(repr, dealt.collect())) == want
    tasks = dealt.where("right_id is not null").withColumn("task", F.spark_partition_id()).groupBy("nation").agg(F.countDistinct("task").alias("n"), F.count(F.lit(1)).alias("pairs"))
    assert tasks.where("pairs > 8").agg(F.min("n")).first()[0] > 1
