"""Cart pricing on the literal carts of the original calculator and service tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwright.operators.pricing.carts import build_carts
from tillwright.operators.pricing.codes import format_check, generate_codes
from tillwright.operators.pricing.evaluate import evaluate, with_defaults
from tillwright.operators.pricing.values import discount_amount

CART_SCHEMA = ("cart_id string, customer struct<id:string,group:string,tags:array<string>,isFirstPurchase:boolean>, "
               "appliedCodes array<string>, shippingAmount double, evaluationDate timestamp")
LINE_SCHEMA = "cart_id string, line int, productId string, categoryId string, quantity double, unitPrice double"


def carts(spark, lines, customer=None, codes=None, shipping=0.0, when=dt.datetime(2024, 6, 1)):
    c = spark.createDataFrame([("c", customer or ("u", "regular", [], False), codes or [], shipping, when)], CART_SCHEMA)
    ln = spark.createDataFrame([("c", i + 1, *x) for i, x in enumerate(lines)], LINE_SCHEMA)
    return build_carts(c, ln)


BASE = [("p1", "c1", 2.0, 50.0), ("p2", "c2", 1.0, 100.0)]


def amount(spark, discount, lines=BASE, **kw):
    return carts(spark, lines, **kw).select(discount_amount(with_defaults(discount)).alias("a")).first()["a"]


def pct(p, target=None, **kw):
    return {"target": target or {"type": "cart"}, "value": {"type": "percentage", "percentage": p, **kw}}


def test_percentage(spark):
    assert amount(spark, pct(10)) == pytest.approx(20)
    assert amount(spark, pct(50, maxAmount=25)) == pytest.approx(25)
    assert amount(spark, pct(20, {"type": "product", "productIds": ["p1"]})) == pytest.approx(20)
    assert amount(spark, pct(10, {"type": "category", "categoryIds": ["c2"]})) == pytest.approx(10)
    assert amount(spark, pct(10, {"type": "product", "productIds": ["zz"]})) is None


def test_fixed_amount(spark):
    fixed = lambda a, t=None: {"target": t or {"type": "cart"}, "value": {"type": "fixedAmount", "amount": a}}
    assert amount(spark, fixed(30)) == pytest.approx(30)
    assert amount(spark, fixed(150, {"type": "product", "productIds": ["p1"]})) == pytest.approx(100)
    assert amount(spark, fixed(40)) == pytest.approx(40)


def bxgy(**kw):
    return {"target": {"type": "cart"},
            "value": {"type": "buyXGetY", "buyQuantity": 2, "getQuantity": 1, "discountPercentage": 100, **kw}}


def test_buy_x_get_y(spark):
    assert amount(spark, bxgy(), lines=[("p", "c", 3.0, 30.0)]) == pytest.approx(30)
    assert amount(spark, bxgy(), lines=[("p", "c", 6.0, 20.0)]) == pytest.approx(40)
    partial = bxgy(discountPercentage=50)
    assert amount(spark, partial, lines=[("p", "c", 3.0, 30.0)]) == pytest.approx(15)
    # cheapest units are free first
    assert amount(spark, bxgy(), lines=[("a", "c", 2.0, 50.0), ("b", "c", 1.0, 10.0)]) == pytest.approx(10)


def tiered(by, tiers):
    return {"target": {"type": "cart"}, "value": {"type": "tiered", "tierBy": by, "tiers": tiers}}


def test_tiered(spark):
    tiers = [{"threshold": 100, "percentage": 5}, {"threshold": 200, "percentage": 10}]
    assert amount(spark, tiered("amount", tiers)) == pytest.approx(20)
    assert amount(spark, tiered("quantity", [{"threshold": 3, "percentage": 5}])) == pytest.approx(10)
    assert amount(spark, tiered("amount", [{"threshold": 1000, "percentage": 5}])) is None
    assert amount(spark, tiered("amount", [{"threshold": 100, "fixedAmount": 25}])) == pytest.approx(25)


def test_bundle_and_shipping(spark):
    lines = [("p1", "c", 1.0, 50.0), ("p2", "c", 1.0, 40.0)]
    bundle = {"target": {"type": "cart"}, "value": {"type": "bundle", "items": [
        {"productId": "p1", "quantity": 1}, {"productId": "p2", "quantity": 1}], "bundlePrice": 70}}
    assert amount(spark, bundle, lines=lines) == pytest.approx(20)
    assert amount(spark, bundle, lines=lines[:1]) is None
    pct_bundle = {"target": {"type": "cart"}, "value": {"type": "bundle", "items": [
        {"productId": "p1", "quantity": 1}, {"productId": "p3", "quantity": 1}], "bundlePercentage": 20}}
    assert amount(spark, pct_bundle, lines=[("p1", "c", 1.0, 50.0), ("p3", "c", 1.0, 50.0)]) == pytest.approx(20)
    ship = {"target": {"type": "shipping"}, "value": {"type": "freeShipping"}}
    assert amount(spark, ship, shipping=15.0) == pytest.approx(15)


def test_exclusive_priority(spark):
    ds = [{"id": "big", "priority": 10, "stacking": "exclusive", **pct(30)},
          {"id": "small", "priority": 5, **pct(5)}]
    out = evaluate(carts(spark, [("p", "c", 1.0, 100.0)]), ds, "byPriority").first()
    assert [a["discountId"] for a in out["appliedDiscounts"]] == ["big"]
    assert out["totalDiscount"] == pytest.approx(30) and out["finalTotal"] == pytest.approx(70)
    allx = evaluate(carts(spark, [("p", "c", 1.0, 100.0)]), ds, "all").first()
    assert len(allx["appliedDiscounts"]) == 2
    best = evaluate(carts(spark, [("p", "c", 1.0, 100.0)]), ds, "none").first()
    assert [a["discountId"] for a in best["appliedDiscounts"]] == ["big"]


def test_vip_tiers_and_shipping_service_cases(spark):
    vip = {"id": "vip", "conditions": [{"type": "customerGroup", "groups": ["vip"]}],
           **tiered("amount", [{"threshold": 200, "percentage": 10}, {"threshold": 300, "percentage": 15}])}
    lines = [("p", "c", 3.0, 100.0)]
    assert evaluate(carts(spark, lines), [vip]).first()["appliedDiscounts"] == []
    got = evaluate(carts(spark, lines, customer=("u", "vip", [], False)), [vip]).first()
    assert got["totalDiscount"] == pytest.approx(45)
    ship = {"id": "s", "target": {"type": "shipping"}, "value": {"type": "freeShipping"}}
    out = evaluate(carts(spark, [("p", "c", 2.0, 60.0)], shipping=15.0), [ship]).first()
    assert out["shippingDiscount"] == pytest.approx(15) and out["finalTotal"] == pytest.approx(120)


def test_codes_and_reasons(spark):
    ds = [{"id": "a", "code": "SAVE10", **pct(10)},
          {"id": "b", "code": "OLD", "validUntil": dt.datetime(2020, 1, 1), **pct(10)},
          {"id": "c", "code": "LATER", "validFrom": dt.datetime(2030, 1, 1), **pct(10)},
          {"id": "d", "code": "MAXED", "usageLimit": 1, "currentUsage": 1, **pct(10)},
          {"id": "e", "code": "BIG", "conditions": [{"type": "minAmount", "amount": 1000}], **pct(10)},
          {"id": "f", "code": "OFF", "status": "inactive", **pct(10)}]
    out = evaluate(carts(spark, BASE, codes=["save10", "nope", "OLD", "LATER", "MAXED", "BIG", "OFF", "SAVE10"]),
                   ds).first()
    assert [a["discountId"] for a in out["appliedDiscounts"]] == ["a", "a"]  # the same code twice applies twice
    assert [(r["code"], r["reason"]) for r in out["rejectedCodes"]] == [
        ("nope", "Invalid code"), ("OLD", "Discount has expired"), ("LATER", "Discount is not yet valid"),
        ("MAXED", "Discount usage limit reached"), ("BIG", "Conditions not met"), ("OFF", "Discount is not active")]


def test_best_combination(spark):
    ds = [{"id": "x", "priority": 3, "stacking": "exclusive", **pct(30)},
          {"id": "y", "priority": 2, **pct(20)}, {"id": "z", "priority": 1, **pct(15)}]
    out = evaluate(carts(spark, [("p", "c", 1.0, 100.0)]), ds, "bestCombination").first()
    assert sorted(a["discountId"] for a in out["appliedDiscounts"]) == ["y", "z"]
    assert out["totalDiscount"] == pytest.approx(35)


def test_code_generation_and_format(spark):
    owners = spark.range(500).withColumnRenamed("id", "owner")
    codes = generate_codes(owners, length=6, prefix="SUM-", seed=3)
    got = codes.collect()
    assert len(got) == 500 and len({r["code"] for r in got}) == 500
    checked = codes.select(format_check(F.col("code"), 6, prefix="SUM-").alias("ok")).collect()
    assert all(r["ok"] for r in checked)
    again = generate_codes(owners, length=6, prefix="SUM-", seed=3).collect()
    assert sorted((r["owner"], r["code"]) for r in again) == sorted((r["owner"], r["code"]) for r in got)
    assert "0" not in "".join(r["code"][4:] for r in got) and "O" not in "".join(r["code"][4:] for r in got)


def _model(es):
    """Best valid subset by trying every bit mask (the first entry is the highest bit)."""
    best, total = [], 0.0
    for mask in range(1 << len(es)):
        on = [j for j in range(len(es)) if mask >> (len(es) - 1 - j) & 1]
        kinds = [es[j]["stacking"] for j in on]
        if "exclusive" in kinds and len(on) > 1:
            continue
        if any(k == "exclusiveByTarget" and es[on[x]]["targetKey"] in [es[j]["targetKey"] for j in on[:x]]
               for x, k in enumerate(kinds)):
            continue
        chosen = [j for j in on if es[j]["amount"] is not None]
        if (t := sum(es[j]["amount"] for j in chosen)) > total:
            best, total = chosen, t
    return best


def test_best_combination_single_exclusive_entry(spark):
    ds = [{"id": "only", "priority": 3, "stacking": "exclusive", **pct(30)}]
    out = evaluate(carts(spark, [("p", "c", 1.0, 100.0)]), ds, "bestCombination").first()
    assert [a["discountId"] for a in out["appliedDiscounts"]] == ["only"]


def test_native_best_combination_matches_model(spark):
    import random

    from tillwright.operators.pricing import evaluate as ev

    rnd = random.Random(17)
    rows = []
    for _ in range(300):
        n = rnd.randint(0, 7)
        rows.append(([(-rnd.randint(0, 3), i, i, rnd.choice([None, 1.0, 2.0, 2.0, 5.0]),
                       rnd.choice(["stackable", "exclusive", "exclusiveByTarget"]),
                       rnd.choice(["cart", "product:a", "category:b"]), False) for i in range(n)],))
    df = spark.createDataFrame(rows, f"entries array<{ev.ENTRY.simpleString()}>")
    got = df.select("entries", ev.best_combination(F.col("entries")).alias("best")).collect()
    for r in got:
        es = [e.asDict() for e in r["entries"]]
        want = _model(es)
        assert [e["idx"] for e in r["best"]] == [es[j]["idx"] for j in want], es


def test_best_combination_of_thirty_entries(spark):
    from tillwright.operators.pricing import evaluate as ev

    es = [(-30 + i, i, i, 1.0, "stackable", f"product:{i % 3}", False) for i in range(29)]
    es.append((0, 29, 29, 12.0, "exclusiveByTarget", "product:2", False))
    df = spark.createDataFrame([(es,)], f"entries array<{ev.ENTRY.simpleString()}>")
    got = df.select(F.explode(ev.best_combination(F.col("entries"))).alias("e")).select("e.idx").collect()
    assert [r["idx"] for r in got] == [i for i in range(29) if i % 3 != 2] + [29]


def test_plan_does_not_grow_with_the_discounts(spark):
    """Ten thousand definitions give the plan of twenty, and the right amounts."""
    import time

    def many(n):
        out = []
        for i in range(n):
            d = {"id": f"d{i}", "priority": i % 7, "stacking": "stackable", "target": {"type": "cart"}, "value": {"type": "fixedAmount", "amount": 1 + i % 3},
                 "conditions": [{"type": "or", "conditions": [{"type": "minAmount", "amount": 10 * (i + 1)}, {"type": "not", "condition": {"type": "minQuantity", "quantity": 1}}]}]}
            if i % 2:
                d["code"] = f"CODE{i}"
            out.append(d)
        return out

    cart = [("c1", [(1, "p1", "a", 2.0, 50.0)], ["code1", "CODE9", "code19"], 5.0)]
    carts = spark.createDataFrame(cart, "cart_id string, items array<struct<line:int,productId:string,categoryId:string,quantity:double,unitPrice:double>>, "
                                        "appliedCodes array<string>, shippingAmount double").selectExpr(
        "*", "named_struct('id', 'x', 'group', 'g', 'tags', array('t'), 'isFirstPurchase', true) AS customer", "timestamp'2024-01-01' AS evaluationDate")
    planned, size, rows = {}, {}, {}
    for n in (20, 10_000):
        t = time.perf_counter()
        df = evaluate(carts, many(n), "all")
        plan = df._jdf.queryExecution().executedPlan()
        planned[n], size[n] = time.perf_counter() - t, len(df._jdf.queryExecution().analyzed().toString().split("\n"))
        rows[n] = df.first()
        assert plan is not None
    assert size[20] == size[10_000] and planned[10_000] < planned[20] + 5
    # the cart of 100 meets the first ten of them: five automatic ones and codes 1 and 9; code 19 needs 200
    for n in (20, 10_000):
        assert {a["discountId"] for a in rows[n]["appliedDiscounts"]} == {"d0", "d2", "d4", "d6", "d8", "d1", "d9"}
        assert [(r["code"], r["reason"]) for r in rows[n]["rejectedCodes"]] == [("code19", "Conditions not met")]


def test_every_condition_and_value_by_rows(spark):
    """Conditions that no query uses, nested, on products, tags and dates."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tillwright.operators.pricing.conditions import condition
    from tillwright.operators.pricing.values import discount_amount

    cart = spark.createDataFrame([([(1, "p1", "a", 2.0, 50.0), (2, "p2", None, 3.0, 10.0)], ["vip"], dt.datetime(2024, 5, 5))],
                                 "items array<struct<line:int,productId:string,categoryId:string,quantity:double,unitPrice:double>>, tags array<string>, evaluationDate timestamp")
    cart = cart.selectExpr("*", "named_struct('group', 'gold', 'tags', tags, 'isFirstPurchase', false) AS customer", "5.0D AS shippingAmount")
    quantity = lambda n, *ids: {"type": "minQuantity", "quantity": n, "productIds": list(ids)}
    true = [quantity(3, "p2"), quantity(5), {"type": "dateRange", "from": "2024-05-01", "until": "2024-05-31T00:00:00Z"}, {"type": "dateRange"},
            {"type": "customerTag", "tags": ["x", "vip"]}, {"type": "requiredProducts", "productIds": ["p1", "p2"], "minQuantity": 2}, {"type": "requiredProducts"},
            {"type": "and", "conditions": []}, {"type": "customerGroup", "groups": ["gold"]},
            {"type": "or", "conditions": [quantity(9), {"type": "and", "conditions": [quantity(1), {"type": "not", "condition": {"type": "firstPurchase"}}]}]}]
    false = [quantity(4, "p2"), quantity(1, "p3"), {"type": "dateRange", "from": "2024-06-01"}, {"type": "customerTag", "tags": []}, {"type": "customerTag", "tags": ["y"]},
             {"type": "requiredProducts", "productIds": ["p1", "p3"]}, {"type": "requiredProducts", "productIds": ["p1"], "minQuantity": 3}, {"type": "or", "conditions": []},
             {"type": "minAmount", "amount": 131}, {"type": "customerGroup"}, {"type": "firstPurchase"}]
    row = cart.select(*[condition(c).alias(f"c{i}") for i, c in enumerate(true + false)]).first()
    assert list(row) == [True] * len(true) + [False] * len(false)
    product, whole = {"type": "product", "productIds": ["p2"]}, {"type": "cart"}
    worth = [
        ({"type": "percentage", "percentage": 10}, product, 3.0), ({"type": "percentage", "percentage": 50, "maxAmount": 40}, whole, 40.0),
        ({"type": "buyXGetY", "buyQuantity": 2, "getQuantity": 1, "discountPercentage": 100, "getProductIds": ["p1"]}, whole, 50.0),
        ({"type": "buyXGetY", "buyQuantity": 1, "getQuantity": 1, "discountPercentage": 50}, whole, 10.0),
        ({"type": "tiered", "tierBy": "quantity", "tiers": [{"threshold": 2, "percentage": 10}, {"threshold": 5, "fixedAmount": 7}]}, whole, 7.0),
        ({"type": "tiered", "tierBy": "amount", "tiers": [{"threshold": 500, "percentage": 10}]}, whole, None),
        ({"type": "bundle", "items": [{"productId": "p1", "quantity": 1}, {"productId": "p2", "quantity": 2}], "bundlePrice": 60}, whole, 10.0),
        ({"type": "bundle", "items": [{"productId": "p1", "quantity": 3}], "bundlePrice": 60}, whole, None),
        ({"type": "freeShipping"}, {"type": "shipping"}, 5.0), ({"type": "fixedAmount", "amount": 500}, {"type": "category", "categoryIds": ["a"]}, 100.0),
        ({"type": "fixedAmount", "amount": 5}, {"type": "product", "productIds": ["none"]}, None)]
    row = cart.select(*[F.round(discount_amount({"target": t, "value": v}), 6).alias(f"v{i}") for i, (v, t, _) in enumerate(worth)]).first()
    assert list(row) == [w for _, _, w in worth]


def test_requests_of_one_code_are_shared_by_tasks(spark):
    from pyspark.sql import functions as F

    from tillwright.operators.pricing.codes import validate_codes
    from tillwright.plans.suite_pricing import VIP

    req = spark.range(4000).select(F.col("id").alias("cart_id"), F.when(F.col("id") < 3000, "MANY").otherwise("GEN").alias("code"), (F.col("id") % 50).cast("string").alias("customerId"))
    generated = spark.createDataFrame([("GEN", "d", None), ("X", "d", "u")], "code string, discountId string, usedBy string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = validate_codes(req, [{**VIP, "id": "d", "conditions": []}], generated)
        found = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if("valid").alias("v")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in found) == 4000 and sum(r.v for r in found) == 1000 and max(r.n for r in found) < 2000
