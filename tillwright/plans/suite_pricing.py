"""Registered pricing queries: orders are carts, lineitems their lines, part
types the categories, the customer's segment its group and its first order
its first purchase.  Promo codes come from the order priority.

Amounts are not rounded: the SQL sums in the same left-to-right order as the
per-cart folds, so both engines produce the same doubles, and rounding would
only reintroduce engine-specific half-way cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.pricing.carts import build_carts
from ..operators.pricing.codes import generate_codes, validate_codes
from ..operators.pricing.conditions import condition
from ..operators.pricing.evaluate import evaluate, rejection, with_defaults
from ..operators.pricing.values import discount_amount

P_BUNDLE = 42

DISCOUNTS = [
    {"id": "d_cart10", "target": {"type": "cart"}, "value": {"type": "percentage", "percentage": 10},
     "conditions": [{"type": "minAmount", "amount": 300000}], "priority": 1},
    {"id": "d_promo20", "target": {"type": "category", "categoryIds": ["PROMO"]},
     "value": {"type": "percentage", "percentage": 20, "maxAmount": 5000}, "priority": 5,
     "stacking": "exclusiveByTarget"},
    {"id": "d_promo_fixed", "target": {"type": "category", "categoryIds": ["PROMO"]},
     "value": {"type": "fixedAmount", "amount": 3000}, "priority": 4, "stacking": "exclusiveByTarget"},
    {"id": "d_small_bxgy", "target": {"type": "category", "categoryIds": ["SMALL"]},
     "value": {"type": "buyXGetY", "buyQuantity": 20, "getQuantity": 5, "discountPercentage": 50}, "priority": 3},
    {"id": "d_tiers", "target": {"type": "cart"},
     "value": {"type": "tiered", "tierBy": "amount", "tiers": [
         {"threshold": 100000, "percentage": 2}, {"threshold": 250000, "percentage": 4},
         {"threshold": 50000, "fixedAmount": 500}]}, "priority": 0},
    {"id": "d_bundle", "target": {"type": "cart"},
     "value": {"type": "bundle", "items": [{"productId": P_BUNDLE, "quantity": 5}], "bundlePercentage": 30},
     "priority": 2},
    {"id": "d_ship", "target": {"type": "shipping"}, "value": {"type": "freeShipping"},
     "conditions": [{"type": "customerGroup", "groups": ["BUILDING"]}, {"type": "firstPurchase"}], "priority": 4},
    {"id": "d_inactive", "status": "inactive", "target": {"type": "cart"},
     "value": {"type": "percentage", "percentage": 50}},
    {"id": "c_urgent", "code": "URGENT10", "target": {"type": "cart"}, "value": {"type": "percentage", "percentage": 10},
     "priority": 10, "stacking": "exclusive", "usageLimit": 1000, "currentUsage": 3},
    {"id": "c_high", "code": "HIGH5", "target": {"type": "cart"}, "value": {"type": "fixedAmount", "amount": 5000},
     "priority": 1, "validUntil": dt.datetime(1998, 1, 1)},
    {"id": "c_limit", "code": "LIMIT", "target": {"type": "cart"}, "value": {"type": "fixedAmount", "amount": 10},
     "usageLimit": 5, "currentUsage": 5},
    {"id": "c_notyet", "code": "NOTYET", "target": {"type": "cart"}, "value": {"type": "percentage", "percentage": 1},
     "validFrom": dt.datetime(1999, 1, 1)},
    {"id": "c_cond", "code": "COND", "target": {"type": "cart"}, "value": {"type": "fixedAmount", "amount": 100},
     "conditions": [{"type": "minQuantity", "quantity": 150}]},
]
BY_ID = {d["id"]: d for d in DISCOUNTS}


def pricing_carts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"))
    prio = F.col("o_orderpriority")
    codes = (F.when(prio == "1-URGENT", F.array(F.lit("URGENT10")))
             .when(prio == "2-HIGH", F.array(F.lit("high5"), F.lit("BOGUS")))
             .when(prio == "3-MEDIUM", F.array(F.lit("LIMIT"), F.lit("NOTYET")))
             .when(prio == "4-NOT SPECIFIED", F.array(F.lit("COND"), F.lit("cond")))
             .otherwise(F.array().cast("array<string>")))
    carts = (o.join(c, o["o_custkey"] == c["c_custkey"]).join(first, "o_custkey")
             .select(F.col("o_orderkey").alias("cart_id"),
                     F.struct(F.col("o_custkey").alias("id"), F.col("c_mktsegment").alias("group"),
                              F.array(prio).alias("tags"),
                              (F.col("o_orderkey") == F.col("first_key")).alias("isFirstPurchase")).alias("customer"),
                     codes.alias("appliedCodes"), (F.col("o_totalprice") / 1000).alias("shippingAmount"),
                     F.col("o_orderdate").alias("evaluationDate")))
    lines = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_orderkey").alias("cart_id"),
        F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("line"),
        F.col("l_partkey").alias("productId"), F.col("p_type").alias("categoryId"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unitPrice"))
    return build_carts(carts, lines)


def _single(discount_id):
    def run(spark, sf_dir):
        carts = pricing_carts(spark, sf_dir)
        d = with_defaults(BY_ID[discount_id])
        amt = F.when(rejection(d).isNull(), discount_amount(d))
        return carts.select("cart_id", amt.alias("amount")).where("amount IS NOT NULL")
    run.__name__ = f"price_{discount_id}"
    return run


BASE_SQL = """
lines AS (
  SELECT l.l_orderkey AS cart_id, l.l_linenumber AS ln, l.l_partkey AS pid, l.l_extendedprice AS ep,
         p.p_type AS cat, l.l_quantity AS q, l.l_extendedprice / l.l_quantity AS price
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
carts AS (
  SELECT o.o_orderkey AS cart_id, c.c_mktsegment AS grp, o.o_orderkey = f.first_key AS is_first,
         o.o_orderpriority AS prio, o.o_totalprice / 1000 AS ship, o.o_orderdate AS d
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey) f ON o.o_custkey = f.o_custkey),
agg AS (
  SELECT cart_id,
         list_reduce(list(price * q ORDER BY ln, pid, ep), lambda a, b: a + b, 0.0::DOUBLE) AS subtotal,
         list_reduce(list(q ORDER BY ln, pid, ep), lambda a, b: a + b, 0.0::DOUBLE) AS tq,
         list_reduce(list(price * q * 10.0::DOUBLE / 100.0::DOUBLE ORDER BY ln, pid, ep),
                     lambda a, b: a + b, 0.0::DOUBLE) AS pct10,
         list_reduce(list(price * q * 1.0::DOUBLE / 100.0::DOUBLE ORDER BY ln, pid, ep),
                     lambda a, b: a + b, 0.0::DOUBLE) AS pct1,
         list_reduce(coalesce(list(price * q ORDER BY ln, pid, ep) FILTER (WHERE cat = 'PROMO'), []::DOUBLE[]),
                     lambda a, b: a + b, 0.0::DOUBLE) AS promo_total,
         count(*) FILTER (WHERE cat = 'PROMO') AS promo_n,
         list_reduce(coalesce(list(price * q * 20.0::DOUBLE / 100.0::DOUBLE ORDER BY ln, pid, ep)
                              FILTER (WHERE cat = 'PROMO'), []::DOUBLE[]),
                     lambda acc, x: acc + CASE WHEN least(x, 5000.0::DOUBLE - acc) > 0
                                               THEN least(x, 5000.0::DOUBLE - acc) ELSE 0.0::DOUBLE END,
                     0.0::DOUBLE) AS promo_pct,
         count(*) FILTER (WHERE cat = 'SMALL') AS small_n,
         first(q ORDER BY ln, pid, ep) FILTER (WHERE pid = 42) AS b_q,
         first(price ORDER BY ln, pid, ep) FILTER (WHERE pid = 42) AS b_price
  FROM lines GROUP BY cart_id),
small AS (
  SELECT cart_id, price, q, ln, pid, ep,
         sum(q) OVER (PARTITION BY cart_id) AS sq,
         coalesce(sum(q) OVER (PARTITION BY cart_id ORDER BY price, ln, pid, ep
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lines WHERE cat = 'SMALL'),
bx AS (
  SELECT cart_id, list_reduce(list(price * greatest(0.0::DOUBLE, least(q, floor(sq / 25.0::DOUBLE) * 5.0::DOUBLE - before))
                      * 50.0::DOUBLE / 100.0::DOUBLE ORDER BY price, ln, pid, ep), lambda a, b: a + b, 0.0::DOUBLE) AS a,
         max(floor(sq / 25.0::DOUBLE)) AS sets
  FROM small GROUP BY cart_id),
base AS (
  SELECT c.*, coalesce(a.subtotal, 0.0) AS subtotal, coalesce(a.tq, 0.0) AS tq, a.promo_total, coalesce(a.promo_n, 0) AS promo_n,
         a.promo_pct, coalesce(a.small_n, 0) AS small_n, a.b_q, a.b_price, CASE WHEN bx.sets > 0 THEN bx.a END AS bx_a,
         coalesce(a.pct10, 0.0) AS pct10, coalesce(a.pct1, 0.0) AS pct1
  FROM carts c LEFT JOIN agg a ON c.cart_id = a.cart_id LEFT JOIN bx ON c.cart_id = bx.cart_id),
amt AS (
  SELECT cart_id, subtotal, ship, prio, d,
    CASE WHEN subtotal >= 300000 AND pct10 > 0 THEN pct10 END AS d_cart10,
    CASE WHEN promo_n > 0 AND least(5000.0::DOUBLE, promo_pct) > 0 THEN least(5000.0::DOUBLE, promo_pct) END AS d_promo20,
    CASE WHEN promo_n > 0 AND least(3000.0::DOUBLE, promo_total) > 0 THEN least(3000.0::DOUBLE, promo_total) END AS d_promo_fixed,
    CASE WHEN small_n > 0 AND bx_a > 0 THEN bx_a END AS d_small_bxgy,
    CASE WHEN subtotal >= 250000 THEN subtotal * 4.0::DOUBLE / 100.0::DOUBLE
         WHEN subtotal >= 100000 THEN subtotal * 2.0::DOUBLE / 100.0::DOUBLE
         WHEN subtotal >= 50000 AND least(500.0::DOUBLE, subtotal) > 0 THEN least(500.0::DOUBLE, subtotal) END AS d_tiers,
    CASE WHEN b_q >= 5 AND b_price * 5.0::DOUBLE * 30.0::DOUBLE / 100.0::DOUBLE > 0
         THEN b_price * 5.0::DOUBLE * 30.0::DOUBLE / 100.0::DOUBLE END AS d_bundle,
    CASE WHEN grp = 'BUILDING' AND is_first AND ship > 0 THEN ship END AS d_ship,
    CASE WHEN prio = '1-URGENT' AND pct10 > 0 THEN pct10 END AS c_urgent,
    CASE WHEN prio = '2-HIGH' AND d <= TIMESTAMP '1998-01-01' AND least(5000.0::DOUBLE, subtotal) > 0
         THEN least(5000.0::DOUBLE, subtotal) END AS c_high,
    CASE WHEN prio = '3-MEDIUM' AND d >= TIMESTAMP '1999-01-01' AND pct1 > 0 THEN pct1 END AS c_notyet,
    CASE WHEN prio = '4-NOT SPECIFIED' AND tq >= 150 AND least(100.0::DOUBLE, subtotal) > 0
         THEN least(100.0::DOUBLE, subtotal) END AS c_cond
  FROM base)
"""


def _single_sql(col):
    return f"WITH {BASE_SQL} SELECT cart_id, {col} AS amount FROM amt WHERE {col} IS NOT NULL"


def _evaluated(spark, sf_dir, strategy):
    return evaluate(pricing_carts(spark, sf_dir), DISCOUNTS, strategy)


def _totals(df):
    n = F.size("appliedDiscounts").cast("long")
    return df.select("cart_id", n.alias("n_applied"), F.col("subtotal").alias("subtotal"),
                     F.col("totalDiscount").alias("total_discount"),
                     F.col("shippingDiscount").alias("shipping_discount"),
                     F.col("finalTotal").alias("final_total"))


def price_by_priority(spark, sf_dir):
    return _totals(_evaluated(spark, sf_dir, "byPriority")).drop("subtotal", "final_total")


def price_all(spark, sf_dir):
    return _totals(_evaluated(spark, sf_dir, "all")).drop("subtotal", "final_total")


def price_totals(spark, sf_dir):
    return _totals(_evaluated(spark, sf_dir, "byPriority"))


def price_none(spark, sf_dir):
    df = _evaluated(spark, sf_dir, "none")
    best = F.try_element_at(F.col("appliedDiscounts"), F.lit(1))
    return df.select("cart_id", best["amount"].alias("best_amount"))


def price_best_combination(spark, sf_dir):
    return _totals(_evaluated(spark, sf_dir, "bestCombination"))


def code_reasons(spark, sf_dir):
    df = _evaluated(spark, sf_dir, "byPriority")
    return df.select("cart_id", F.explode("rejectedCodes").alias("r")).select(
        "cart_id", F.col("r.code").alias("code"), F.col("r.reason").alias("reason"))


def codes_generated(spark, sf_dir):
    """One unique promo code per customer (seeded, reproducible)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return generate_codes(c.select(F.col("c_custkey").alias("owner")), length=8, prefix="VIP-",
                          pattern="alphanumeric", seed=7)


_ITEM_COLS = ["d_cart10", "d_promo20", "d_small_bxgy", "d_tiers", "d_bundle"]
_CODE_COLS = ["c_high", "c_notyet", "c_cond", "c_cond2"]


def _stack_sql(strategy: str) -> str:
    # Entries in the stacking order (priority desc, automatic ones before codes):
    # byPriority - an applicable URGENT10 code (priority 10, exclusive) stops the
    # fold; d_promo_fixed shares d_promo20's target and only follows it when
    # d_promo20 gives nothing, which needs PROMO lines, so it never applies.
    # ``all`` keeps every positive amount.  Sums run left to right like the fold.
    if strategy == "all":
        items = ["c_urgent", "d_promo20", "d_promo_fixed", "d_small_bxgy", "d_bundle", "d_cart10", "c_high",
                 "d_tiers", "c_notyet", "c_cond", "c_cond"]
    else:
        items = ["d_promo20", "d_small_bxgy", "d_bundle", "d_cart10", "c_high", "d_tiers", "c_notyet",
                 "c_cond", "c_cond"]
    lst = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    total = f"list_reduce({lst}, lambda a, b: a + b, 0.0::DOUBLE)"
    n = f"len({lst}) + CASE WHEN d_ship IS NOT NULL THEN 1 ELSE 0 END"
    if strategy == "byPriority":
        disc = f"CASE WHEN c_urgent IS NOT NULL THEN c_urgent ELSE {total} END"
        shipd = "CASE WHEN c_urgent IS NOT NULL THEN 0.0::DOUBLE ELSE coalesce(d_ship, 0.0::DOUBLE) END"
        n_all = f"CASE WHEN c_urgent IS NOT NULL THEN 1 ELSE {n} END"
    else:
        disc = total
        shipd = "coalesce(d_ship, 0.0::DOUBLE)"
        n_all = n
    return f"""
WITH {BASE_SQL}
SELECT cart_id, CAST({n_all} AS BIGINT) AS n_applied, subtotal AS subtotal,
       least({disc}, subtotal) AS total_discount, {shipd} AS shipping_discount,
       greatest(0.0::DOUBLE, subtotal - least({disc}, subtotal) + ship - {shipd}) AS final_total
FROM amt"""


def _best_sql() -> str:
    """The exclusive code alone, or everything else with the better of the two PROMO discounts."""
    promo = "CASE WHEN d_promo20 IS NULL OR d_promo_fixed >= d_promo20 THEN coalesce(d_promo_fixed, d_promo20) ELSE d_promo20 END"
    rest = "d_small_bxgy, d_bundle, d_cart10, c_high, d_tiers, c_notyet, c_cond, c_cond"
    sum_of = lambda xs: f"list_reduce(list_filter([{xs}], lambda x: x IS NOT NULL), lambda a, b: a + b, 0.0::DOUBLE)"
    return f"""
WITH {BASE_SQL},
tried AS (
  SELECT *, {sum_of(f"{promo}, d_ship, {rest}")} AS joint, {sum_of(f"{promo}, {rest}")} AS items,
         len(list_filter([{promo}, d_ship, {rest}], lambda x: x IS NOT NULL)) AS n FROM amt),
best AS (SELECT *, c_urgent IS NOT NULL AND round(c_urgent, 6) > round(joint, 6) AS alone FROM tried),
given AS (SELECT *, CASE WHEN alone THEN c_urgent ELSE items END AS disc, CASE WHEN alone THEN 0.0::DOUBLE ELSE coalesce(d_ship, 0.0::DOUBLE) END AS shipd FROM best)
SELECT cart_id, CAST(CASE WHEN alone THEN 1 ELSE n END AS BIGINT) AS n_applied, subtotal AS subtotal, least(disc, subtotal) AS total_discount,
       shipd AS shipping_discount, greatest(0.0::DOUBLE, subtotal - least(disc, subtotal) + ship - shipd) AS final_total
FROM given"""


def _drop_cols(sql: str, *cols: str) -> str:
    return f"SELECT * EXCLUDE ({', '.join(cols)}) FROM ({sql})"


PRICE_NONE_SQL = f"""
WITH {BASE_SQL}
SELECT cart_id, (list_max(list_filter([d_cart10, d_promo20, d_promo_fixed, d_small_bxgy, d_tiers, d_bundle,
        d_ship, c_urgent, c_high, c_notyet, c_cond], lambda x: x IS NOT NULL))) AS best_amount
FROM amt
"""

CODE_REASONS_SQL = f"""
WITH {BASE_SQL},
codes AS (
  SELECT cart_id, d, tq,
         CASE prio WHEN '1-URGENT' THEN ['URGENT10'] WHEN '2-HIGH' THEN ['high5', 'BOGUS']
                   WHEN '3-MEDIUM' THEN ['LIMIT', 'NOTYET'] WHEN '4-NOT SPECIFIED' THEN ['COND', 'cond']
                   ELSE []::VARCHAR[] END AS cs
  FROM base),
each AS (SELECT cart_id, d, tq, unnest(cs) AS code, unnest(range(len(cs))) AS pos FROM codes),
why AS (
  SELECT cart_id, CAST(pos AS INTEGER) AS pos, code,
         CASE upper(code)
           WHEN 'URGENT10' THEN NULL
           WHEN 'HIGH5' THEN CASE WHEN d > TIMESTAMP '1998-01-01' THEN 'Discount has expired' END
           WHEN 'LIMIT' THEN 'Discount usage limit reached'
           WHEN 'NOTYET' THEN CASE WHEN d < TIMESTAMP '1999-01-01' THEN 'Discount is not yet valid' END
           WHEN 'COND' THEN CASE WHEN NOT (tq >= 150) THEN 'Conditions not met' END
           ELSE 'Invalid code' END AS reason
  FROM each)
SELECT cart_id, code, reason FROM why WHERE reason IS NOT NULL
"""

VIP = {"id": "c_vip", "target": {"type": "cart"}, "value": {"type": "percentage", "percentage": 5},
       "usageLimitPerCustomer": 2, "conditions": [{"type": "minQuantity", "quantity": 100}]}


def code_validation(spark, sf_dir):
    """Batch code validation: generated per-customer codes (some redeemed, some
    pointing at a removed discount), static codes, the usage ledger from
    finished orders, conditions over each order's own lines."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    generated = c.select(F.concat(F.lit("VIP-"), F.col("c_custkey").cast("string")).alias("code"),
                         F.when(F.col("c_nationkey") == 24, F.lit("gone")).otherwise(F.lit("c_vip")).alias("discountId"),
                         F.when(F.col("c_acctbal") < 0, F.col("c_custkey").cast("string")).alias("usedBy"))
    usage = o.where(F.col("o_orderstatus") == "F").select(F.lit("c_vip").alias("discountId"),
                                                          F.col("o_custkey").cast("string").alias("customerId"))
    prio = F.col("o_orderpriority")
    code = (F.when(prio == "1-URGENT", F.concat(F.lit("VIP-"), F.col("o_custkey").cast("string")))
            .when(prio == "2-HIGH", F.lit("HIGH5")).when(prio == "3-MEDIUM", F.lit("high5"))
            .when(prio == "4-NOT SPECIFIED", F.lit("LIMIT")).otherwise(F.lit("NOTYET")))
    carts = pricing_carts(spark, sf_dir).select("cart_id", "items")
    req = o.select(F.col("o_orderkey").alias("cart_id"), code.alias("code"),
                   F.col("o_custkey").cast("string").alias("customerId"),
                   F.col("o_orderdate").alias("evaluationDate")).join(carts, "cart_id", "left")
    out = validate_codes(req, DISCOUNTS + [VIP], generated, usage)
    return out.select("cart_id", "code", "discountId", "valid", "reason",
                      F.array_join("conditionsNotMet", ",").alias("conditions_not_met"))


CODE_VALIDATION_SQL = """
WITH uses AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
lq AS (SELECT l_orderkey, sum(l_quantity) AS tq FROM lineitem GROUP BY l_orderkey),
r AS (
  SELECT o.o_orderkey AS cart_id, o.o_orderdate AS d, coalesce(lq.tq, 0) AS tq, coalesce(u.n, 0) AS uses,
         c.c_nationkey, c.c_acctbal,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'VIP-' || CAST(o.o_custkey AS VARCHAR) WHEN '2-HIGH' THEN 'HIGH5'
              WHEN '3-MEDIUM' THEN 'high5' WHEN '4-NOT SPECIFIED' THEN 'LIMIT' ELSE 'NOTYET' END AS code
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN lq ON lq.l_orderkey = o.o_orderkey LEFT JOIN uses u ON u.o_custkey = o.o_custkey),
v AS (
  SELECT cart_id, code,
    CASE WHEN starts_with(code, 'VIP-') THEN CASE WHEN c_nationkey = 24 THEN NULL ELSE 'c_vip' END
         WHEN code = 'HIGH5' THEN 'c_high' WHEN code = 'LIMIT' THEN 'c_limit' WHEN code = 'NOTYET' THEN 'c_notyet' END
      AS "discountId",
    CASE WHEN starts_with(code, 'VIP-') THEN
           CASE WHEN c_acctbal < 0 THEN 'Code has already been redeemed'
                WHEN c_nationkey = 24 THEN 'Discount no longer exists'
                WHEN uses >= 2 THEN 'Customer usage limit reached'
                WHEN tq < 100 THEN 'Conditions not met' END
         WHEN code = 'HIGH5' THEN CASE WHEN d > TIMESTAMP '1998-01-01' THEN 'Discount has expired' END
         WHEN code = 'LIMIT' THEN 'Usage limit reached'
         WHEN code = 'NOTYET' THEN CASE WHEN d < TIMESTAMP '1999-01-01' THEN 'Discount is not yet active' END
         ELSE 'Invalid code' END AS reason
  FROM r)
SELECT cart_id, code, "discountId", reason IS NULL AS valid, reason,
       CASE WHEN reason = 'Conditions not met' THEN 'minQuantity' END AS conditions_not_met
FROM v
"""

# -- K3, K6-K8 and the forms of values that the definitions above do not use ---------------------

POOL = list(range(0, 200, 3))
DATES = {"type": "dateRange", "from": dt.datetime(1996, 1, 1), "until": dt.datetime(1997, 12, 31)}
TAGGED = {"type": "customerTag", "tags": ["1-URGENT", "2-HIGH"]}
REQUIRED = {"type": "requiredProducts", "productIds": [P_BUNDLE], "minQuantity": 3}
CHECKED = {
    "in_dates": DATES, "tagged": TAGGED, "has_product": REQUIRED, "enough": {"type": "minQuantity", "quantity": 5, "productIds": POOL},
    "nested": {"type": "or", "conditions": [{"type": "and", "conditions": [{"type": "not", "condition": DATES}, TAGGED]}, REQUIRED]}}
WORTH = {
    "off_products": ({"type": "product", "productIds": POOL}, {"type": "percentage", "percentage": 5}),
    "off_quantity": ({"type": "cart"}, {"type": "tiered", "tierBy": "quantity", "tiers": [{"threshold": 50, "fixedAmount": 40}, {"threshold": 100, "percentage": 3}]}),
    "off_bundle": ({"type": "cart"}, {"type": "bundle", "items": [{"productId": P_BUNDLE, "quantity": 2}], "bundlePrice": 100}),
    "off_free": ({"type": "cart"}, {"type": "buyXGetY", "buyQuantity": 10, "getQuantity": 2, "discountPercentage": 100, "getProductIds": POOL})}


def price_conditions(spark, sf_dir):
    """Conditions on dates, tags and products, nested, for every cart."""
    return pricing_carts(spark, sf_dir).select("cart_id", *[condition(c).alias(n) for n, c in CHECKED.items()])


def price_values(spark, sf_dir):
    """Amounts off products, by quantity, for a bundle and for free products, for every cart."""
    return pricing_carts(spark, sf_dir).select("cart_id", *[F.round(discount_amount({"target": t, "value": v}), 4).alias(n) for n, (t, v) in WORTH.items()])


_POOL_SQL = f"pid IN ({', '.join(map(str, POOL))})"
PRICE_CONDITIONS_SQL = f"""
WITH {BASE_SQL},
pool AS (SELECT cart_id, sum(q) AS pq FROM lines WHERE {_POOL_SQL} GROUP BY cart_id),
k AS (SELECT cart_id, d BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AS in_dates, prio IN ('1-URGENT', '2-HIGH') AS tagged,
             coalesce(b_q >= 3, false) AS has_product, coalesce(pq, 0) >= 5 AS enough FROM base LEFT JOIN pool USING (cart_id))
SELECT *, (NOT in_dates AND tagged) OR has_product AS nested FROM k
"""
PRICE_VALUES_SQL = f"""
WITH {BASE_SQL},
pool AS (
  SELECT *, coalesce(sum(q) OVER (PARTITION BY cart_id ORDER BY price, ln, pid, ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lines WHERE {_POOL_SQL}),
free AS (
  SELECT cart_id, list_reduce(list(price * q * 5.0::DOUBLE / 100.0::DOUBLE ORDER BY ln, pid, ep), lambda a, b: a + b, 0.0::DOUBLE) AS pct,
         list_reduce(list(price * greatest(0.0::DOUBLE, least(q, floor(tq / 12.0::DOUBLE) * 2.0::DOUBLE - before)) * 100.0::DOUBLE / 100.0::DOUBLE ORDER BY price, ln, pid, ep),
                     lambda a, b: a + b, 0.0::DOUBLE) AS off
  FROM pool JOIN base USING (cart_id) GROUP BY cart_id)
SELECT cart_id, CASE WHEN pct > 0 THEN round(pct, 4) END AS off_products,
       CASE WHEN tq >= 100 AND subtotal > 0 THEN round(subtotal * 3 / 100, 4) WHEN tq >= 50 AND subtotal > 0 THEN round(least(40.0, subtotal), 4) END AS off_quantity,
       CASE WHEN b_q >= 2 AND b_price * 2 > 100 THEN round(b_price * 2 - 100, 4) END AS off_bundle, CASE WHEN off > 0 THEN round(off, 4) END AS off_free
FROM base LEFT JOIN free USING (cart_id)
"""


QUERIES = {
    "price_conditions": price_conditions,
    "price_values": price_values,
    "price_percentage": _single("d_promo20"),
    "price_fixed": _single("d_promo_fixed"),
    "price_bxgy": _single("d_small_bxgy"),
    "price_tiered": _single("d_tiers"),
    "price_bundle": _single("d_bundle"),
    "price_free_shipping": _single("d_ship"),
    "price_by_priority": price_by_priority,
    "price_none": price_none,
    "price_all": price_all,
    "price_totals": price_totals,
    "code_reasons": code_reasons,
    "price_best_combination": price_best_combination,
    "codes_generated": codes_generated,
    "code_validation": code_validation,
}

ORACLE = {
    "price_conditions": PRICE_CONDITIONS_SQL,
    "price_values": PRICE_VALUES_SQL,
    "price_best_combination": _best_sql(),
    "price_percentage": _single_sql("d_promo20"),
    "price_fixed": _single_sql("d_promo_fixed"),
    "price_bxgy": _single_sql("d_small_bxgy"),
    "price_tiered": _single_sql("d_tiers"),
    "price_bundle": _single_sql("d_bundle"),
    "price_free_shipping": _single_sql("d_ship"),
    "price_by_priority": _drop_cols(_stack_sql("byPriority"), "subtotal", "final_total"),
    "price_none": PRICE_NONE_SQL,
    "price_all": _drop_cols(_stack_sql("all"), "subtotal", "final_total"),
    "price_totals": _stack_sql("byPriority"),
    "code_reasons": CODE_REASONS_SQL,
    "code_validation": CODE_VALIDATION_SQL,
}
