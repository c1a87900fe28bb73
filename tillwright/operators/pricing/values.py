"""Discount amounts (targets and value types) as folds over a cart, interpreted
from the fields of a definition row (``table.SCHEMA``).

``amount(d)`` is what the discount gives the cart row, or NULL when it gives
none (no eligible line for a product / category target, or an amount <= 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .carts import first_line_of, line_total, sum_over
from .table import one


def eligible_items(d: Column) -> Column:
    items = F.col("items")
    inside = lambda x: F.coalesce(
        F.when(d["target"] == "cart", F.lit(True)).when(d["target"] == "product", F.array_contains(d["targetIds"], x["productId"].cast("string")))
        .when(d["target"] == "category", F.array_contains(d["targetIds"], x["categoryId"].cast("string"))), F.lit(False))
    return F.filter(items, inside)


def _percentage(d: Column, items: Column) -> Column:
    def step(acc, x):
        part = line_total(x) * d["percentage"] / F.lit(100.0)
        part = F.when(d["maxAmount"].isNull(), part).otherwise(F.least(part, d["maxAmount"] - acc))
        return acc + F.when(part > 0, part).otherwise(F.lit(0.0))

    return F.aggregate(items, F.lit(0.0), step)


def _buy_x_get_y(d: Column, items: Column) -> Column:
    sets = F.floor(sum_over(items, lambda x: x["quantity"]) / (d["buy"] + d["get"]))
    pool = F.when(d["getIds"].isNull(), items).otherwise(F.filter(F.col("items"), lambda x: F.array_contains(d["getIds"], x["productId"].cast("string"))))
    # cheapest first; equal prices keep cart line order
    ordered = F.sort_array(F.transform(pool, lambda x: F.struct(x["unitPrice"].alias("p"), x["line"].alias("l"), x["quantity"].alias("q"))))

    def step(acc, x):
        take = F.least(x["q"], acc["left"])
        use = acc["left"] > 0
        add = F.when(use, x["p"] * take * d["percentage"] / F.lit(100.0)).otherwise(F.lit(0.0))
        return F.struct((acc["left"] - F.when(use, take).otherwise(F.lit(0.0))).alias("left"), (acc["total"] + add).alias("total"))

    start = F.struct((sets * d["get"]).cast("double").alias("left"), F.lit(0.0).alias("total"))
    return F.when(sets == 0, F.lit(0.0)).otherwise(F.aggregate(ordered, start, step)["total"])


def _tiered(d: Column, items: Column) -> Column:
    total = sum_over(items, line_total)
    measure = F.when(d["tierBy"] == "amount", total).otherwise(sum_over(items, lambda x: x["quantity"]))
    # tiers are stored highest first
    reached = F.get(F.filter(d["tiers"], lambda t: measure >= t["threshold"]), F.lit(0))
    given = (F.when(reached["percentage"].isNotNull(), total * reached["percentage"] / F.lit(100.0))
             .when(reached["fixed"].isNotNull(), F.least(reached["fixed"], total)))
    return F.coalesce(given, F.lit(0.0))


def _bundle(d: Column) -> Column:
    items = F.col("items")

    def step(acc, b):
        line = first_line_of(items, b["productId"])
        ok = F.coalesce(line.isNotNull() & (line["quantity"] >= b["quantity"]), F.lit(False))
        return F.struct((acc["ok"] & ok).alias("ok"), (acc["sum"] + F.coalesce(line["unitPrice"] * b["quantity"], F.lit(0.0))).alias("sum"))

    seen = F.aggregate(d["bundle"], F.struct(F.lit(True).alias("ok"), F.lit(0.0).alias("sum")), step)
    off = F.when(d["bundlePrice"].isNotNull(), seen["sum"] - d["bundlePrice"]).when(d["bundlePercentage"].isNotNull(), seen["sum"] * d["bundlePercentage"] / F.lit(100.0))
    return F.when((F.size(d["bundle"]) > 0) & seen["ok"], F.greatest(F.lit(0.0), F.coalesce(off, F.lit(0.0)))).otherwise(F.lit(0.0))


def raw_amount(d: Column, items: Column) -> Column:
    return (F.when(d["type"] == "percentage", _percentage(d, items))
            .when(d["type"] == "fixedAmount", F.least(d["amount"], sum_over(items, line_total)))
            .when(d["type"] == "buyXGetY", _buy_x_get_y(d, items))
            .when(d["type"] == "tiered", _tiered(d, items))
            .when(d["type"] == "bundle", _bundle(d))
            .when(d["type"] == "freeShipping", F.coalesce(F.col("shippingAmount").cast("double"), F.lit(0.0))))


def amount(d: Column) -> Column:
    """Amount given to the cart, NULL for none; ``d`` is a definition row."""
    def worth(items):
        off = raw_amount(d, items)
        return F.when((off > 0) & (d["target"].isin("cart", "shipping") | (F.size(items) > 0)), off)

    return F.get(F.transform(F.array(eligible_items(d)), worth), F.lit(0))  # eligible lines once


def discount_amount(discount: dict) -> Column:
    """Amount of one definition."""
    return amount(one(discount))
