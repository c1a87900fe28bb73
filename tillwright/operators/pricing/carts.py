"""Cart frames: one row per cart with its lines as an ordered array.

Cart-level rules (running caps, cheapest-first free units, first line of a
product) are sequential *within* a cart, so lines are gathered per cart with
``collect_list`` - bounded by the size of a cart, never by the table - and
folded with higher-order functions (``aggregate``, ``filter``,
``transform``), all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_FIELDS = ("line", "productId", "categoryId", "quantity", "unitPrice")


def build_carts(carts: DataFrame, lines: DataFrame, cart_key: str = "cart_id") -> DataFrame:
    """``carts(cart_id, customer, appliedCodes, shippingAmount, evaluationDate)``
    plus ``lines(cart_id, line, productId, categoryId, quantity, unitPrice)``
    -> carts with ``items`` sorted by line number (carts without lines get [])."""
    item = F.struct(*[F.col(c) for c in ITEM_FIELDS])
    per_cart = lines.groupBy(F.col(cart_key).alias("__cid")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = carts.join(per_cart, carts[cart_key] == per_cart["__cid"], "left").drop("__cid")
    return out.withColumn("items", F.coalesce(F.col("items"), F.array().cast(per_cart.schema["items"].dataType)))


def line_total(x: Column) -> Column:
    return x["unitPrice"] * x["quantity"]


def sum_over(arr: Column, fn) -> Column:
    """Left-to-right double sum (same order as the original's reduce)."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + fn(x).cast("double"))


def subtotal(items: Column) -> Column:
    return sum_over(items, line_total)


def first_line_of(items: Column, product_id) -> Column:
    """The first cart line holding ``product_id`` (NULL when absent)."""
    wanted = product_id if isinstance(product_id, Column) else F.lit(str(product_id))
    return F.get(F.filter(items, lambda x: x["productId"].cast("string") == wanted), F.lit(0))
