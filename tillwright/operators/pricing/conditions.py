"""Discount conditions over a cart row, interpreted from postfix programs (``table.postfix``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .carts import first_line_of, subtotal, sum_over
from .table import TOKEN, literal, postfix


def now_col() -> Column:
    return F.coalesce(F.col("evaluationDate"), F.current_timestamp())


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _leaf(t: Column) -> Column:
    """Whether the cart row meets one token that is no ``and`` / ``or`` / ``not``."""
    items, now = F.col("items"), F.unix_micros(now_col())
    some = F.filter(items, lambda x: F.array_contains(t["ids"], x["productId"].cast("string")))
    quantity = sum_over(F.when(F.size(t["ids"]) > 0, some).otherwise(items), lambda x: x["quantity"])

    def there(pid):
        line = first_line_of(items, pid)
        return line.isNotNull() & (t["quantity"].isNull() | _no(line["quantity"] >= t["quantity"]))

    return (F.when(t["op"] == "minAmount", _no(subtotal(items) >= t["amount"]))
            .when(t["op"] == "minQuantity", _no(quantity >= t["quantity"]))
            .when(t["op"] == "dateRange", (t["from"].isNull() | _no(now >= t["from"])) & (t["until"].isNull() | _no(now <= t["until"])))
            .when(t["op"] == "customerGroup", _no(F.array_contains(t["ids"], F.col("customer.group").cast("string"))))
            .when(t["op"] == "firstPurchase", F.col("customer.isFirstPurchase").eqNullSafe(F.lit(True)))
            .when(t["op"] == "customerTag", _no(F.exists(F.col("customer.tags"), lambda x: F.array_contains(t["ids"], x.cast("string")))))
            .when(t["op"] == "requiredProducts", F.forall(t["ids"], there))
            .otherwise(F.lit(False)))


def holds(program: Column) -> Column:
    """The verdict of a postfix program: leaves go on a stack, ``and`` / ``or`` / ``not`` take theirs off it."""
    def step(stack, t):
        left = F.size(stack) - t["n"]
        taken = F.slice(stack, left + 1, t["n"])
        joined = (F.when(t["op"] == "and", F.forall(taken, lambda x: x)).when(t["op"] == "or", F.exists(taken, lambda x: x))
                  .when(t["op"] == "not", ~F.element_at(taken, 1)).otherwise(_leaf(t)))
        return F.concat(F.slice(stack, F.lit(1), left), F.array(joined))

    return F.element_at(F.aggregate(program, F.array().cast("array<boolean>"), step), -1)


def all_hold(conditions: Column) -> Column:
    return F.forall(conditions, lambda c: holds(c["program"]))


def failed(conditions: Column) -> Column:
    """Types of the conditions that do not hold."""
    return F.transform(F.filter(conditions, lambda c: ~holds(c["program"])), lambda c: c["type"])


def condition(c: dict) -> Column:
    """One condition, given as a definition."""
    return holds(literal(postfix(c), TOKEN))
