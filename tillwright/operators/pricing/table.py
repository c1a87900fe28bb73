"""Discount definitions as data.

Definitions become the rows of one typed array literal, and the plan of a cart
evaluation is the same for ten of them and for ten thousand: value types,
targets and conditions are interpreted per row by functions of that row's
fields (``values.amount``, ``conditions.holds``).  A condition tree is stored in
postfix order, every ``and`` / ``or`` / ``not`` after its parts with their number.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<op:string,n:int,amount:double,quantity:double,ids:array<string>,from:bigint,until:bigint>"
SCHEMA = (
    "struct<idx:int,id:string,code:string,priority:bigint,stacking:string,status:string,validFrom:bigint,validUntil:bigint,"
    "usageLimit:double,usageLimitPerCustomer:double,currentUsage:double,target:string,targetIds:array<string>,targetKey:string,"
    "type:string,percentage:double,maxAmount:double,amount:double,buy:double,get:double,getIds:array<string>,tierBy:string,"
    "tiers:array<struct<threshold:double,percentage:double,fixed:double>>,bundle:array<struct<productId:string,quantity:double>>,"
    f"bundlePrice:double,bundlePercentage:double,conditions:array<struct<type:string,program:array<{TOKEN}>>>>")


def with_defaults(d: dict) -> dict:
    out = {"conditions": [], "priority": 0, "stacking": "stackable", "currentUsage": 0, "status": "active"}
    out.update({k: v for k, v in d.items() if v is not None})
    return out


def target_key(d: dict) -> str:
    t = d["target"]
    if t["type"] in ("cart", "shipping"):
        return t["type"]
    ids = t.get("productIds") if t["type"] == "product" else t.get("categoryIds")
    return f"{t['type']}:" + ",".join(sorted(str(x) for x in ids or []))


def micros(v) -> int | None:
    """UTC microseconds of a datetime or ISO text."""
    if not v:
        return None
    t = v if isinstance(v, _dt.datetime) else _dt.datetime.fromisoformat(str(v).replace("Z", ""))
    t = t if t.tzinfo else t.replace(tzinfo=_dt.UTC)
    return (t - _dt.datetime(1970, 1, 1, tzinfo=_dt.UTC)) // _dt.timedelta(microseconds=1)


def _number(v) -> float | None:
    return None if v is None else float(v)


def _texts(v) -> list[str] | None:
    return None if v is None else [str(x) for x in v]


_LISTS = {"minQuantity": "productIds", "customerGroup": "groups", "customerTag": "tags", "requiredProducts": "productIds"}
_NUMBERS = {"minAmount": ("amount", "amount"), "minQuantity": ("quantity", "quantity"), "requiredProducts": ("quantity", "minQuantity")}


def postfix(c: dict) -> list[dict]:
    """The condition tree as tokens, parts before what joins them."""
    t = c["type"]
    if t in ("and", "or", "not"):
        parts = [c["condition"]] if t == "not" else list(c.get("conditions") or [])
        return [x for p in parts for x in postfix(p)] + [{"op": t, "n": len(parts)}]
    if t not in {*_LISTS, *_NUMBERS, "dateRange", "firstPurchase"}:
        raise ValueError(f"unknown condition type {t!r}")
    token = {"op": t, "n": 0}
    if t in _LISTS:
        token["ids"] = _texts(c.get(_LISTS[t]) or [])
    if t in _NUMBERS:
        to, of = _NUMBERS[t]
        token[to] = _number(c.get(of) or None) if t == "requiredProducts" else _number(c[of])
    if t == "dateRange":
        token |= {"from": micros(c.get("from")), "until": micros(c.get("until"))}
    return [token]


def row(d: dict, idx: int) -> dict:
    """One definition as a row of ``SCHEMA``."""
    d = with_defaults(d)
    t, v = d["target"], d["value"]
    if t["type"] not in ("cart", "shipping", "product", "category"):
        raise ValueError(f"unknown target type {t['type']!r}")
    if v["type"] not in ("percentage", "fixedAmount", "buyXGetY", "tiered", "bundle", "freeShipping"):
        raise ValueError(f"unknown value type {v['type']!r}")
    tiers = sorted(v.get("tiers") or [], key=lambda x: -float(x["threshold"]))  # stable, highest first
    return {
        "idx": idx, "id": str(d.get("id", idx)), "code": d.get("code") or None, "priority": int(d["priority"]), "stacking": d["stacking"],
        "status": d["status"], "validFrom": micros(d.get("validFrom")), "validUntil": micros(d.get("validUntil")),
        "usageLimit": _number(d.get("usageLimit")), "usageLimitPerCustomer": _number(d.get("usageLimitPerCustomer")), "currentUsage": float(d["currentUsage"]),
        "target": t["type"], "targetIds": _texts(t.get("productIds" if t["type"] == "product" else "categoryIds") or []), "targetKey": target_key(d),
        "type": v["type"], "percentage": _number(v.get("discountPercentage") if v["type"] == "buyXGetY" else v.get("percentage")), "maxAmount": _number(v.get("maxAmount")), "amount": _number(v.get("amount")),
        "buy": _number(v.get("buyQuantity")), "get": _number(v.get("getQuantity")), "getIds": _texts(v.get("getProductIds") or None), "tierBy": v.get("tierBy"),
        "tiers": [{"threshold": float(x["threshold"]), "percentage": _number(x.get("percentage")), "fixed": _number(x.get("fixedAmount"))} for x in tiers],
        "bundle": [{"productId": str(b["productId"]), "quantity": float(b["quantity"])} for b in v.get("items") or []] if v["type"] == "bundle" else [],
        "bundlePrice": _number(v.get("bundlePrice")), "bundlePercentage": _number(v.get("bundlePercentage")),
        "conditions": [{"type": c["type"], "program": postfix(c)} for c in d["conditions"]],
    }


def literal(rows: list[dict], schema: str = SCHEMA) -> Column:
    """The rows as one constant array (folded when the plan is optimized)."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")


def texts(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def one(d: dict) -> Column:
    return F.get(literal([row(d, 0)]), F.lit(0))
