"""Promo codes in bulk: generation, format checks, redemption and usage.

Generation is a seeded, reproducible Spark job: every row of a driving
table (e.g. one per customer) draws a few candidate codes from
``xxhash64(seed, owner, attempt, position)``; each distinct code goes to its
smallest ``(attempt, owner)`` drawer, existing codes are removed with an
anti join, and each owner keeps its first won attempt.  Two owners can never
keep the same code, and owners left without one draw again in the next round.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ...session import checkpoint_dir
from .conditions import failed
from .table import SCHEMA, row

# Default character sets (alphanumeric leaves out 0, O, 1, I).
CHARSETS = {
    "alphanumeric": "ABCDEFGHJKLMNPQRSTUVWXYZ23456789",
    "alphabetic": "ABCDEFGHJKLMNPQRSTUVWXYZ",
    "numeric": "0123456789",
}
ATTEMPTS = 4  # draws of an owner in the first round
SHARES = 16  # tasks that share the requests of one code


class CodeGenerationError(RuntimeError):
    pass


def charset_of(pattern: str = "alphanumeric", custom: str | None = None, exclude: str | None = None) -> str:
    cs = custom if pattern == "custom" and custom else CHARSETS.get(pattern, "")
    for ch in exclude or "":
        cs = re.sub(re.escape(ch), "", cs, flags=re.IGNORECASE)
    return cs


def generate_codes(owners: DataFrame, length: int, prefix: str = "", suffix: str = "",
                   pattern: str = "alphanumeric", custom: str | None = None, exclude_chars: str | None = None,
                   uppercase: bool = True, seed: int = 0, existing: DataFrame | None = None,
                   owner_col: str = "owner") -> DataFrame:
    """``(owner, code)``: one unique code per distinct owner (NULL has none).

    Owners without a code draw again until all have one; more owners than
    free codes are an error before the first draw."""
    spark = owners.sparkSession
    cs = charset_of(pattern, custom, exclude_chars)
    if not cs:
        raise CodeGenerationError("empty character set")
    taken = None if existing is None else existing.select(F.upper(F.col("code")).alias("__ex")).distinct()
    left = owners.select(F.col(owner_col).alias("owner")).where("owner is not null").distinct()
    letters = set(cs.upper() if existing is not None else cs if uppercase else cs.lower())
    free = len(letters) ** length - (0 if existing is None else existing.where(
        format_check(F.col("code"), length, prefix, suffix, pattern, custom, exclude_chars, uppercase)).distinct().count())
    if left.count() > free:
        raise CodeGenerationError("more owners than free codes; increase the code length or change the pattern")
    chars = [F.substring(F.lit(cs), (F.pmod(F.xxhash64(F.lit(seed), F.col("owner"), F.col("attempt"), F.lit(i)),
                                           F.lit(len(cs))) + 1).cast("int"), 1) for i in range(length)]
    core = F.concat(*chars) if uppercase else F.lower(F.concat(*chars))
    checkpoint_dir(spark)
    given, start, span = None, 0, ATTEMPTS
    while True:
        cand = left.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(start + span - 1)))).withColumn(
            "code", F.concat(F.lit(prefix), core, F.lit(suffix)))
        if taken is not None:
            cand = cand.join(taken, F.upper(cand["code"]) == taken["__ex"], "left_anti")
        if given is not None:
            cand = cand.join(given.select("code"), "code", "left_anti")
        won = cand.groupBy("code").agg(F.min(F.struct("attempt", "owner")).alias("w")).select(
            "code", F.col("w.owner").alias("owner"), F.col("w.attempt").alias("attempt"))
        kept = won.groupBy("owner").agg(F.min(F.struct("attempt", "code")).alias("k")).select(
            "owner", F.col("k.code").alias("code")).checkpoint()
        given = kept if given is None else given.unionByName(kept)
        left = left.join(kept, "owner", "left_anti").checkpoint()
        if left.isEmpty():
            return given
        start, span = start + span, min(2 * span, 64)


def format_check(code: Column, length: int, prefix: str = "", suffix: str = "", pattern: str = "alphanumeric",
                 custom: str | None = None, exclude_chars: str | None = None, uppercase: bool = True) -> Column:
    """Prefix, suffix, core length and character set; the core is upper-cased
    before the character check unless ``uppercase`` is False."""
    cs = charset_of(pattern, custom, exclude_chars)
    core = F.substring(code, len(prefix) + 1, length)
    if uppercase is not False:
        core = F.upper(core)
    return F.coalesce(code.startswith(prefix) & code.endswith(suffix)
                      & (F.length(code) == len(prefix) + length + len(suffix))
                      & core.rlike("^[" + re.escape(cs) + "]{" + str(length) + "}$"), F.lit(False))


def redeem(codes: DataFrame, redemptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``redemptions(code, customerId, orderId, at)`` -> (accepted, rejected).

    The first redemption of an unused code (by time, then order id) wins;
    later ones and redemptions of used or unknown codes are rejected."""
    known = codes.groupBy("code").agg(F.bool_or(F.col("usedBy").isNotNull()).alias("used"))
    r = redemptions.join(known, "code", "left")
    first = r.where(F.col("used") == F.lit(False)).groupBy("code").agg(
        F.min(F.struct("at", "orderId")).alias("__w"))
    tagged = r.join(first, "code", "left").withColumn(
        "__ok", F.coalesce((F.col("used") == F.lit(False)) & (F.struct("at", "orderId") == F.col("__w")), F.lit(False)))
    reason = (F.when(F.col("used").isNull(), F.lit("Unknown code"))
              .when(F.col("used"), F.lit("Code already used"))
              .otherwise(F.lit("Code already used")))
    accepted = tagged.where("__ok").drop("__w", "__ok", "used")
    rejected = tagged.where(~F.col("__ok")).withColumn("reason", reason).drop("__w", "__ok", "used")
    return accepted, rejected


def usage_counts(usage: DataFrame) -> DataFrame:
    """Uses per (discount, customer) with the discount's total, from the ledger
    (replaces the original's running counter).  Both are hash aggregates; uses
    without a customer are a row of their own."""
    per_customer = usage.groupBy("discountId", "customerId").agg(F.count(F.lit(1)).alias("uses"))
    per_discount = per_customer.groupBy("discountId").agg(F.sum("uses").alias("discountUses"))
    return per_customer.join(per_discount, "discountId")


def usage_of(usage: DataFrame, discounts: DataFrame) -> DataFrame:
    """The ledger rows of the given discounts (``discounts(id)``)."""
    return usage.join(discounts.select(F.col("id").alias("discountId")).distinct(), "discountId", "left_semi")


def record_usage(discounts: DataFrame, usage: DataFrame) -> DataFrame:
    """``discounts(id, currentUsage, ...)`` after the ledger rows ``usage``: every use counts one, of unknown discounts none."""
    uses = usage.groupBy(F.col("discountId").alias("__did")).agg(F.count(F.lit(1)).alias("__uses"))
    joined = discounts.join(uses, discounts["id"] == uses["__did"], "left")
    return joined.withColumn("currentUsage", F.coalesce("currentUsage", F.lit(0)) + F.coalesce("__uses", F.lit(0))).drop("__did", "__uses")


# -- batch code validation (C15) ---------------------------------------------------------

def validate_codes(requests: DataFrame, discounts: list[dict], generated: DataFrame | None = None,
                   usage: DataFrame | None = None, zero_unit_price: bool = False) -> DataFrame:
    """Validate promo codes in bulk.

    ``requests(code, customerId, items, evaluationDate)`` (``items`` as cart
    lines, may be NULL); ``generated(code, discountId, usedBy)``; ``usage``
    is the ledger ``(discountId, customerId, ...)``.  Codes match exactly
    (case-sensitive).  Adds ``discountId, valid, reason, isExpired, isInactive,
    usageLimitReached, customerUsageLimitReached, conditionsNotMet``.
    ``zero_unit_price`` reproduces the original, which prices validation
    carts at 0 (so ``minAmount`` never holds).
    """
    ds = [row(d, i) for i, d in enumerate(discounts)]
    spark = requests.sparkSession
    now = F.unix_micros(F.coalesce(F.col("evaluationDate"), F.current_timestamp()) if "evaluationDate" in requests.columns else F.current_timestamp())
    # definitions as a table, met by equi joins: by id for generated codes, by code for the others; the first of equal ones counts
    defs = spark.createDataFrame([(json.dumps(d), d["id"], d["code"], d["idx"]) for d in ds], "d string, id string, code string, idx int")
    defs = defs.select(F.from_json("d", SCHEMA).alias("d"), "id", "code", "idx")
    by_id = defs.groupBy(F.col("id").alias("__did")).agg(F.min_by("d", "idx").alias("__by_id"))
    by_code = defs.where("code is not null").groupBy(F.col("code").alias("__dcode")).agg(F.min_by("d", "idx").alias("__by_code"))
    r = requests
    if generated is not None:
        # one row per code, used if any of its rows is
        g = generated.groupBy(F.col("code").alias("__gcode")).agg(
            F.min("discountId").alias("__gdid"), F.max("usedBy").alias("__gused")).withColumn("__gen", F.lit(True))
        # requests carry their carts and many have one code: each code's are dealt out, and met by as many copies of its narrow row
        plain = [f.name for f in r.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
        r = r.withColumn("__share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SHARES)))
        g = g.withColumn("__gshare", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        r = r.join(g, (r["code"] == g["__gcode"]) & (r["__share"] == g["__gshare"]), "left").drop("__gcode", "__share", "__gshare")
    else:
        r = r.withColumn("__gdid", F.lit(None).cast("string")).withColumn("__gused", F.lit(None).cast("string")) \
            .withColumn("__gen", F.lit(None).cast("boolean"))
    # definitions come from the driver, so they are small; dealt by them, all requests without a generated code (a null id) or of one code would meet in one task
    r = r.join(F.broadcast(by_id), r["__gdid"] == by_id["__did"], "left").join(F.broadcast(by_code), r["code"] == by_code["__dcode"], "left")
    gen = F.coalesce(F.col("__gen"), F.lit(False))
    r = r.withColumn("__d", F.when(gen, F.col("__by_id")).otherwise(F.col("__by_code"))).drop("__did", "__dcode", "__by_id", "__by_code")
    d = F.col("__d")
    r = r.withColumn("discountId", d["id"])
    if usage is not None:
        u = usage.groupBy(F.col("discountId").alias("__udid"), F.col("customerId").alias("__ucid")).agg(
            F.count(F.lit(1)).alias("__uses"))
        r = r.join(u, (r["discountId"] == u["__udid"]) & (r["customerId"] == u["__ucid"]), "left") \
            .drop("__udid", "__ucid")
    else:
        r = r.withColumn("__uses", F.lit(None).cast("long"))
    items = F.col("items") if "items" in r.columns else F.lit(None).cast(
        "array<struct<line:int,productId:string,categoryId:string,quantity:double,unitPrice:double>>")
    if zero_unit_price and "items" in r.columns:
        items = F.transform(F.col("items"), lambda x: x.withField("unitPrice", F.lit(0.0)))
    ctx = r.withColumn("items", items).withColumn(
        "customer", F.struct(F.col("customerId").cast("string").alias("id"), F.lit(None).cast("string").alias("group"),
                             F.lit(None).cast("array<string>").alias("tags"),
                             F.lit(None).cast("boolean").alias("isFirstPurchase")))
    if "evaluationDate" not in ctx.columns:
        ctx = ctx.withColumn("evaluationDate", F.lit(None).cast("timestamp"))
    # conditions are evaluated over the request's own lines
    ctx = ctx.withColumn("__failed", F.when(F.col("items").isNotNull(), failed(F.col("__d.conditions"))))
    hit = lambda c: F.coalesce(c, F.lit(False))
    # The texts of the reasons, in the order they are checked.
    reason = (F.when(gen & F.col("__gused").isNotNull(), F.lit("Code has already been redeemed"))
              .when(gen & d.isNull(), F.lit("Discount no longer exists"))
              .when(d.isNull(), F.lit("Invalid code"))
              .when(d["status"] != "active", F.concat(F.lit("Discount is "), d["status"]))
              .when(hit(now < d["validFrom"]), F.lit("Discount is not yet active"))
              .when(hit(now > d["validUntil"]), F.lit("Discount has expired"))
              .when(hit((d["usageLimit"] != 0) & (d["currentUsage"] >= d["usageLimit"])), F.lit("Usage limit reached"))
              .when(hit((d["usageLimitPerCustomer"] != 0) & F.col("customerId").isNotNull() & (F.coalesce("__uses", F.lit(0)) >= d["usageLimitPerCustomer"])),
                    F.lit("Customer usage limit reached"))
              .when(hit(F.size("__failed") > 0), F.lit("Conditions not met")))
    out = ctx.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    out = out.withColumn("isExpired", F.col("reason").isin("Discount has expired", "Discount is expired")) \
        .withColumn("isInactive", F.col("reason") == F.lit("Discount is inactive")) \
        .withColumn("usageLimitReached", F.col("reason") == F.lit("Usage limit reached")) \
        .withColumn("customerUsageLimitReached", F.col("reason") == F.lit("Customer usage limit reached")) \
        .withColumn("conditionsNotMet", F.when(F.col("reason") == F.lit("Conditions not met"), F.col("__failed")))
    out = out.drop("__gdid", "__gused", "__gen", "__d", "__uses", "__failed", "customer")
    return out if "evaluationDate" in requests.columns else out.drop("evaluationDate")
