"""A corpus pipeline over ``documents``: five stages, each one of the training-data operators.

Every stage takes what the stage before kept, from a written table; all but
the last return the columns of ``documents``.

Defined results of all stages: other columns are dropped, whatever they are
called; repeated rows and ids are rows of their own (near dedup keeps one of
equal rows); texts of any length are read whole; an empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.llm import lines, minmax, quality, queries, wumanber
from tillwright.llm.common import row_key, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or empty text has no words and goes."""
    return quality.cascade(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines found in ten documents or more; ``n_chars`` follows.

    A null text is one empty line, so an empty text; a text that loses all lines is empty and stays.
    """
    found = lines.with_bitmaps(docs, lines.keep_bitmaps(docs, each_row=True), carried=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %).

    The smallest id stays, rows without id come last, ties go to the smaller text
    hash; texts without words are alone and stay.
    """
    found = minmax.near_duplicates(docs, width=5, num=80, den=100).filter("root is not null").groupBy("root", "_k1", "_k2").agg(
        F.min(F.coalesce("doc_id", F.lit(minmax.LAST))).alias("id"), F.count(F.lit(1)).alias("c"))
    found = written(found, "found")
    # of each component the smallest id, then the smallest text hash
    first = written(found.groupBy("root").agg(F.min(F.struct("id", "_k2", "_k1", "c")).alias("x"), F.count(F.lit(1)).alias("keys")), "first")
    gone = (found.join(first.filter("keys > 1").select("root", F.col("x._k1").alias("a"), F.col("x._k2").alias("b")), "root")
            .filter("_k1 <> a or _k2 <> b").select("_k1", "_k2"))
    left = docs.select(*COLUMNS, *row_key(docs)).join(gone, ["_k1", "_k2"], "left_anti")
    again = first.filter("x.c > 1").select("x._k1", "x._k2")
    if again.isEmpty():
        return left.select(*COLUMNS)
    # rows equal in id and text are one document
    one = left.join(again, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return left.join(again, ["_k1", "_k2"], "left_anti").select(*COLUMNS).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a test item; items without words, and null texts, hit nothing."""
    found = wumanber.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=[c for c in COLUMNS if c != "doc_id"])
    return found.filter(F.size("spans") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of at most 1024 tokens; a null text is its end token only."""
    return queries.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenizing and packing are not SQL; the tests hold the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
