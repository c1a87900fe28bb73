"""Operator 9 (native): quality rules as a short-circuit cascade.

A rule is a condition that rejects a document.  On a bounded sample the
cascade estimates for each rule how many documents it rejects (selectivity)
and what evaluating it costs (the time of a query that evaluates this rule
alone over the sample); rules then run in falling order of rejection per cost,
and a document that one rule rejects is not shown to the later ones.  The
verdict does not depend on the order, so a sample only changes the speed.

All features are Spark's own functions on the text; the longest texts cost a
sort of their three-word windows inside their row, nothing is shuffled.

Defined results: a null or empty text has no words, every count 0, and fails
the base rules; a null id and repeated rows are carried through; an empty
table gives an empty result; other columns are ignored (features are made
under names of their own).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import SPACE_CHARS, SPACE_CLASS

# Documents of the sample that orders the rules; it never changes a verdict.
SAMPLE_DOCS = 500
SAMPLE_CHARS = 50_000

SYMBOLS = "#*$%&|<>"


class Text(NamedTuple):
    """A document's text (never null) and its words, as columns."""

    text: Column
    words: Column


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], Column]


class Measured(NamedTuple):
    name: str
    rejected: float  # share of the sample
    cost: float  # seconds for the sample
    gain: float  # rejected per cost


def of(text: Column) -> Text:
    text = F.coalesce(text, F.lit(""))
    return Text(text, words(text))


def words(text: Column) -> Column:
    """Runs of characters that are not white space, in order."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+", -1))


def _count(text: Column, characters: str) -> Column:
    """Characters of the text in a regex class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def n_words(t: Text) -> Column:
    return F.size(t.words).cast("long")


def word_chars(t: Text) -> Column:
    return F.length(F.array_join(t.words, "")).cast("long")


def n_symbols(t: Text) -> Column:
    return _count(t.text, SYMBOLS)


def _lines(t: Text) -> Column:
    return F.filter(F.split(t.text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")


def n_dup_lines(t: Text) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return _with(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(t: Text) -> Column:
    """Words inside three-word windows found twice or more in the text.

    Windows are told apart by 64-bit hashes, inside one text only.  Hashes
    that occur again are found in their sorted list; each repeated window
    then adds the words that the repeated window before it doesn't cover.
    """
    def counted(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_with(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_with(_again(h), lambda a: _covered(_places(h, a))))))

    return _with(t.words, counted)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _again(h: Column) -> Column:
    """The hashes that occur twice or more."""
    return _with(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))


def _places(h: Column, again: Column) -> Column:
    """Ascending positions of the repeated windows.

    A short list of repeated hashes is looked through at every position; with
    a long one, (hash, position) pairs are sorted and equal neighbours kept.
    """
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())
    many = _with(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))),
        lambda x: x["i"])))
    return F.when(F.size(again) <= 64, few).otherwise(many)


def _covered(places: Column) -> Column:
    return _with(places, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


#: The production rules.  Thresholds are those usual for web text; the first
#: two are the base rules.
BASE = ("short", "repeated_words")
RULES = (
    Rule("short", lambda t: n_words(t) < 50),
    Rule("repeated_words", lambda t: 100 * n_repeat_words(t) > 50 * n_words(t)),
    Rule("symbols", lambda t: 10 * n_symbols(t) > n_words(t)),
    Rule("duplicate_lines", lambda t: _with(_lines(t), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x))),
    Rule("word_length", lambda t: (word_chars(t) < 2 * n_words(t)) | (word_chars(t) > 20 * n_words(t))),
    Rule("capitals", lambda t: 10 * _count(t.text, "A-Z") > 4 * word_chars(t)),
    Rule("exclamations", lambda t: 10 * _count(t.text, "!") > 3 * n_words(t)),
)


def measure(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", sample_docs: int = SAMPLE_DOCS,
            clock: Callable[[], float] = time.perf_counter) -> list[Measured]:
    """Selectivity and cost of each rule on a bounded sample, best gain first.

    The sample is the first ``sample_docs`` documents of at most
    ``SAMPLE_CHARS`` that Spark finds, so it has a bounded size; on an empty
    table the rules keep their order.
    """
    found = docs.select(F.col(text).alias("_text")).filter(F.length("_text") <= SAMPLE_CHARS).limit(sample_docs).collect()
    sample = docs.sparkSession.createDataFrame(found, "_text string").cache()
    try:
        n = sample.count()
        none = sample.agg(F.max(F.length("_text")))
        none.collect()  # compiles the scan of the sample
        began = clock()
        none.collect()
        idle = clock() - began
        found = []
        for rule in rules:
            began = clock()
            hit = sample.agg(F.sum(rule.rejects(of(F.col("_text"))).cast("int"))).first()[0] or 0
            cost = max(clock() - began - idle, 1e-4)
            found.append(Measured(rule.name, hit / max(n, 1), cost, hit / max(n, 1) / cost))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda m: -m.gain)


def ordered(rules: Iterable[Rule], measured: Iterable[Measured]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[m.name] for m in measured]


def verdict(t: Text, rules: Iterable[Rule]) -> Column:
    """Whether the document stays: CASE stops at the first rule that rejects."""
    case = None
    for rule in rules:
        case = F.when(rule.rejects(t), False) if case is None else case.when(rule.rejects(t), False)
    return F.lit(True) if case is None else case.otherwise(True)


def cascade(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that no rule rejects, rules in measured order."""
    rules = list(rules)
    for rule in ordered(rules, measure(docs, rules, text, sample_docs)):
        docs = docs.filter(F.coalesce(~rule.rejects(of(F.col(text))), F.lit(True)))
    return docs


def judged(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id`` with the base features, ``base_failed`` and ``kept`` for every document."""
    rules = list(rules)
    rules = ordered(rules, measure(docs, rules, text, sample_docs))
    plain = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = Text(F.col("_text"), F.col("_words"))
    features = plain.withColumn("_words", words(F.col("_text"))).select(
        "doc_id", "_text", "_words", n_words(t).alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(t).alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return features.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(verdict(t, [r for r in rules if r.name not in BASE]))).drop("_text", "_words")
