"""Audience selection and message rendering.

Recipients stay rows (never collected into one list); previews and run
statistics are single-row aggregates.  Templates with ``{{name}}``
placeholders render natively: a constant template becomes a ``concat`` of
literals and variable lookups, a template column is split around its
placeholders and re-joined with ``zip_with`` (no re-substitution of
inserted values).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import family, js_text, resolve
from ..sources.catalog import Catalog
from .query import FilterCompiler

PLACEHOLDER = r"\{\{(\w+)\}\}"
RUNNABLE = ("draft", "active")


class CampaignError(ValueError):
    pass


def _lookup(variables: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(variables, F.lit(name)), F.lit("{{" + name + "}}"))


def render_constant(template: str, variables: Column) -> Column:
    """Render a template known on the driver; unknown names stay verbatim."""
    pieces, pos = [], 0
    for m in re.finditer(PLACEHOLDER, template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(_lookup(variables, m.group(1)))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces) if pieces else F.lit("")


def render_column(template: Column, variables: Column) -> Column:
    """Render a per-row template column."""
    texts = F.split(template, PLACEHOLDER, -1)
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1)
    values = F.concat(F.transform(names, lambda n: F.coalesce(F.try_element_at(variables, n),
                                                               F.concat(F.lit("{{"), n, F.lit("}}")))),
                      F.array(F.lit("")))
    return F.when(template.isNotNull(), F.array_join(F.zip_with(texts, values, lambda t, v: F.concat(t, v)), ""))


def extract_variables(subject: Column, body: Column) -> Column:
    """Distinct placeholder names of subject then body, in first-seen order."""
    text = F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1))


def serialize(df: DataFrame, path: str) -> Column:
    """Variable text of an entity value: strings as-is, numbers / booleans as
    text, anything else as JSON (timestamps as a quoted ISO string)."""
    tc = resolve(df.schema, path)
    if family(tc.dtype) == "date":
        return F.concat(F.lit('"'), js_text(tc), F.lit('"'))
    return js_text(tc)


def variables_of(df: DataFrame, mappings: dict[str, str]) -> Column:
    """``map<string,string>`` of template variables; NULL values are left out."""
    if not mappings:
        return F.create_map().cast("map<string,string>")
    pairs = []
    for var, path in mappings.items():
        pairs += [F.lit(var), serialize(df, path)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _recipient(df: DataFrame, path: str) -> Column:
    tc = resolve(df.schema, path)
    if family(tc.dtype) != "string":
        return F.lit(None).cast("string")  # non-string recipients are skipped
    return F.when(tc.col != "", tc.col)


def audience(cat: Catalog, campaign: dict) -> DataFrame:
    """Entities selected by the campaign filter with their ``recipient``
    (NULL when the recipient field is missing, empty or not text)."""
    cfg = campaign["entityConfig"]
    if not cat.has(cfg["collection"]):
        raise CampaignError(f'Collection "{cfg["collection"]}" not found')
    df = FilterCompiler(cat).apply(cfg["collection"], cfg.get("filter"))
    return df.withColumn("__recipient", _recipient(df, cfg["recipientField"]))


def preview(cat: Catalog, campaign: dict) -> tuple[DataFrame, DataFrame]:
    """(recipient rows, one stats row ``total, recipients, skipped``)."""
    aud = audience(cat, campaign)
    rec = aud.where(F.col("__recipient").isNotNull()).select(F.col("__recipient").alias("recipient"))
    stats = aud.agg(F.count(F.lit(1)).alias("total"),
                    F.count("__recipient").alias("recipients"),
                    F.count_if(F.col("__recipient").isNull()).alias("skipped"))
    return rec, stats


def run_campaign(cat: Catalog, campaign: dict, template: dict, sent_at=None) -> tuple[DataFrame, DataFrame]:
    """(message rows for the sent log, one stats row).  Delivery is not part
    of the data work: every rendered message is logged ``sent``."""
    if campaign.get("status", "draft") not in RUNNABLE:
        raise CampaignError(f'Cannot run campaign with status "{campaign.get("status")}"')
    aud = audience(cat, campaign)
    ts = F.lit(sent_at).cast("timestamp") if sent_at is not None else F.current_timestamp()
    variables = variables_of(aud, campaign.get("variableMappings") or {})
    msgs = aud.where(F.col("__recipient").isNotNull()).select(
        F.lit(template["id"]).alias("templateId"), F.col("__recipient").alias("recipient"),
        (render_constant(template["subject"], variables) if template.get("subject") else F.lit(None).cast("string"))
        .alias("subject"),
        render_constant(template["body"], variables).alias("body"),
        F.lit("sent").alias("status"), ts.alias("createdAt"))
    stats = aud.agg(F.count(F.lit(1)).alias("totalRecipients"), F.count("__recipient").alias("sent"),
                    F.lit(0).cast("long").alias("failed"),
                    F.count_if(F.col("__recipient").isNull()).alias("skipped")).withColumn(
        "status", F.when(F.col("failed") == 0, F.lit("completed")).otherwise(F.lit("failed")))
    return msgs, stats


def bulk_send(recipients: DataFrame, template: dict, variables: dict[str, str] | None = None,
              recipient_col: str = "recipient", sent_at=None) -> DataFrame:
    """One template, many recipients, constant variables (subject defaults to "")."""
    pairs = []
    for k, v in (variables or {}).items():
        pairs += [F.lit(k), F.lit(v)]
    vmap = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    ts = F.lit(sent_at).cast("timestamp") if sent_at is not None else F.current_timestamp()
    return recipients.select(
        F.lit(template["id"]).alias("templateId"), F.col(recipient_col).alias("recipient"),
        render_constant(template.get("subject") or "", vmap).alias("subject"),
        render_constant(template["body"], vmap).alias("body"), F.lit("pending").alias("status"), ts.alias("createdAt"))
