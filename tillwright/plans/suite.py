"""All registered queries (name -> callable(spark, sf_dir)) and their SQL."""

from __future__ import annotations

from . import suite_checks, suite_mdm, suite_misc, suite_more, suite_pricing, suite_query, suite_stream, suite_transform

QUERIES: dict = {}
ORACLE: dict = {}

for _mod in (suite_transform, suite_query, suite_mdm, suite_pricing, suite_misc, suite_stream, suite_more, suite_checks):
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)
