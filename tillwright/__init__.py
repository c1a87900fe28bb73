"""tillwright: back-office analytics (pipelines, collection queries, entity
resolution, pricing, audiences, rule routing) as lazy Spark DataFrame plans.

Entry points:

* ``sources.catalog.Catalog`` - named tables with order keys, ids, relations
* ``plans.pipeline.run_pipeline`` - transform pipelines (12 step types)
* ``operators.query.find_all`` / ``storage_aggregate``, ``plans.reports``
* ``operators.mdm`` - ``match.find_matches``, ``merge.merge_golden``,
  ``ingest.ingest_batch``
* ``operators.pricing.evaluate.evaluate`` and ``pricing.codes``
* ``operators.audience``, ``operators.rules.route``, ``operators.tables``
* ``streaming.incremental`` - ``stream_steps``, ``ingest_stream``
"""
