"""Training-data operators: packing, sharding, filtering, deduplication, search.

Nothing else in the library imports this subpackage; its queries are listed in
``tidemill.llm.queries`` and added by ``__spark_entry__`` when it is present.
"""
