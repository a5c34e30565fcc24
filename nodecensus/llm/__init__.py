"""Training-data operators: deduplication, search, privacy, extraction, tokens, packing, archives and quality.

Nothing outside this subpackage imports it.  ``registry.queries()`` and ``registry.oracle_sql()`` list what it offers.
"""
