"""Operators for preparing training data: filtering, deduplication,
decontamination, formatting and tokenisation of document tables.

Nothing outside this package imports it; the queries are registered by
``tidemark.llm.queries``.
"""
