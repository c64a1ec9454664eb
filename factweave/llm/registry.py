"""Queries and oracle SQL of the training-data operators."""

from factweave.llm import (
    chat_format, decontaminate, exact_dedup, html_extract, language_id, line_dedup, merkle, mixing, near_duplicates, period_runs, quality_rules, token_counts, warc,
)

_MODULES = (
    language_id, warc, token_counts, chat_format, decontaminate, quality_rules, near_duplicates, html_extract, line_dedup, mixing, exact_dedup, merkle, period_runs,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
