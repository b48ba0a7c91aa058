"""The registered queries of this subpackage."""

from __future__ import annotations

from tablewright.llm import decontaminate, html_text, jaccard, language, metric_join, prefix_trie, quality_net, segment, substring, token_count, toxicity, turns, winnow

MODULES = (segment, jaccard, quality_net, html_text, language, token_count, decontaminate, winnow, toxicity, substring, prefix_trie, metric_join, turns)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
