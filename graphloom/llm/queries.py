"""The queries of this subpackage, by name."""

from __future__ import annotations

from graphloom.llm import jaccard, packing, secrets, substrings, tokens, topk, urls, vectors, warc, weak

MODULES = (jaccard, vectors, substrings, topk, weak, tokens, warc, packing, urls, secrets)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
