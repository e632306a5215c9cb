"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm import decontaminate, embeddings, html_text, jaccard, manifest, mixing, packing, pii, quality, repair, substrings, tokens, warc

MODULES = (pii, embeddings, quality, packing, html_text, tokens, substrings, jaccard, decontaminate, warc, repair, mixing, manifest)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items() if s}
