"""All queries over the driver tables that belong to the document engine."""

from __future__ import annotations

from quire.plans import anchors, exports, formulas, grids, jsons, layouts, markups, more, orders, pagetrees, pictures, prints, rules, texts, wordlists

MODULES = (anchors, exports, formulas, jsons, markups, texts, grids, orders, more, rules, layouts, pagetrees, pictures, prints, wordlists)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items() if s}
