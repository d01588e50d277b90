"""Every corpus query and its SQL, gathered from the operators' modules."""

from __future__ import annotations

from framequery.llm import exact_dedup, line_dedup, mixing, near_dedup, pieces, quality_rules, suffix_array, suffix_trees, token_files, toxicity

MODULES = [suffix_trees, exact_dedup, quality_rules, toxicity, line_dedup, suffix_array, near_dedup, token_files, pieces, mixing]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
