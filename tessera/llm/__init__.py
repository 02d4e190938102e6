"""Training-data operators. Nothing else in the package imports this one."""

from __future__ import annotations

from tessera.llm import best_fit_packing, decontaminate, exact_dedup, language_id, lexical_search, license_scan, line_dedup, minhash, periodic_runs, quality, simhash, suffix_dedup, toxicity

_MODULES = (line_dedup, best_fit_packing, exact_dedup, suffix_dedup, license_scan, simhash, language_id, decontaminate, quality, toxicity, lexical_search, periodic_runs, minhash)


def queries() -> dict:
    """Every opN query, by name; each takes (spark, sf_dir)."""
    return {m.QUERY: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can state."""
    return {m.QUERY: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
