"""All queries of this package and their SQL, by name."""

from . import exact_dedup, line_dedup, mixing, ngram_join, packing, quality_qda, quality_rules, secret_scan, token_counts, toxicity

_MODULES = (mixing, quality_rules, secret_scan, ngram_join, packing, exact_dedup, toxicity, line_dedup, token_counts, quality_qda)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
