"""All queries and oracle SQL of this subpackage."""

from . import chat, decontaminate, divergence, jaccard, language_model, mixing, negatives, packing, substring, token_counts, topk, toxicity, urls

_MODULES = (decontaminate, jaccard, toxicity, urls, topk, token_counts, packing, substring, chat, language_model, mixing, divergence, negatives)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
