"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import chat, chosen_path, decontamination, jaccard, lm_scores, merkle, packing, quality, secrets, substring_dedup, suffix_dedup, token_counts, whitening

_MODULES = (chat, chosen_path, decontamination, jaccard, lm_scores, merkle, packing, quality, secrets, substring_dedup, suffix_dedup, token_counts, whitening)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
