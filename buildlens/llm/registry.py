"""The registered queries of the corpus operators and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ["toxicity", "secrets", "vector_dedup", "token_files", "byte_bpe", "suffix_dedup", "line_dedup", "language", "decontaminate", "ngram_join",
           "lm_score", "vector_codes", "ball_search"]


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
