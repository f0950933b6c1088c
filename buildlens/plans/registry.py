"""Collects the registered queries and oracle SQL of every plan module."""

from __future__ import annotations

import importlib

MODULES = ["q_builds", "q_text", "q_context", "q_shards", "q_manifest", "q_models", "q_train", "q_endtoend"]


def _mods():
    return [importlib.import_module(f"buildlens.plans.{m}") for m in MODULES]


def all_queries() -> dict:
    out: dict = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def raw_oracles() -> dict:
    out: dict = {}
    for m in _mods():
        out.update(m.ORACLES)
    return out


def all_oracles() -> dict:
    """Oracle SQL with each output column cast to the Spark column's type."""
    try:
        from .oracle_types import TYPES
    except ImportError:
        TYPES = {}
    out = {}
    for name, sql in raw_oracles().items():
        cols = TYPES.get(name)
        if not cols:
            out[name] = sql
            continue
        proj = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in cols)
        out[name] = f"SELECT {proj} FROM (\n{sql}\n) AS _oracle"
    return out


def flagship(spark, sf_dir: str):
    from .q_builds import builds, repo_summary
    return repo_summary(builds(spark, sf_dir))
