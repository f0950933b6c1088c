"""DuckDB expression text mirroring the engine's scalar functions (oracle side only)."""

from __future__ import annotations

# The status words that mean success, from the specification, not from the engine.
SUCCESS_SQL = "'1', 'pass', 'passed', 'success', 'successful', 'succeeded', 'true', 'yes', 'y'"
PY_SPACE = ("[\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def optional_text(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def optional_double(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} = floor({x}) "
            f"THEN CAST(CAST({x} AS HUGEINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END")


def label_text(x: str) -> str:
    s = f"lower({strip(x)})"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = '' THEN NULL "
            f"WHEN {s} IN ({SUCCESS_SQL}) THEN 1 ELSE 0 END")


def sample_id(repo: str, commit: str, build_id: str, idx: str) -> str:
    return (f"'sha256:' || sha256(concat_ws(chr(10), {repo}, {commit}, coalesce({build_id}, ''), "
            f"CAST({idx} AS VARCHAR)))")


def builds_select(src: str = "b") -> str:
    """Normalised ``builds`` rows from a raw build view ``src``."""
    bid = optional_double(f"{src}.tr_build_id")
    return f"""SELECT {src}.source_row_index, {src}.gh_project_name AS repo, {src}.git_trigger_commit AS commit_sha,
 {optional_text(src + '.git_prev_built_commit')} AS parent_commit_sha,
 {bid} AS build_id, {src}.tr_status AS raw_status,
 CAST({label_text(src + '.tr_status')} AS INTEGER) AS label,
 {sample_id(src + '.gh_project_name', src + '.git_trigger_commit', bid, src + '.source_row_index')} AS sample_id
FROM {src}"""
