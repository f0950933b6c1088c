"""Code-context text assembly.

Per changed file, the changed new-side lines come from a fold over the full
diff, and a function (or global-window) region is cut from the file content
for each of the first N changed lines -- all in-row with higher-order
functions, so the file content never crosses a shuffle.  One shuffle by
``(repo, commit_sha)`` then runs the ordered budget window, the region merge
and the summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_char, py_splitlines, py_strip
from .diffs import (CONTEXT_SEP, FIELD_SEP, KEYS, MAX_DIFF_CHARS_PER_FILE, candidate_bound,
                    changed_file_rows, materialize, materialize_budget, with_diff_columns)

# Fixed value: new-side hunk header used to number changed lines.
CHANGED_HEADER = "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@"

# Fixed value: function-signature heuristic for Java-like code, one line at a
# time; group 2 is the symbol name.
SIGNATURE = ("(?U)^\\s*(public|private|protected|static|final|synchronized|abstract|"
             "void|int|long|double|float|boolean|char|String|def|function|"
             "[A-Za-z_][A-Za-z0-9_<>\\[\\]]*)[\\w<>\\[\\],\\s]*\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*"
             "\\([^)]*\\)\\s*(\\{|$)")
SIGNATURE_NAME_GROUP = 2

MAX_CHANGED_LINES_PER_FILE = 20
MAX_CONTEXT_CHARS_PER_SNIPPET = 20_000
MAX_TOTAL_CONTEXT_CHARS = 150_000
GLOBAL_WINDOW_LINES = 75
MAX_FUNCTION_LINES = 200


def classify_diff_lines(diff_text: Column) -> Column:
    """Per line of the stripped diff: header start (or -1) and kind.

    kind: 0 other (advances), 1 ``+`` (changed, advances), 2 ``-`` (no
    advance), 3 ``+++`` (skipped).  One regex evaluation per line.
    """
    lines = py_splitlines(py_strip(diff_text))
    # the regex only runs on lines that can be headers
    return F.transform(lines, lambda line: F.struct(
        F.when(line.startswith("@@ -"),
               F.coalesce(F.nullif(F.regexp_extract(line, CHANGED_HEADER, 1), F.lit("")).cast("int"), F.lit(-1)))
        .otherwise(F.lit(-1)).alias("h"),
        F.when(line.startswith("+++"), F.lit(3)).when(line.startswith("+"), F.lit(1))
        .when(line.startswith("-"), F.lit(2)).otherwise(F.lit(0)).alias("k")))


def changed_new_lines_from(classified: Column, keep: int = MAX_CHANGED_LINES_PER_FILE) -> Column:
    """T11 fold over classified lines -> struct(n_changed, first).

    Lines before the first header are ignored; a header sets the counter;
    ``+`` lines are recorded and advance, ``-`` lines do not advance, ``+++``
    lines are skipped, others advance.  The state is bounded (``keep``
    numbers), so the fold is linear in the number of lines.
    """
    init = F.struct(F.lit(None).cast("int").alias("cur"), F.lit(0).alias("n"),
                    F.array().cast("array<int>").alias("first"))

    def step(acc, x):
        cur, h, k = acc["cur"], x["h"], x["k"]
        active = (h < 0) & cur.isNotNull()
        plus = active & (k == 1)
        nxt = F.when(h >= 0, h).when(active & ((k == 0) | (k == 1)), cur + 1).otherwise(cur)
        first = F.when(plus & (F.size(acc["first"]) < keep),
                       F.concat(acc["first"], F.array(cur))).otherwise(acc["first"])
        return F.struct(nxt.alias("cur"), (acc["n"] + plus.cast("int")).alias("n"), first.alias("first"))

    return F.aggregate(classified, init, step,
                       lambda acc: F.struct(acc["n"].alias("n_changed"), acc["first"].alias("first")))


def changed_new_lines(diff_text: Column, keep: int = MAX_CHANGED_LINES_PER_FILE) -> Column:
    """T11 on a diff text column (single expression; tables use the staged form)."""
    return changed_new_lines_from(classify_diff_lines(diff_text), keep)


def with_changed_lines(df: DataFrame, diff_col: str, out: str = "cl",
                       keep: int = MAX_CHANGED_LINES_PER_FILE) -> DataFrame:
    """T11 staged: classify lines in one projection, fold in the next.

    The classified array is read twice (size check and fold) so Catalyst does
    not inline the per-line regex into the fold.
    """
    tmp = "__bl_classified"
    staged = df.withColumn(tmp, classify_diff_lines(F.col(diff_col)))
    return staged.withColumn(out, F.when(F.size(tmp) > 0, changed_new_lines_from(F.col(tmp), keep)).otherwise(
        F.struct(F.lit(0).alias("n_changed"), F.array().cast("array<int>").alias("first")))).drop(tmp)


def _line(lines: Column, i: Column) -> Column:
    """0-based element of the line array."""
    return F.element_at(lines, i + 1)


def global_window(lines: Column, idx: Column, max_lines: int = GLOBAL_WINDOW_LINES) -> Column:
    """``max_lines`` lines around ``idx`` (half above), clipped to the file."""
    n = F.size(lines)
    start = F.greatest(F.lit(0), idx - max_lines // 2)
    end = F.least(n, start + max_lines)
    return F.struct(
        F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("text"),
        (start + 1).alias("start_line"), end.alias("end_line"),
        F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("symbol_type"),
        F.lit("global_window").alias("extraction_method"))


def signature_flags(lines: Column) -> Column:
    """Per line, does it look like a function signature (evaluated once per line).

    The pattern needs a ``(``, so lines without one skip the regex.
    """
    return F.transform(lines, lambda x: x.contains("(") & x.rlike(SIGNATURE))


def nearest_signature(flags: Column, idx: Column, lookback: int = MAX_FUNCTION_LINES) -> Column:
    """Index of the closest signature line at or above ``idx`` (``lookback`` lines)."""
    lo = F.greatest(F.lit(0), idx - (lookback - 1))
    hits = F.filter(F.sequence(lo, idx), lambda i: F.element_at(flags, i + 1))
    return F.when((idx >= 0) & (idx < F.size(flags)), F.array_max(hits))


def brace_deltas(lines: Column) -> Column:
    """Per line: count('{') - count('}')."""
    return F.transform(lines, lambda x: count_char(x, "{") - count_char(x, "}"))


def function_end(deltas: Column, opens: Column, s: Column, max_lines: int = MAX_FUNCTION_LINES) -> Column:
    """First line from ``s`` (within ``max_lines``) where a ``{`` was seen and the
    brace balance is <= 0; ``s`` itself when the body never closes."""
    # both arrays are read twice, so that Catalyst does not inline their making into the fold
    last = F.least(F.size(deltas), F.size(opens), s + max_lines) - 1
    init = F.struct(F.lit(0).alias("bal"), F.lit(False).alias("seen"), F.lit(None).cast("int").alias("end"))

    def step(acc, j):
        bal = acc["bal"] + F.element_at(deltas, j + 1)
        seen = acc["seen"] | F.element_at(opens, j + 1)
        end = F.when(acc["end"].isNull() & seen & (bal <= 0), j).otherwise(acc["end"])
        return F.struct(bal.alias("bal"), seen.alias("seen"), end.alias("end"))

    return F.coalesce(F.aggregate(F.sequence(s, last), init, step)["end"], s)


def _region(lines: Column, idx: Column, s: Column, e: Column) -> Column:
    """Function region when a signature is found, else the global window; NULL out of range."""
    func = F.struct(
        F.array_join(F.slice(lines, s + 1, e - s + 1), "\n").alias("text"),
        (s + 1).alias("start_line"), (e + 1).alias("end_line"),
        F.regexp_extract(_line(lines, s), SIGNATURE, SIGNATURE_NAME_GROUP).alias("symbol_name"),
        F.lit("function").alias("symbol_type"),
        F.lit("brace_based_function").alias("extraction_method"))
    in_range = (idx >= 0) & (idx < F.size(lines))
    return F.when(in_range, F.when(s.isNotNull(), func).otherwise(global_window(lines, idx)))


def regions_for_lines(df: DataFrame, lines_col: str, first_col: str, out: str = "regions") -> DataFrame:
    """T12-T16 on a table: ``first_col`` (array of 1-based line numbers) -> array of
    struct(line, region).  Per-line flags are computed once per row; each step
    is its own projection so no array is recomputed inside a lambda."""
    lines = F.col(lines_col)
    staged = df.withColumn("_sig", signature_flags(lines)).withColumn("_dl", brace_deltas(lines)) \
        .withColumn("_op", F.transform(lines, lambda x: x.contains("{")))
    staged = staged.withColumn("_t", F.transform(first_col, lambda ln: F.struct(
        ln.alias("line"), nearest_signature(F.col("_sig"), ln - 1).alias("s"))))
    # changed lines of one function share its end
    staged = staged.withColumn("_ends", F.transform(F.array_distinct(F.filter(F.transform("_t", lambda x: x["s"]), lambda s: s.isNotNull())),
                                                    lambda s: F.struct(s.alias("s"), function_end(F.col("_dl"), F.col("_op"), s).alias("e"))))
    e = lambda x: F.get(F.filter("_ends", lambda p: (p["s"] == x["s"]) & (F.size("_ends") > 0)), F.lit(0))["e"]  # noqa: E731 - read twice: not inlined
    staged = staged.withColumn("_t", F.transform("_t", lambda x: F.struct(x["line"].alias("line"), x["s"].alias("s"), e(x).alias("e"))))
    regions = F.when(lines.isNotNull(), F.transform("_t", lambda x: F.struct(
        x["line"].alias("line"), _region(lines, x["line"] - 1, x["s"], x["e"]).alias("region"))))
    return staged.withColumn(out, regions).drop("_sig", "_dl", "_op", "_t", "_ends")


def with_context_columns(files: DataFrame, max_lines: int = MAX_CHANGED_LINES_PER_FILE) -> DataFrame:
    """Adds over_line_cap and regions from ``diff_text`` and ``content_after``.

    A NULL diff or a diff without changed lines gives no regions and a false
    flag; NULL content gives NULL regions (the file still counts as visited).
    No filter on the changed-line count is applied: it would be pushed below
    the projection and run the fold twice.
    """
    base = with_changed_lines(files, "diff_text", "cl", max_lines)
    base = base.withColumn("over_line_cap", F.col("cl.n_changed") > max_lines) \
        .withColumn("first", F.col("cl.first")).withColumn("lines", py_splitlines(F.col("content_after"))) \
        .drop("cl")
    return regions_for_lines(base, "lines", "first").drop("first", "lines")


def prepare_context_files(commit_files: DataFrame, max_lines: int = MAX_CHANGED_LINES_PER_FILE) -> DataFrame:
    """Map-side per file: line-cap flag and the regions of the first changed lines."""
    rows = changed_file_rows(commit_files, "diff_text", "content_after")
    return with_context_columns(rows, max_lines).select(*KEYS, "file_order", "path", "over_line_cap", "regions")


def prepare_commit_files(commit_files: DataFrame, max_per_file: int = MAX_DIFF_CHARS_PER_FILE,
                         max_lines: int = MAX_CHANGED_LINES_PER_FILE) -> DataFrame:
    """Both builders' per-file columns in one map-side pass, checkpointed without a shuffle.

    File content is consumed here and never shuffled; only bounded candidate
    rows (cut diffs, cut regions) cross the commit shuffles downstream.
    """
    rows = changed_file_rows(commit_files, "name_status", "diff_text", "content_after")
    both = with_context_columns(with_diff_columns(rows, max_per_file), max_lines)
    return materialize(both.drop("diff_text", "content_after"))


def context_snippets(files: DataFrame, max_chars: int = MAX_CONTEXT_CHARS_PER_SNIPPET) -> DataFrame:
    """One row per non-blank region, in (file_order, pos) order, with its snippet length."""
    # posexplode_outer: a plain explode makes Catalyst infer size(regions) > 0 and
    # push it below the projections, inlining the region expression into a filter.
    ex = files.select(*KEYS, "file_order", "path", F.posexplode_outer("regions").alias("pos", "r")) \
        .where(F.col("r.region").isNotNull()) \
        .where(py_strip(F.col("r.region.text")) != "")
    text = F.col("r.region.text")
    prefix = F.concat(F.col("path"), F.lit(":"), F.col("r.line").cast("string"))
    retained = F.substring(text, 1, max_chars)
    return ex.select(
        *KEYS, "file_order", "pos", "path", F.col("r.line").alias("line"),
        F.col("r.region.start_line").alias("start_line"), F.col("r.region.end_line").alias("end_line"),
        F.col("r.region.symbol_name").alias("symbol_name"), F.col("r.region.symbol_type").alias("symbol_type"),
        F.col("r.region.extraction_method").alias("extraction_method"),
        F.length(text).alias("original_char_count"), retained.alias("retained_text"),
        (F.length(text) > max_chars).alias("snippet_truncated"), prefix.alias("prefix"),
        (F.length(prefix) + len(FIELD_SEP) + F.length(retained)).alias("snippet_len"))


def select_context_budget(snips: DataFrame, max_total: int = MAX_TOTAL_CONTEXT_CHARS) -> DataFrame:
    """T17 (W1): the diff budget rule over (file_order, pos), with offsets (T5)."""
    k = candidate_bound(max_total, len(FIELD_SEP))
    order = Window.partitionBy(*KEYS).orderBy("file_order", "pos")
    ranked = snips.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    prev = F.coalesce(F.sum("snippet_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = ranked.withColumn("_prev", prev).where((F.col("rank") == 1) | (F.col("_prev") < max_total))
    start = F.col("_prev") + (F.col("rank") - 1) * len(CONTEXT_SEP)
    cstart = start + F.length("prefix") + len(FIELD_SEP)
    return kept.select(
        "*", start.alias("start_offset"), (start + F.col("snippet_len")).alias("end_offset"),
        cstart.alias("context_start_offset"), (cstart + F.length("retained_text")).alias("context_end_offset")) \
        .drop("_prev")


REGION_FIELDS = ["file_path", "start_line", "end_line", "symbol_name", "symbol_type", "extraction_method",
                 "triggering_changed_lines", "original_char_count", "retained_char_count", "truncated",
                 "occurrences"]


def merge_regions(kept: DataFrame) -> DataFrame:
    """One row per (file, start, end, retained text, method); triggering lines sorted
    and distinct; truncation OR-ed; occurrences in emit order; first-seen rank kept."""
    occ = F.struct(F.col("rank"), F.struct(
        F.col("line").alias("triggering_changed_line"), "start_offset", "end_offset",
        "context_start_offset", "context_end_offset").alias("o"))
    g = kept.groupBy(*KEYS, "path", "start_line", "end_line", "retained_text", "extraction_method").agg(
        F.min("rank").alias("first_rank"),
        F.min_by("symbol_name", "rank").alias("symbol_name"),
        F.min_by("symbol_type", "rank").alias("symbol_type"),
        F.min_by("original_char_count", "rank").alias("original_char_count"),
        F.array_sort(F.collect_set("line")).alias("triggering_changed_lines"),
        F.bool_or("snippet_truncated").alias("truncated"),
        F.array_sort(F.collect_list(occ)).alias("_occ"))
    return g.select(
        *KEYS, "first_rank", F.col("path").alias("file_path"), "start_line", "end_line", "symbol_name",
        "symbol_type", "extraction_method", "triggering_changed_lines", "original_char_count",
        F.length("retained_text").alias("retained_char_count"), "truncated",
        F.transform("_occ", lambda e: e["o"]).alias("occurrences"))


def context_artifacts(commit_files: DataFrame, max_lines: int = MAX_CHANGED_LINES_PER_FILE,
                      max_chars: int = MAX_CONTEXT_CHARS_PER_SNIPPET,
                      max_total: int = MAX_TOTAL_CONTEXT_CHARS, prepared: DataFrame | None = None) -> DataFrame:
    """Context artifact per commit (empty text when nothing was extracted).

    ``extraction_truncated`` = a visited file had more than ``max_lines``
    changed lines, or a snippet was cut, or the total budget fired.  A file is
    visited when it is not after the file holding the budget-crossing snippet.
    Same plan shape as the diff builder: map-side prep checkpointed without a
    shuffle, exact candidate bound as a partial group limit before the
    commit shuffle, bounded kept rows checkpointed.
    """
    files = prepared if prepared is not None else materialize(prepare_context_files(commit_files, max_lines))
    kept = materialize_budget(select_context_budget(context_snippets(files, max_chars), max_total),
                              candidate_bound(max_total, len(FIELD_SEP)))
    per = kept.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("rank", "prefix", "retained_text"))).alias("_s"),
        F.sum("snippet_len").alias("_sum"), F.max("file_order").alias("_last_file"),
        F.bool_or("snippet_truncated").alias("_cut"))
    per = per.select(*KEYS, "_s", "_cut", (F.col("_sum") >= max_total).alias("_capped"),
                     F.when(F.col("_sum") >= max_total, F.col("_last_file")).alias("_cap_file"))
    # A visited file over the line cap exists iff the earliest such file is not
    # after the capping file: one partial aggregate per commit, no per-file join.
    commits = files.groupBy(*KEYS).agg(F.min(F.when(F.col("over_line_cap"), F.col("file_order"))).alias("_min_over"))
    flags = commits.join(per, KEYS, "left").select(
        *KEYS, "_s", "_cut", "_capped",
        (F.col("_min_over").isNotNull() & (F.col("_cap_file").isNull() | (F.col("_min_over") <= F.col("_cap_file"))))
        .alias("_over"))
    regions = merge_regions(kept)
    ra = regions.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("first_rank", *REGION_FIELDS))).alias("_r"),
        F.sum("original_char_count").alias("_orig"))
    text = F.coalesce(F.array_join(F.transform("_s", lambda e: F.concat(e["prefix"], F.lit(FIELD_SEP),
                                                                         e["retained_text"])), CONTEXT_SEP),
                      F.lit(""))
    out = flags.join(ra, KEYS, "left")
    return out.select(
        *KEYS, text.alias("text"), F.lit("context").alias("source_type"),
        F.when(F.col("_r").isNull(), F.lit(0)).otherwise(F.size("_r")).alias("regions_retained"),
        F.coalesce(F.col("_orig"), F.lit(0)).alias("original_char_count"),
        F.length(text).alias("retained_char_count"),
        (F.coalesce(F.col("_over"), F.lit(False)) | F.coalesce(F.col("_cut"), F.lit(False))
         | F.coalesce(F.col("_capped"), F.lit(False))).alias("extraction_truncated"),
        F.transform(F.coalesce(F.col("_r"), F.array()),
                    lambda e: F.struct(*[e[f].alias(f) for f in REGION_FIELDS])).alias("regions"))
