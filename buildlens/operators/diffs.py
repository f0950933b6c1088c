"""Commit message and diff text assembly with offset-exact provenance.

Plan shape: per-file work is map-side (strip, cut, header fold, name-status
parse); a single shuffle by ``(repo, commit_sha)`` feeds the ordered budget
window, the line-level hunk parse and the re-aggregation, all of which are
keyed by supersets of the shuffle key and so reuse its partitioning.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import diff_git_paths
from ..session import ensure_checkpoint_dir, scoped_conf
from ..functions.text import py_splitlines, py_splitlines_keepends, py_strip, strip_line_end

# Separators of the assembled texts.
DIFF_FILE_SEP = "\n<DIFF_FILE_SEP>\n"
FIELD_SEP = "\n<FIELD_SEP>\n"
CONTEXT_SEP = "\n<CONTEXT_SEP>\n"

# Fixed value: unified-diff hunk header, counts optional (default 1).
HUNK_HEADER = "^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@"

MAX_DIFF_CHARS_PER_FILE = 20_000
MAX_TOTAL_DIFF_CHARS = 100_000

KEYS = ["repo", "commit_sha"]


def candidate_bound(max_total: int, min_snippet_len: int) -> int:
    """Largest rank a snippet can have and still be retained.

    Every snippet is at least ``min_snippet_len`` long, so once ``k-1``
    snippets are in, their sum is >= (k-1)*min and the budget has fired when
    that reaches ``max_total``.  Filtering ranks above this is exact.
    """
    return max(1, math.ceil(max_total / max(1, min_snippet_len)) + 1)


# ------------------------------------------------------------------ T1
def message_artifact(commits: DataFrame) -> DataFrame:
    """Stripped message and its character counts; never truncated."""
    text = py_strip(F.coalesce(F.col("message"), F.lit("")))
    return commits.select(*KEYS, F.struct(
        text.alias("text"),
        F.struct(F.lit("commit_message").alias("source_type"),
                 F.length(text).alias("original_char_count"),
                 F.length(text).alias("retained_char_count"),
                 F.lit(False).alias("extraction_truncated")).alias("provenance")).alias("message"))


# ------------------------------------------------------------------ T2 / T3
def changed_files(commit_files: DataFrame) -> DataFrame:
    """Changed paths in listing order; blank paths dropped, paths stripped."""
    p = py_strip(F.col("path"))
    return commit_files.where(p != "").select(*KEYS, "file_order", p.alias("path"))


def parse_name_status(line: Column) -> Column:
    """One name-status line -> struct(key_path, old_path, new_path, change_type) or NULL."""
    parts = F.split(line, "\t", -1)
    status = F.element_at(parts, 1)
    n = F.size(parts)
    p1 = F.element_at(parts, 2)
    p2 = F.element_at(parts, 3)
    null = F.lit(None).cast("string")

    def meta(key, old, new, kind):
        return F.struct(key.alias("key_path"), old.alias("old_path"), new.alias("new_path"),
                        F.lit(kind).alias("change_type"))
    return (F.when(line.isNull() | (py_strip(line) == ""), F.lit(None))
            .when(status.startswith("R") & (n >= 3), meta(p2, p1, p2, "renamed"))
            .when((status == "A") & (n >= 2), meta(p1, null, p1, "added"))
            .when((status == "D") & (n >= 2), meta(p1, p1, null, "deleted"))
            .when((status == "M") & (n >= 2), meta(p1, p1, p1, "modified")))


def name_status_table(commit_files: DataFrame, only_keys: DataFrame | None = None) -> DataFrame:
    """T3 as a table: one row per path key, the later listing line wins.

    ``only_keys`` (repo, commit_sha, key_path) restricts the entries to the
    keys that will be looked up.
    """
    ns = commit_files.select(*KEYS, "file_order", parse_name_status(F.col("name_status")).alias("ns")) \
        .where(F.col("ns").isNotNull()).select(*KEYS, "file_order", "ns.*")
    if only_keys is not None:
        ns = ns.join(only_keys, KEYS + ["key_path"], "left_semi")
    w = Window.partitionBy(*KEYS, "key_path").orderBy(F.col("file_order").desc())
    return ns.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk", "file_order")


# ------------------------------------------------------------------ T7
def header_metadata(text: Column) -> Column:
    """Fold over the diff lines -> struct(old_path, new_path, change_type, binary).

    The last ``diff --git`` / rename line wins; ``modified`` is the default
    once any path is known.  Lines that set nothing are left out of the fold.
    """
    marks = ("diff --git ", "rename from ", "rename to ", "new file mode", "deleted file mode", "Binary files ", "GIT binary patch")
    lines = F.filter(py_splitlines(text), lambda line: reduce(Column.__or__, [line.startswith(m) for m in marks]))
    null = F.lit(None).cast("string")
    init = F.struct(null.alias("old_path"), null.alias("new_path"), null.alias("change_type"),
                    F.lit(False).alias("binary"))

    def step(acc, line):
        git = diff_git_paths(line)
        is_git = line.startswith("diff --git ")
        rf = py_strip(F.substring(line, len("rename from ") + 1, 1 << 30))
        rt = py_strip(F.substring(line, len("rename to ") + 1, 1 << 30))
        is_rf = line.startswith("rename from ")
        is_rt = line.startswith("rename to ")
        old = (F.when(is_git, git["old_path"])
               .when(is_rf & (rf != ""), rf).otherwise(acc["old_path"]))
        new = (F.when(is_git, git["new_path"])
               .when(is_rt & (rt != ""), rt).otherwise(acc["new_path"]))
        kind = (F.when(is_git, acc["change_type"])
                .when(line.startswith("new file mode"), F.lit("added"))
                .when(line.startswith("deleted file mode"), F.lit("deleted"))
                .when(is_rf | is_rt, F.lit("renamed"))
                .otherwise(acc["change_type"]))
        binary = acc["binary"] | (~is_git & (line.startswith("Binary files ")
                                            | line.startswith("GIT binary patch")))
        # The branches are exclusive in the line loop: a diff --git line only sets paths.
        return F.struct(old.alias("old_path"), new.alias("new_path"), kind.alias("change_type"),
                        binary.alias("binary"))

    def finish(acc):
        kind = F.when(acc["change_type"].isNull() & (acc["old_path"].isNotNull() | acc["new_path"].isNotNull()),
                      F.lit("modified")).otherwise(acc["change_type"])
        return F.struct(acc["old_path"].alias("old_path"), acc["new_path"].alias("new_path"),
                        kind.alias("change_type"), acc["binary"].alias("binary"))
    return F.aggregate(lines, init, step, finish)


# ------------------------------------------------------------------ map-side file prep
def with_diff_columns(files: DataFrame, max_per_file: int = MAX_DIFF_CHARS_PER_FILE) -> DataFrame:
    """Adds usable / original_char_count / retained_diff / truncated from ``diff_text``."""
    full = py_strip(F.col("diff_text"))
    usable = F.col("diff_text").isNotNull() & (full != "")
    return files.withColumn("usable", usable) \
        .withColumn("original_char_count", F.when(usable, F.length(full))) \
        .withColumn("retained_diff", F.when(usable, F.substring(full, 1, max_per_file))) \
        .withColumn("truncated", F.when(usable, F.length(full) > max_per_file))


def changed_file_rows(commit_files: DataFrame, *extra: str) -> DataFrame:
    """T2 rows with the given extra columns: stripped non-blank paths."""
    path = py_strip(F.col("path"))
    return commit_files.where(path != "").select(*KEYS, "file_order", path.alias("path"), *extra)


def prepare_diff_files(commit_files: DataFrame, max_per_file: int = MAX_DIFF_CHARS_PER_FILE) -> DataFrame:
    """Per file: stripped diff, per-file cut, lengths; content is not carried."""
    return with_diff_columns(changed_file_rows(commit_files, "name_status", "diff_text"), max_per_file) \
        .drop("diff_text")


def select_diff_budget(files: DataFrame, max_total: int = MAX_TOTAL_DIFF_CHARS) -> DataFrame:
    """T4/T5 (W1): keep snippets until the running length reaches the budget.

    A snippet is kept when it is the first or the snippets before it sum to
    less than ``max_total`` (the crossing snippet is kept).  Offsets count
    earlier snippet lengths plus one separator per earlier snippet.
    """
    k = candidate_bound(max_total, len(FIELD_SEP))
    u = files.where("usable").withColumn(
        "snippet_len", F.length("path") + F.lit(len(FIELD_SEP)) + F.length("retained_diff"))
    order = Window.partitionBy(*KEYS).orderBy("file_order")
    ranked = u.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    prev = F.sum("snippet_len").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = ranked.withColumn("_prev", F.coalesce(prev, F.lit(0))) \
        .where((F.col("rank") == 1) | (F.col("_prev") < max_total))
    start = F.col("_prev") + (F.col("rank") - 1) * len(DIFF_FILE_SEP)
    return kept.select(
        *KEYS, "file_order", "path", "retained_diff", "original_char_count", "truncated", "rank",
        "snippet_len",
        start.alias("start_offset"),
        (start + F.col("snippet_len")).alias("end_offset"),
        (start + F.length("path") + len(FIELD_SEP)).alias("diff_start_offset"),
        (start + F.col("snippet_len")).alias("diff_end_offset"))


# ------------------------------------------------------------------ T8 / T9
def parse_hunks(kept: DataFrame) -> DataFrame:
    """Hunks of each retained diff, with line numbers and text offsets.

    Lines keep their ends; offsets are running sums of line lengths from the
    file's diff start.  Inside a hunk, ``+++ ``/``--- `` lines are skipped;
    ``+`` lines take the new-side number, ``-`` lines the old-side number,
    any other line advances both counters.
    """
    fkeys = KEYS + ["file_order"]
    lines = kept.select(*fkeys, "diff_start_offset", "diff_end_offset",
                        F.posexplode_outer(py_splitlines_keepends(F.col("retained_diff"))).alias("pos", "raw")) \
        .where(F.col("raw").isNotNull())
    s = strip_line_end(F.col("raw"))
    hdr = F.col("raw").startswith("@@ -") & (F.regexp_extract(s, HUNK_HEADER, 0) != "")  # other lines skip the regex
    wf = Window.partitionBy(*fkeys).orderBy("pos")
    x = lines.select(
        *fkeys, "pos", "diff_end_offset",
        (F.col("diff_start_offset") + F.coalesce(
            F.sum(F.length("raw")).over(wf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"),
        hdr.alias("is_header"),
        F.sum(hdr.cast("int")).over(wf.rowsBetween(Window.unboundedPreceding, 0)).alias("hunk"),
        F.when(hdr, F.regexp_extract(s, HUNK_HEADER, 1).cast("int")).alias("h_old_start"),
        F.when(hdr, F.coalesce(F.nullif(F.regexp_extract(s, HUNK_HEADER, 2), F.lit("")), F.lit("1")).cast("int"))
        .alias("h_old_count"),
        F.when(hdr, F.regexp_extract(s, HUNK_HEADER, 3).cast("int")).alias("h_new_start"),
        F.when(hdr, F.coalesce(F.nullif(F.regexp_extract(s, HUNK_HEADER, 4), F.lit("")), F.lit("1")).cast("int"))
        .alias("h_new_count"),
        (s.startswith("+++ ") | s.startswith("--- ")).alias("skip"),
        s.startswith("+").alias("plus"), s.startswith("-").alias("minus"))
    body = ~F.col("is_header") & ~F.col("skip")
    old_adv = (body & ~F.col("plus")).cast("int")
    new_adv = (body & ~F.col("minus")).cast("int")
    wh = Window.partitionBy(*fkeys, "hunk").orderBy("pos")
    before = wh.rowsBetween(Window.unboundedPreceding, -1)
    y = x.where("hunk > 0").select(
        *fkeys, "hunk", "pos", "offset", "is_header", "diff_end_offset",
        "h_old_start", "h_old_count", "h_new_start", "h_new_count",
        (body & F.col("plus")).alias("added"), (body & ~F.col("plus") & F.col("minus")).alias("removed"),
        (F.max("h_old_start").over(wh) + F.coalesce(F.sum(old_adv).over(before), F.lit(0))).alias("old_no"),
        (F.max("h_new_start").over(wh) + F.coalesce(F.sum(new_adv).over(before), F.lit(0))).alias("new_no"))
    hunks = y.groupBy(*fkeys, "hunk").agg(
        F.max("h_old_start").alias("old_start"), F.max("h_old_count").alias("old_count"),
        F.max("h_new_start").alias("new_start"), F.max("h_new_count").alias("new_count"),
        F.min("offset").alias("start_offset"), F.max("diff_end_offset").alias("_file_end"),
        F.array_sort(F.collect_list(F.when(F.col("added"), F.struct("pos", "new_no")))).alias("_add"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.struct("pos", "old_no")))).alias("_rem"))
    nxt = F.lead("start_offset").over(Window.partitionBy(*fkeys).orderBy("hunk"))
    return hunks.select(
        *fkeys, "hunk", "old_start", "old_count", "new_start", "new_count",
        F.transform("_add", lambda e: e["new_no"]).alias("added_line_numbers"),
        F.transform("_rem", lambda e: e["old_no"]).alias("removed_line_numbers"),
        "start_offset", F.coalesce(nxt, F.col("_file_end")).alias("end_offset"))


HUNK_FIELDS = ["old_start", "old_count", "new_start", "new_count", "added_line_numbers",
               "removed_line_numbers", "start_offset", "end_offset"]


def file_hunk_arrays(hunks: DataFrame) -> DataFrame:
    """Per file, hunks in order and the flattened added/removed numbers."""
    fkeys = KEYS + ["file_order"]
    per = hunks.groupBy(*fkeys).agg(
        F.array_sort(F.collect_list(F.struct("hunk", *HUNK_FIELDS))).alias("_h"))
    h = F.transform("_h", lambda e: F.struct(*[e[f].alias(f) for f in HUNK_FIELDS]))
    return per.select(*fkeys, h.alias("hunk_ranges"),
                      F.flatten(F.transform("_h", lambda e: e["added_line_numbers"])).alias("added_line_numbers"),
                      F.flatten(F.transform("_h", lambda e: e["removed_line_numbers"])).alias("removed_line_numbers"))


# ------------------------------------------------------------------ T4-T10 together
def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared checkpoint folder.

    A checkpointed relation keeps the output partitioning of the plan that
    produced it, so keyed operators downstream can reuse it; executor loss
    does not recompute the work before the cut.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def materialize_budget(selected: DataFrame, k: int) -> DataFrame:
    """Checkpoint a ``row_number() <= k`` budget selection with the group limit enabled.

    Spark turns ``rank <= k`` into a partial per-key limit that runs before
    the shuffle only while k is under ``windowGroupLimitThreshold`` (1000 by
    default); the exact candidate bounds here are larger, so the threshold is
    raised for the eager checkpoint that plans and runs the selection.  That
    one step also runs without adaptive execution: a checkpoint of an
    adaptive plan does not report its hash partitioning, and with it the
    branches downstream (text, hunks, metadata, region merge -- all keyed by
    the commit) need no further shuffle.  AQE's skew splitting applies to
    joins, not to this window stage, and the partial limit already bounds
    the rows per commit and map task.
    """
    with scoped_conf(selected.sparkSession, {GROUP_LIMIT_CONF: k + 1, "spark.sql.adaptive.enabled": "false"}):
        return materialize(selected)


def diff_artifacts(commit_files: DataFrame, max_per_file: int = MAX_DIFF_CHARS_PER_FILE,
                   max_total: int = MAX_TOTAL_DIFF_CHARS, with_files: bool = True,
                   prepared: DataFrame | None = None) -> DataFrame:
    """Diff artifact per commit: text + provenance (files_found .. files[]).

    Plan: the per-file table is prepared map-side and checkpointed (no
    shuffle).  Candidates are ranked per commit with ``row_number() <= K``
    (exact bound), which Spark runs as a partial group limit *before* the
    shuffle, so even a commit holding a third of all files sends at most K
    rows per map task.  The budget window runs after the shuffle; the kept
    rows (bounded per commit) are checkpointed and feed the text, hunk and
    metadata branches.  ``files_found`` is a partial aggregate.
    ``prepared`` is a prepared per-file table (see ``context.prepare_commit_files``).
    """
    prep = prepared if prepared is not None else materialize(prepare_diff_files(commit_files, max_per_file))
    found = prep.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("files_found"))
    kept = materialize_budget(select_diff_budget(prep, max_total), candidate_bound(max_total, len(FIELD_SEP)))
    per_commit = kept.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("file_order", "path", "retained_diff"))).alias("_s"),
        F.count(F.lit(1)).alias("files_retained"),
        F.sum("original_char_count").alias("original_char_count"),
        F.sum("snippet_len").alias("_sum_len"),
        F.bool_or("truncated").alias("_any_cut"))
    text = F.array_join(F.transform("_s", lambda e: F.concat(e["path"], F.lit(FIELD_SEP), e["retained_diff"])),
                        DIFF_FILE_SEP)
    # a commit whose diffs are all blank keeps an artifact: no text, its files counted
    out = found.join(per_commit, KEYS, "left").select(
        *KEYS, F.coalesce(text, F.lit("")).alias("text"),
        F.lit("diff").alias("source_type"), "files_found",
        F.coalesce("files_retained", F.lit(0)).alias("files_retained"),
        F.coalesce("original_char_count", F.lit(0)).alias("original_char_count"),
        F.coalesce(F.length(text), F.lit(0)).alias("retained_char_count"),
        F.coalesce(F.col("_any_cut") | (F.col("_sum_len") >= max_total), F.lit(False)).alias("extraction_truncated"),
        F.coalesce(F.transform("_s", lambda e: e["path"]), F.array().cast("array<string>")).alias("retained_file_order"))
    if not with_files:
        return out
    fa = file_metadata(prep, kept)
    kind = fa.schema["files"].dataType
    return out.join(fa, KEYS, "left").select(*out.columns, F.coalesce("files", F.array().cast(kind)).alias("files"))


def file_metadata(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Per commit, the ``files`` array of retained-file metadata.

    ``files`` carries the name-status lines of every changed file of the
    commits (the commit-partitioned table).  Hunk arrays and name-status
    entries are folded into per-commit maps and looked up by file order and
    path, so every join is on exactly (repo, commit_sha) and reuses the one
    commit partitioning.  Name-status fields override header fields.
    """
    hdr = kept.select(*KEYS, F.struct(
        "file_order", "path", "original_char_count", "truncated", "start_offset", "end_offset",
        "diff_start_offset", "diff_end_offset", F.length("retained_diff").alias("retained_char_count"),
        header_metadata(F.col("retained_diff")).alias("h")).alias("f")) \
        .groupBy(*KEYS).agg(F.array_sort(F.collect_list("f")).alias("_files"))
    arrays = file_hunk_arrays(parse_hunks(kept))
    hm = arrays.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct(
        "file_order", F.struct("hunk_ranges", "added_line_numbers", "removed_line_numbers")))).alias("_hm"))
    # only name-status entries whose key is a retained path matter; the semi-join
    # spreads a hot commit's entries over (commit, path) before the later-wins window
    kept_paths = kept.select(*KEYS, F.col("path").alias("key_path"))
    ns = name_status_table(files, kept_paths)
    nm = ns.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct(
        "key_path", F.struct("old_path", "new_path", "change_type")))).alias("_nm"))
    j = hdr.join(hm, KEYS, "left").join(nm, KEYS, "left")
    hunk_type = ("array<struct<old_start:int,old_count:int,new_start:int,new_count:int,"
                 "added_line_numbers:array<int>,removed_line_numbers:array<int>,"
                 "start_offset:bigint,end_offset:bigint>>")
    empty_int = F.array().cast("array<int>")

    def one(f):
        h = F.try_element_at(F.col("_hm"), f["file_order"])
        n = F.try_element_at(F.col("_nm"), f["path"])
        binary_null = f["h"]["binary"] & h.isNull()
        return F.struct(
            f["path"].alias("path"), f["path"].alias("retained_path"),
            F.coalesce(n["old_path"], f["h"]["old_path"]).alias("old_path"),
            F.coalesce(n["new_path"], f["h"]["new_path"]).alias("new_path"),
            F.coalesce(n["change_type"], f["h"]["change_type"]).alias("change_type"),
            f["h"]["binary"].alias("binary"),
            f["original_char_count"].alias("original_char_count"),
            f["retained_char_count"].alias("retained_char_count"), f["truncated"].alias("truncated"),
            F.when(binary_null, F.lit(None)).otherwise(
                F.coalesce(h["hunk_ranges"], F.array().cast(hunk_type))).alias("hunk_ranges"),
            F.when(binary_null, F.lit(None)).otherwise(F.coalesce(h["added_line_numbers"], empty_int))
            .alias("added_line_numbers"),
            F.when(binary_null, F.lit(None)).otherwise(F.coalesce(h["removed_line_numbers"], empty_int))
            .alias("removed_line_numbers"),
            f["start_offset"].alias("start_offset"), f["end_offset"].alias("end_offset"),
            f["diff_start_offset"].alias("diff_start_offset"), f["diff_end_offset"].alias("diff_end_offset"))

    return j.select(*KEYS, F.transform("_files", one).alias("files"))
