"""Registered queries: commit message, diff text, hunks, name-status (phase 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import diff_git_paths
from ..operators import diffs as DF
from . import duck as D
from . import fixtures as FX

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


SEP_DIFF = "chr(10) || '<DIFF_FILE_SEP>' || chr(10)"
SEP_FIELD = "chr(10) || '<FIELD_SEP>' || chr(10)"
HUNK = "'^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@'"


def duck_kept(cap: int, per_file: int = 20000) -> str:
    """DuckDB views cf, p, r, k: usable diffs, budget window, kept snippets with offsets."""
    return FX.duck_with(cf=FX.DUCK_COMMIT_FILES).rstrip("\n") + f""",
p AS (SELECT repo, commit_sha, file_order, {D.strip('path')} AS path, {D.strip('diff_text')} AS dtext
      FROM cf WHERE {D.strip('path')} <> ''),
q AS (SELECT *, substring(dtext, 1, {per_file}) AS ret, length(dtext) AS orig, length(dtext) > {per_file} AS cut
      FROM p WHERE dtext IS NOT NULL AND dtext <> ''),
r AS (SELECT *, length(path) + 13 + length(ret) AS slen,
      row_number() OVER (PARTITION BY repo, commit_sha ORDER BY file_order) AS rk,
      coalesce(sum(length(path) + 13 + length(ret)) OVER (PARTITION BY repo, commit_sha ORDER BY file_order
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM q),
k AS (SELECT *, prev + (rk - 1) * 17 AS so, prev + (rk - 1) * 17 + length(path) + 13 AS dso,
      prev + (rk - 1) * 17 + slen AS deo FROM r WHERE rk = 1 OR prev < {cap})
"""


def duck_hunks(cap: int) -> str:
    """DuckDB views l..h2: retained diff lines with ends, running offsets, hunk ids and numbers."""
    key = "repo, commit_sha, file_order"
    return duck_kept(cap).rstrip("\n") + f""",
l0 AS (SELECT {key}, dso, deo, string_split(ret, chr(10)) AS parts FROM k),
l1 AS (SELECT {key}, dso, deo, unnest(parts) AS x, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM l0),
l2 AS (SELECT *, CASE WHEN i < n THEN x || chr(10) ELSE x END AS raw FROM l1),
l3 AS (SELECT *, regexp_replace(raw, '[\\r\\n]+$', '') AS s FROM l2 WHERE raw <> ''),
l4 AS (SELECT *, regexp_matches(s, {HUNK}) AS hdr,
   dso + coalesce(sum(length(raw)) OVER (PARTITION BY {key} ORDER BY i
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l3),
l5 AS (SELECT *, sum(CAST(hdr AS INTEGER)) OVER (PARTITION BY {key} ORDER BY i
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hunk,
   (NOT hdr AND NOT (starts_with(s, '+++ ') OR starts_with(s, '--- '))) AS body FROM l4),
h AS (SELECT *, CASE WHEN hdr THEN CAST(regexp_extract(s, {HUNK}, 1) AS INTEGER) END AS os,
   CASE WHEN hdr THEN CAST(coalesce(nullif(regexp_extract(s, {HUNK}, 2), ''), '1') AS INTEGER) END AS oc,
   CASE WHEN hdr THEN CAST(regexp_extract(s, {HUNK}, 3) AS INTEGER) END AS ns,
   CASE WHEN hdr THEN CAST(coalesce(nullif(regexp_extract(s, {HUNK}, 4), ''), '1') AS INTEGER) END AS nc,
   body AND starts_with(s, '+') AS added, body AND NOT starts_with(s, '+') AND starts_with(s, '-') AS removed
   FROM l5 WHERE hunk > 0),
h2 AS (SELECT *, max(os) OVER (PARTITION BY {key}, hunk) + coalesce(sum(CAST(body AND NOT starts_with(s, '+') AS INTEGER))
     OVER (PARTITION BY {key}, hunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old_no,
   max(ns) OVER (PARTITION BY {key}, hunk) + coalesce(sum(CAST(body AND NOT starts_with(s, '-') AS INTEGER))
     OVER (PARTITION BY {key}, hunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_no
   FROM h),
hk AS (SELECT {key}, hunk, max(os) AS old_start, max(oc) AS old_count, max(ns) AS new_start, max(nc) AS new_count,
   coalesce(list(new_no ORDER BY i) FILTER (WHERE added), []) AS added_line_numbers,
   coalesce(list(old_no ORDER BY i) FILTER (WHERE removed), []) AS removed_line_numbers,
   min(off) AS start_offset, max(deo) AS file_end FROM h2 GROUP BY {key}, hunk),
hunks AS (SELECT {key}, hunk, old_start, old_count, new_start, new_count, added_line_numbers, removed_line_numbers,
   start_offset, coalesce(lead(start_offset) OVER (PARTITION BY {key} ORDER BY hunk), file_end) AS end_offset FROM hk)
"""


def commit_files(spark, sf_dir):
    return FX.commit_files(spark, sf_dir)


@query("commit_source", FX.duck_with(cf=FX.DUCK_COMMIT_FILES, c=FX.DUCK_COMMITS) + """
SELECT cf.repo, cf.commit_sha, count(*) AS n_files, count(cf.content_after) AS n_with_content,
 max(c.message) AS message FROM cf JOIN c USING (repo, commit_sha) GROUP BY cf.repo, cf.commit_sha""")
def q_commit_source(spark, sf_dir):
    """Commit and changed-file tables joined per commit (content may be NULL)."""
    cf = commit_files(spark, sf_dir)
    c = FX.commits(spark, sf_dir)
    per = cf.groupBy(*DF.KEYS).agg(F.count(F.lit(1)).alias("n_files"),
                                   F.count("content_after").alias("n_with_content"))
    return per.join(c, DF.KEYS).select(*DF.KEYS, "n_files", "n_with_content", "message")


@query("message_artifact", FX.duck_with(c=FX.DUCK_COMMITS) + f"""
SELECT repo, commit_sha, {D.strip('message')} AS text, length({D.strip('message')}) AS original_char_count,
 length({D.strip('message')}) AS retained_char_count, false AS extraction_truncated FROM c""")
def q_message_artifact(spark, sf_dir):
    m = DF.message_artifact(FX.commits(spark, sf_dir))
    return m.select(*DF.KEYS, "message.text", "message.provenance.original_char_count",
                    "message.provenance.retained_char_count", "message.provenance.extraction_truncated")


@query("changed_files", FX.duck_with(cf=FX.DUCK_COMMIT_FILES) + f"""
SELECT repo, commit_sha, file_order, {D.strip('path')} AS path FROM cf WHERE {D.strip('path')} <> ''""")
def q_changed_files(spark, sf_dir):
    return DF.changed_files(commit_files(spark, sf_dir))


@query("name_status", FX.duck_with(cf=FX.DUCK_COMMIT_FILES) + """
, s AS (SELECT repo, commit_sha, file_order, string_split(name_status, chr(9)) AS p FROM cf WHERE name_status IS NOT NULL),
m AS (SELECT repo, commit_sha, file_order,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN p[3] WHEN p[1] IN ('A', 'D', 'M') AND len(p) >= 2 THEN p[2] END AS key_path,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN p[2] WHEN p[1] IN ('D', 'M') AND len(p) >= 2 THEN p[2] END AS old_path,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN p[3] WHEN p[1] IN ('A', 'M') AND len(p) >= 2 THEN p[2] END AS new_path,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN 'renamed' WHEN p[1] = 'A' AND len(p) >= 2 THEN 'added'
       WHEN p[1] = 'D' AND len(p) >= 2 THEN 'deleted' WHEN p[1] = 'M' AND len(p) >= 2 THEN 'modified' END AS change_type
  FROM s)
SELECT repo, commit_sha, key_path, old_path, new_path, change_type FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, key_path ORDER BY file_order DESC) AS rk
  FROM m WHERE change_type IS NOT NULL) WHERE rk = 1""")
def q_name_status(spark, sf_dir):
    return DF.name_status_table(commit_files(spark, sf_dir))


def _diff_text_sql(cap: int) -> str:
    return duck_kept(cap) + f"""
, t AS (SELECT repo, commit_sha, string_agg(path || {SEP_FIELD} || ret, {SEP_DIFF} ORDER BY file_order) AS text FROM k
  GROUP BY repo, commit_sha)
SELECT f.repo, f.commit_sha, coalesce(t.text, '') AS text FROM (SELECT DISTINCT repo, commit_sha FROM p) f
LEFT JOIN t USING (repo, commit_sha)"""


@query("diff_text", _diff_text_sql(100000))
def q_diff_text(spark, sf_dir):
    return DF.diff_artifacts(commit_files(spark, sf_dir), with_files=False).select(*DF.KEYS, "text")


@query("diff_text_capped", _diff_text_sql(6000))
def q_diff_text_capped(spark, sf_dir):
    return DF.diff_artifacts(commit_files(spark, sf_dir), max_total=6000, with_files=False) \
        .select(*DF.KEYS, "text")


@query("diff_offsets", duck_kept(100000) + """
SELECT repo, commit_sha, file_order, so AS start_offset, deo AS end_offset, dso AS diff_start_offset,
 deo AS diff_end_offset FROM k""")
def q_diff_offsets(spark, sf_dir):
    kept = DF.select_diff_budget(DF.prepare_diff_files(commit_files(spark, sf_dir)))
    return kept.select(*DF.KEYS, "file_order", "start_offset", "end_offset", "diff_start_offset", "diff_end_offset")


@query("diff_provenance", duck_kept(100000) + """
, fnd AS (SELECT repo, commit_sha, count(*) AS files_found FROM p GROUP BY repo, commit_sha),
agg AS (SELECT repo, commit_sha, count(*) AS files_retained, sum(orig) AS original_char_count,
  length(string_agg(path || chr(10) || '<FIELD_SEP>' || chr(10) || ret, chr(10) || '<DIFF_FILE_SEP>' || chr(10)
    ORDER BY file_order)) AS retained_char_count,
  bool_or(cut) OR sum(slen) >= 100000 AS extraction_truncated, list(path ORDER BY file_order) AS retained_file_order
  FROM k GROUP BY repo, commit_sha)
SELECT fnd.repo, fnd.commit_sha, 'diff' AS source_type, fnd.files_found, coalesce(files_retained, 0) AS files_retained,
 coalesce(original_char_count, 0) AS original_char_count, coalesce(retained_char_count, 0) AS retained_char_count,
 coalesce(extraction_truncated, false) AS extraction_truncated, coalesce(retained_file_order, []) AS retained_file_order
FROM fnd LEFT JOIN agg USING (repo, commit_sha)""")
def q_diff_provenance(spark, sf_dir):
    a = DF.diff_artifacts(commit_files(spark, sf_dir), with_files=False)
    return a.select(*DF.KEYS, "source_type", "files_found", "files_retained", "original_char_count",
                    "retained_char_count", "extraction_truncated", "retained_file_order")


@query("diff_header_meta", duck_kept(100000) + """
, hl AS (SELECT repo, commit_sha, file_order, unnest(string_split(ret, chr(10))) AS line,
   generate_subscripts(string_split(ret, chr(10)), 1) AS i FROM k),
g AS (SELECT repo, commit_sha, file_order, string_split(substring(line, 12), ' ') AS parts, i FROM hl
   WHERE starts_with(line, 'diff --git ')),
last_git AS (SELECT repo, commit_sha, file_order, arg_max(parts, i) AS parts FROM g GROUP BY ALL),
kinds AS (SELECT repo, commit_sha, file_order, arg_max(CASE WHEN starts_with(line, 'new file mode') THEN 'added'
   WHEN starts_with(line, 'deleted file mode') THEN 'deleted' ELSE 'renamed' END, i) AS kind FROM hl
   WHERE starts_with(line, 'new file mode') OR starts_with(line, 'deleted file mode')
      OR starts_with(line, 'rename from ') OR starts_with(line, 'rename to ') GROUP BY ALL),
bin AS (SELECT repo, commit_sha, file_order, bool_or(starts_with(line, 'Binary files ')
   OR starts_with(line, 'GIT binary patch')) AS is_bin FROM hl GROUP BY ALL)
SELECT k.repo, k.commit_sha, k.file_order,
 CASE WHEN len(g.parts) >= 2 THEN regexp_replace(g.parts[1], '^[ab]/', '') END AS old_path,
 CASE WHEN len(g.parts) >= 2 THEN regexp_replace(g.parts[2], '^[ab]/', '') END AS new_path,
 coalesce(kinds.kind, CASE WHEN len(g.parts) >= 2 THEN 'modified' END) AS change_type,
 coalesce(bin.is_bin, false) AS binary
FROM k LEFT JOIN last_git g USING (repo, commit_sha, file_order) LEFT JOIN kinds USING (repo, commit_sha, file_order)
LEFT JOIN bin USING (repo, commit_sha, file_order)""")
def q_diff_header_meta(spark, sf_dir):
    kept = DF.select_diff_budget(DF.prepare_diff_files(commit_files(spark, sf_dir)))
    return kept.select(*DF.KEYS, "file_order", DF.header_metadata(F.col("retained_diff")).alias("h")) \
        .select(*DF.KEYS, "file_order", "h.old_path", "h.new_path", "h.change_type", "h.binary")


@query("diff_git_paths", FX.duck_with(cf=FX.DUCK_COMMIT_FILES) + """
, f AS (SELECT repo, commit_sha, file_order, string_split(substring(diff_text, 12), chr(10))[1] AS rest FROM cf
   WHERE starts_with(diff_text, 'diff --git '))
SELECT repo, commit_sha, file_order,
 CASE WHEN len(string_split(rest, ' ')) >= 2 THEN regexp_replace(string_split(rest, ' ')[1], '^[ab]/', '') END AS old_path,
 CASE WHEN len(string_split(rest, ' ')) >= 2 THEN regexp_replace(string_split(rest, ' ')[2], '^[ab]/', '') END AS new_path
FROM f""")
def q_diff_git_paths(spark, sf_dir):
    cf = commit_files(spark, sf_dir).where(F.col("diff_text").startswith("diff --git "))
    first = F.element_at(F.split(F.col("diff_text"), "\n"), 1)
    return cf.select(*DF.KEYS, "file_order", diff_git_paths(first).alias("p")) \
        .select(*DF.KEYS, "file_order", "p.old_path", "p.new_path")


def _hunks(spark, sf_dir, cap):
    kept = DF.select_diff_budget(DF.prepare_diff_files(commit_files(spark, sf_dir)), cap)
    return DF.parse_hunks(kept)


@query("patch_hunks", duck_hunks(100000) + "SELECT * FROM hunks")
def q_patch_hunks(spark, sf_dir):
    return _hunks(spark, sf_dir, 100000)


@query("patch_line_numbers", duck_hunks(100000) + """
SELECT repo, commit_sha, file_order, flatten(list(added_line_numbers ORDER BY hunk)) AS added_line_numbers,
 flatten(list(removed_line_numbers ORDER BY hunk)) AS removed_line_numbers FROM hunks GROUP BY ALL""")
def q_patch_line_numbers(spark, sf_dir):
    return DF.file_hunk_arrays(_hunks(spark, sf_dir, 100000)).select(
        *DF.KEYS, "file_order", "added_line_numbers", "removed_line_numbers")


def _header_meta_ctes() -> str:
    """DuckDB views hl, g, last_git, kinds, bin, hm over the kept diffs (k)."""
    return """
, hl AS (SELECT repo, commit_sha, file_order, unnest(string_split(ret, chr(10))) AS line,
   generate_subscripts(string_split(ret, chr(10)), 1) AS i FROM k),
g AS (SELECT repo, commit_sha, file_order, string_split(substring(line, 12), ' ') AS parts, i FROM hl
   WHERE starts_with(line, 'diff --git ')),
last_git AS (SELECT repo, commit_sha, file_order, arg_max(parts, i) AS parts FROM g GROUP BY ALL),
kinds AS (SELECT repo, commit_sha, file_order, arg_max(CASE WHEN starts_with(line, 'new file mode') THEN 'added'
   WHEN starts_with(line, 'deleted file mode') THEN 'deleted' ELSE 'renamed' END, i) AS kind FROM hl
   WHERE starts_with(line, 'new file mode') OR starts_with(line, 'deleted file mode')
      OR starts_with(line, 'rename from ') OR starts_with(line, 'rename to ') GROUP BY ALL),
hm AS (SELECT k.repo, k.commit_sha, k.file_order, k.path,
 CASE WHEN len(g.parts) >= 2 THEN regexp_replace(g.parts[1], '^[ab]/', '') END AS h_old,
 CASE WHEN len(g.parts) >= 2 THEN regexp_replace(g.parts[2], '^[ab]/', '') END AS h_new,
 coalesce(kinds.kind, CASE WHEN len(g.parts) >= 2 THEN 'modified' END) AS h_type
FROM k LEFT JOIN last_git g USING (repo, commit_sha, file_order) LEFT JOIN kinds USING (repo, commit_sha, file_order)),
nsl AS (SELECT repo, commit_sha, file_order, string_split(name_status, chr(9)) AS p FROM cf WHERE name_status IS NOT NULL),
nsm AS (SELECT repo, commit_sha, file_order,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN p[3] WHEN p[1] IN ('A', 'D', 'M') AND len(p) >= 2 THEN p[2] END AS key_path,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN p[2] WHEN p[1] IN ('D', 'M') AND len(p) >= 2 THEN p[2] END AS n_old,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN p[3] WHEN p[1] IN ('A', 'M') AND len(p) >= 2 THEN p[2] END AS n_new,
  CASE WHEN starts_with(p[1], 'R') AND len(p) >= 3 THEN 'renamed' WHEN p[1] = 'A' AND len(p) >= 2 THEN 'added'
       WHEN p[1] = 'D' AND len(p) >= 2 THEN 'deleted' WHEN p[1] = 'M' AND len(p) >= 2 THEN 'modified' END AS n_type
  FROM nsl),
ns1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, key_path ORDER BY file_order DESC) AS rk
  FROM nsm WHERE n_type IS NOT NULL) WHERE rk = 1)
"""


@query("file_metadata", duck_kept(100000) + _header_meta_ctes() + """
SELECT hm.repo, hm.commit_sha, hm.file_order, coalesce(ns1.n_old, hm.h_old) AS old_path,
 coalesce(ns1.n_new, hm.h_new) AS new_path, coalesce(ns1.n_type, hm.h_type) AS change_type
FROM hm LEFT JOIN ns1 ON ns1.repo = hm.repo AND ns1.commit_sha = hm.commit_sha AND ns1.key_path = hm.path""")
def q_file_metadata(spark, sf_dir):
    a = DF.diff_artifacts(commit_files(spark, sf_dir))
    ex = a.select(*DF.KEYS, F.posexplode_outer("files").alias("i", "f")).where(F.col("f").isNotNull())
    # file_order of the i-th retained file
    order = a.select(*DF.KEYS, F.posexplode_outer("retained_file_order").alias("i", "p"))
    return ex.join(order, DF.KEYS + ["i"]).select(
        *DF.KEYS, F.col("f.path").alias("_path"), "f.old_path", "f.new_path", "f.change_type", "i") \
        .join(commit_files(spark, sf_dir).select(*DF.KEYS, "file_order", F.col("path").alias("_path")),
              DF.KEYS + ["_path"]).select(*DF.KEYS, "file_order", "old_path", "new_path", "change_type")
