"""Registered queries: changed lines, code regions, context text (phase 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as CX
from ..operators.diffs import KEYS
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


K = "repo, commit_sha, file_order"
# Fixed value: RE2 form of the signature heuristic (Unicode letters/digits for \w).
SIG_RE2 = ("'^\\s*(public|private|protected|static|final|synchronized|abstract|void|int|long|double|float|"
           "boolean|char|String|def|function|[A-Za-z_][A-Za-z0-9_<>\\[\\]]*)[\\pL\\pN_<>\\[\\],\\s]*\\s+"
           "([A-Za-z_][A-Za-z0-9_]*)\\s*\\([^)]*\\)\\s*(\\{|$)'")
CHG = "'^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@'"


def duck_changed() -> str:
    """Views f (usable files), ch (changed new-side lines, numbered k, with n_changed)."""
    return FX.duck_with(cf=FX.DUCK_COMMIT_FILES).rstrip("\n") + f""",
f AS (SELECT repo, commit_sha, file_order, {D.strip('path')} AS path, {D.strip('diff_text')} AS dtext, content_after
      FROM cf WHERE {D.strip('path')} <> '' AND diff_text IS NOT NULL),
dl0 AS (SELECT {K}, string_split(dtext, chr(10)) AS parts FROM f WHERE dtext <> ''),
dl AS (SELECT {K}, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM dl0),
dh AS (SELECT *, regexp_extract(line, {CHG}, 1) AS hs FROM dl),
dg AS (SELECT *, sum(CASE WHEN hs <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hunk FROM dh),
da AS (SELECT *, hs <> '' AS is_hdr, (hs = '' AND NOT starts_with(line, '+++')) AS active,
      (hs = '' AND NOT starts_with(line, '+++') AND starts_with(line, '+')) AS plus,
      (hs = '' AND NOT starts_with(line, '+++') AND NOT starts_with(line, '+') AND starts_with(line, '-')) AS minus
      FROM dg WHERE hunk > 0),
dn AS (SELECT *, max(CASE WHEN is_hdr THEN CAST(hs AS INTEGER) END) OVER (PARTITION BY {K}, hunk)
      + coalesce(sum(CASE WHEN active AND NOT minus THEN 1 ELSE 0 END) OVER (PARTITION BY {K}, hunk ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM da),
ch AS (SELECT {K}, cur AS line_no, row_number() OVER (PARTITION BY {K} ORDER BY i) AS k,
      count(*) OVER (PARTITION BY {K}) AS n_changed FROM dn WHERE plus)
"""


def duck_regions() -> str:
    """Adds views for content lines and reg (one region per retained changed line)."""
    return duck_changed().rstrip("\n") + f""",
cl0 AS (SELECT {K}, CASE WHEN string_split(content_after, chr(10))[-1] = ''
      THEN string_split(content_after, chr(10))[1:len(string_split(content_after, chr(10))) - 1]
      ELSE string_split(content_after, chr(10)) END AS parts FROM f WHERE content_after IS NOT NULL),
cl AS (SELECT {K}, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS j FROM cl0),
cs AS (SELECT *, regexp_matches(line, {SIG_RE2}) AS sig,
      length(line) - length(replace(line, '{{', '')) - (length(line) - length(replace(line, '}}', ''))) AS dlt,
      CASE WHEN contains(line, '{{') THEN 1 ELSE 0 END AS opn FROM cl),
cp AS (SELECT *, sum(dlt) OVER (PARTITION BY {K} ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb,
      sum(opn) OVER (PARTITION BY {K} ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS po,
      max(CASE WHEN sig THEN j END) OVER (PARTITION BY {K} ORDER BY j ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS near
      FROM cs),
tgt AS (SELECT ch.{K.replace(', ', ', ch.')}, ch.line_no, ch.k, len(cl0.parts) AS n, cl0.parts, cp.near AS s
      FROM ch JOIN cl0 USING (repo, commit_sha, file_order)
      LEFT JOIN cp ON cp.repo = ch.repo AND cp.commit_sha = ch.commit_sha AND cp.file_order = ch.file_order
        AND cp.j = ch.line_no - 1
      WHERE ch.k <= 20 AND ch.line_no - 1 >= 0 AND ch.line_no - 1 < len(cl0.parts)),
fe AS (SELECT t.repo, t.commit_sha, t.file_order, t.line_no, min(e.j) AS e FROM tgt t
      JOIN cp sg ON sg.repo = t.repo AND sg.commit_sha = t.commit_sha AND sg.file_order = t.file_order AND sg.j = t.s
      JOIN cp e ON e.repo = t.repo AND e.commit_sha = t.commit_sha AND e.file_order = t.file_order
        AND e.j BETWEEN t.s AND least(t.n, t.s + 200) - 1
        AND e.po - (sg.po - sg.opn) > 0 AND e.pb - (sg.pb - sg.dlt) <= 0
      WHERE t.s IS NOT NULL GROUP BY ALL),
reg AS (SELECT t.repo, t.commit_sha, t.file_order, t.line_no, t.k,
      CASE WHEN t.s IS NOT NULL THEN t.s + 1 ELSE greatest(0, t.line_no - 1 - 37) + 1 END AS start_line,
      CASE WHEN t.s IS NOT NULL THEN coalesce(fe.e, t.s) + 1 ELSE least(t.n, greatest(0, t.line_no - 1 - 37) + 75) END
        AS end_line,
      CASE WHEN t.s IS NOT NULL THEN regexp_extract(t.parts[t.s + 1], {SIG_RE2}, 2) END AS symbol_name,
      CASE WHEN t.s IS NOT NULL THEN 'function' END AS symbol_type,
      CASE WHEN t.s IS NOT NULL THEN 'brace_based_function' ELSE 'global_window' END AS extraction_method,
      t.parts FROM tgt t LEFT JOIN fe USING (repo, commit_sha, file_order, line_no)),
rt AS (SELECT * EXCLUDE (parts), array_to_string(parts[start_line:end_line], chr(10)) AS text FROM reg)
"""


def duck_kept_context(cap: int) -> str:
    return duck_regions().rstrip("\n") + f""",
sn AS (SELECT rt.*, f.path, substring(text, 1, 20000) AS ret, length(text) > 20000 AS cut,
      f.path || ':' || CAST(line_no AS VARCHAR) AS prefix FROM rt JOIN f USING (repo, commit_sha, file_order)
      WHERE {D.strip('text')} <> ''),
sr AS (SELECT *, length(prefix) + 13 + length(ret) AS slen,
      row_number() OVER (PARTITION BY repo, commit_sha ORDER BY file_order, k) AS rk,
      coalesce(sum(length(prefix) + 13 + length(ret)) OVER (PARTITION BY repo, commit_sha ORDER BY file_order, k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM sn),
kc AS (SELECT *, prev + (rk - 1) * 15 AS so FROM sr WHERE rk = 1 OR prev < {cap}),
capinfo AS (SELECT repo, commit_sha, sum(slen) >= {cap} AS capped, bool_or(cut) AS anycut,
      CASE WHEN sum(slen) >= {cap} THEN max(file_order) END AS cap_file FROM kc GROUP BY ALL),
ff AS (SELECT DISTINCT repo, commit_sha, file_order, n_changed > 20 AS over FROM ch)
"""


def commit_files(spark, sf_dir):
    return FX.commit_files(spark, sf_dir)


@query("changed_lines", duck_changed() + f"""
SELECT cf.repo, cf.commit_sha, cf.file_order, coalesce(max(n_changed), 0) AS n_changed,
 coalesce(list(line_no ORDER BY k) FILTER (WHERE k <= 20), []) AS first_changed
FROM cf LEFT JOIN ch USING (repo, commit_sha, file_order) WHERE cf.diff_text IS NOT NULL GROUP BY ALL""")
def q_changed_lines(spark, sf_dir):
    cf = commit_files(spark, sf_dir).where(F.col("diff_text").isNotNull())
    c = cf.select(*KEYS, "file_order", CX.changed_new_lines(F.col("diff_text")).alias("c"))
    return c.select(*KEYS, "file_order", F.col("c.n_changed").cast("long").alias("n_changed"),
                                             F.col("c.first").alias("first_changed"))


def _regions(spark, sf_dir):
    files = CX.prepare_context_files(commit_files(spark, sf_dir))
    ex = files.select(*KEYS, "file_order", F.posexplode_outer("regions").alias("pos", "r")).where("r.region IS NOT NULL")
    return ex.select(*KEYS, "file_order", F.col("r.line").alias("line_no"), "r.region.*")


@query("context_region", duck_regions() + f"""
SELECT {K}, line_no, start_line, end_line, symbol_name, symbol_type, extraction_method, text FROM rt""")
def q_context_region(spark, sf_dir):
    return _regions(spark, sf_dir).select(*KEYS, "file_order", "line_no", "start_line", "end_line", "symbol_name",
                                          "symbol_type", "extraction_method", "text")


@query("nearest_signature", duck_regions() + f"""
SELECT {K}, line_no, start_line AS signature_line FROM rt WHERE extraction_method = 'brace_based_function'""")
def q_nearest_signature(spark, sf_dir):
    return _regions(spark, sf_dir).where("extraction_method = 'brace_based_function'") \
        .select(*KEYS, "file_order", "line_no", F.col("start_line").alias("signature_line"))


@query("function_span", duck_regions() + f"""
SELECT {K}, line_no, start_line, end_line, symbol_name FROM rt WHERE extraction_method = 'brace_based_function'""")
def q_function_span(spark, sf_dir):
    return _regions(spark, sf_dir).where("extraction_method = 'brace_based_function'") \
        .select(*KEYS, "file_order", "line_no", "start_line", "end_line", "symbol_name")


@query("context_window", duck_regions() + f"""
SELECT t.repo, t.commit_sha, t.file_order, t.line_no, greatest(0, t.line_no - 1 - 37) + 1 AS start_line,
 least(t.n, greatest(0, t.line_no - 1 - 37) + 75) AS end_line,
 array_to_string(t.parts[greatest(0, t.line_no - 1 - 37) + 1:least(t.n, greatest(0, t.line_no - 1 - 37) + 75)],
   chr(10)) AS text FROM tgt t""")
def q_context_window(spark, sf_dir):
    cf = commit_files(spark, sf_dir).where(F.col("content_after").isNotNull() & F.col("diff_text").isNotNull())
    lines = CX.py_splitlines(F.col("content_after"))
    c = cf.select(*KEYS, "file_order", lines.alias("lines"), CX.changed_new_lines(F.col("diff_text")).alias("c"))
    ex = c.select(*KEYS, "file_order", "lines", F.explode("c.first").alias("line_no")) \
        .where((F.col("line_no") >= 1) & (F.col("line_no") <= F.size("lines")))
    w = CX.global_window(F.col("lines"), F.col("line_no") - 1)
    return ex.select(*KEYS, "file_order", "line_no", w["start_line"].alias("start_line"),
                     w["end_line"].alias("end_line"), w["text"].alias("text"))


@query("signature_lines", duck_regions() + f"""
SELECT {K}, j + 1 AS line_no, regexp_extract(line, {SIG_RE2}, 2) AS symbol_name FROM cs WHERE sig""")
def q_signature_lines(spark, sf_dir):
    cf = commit_files(spark, sf_dir).where(F.col("content_after").isNotNull())
    path = CX.py_strip(F.col("path"))
    cf = cf.where((path != "") & F.col("diff_text").isNotNull())
    ex = cf.select(*KEYS, "file_order", F.posexplode(CX.py_splitlines(F.col("content_after"))).alias("j", "line"))
    return ex.where(F.col("line").rlike(CX.SIGNATURE)).select(
        *KEYS, "file_order", (F.col("j") + 1).alias("line_no"),
        F.regexp_extract("line", CX.SIGNATURE, CX.SIGNATURE_NAME_GROUP).alias("symbol_name"))


def _context_text_sql(cap: int) -> str:
    return duck_kept_context(cap) + """
, t AS (SELECT repo, commit_sha, string_agg(prefix || chr(10) || '<FIELD_SEP>' || chr(10) || ret,
  chr(10) || '<CONTEXT_SEP>' || chr(10) ORDER BY rk) AS text FROM kc GROUP BY ALL)
SELECT f.repo, f.commit_sha, coalesce(t.text, '') AS text FROM (SELECT DISTINCT repo, commit_sha FROM cf) f
LEFT JOIN t USING (repo, commit_sha)"""


@query("context_text", _context_text_sql(150000))
def q_context_text(spark, sf_dir):
    a = CX.context_artifacts(commit_files(spark, sf_dir))
    return a.select(*KEYS, "text")


@query("context_text_capped", _context_text_sql(6000))
def q_context_text_capped(spark, sf_dir):
    a = CX.context_artifacts(commit_files(spark, sf_dir), max_total=6000)
    return a.select(*KEYS, "text")


@query("context_regions", duck_kept_context(150000) + """
SELECT repo, commit_sha, path AS file_path, start_line, end_line, extraction_method, min(symbol_name) AS symbol_name,
 list(DISTINCT line_no ORDER BY line_no) AS triggering_changed_lines, bool_or(cut) AS truncated,
 count(*) AS n_occurrences, min(so) AS first_start_offset, min(rk) AS first_rank,
 min(length(ret)) AS retained_char_count
FROM kc GROUP BY repo, commit_sha, path, start_line, end_line, ret, extraction_method""")
def q_context_regions(spark, sf_dir):
    files = CX.prepare_context_files(commit_files(spark, sf_dir))
    kept = CX.select_context_budget(CX.context_snippets(files))
    r = CX.merge_regions(kept)
    return r.select(*KEYS, "file_path", "start_line", "end_line", "extraction_method", "symbol_name",
                    "triggering_changed_lines", "truncated", F.size("occurrences").cast("long").alias("n_occurrences"),
                    F.col("occurrences")[0]["start_offset"].alias("first_start_offset"),
                    F.col("first_rank").cast("long").alias("first_rank"), "retained_char_count")


@query("context_provenance", duck_kept_context(150000) + """
, merged AS (SELECT repo, commit_sha, min(length(text)) AS orig FROM kc
   GROUP BY repo, commit_sha, path, start_line, end_line, ret, extraction_method),
agg AS (SELECT repo, commit_sha, count(*) AS regions_retained, sum(orig) AS original_char_count FROM merged GROUP BY ALL),
txt AS (SELECT repo, commit_sha, length(string_agg(prefix || chr(10) || '<FIELD_SEP>' || chr(10) || ret,
   chr(10) || '<CONTEXT_SEP>' || chr(10) ORDER BY rk)) AS retained_char_count FROM kc GROUP BY ALL),
fl AS (SELECT ff.repo, ff.commit_sha, bool_or(ff.over AND (c.cap_file IS NULL OR ff.file_order <= c.cap_file)) AS over_any
   FROM ff LEFT JOIN capinfo c USING (repo, commit_sha) GROUP BY ALL)
SELECT cm.repo, cm.commit_sha, coalesce(agg.regions_retained, 0) AS regions_retained,
 coalesce(agg.original_char_count, 0) AS original_char_count, coalesce(txt.retained_char_count, 0) AS retained_char_count,
 coalesce(fl.over_any, false) OR coalesce(c.anycut, false) OR coalesce(c.capped, false) AS extraction_truncated
FROM (SELECT DISTINCT repo, commit_sha FROM cf) cm LEFT JOIN fl USING (repo, commit_sha) LEFT JOIN agg USING (repo, commit_sha)
LEFT JOIN txt USING (repo, commit_sha) LEFT JOIN capinfo c USING (repo, commit_sha)""")
def q_context_provenance(spark, sf_dir):
    a = CX.context_artifacts(commit_files(spark, sf_dir))
    return a.select(*KEYS, F.col("regions_retained").cast("long").alias("regions_retained"),
                    F.col("original_char_count").cast("long").alias("original_char_count"),
                    F.col("retained_char_count").cast("long").alias("retained_char_count"), "extraction_truncated")
