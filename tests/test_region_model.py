"""Random Java-like files: Spark function/global-window regions against a Python model,
including the 200-line look-back and span limits and unbalanced braces."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildlens.operators import context as CX
from tests.models import changed_model

SIG = re.compile(CX.SIGNATURE.replace("(?U)", ""))
VOCAB = ["  public void f() {", "  int x = 1;", "  }", "}", "{", "  if (a) {", "text words", "",
         "  private static int g(int a, String b) {", "def h(x):", "  call(x);", "  return foo(x)",
         "  else if (x) {", "{ {", "} }"]


def region_model(lines, line_no, window=75, span=200):
    idx = line_no - 1
    if not 0 <= idx < len(lines):
        return None
    hits = [i for i in range(max(0, idx - span + 1), idx + 1) if SIG.search(lines[i])]
    if not hits:
        start = max(0, idx - window // 2)
        end = min(len(lines), start + window)
        return ("\n".join(lines[start:end]), start + 1, end, None, "global_window")
    s = hits[-1]
    depth, opened, e = 0, False, s
    for j in range(s, min(len(lines), s + span)):
        depth += lines[j].count("{") - lines[j].count("}")
        opened = opened or "{" in lines[j]
        if opened and depth <= 0:
            e = j
            break
    return ("\n".join(lines[s:e + 1]), s + 1, e + 1, SIG.search(lines[s]).group(2), "brace_based_function")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(VOCAB), min_size=1, max_size=450),
                          st.lists(st.integers(min_value=-2, max_value=460), min_size=1, max_size=20)),
                min_size=1, max_size=4))
def test_random_regions_against_model(spark, files):
    rows = [(i, "\n".join(lines), lns) for i, (lines, lns) in enumerate(files)]
    df = spark.createDataFrame(rows, "fid int, content string, first array<int>")
    df = df.withColumn("lines", CX.py_splitlines(F.col("content")))
    got = {r["fid"]: r["regions"] for r in CX.regions_for_lines(df, "lines", "first").select("fid", "regions").collect()}
    for i, (lines, lns) in enumerate(files):
        content_lines = "\n".join(lines).splitlines()
        for pos, ln in enumerate(lns):
            r = got[i][pos]
            assert r["line"] == ln
            exp = region_model(content_lines, ln)
            if exp is None:
                assert r["region"] is None
            else:
                g = r["region"]
                assert (g["text"], g["start_line"], g["end_line"], g["symbol_name"] or None,
                        g["extraction_method"]) == exp, (i, ln)


def context_model(files, max_lines, max_chars, max_total):
    """Walk files in order; stop right after the snippet that reaches the budget."""
    sep, fsep = CX.CONTEXT_SEP, CX.FIELD_SEP
    snippets, truncated, running = [], False, 0
    for path, diff, content in files:
        if diff is None:
            continue
        n, first = changed_model(diff.strip(), max_lines)
        if n == 0:
            continue
        truncated = truncated or n > max_lines
        if content is None:
            continue
        lines = content.splitlines()
        for ln in first:
            reg = region_model(lines, ln)
            if reg is None or not reg[0].strip():
                continue
            kept = reg[0][:max_chars]
            truncated = truncated or len(reg[0]) > len(kept)
            snippets.append(f"{path}:{ln}{fsep}{kept}")
            running += len(snippets[-1])
            if running >= max_total:
                return sep.join(snippets), True
    return sep.join(snippets), truncated


FILE = st.tuples(
    st.lists(st.sampled_from(["+  int x = 1;", "+  public void f() {", "-gone", " same", "+}", "+"]),
             min_size=0, max_size=30),
    st.integers(min_value=1, max_value=6),
    st.one_of(st.none(), st.lists(st.sampled_from(VOCAB), min_size=1, max_size=40)))


@settings(max_examples=12, deadline=None)
@given(st.lists(FILE, min_size=1, max_size=5), st.integers(min_value=1, max_value=4),
       st.integers(min_value=5, max_value=60), st.integers(min_value=20, max_value=400))
def test_random_context_budget_against_model(spark, files, max_lines, max_chars, max_total):
    rows, model_files = [], []
    for i, (body, start, content) in enumerate(files):
        diff = f"diff --git a/f{i} b/f{i}\n@@ -{start} +{start},{len(body)} @@\n" + "\n".join(body)
        text = None if content is None else "\n".join(content)
        rows.append(("r", "c", i, f"f{i}.java", None, diff, text))
        model_files.append((f"f{i}.java", diff, text))
    cf = spark.createDataFrame(rows, "repo string, commit_sha string, file_order int, path string, "
                                     "name_status string, diff_text string, content_after string")
    got = CX.context_artifacts(cf, max_lines, max_chars, max_total).first()
    text, truncated = context_model(model_files, max_lines, max_chars, max_total)
    assert (got["text"], got["extraction_truncated"]) == (text, truncated)
    assert got["retained_char_count"] == len(text)
