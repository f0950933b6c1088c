"""Diff and context assembly on hand-written commits, plus a plain-Python budget model."""

from pyspark.sql import functions as F

from buildlens.operators import context as CX
from buildlens.operators import diffs as DF
from buildlens.plans import fixtures as FX
from tests.conftest import SF_SMALL

SCHEMA = ("repo string, commit_sha string, file_order int, path string, name_status string, "
          "diff_text string, content_after string")

MODIFIED = """diff --git a/src/a.py b/src/a.py
index 1111111..2222222 100644
--- a/src/a.py
+++ b/src/a.py
@@ -2 +2 @@
-old
+new
@@ -8,0 +8,2 @@
+x
+y
"""
ADDED = """diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+a
+b"""
DELETED = """diff --git a/d.py b/d.py
deleted file mode 100644
--- a/d.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b"""
RENAMED = """diff --git a/old.py b/new.py
similarity index 90%
rename from old.py
rename to new.py
--- a/old.py
+++ b/new.py
@@ -3 +3 @@
-p
+q"""
BINARY = """diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ"""

FILES = [
    ("r", "c1", 0, "src/a.py", "M\tsrc/a.py", MODIFIED, None),
    ("r", "c1", 1, "n.py", "A\tn.py", ADDED, "a\nb\n"),
    ("r", "c1", 2, "d.py", "D\td.py", DELETED, None),
    ("r", "c1", 3, "new.py", "R090\told.py\tnew.py", RENAMED, None),
    ("r", "c1", 4, "img.png", "M\timg.png", BINARY, None),
    ("r", "c1", 5, "blank.txt", "M\tblank.txt", "   ", None),
]


def test_diff_artifact_fields(spark):
    cf = spark.createDataFrame(FILES, SCHEMA)
    a = DF.diff_artifacts(cf).first()
    text = a["text"]
    assert a["files_found"] == 6 and a["files_retained"] == 5
    assert a["retained_file_order"] == ["src/a.py", "n.py", "d.py", "new.py", "img.png"]
    assert a["retained_char_count"] == len(text) and not a["extraction_truncated"]
    by = {f["path"]: f for f in a["files"]}
    assert [by[p]["change_type"] for p in a["retained_file_order"]] == \
        ["modified", "added", "deleted", "renamed", "modified"]
    assert by["new.py"]["old_path"] == "old.py" and by["new.py"]["new_path"] == "new.py"
    assert by["img.png"]["binary"] and by["img.png"]["hunk_ranges"] is None
    assert by["img.png"]["added_line_numbers"] is None
    m = by["src/a.py"]
    assert m["added_line_numbers"] == [2, 8, 9] and m["removed_line_numbers"] == [2]
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"]) for h in m["hunk_ranges"]] == \
        [(2, 1, 2, 1), (8, 0, 8, 2)]
    assert by["d.py"]["removed_line_numbers"] == [1, 2] and by["n.py"]["added_line_numbers"] == [1, 2]
    for f in a["files"]:
        assert text[f["start_offset"]:f["end_offset"]].startswith(f["path"] + DF.FIELD_SEP)
        assert text[f["diff_start_offset"]:f["diff_end_offset"]].startswith("diff --git")
        for h in f["hunk_ranges"] or []:
            assert text[h["start_offset"]:h["end_offset"]].startswith("@@")


def test_hunk_quirks(spark):
    """``+++ `` inside a hunk is skipped, ``\\ No newline`` advances both sides, CRLF ends count 2."""
    diff = "diff --git a/q b/q\r\n@@ -1,3 +1,3 @@\r\n a\r\n+++ b\r\n-c\r\n\\ No newline at end of file\r\n+d\r\n"
    cf = spark.createDataFrame([("r", "c", 0, "q", None, diff, None)], SCHEMA)
    a = DF.diff_artifacts(cf).first()
    f = a["files"][0]
    h = f["hunk_ranges"][0]
    assert h["added_line_numbers"] == [3] and h["removed_line_numbers"] == [2]
    assert a["text"][h["start_offset"]:h["end_offset"]] == diff.strip()[diff.index("@@"):]


def _model(files, per_file, total):
    """Plain-Python model of the diff budget: kept paths, offsets, text, truncation."""
    snippets, kept, running, cut = [], [], 0, False
    for path, d in files:
        if d is None or not d.strip():
            continue
        d = d.strip()
        r = d[:per_file]
        cut = cut or len(d) > len(r)
        snip = f"{path}{DF.FIELD_SEP}{r}"
        start = sum(len(s) for s in snippets) + len(DF.DIFF_FILE_SEP) * len(snippets)
        snippets.append(snip)
        kept.append((path, start))
        running += len(snip)
        if running >= total:
            cut = True
            break
    return DF.DIFF_FILE_SEP.join(snippets), kept, cut


def test_budget_edges_against_model(spark):
    cf = FX.commit_files(spark, SF_SMALL).cache()
    rows = cf.orderBy("repo", "commit_sha", "file_order").collect()
    by_commit = {}
    for r in rows:
        by_commit.setdefault((r["repo"], r["commit_sha"]), []).append((r["path"], r["diff_text"]))
    key = max(by_commit, key=lambda k: sum(len((d or "").strip()) for _, d in by_commit[k]))
    files = by_commit[key]
    first_two = sum(len(p) + len(DF.FIELD_SEP) + len(d.strip()[:20000]) for p, d in files[:2] if d and d.strip())
    for cap in (first_two - 1, first_two, first_two + 1):
        a = DF.diff_artifacts(cf.where((F.col("repo") == key[0]) & (F.col("commit_sha") == key[1])),
                              max_total=cap).first()
        text, kept, cut = _model(files, 20000, cap)
        assert a["text"] == text
        assert a["retained_file_order"] == [p for p, _ in kept]
        assert [f["start_offset"] for f in a["files"]] == [s for _, s in kept]
        assert a["extraction_truncated"] == cut


JAVA = """public class A {
  public void target(int x) {
    int y = x;
    return;
  }
  private int other() {
    return 1;
  }
}"""
JAVA_DIFF = "diff --git a/A.java b/A.java\n@@ -3,2 +3,2 @@\n-a\n-b\n+    int y = x;\n+    return;"
TXT = "l1\nl2\nl3\nl4\nl5"
TXT_DIFF = "diff --git a/t.txt b/t.txt\n@@ -3 +3 @@\n-x\n+l3"
OPEN = "  void f() {\n    body\n    more"
OPEN_DIFF = "@@ -2 +2 @@\n+    body"


def test_context_regions(spark):
    cf = spark.createDataFrame([("r", "c", 0, "A.java", None, JAVA_DIFF, JAVA),
                                ("r", "c", 1, "t.txt", None, TXT_DIFF, TXT),
                                ("r", "c", 2, "o.c", None, OPEN_DIFF, OPEN),
                                ("r", "c", 3, "gone.java", None, JAVA_DIFF, None)], SCHEMA)
    a = CX.context_artifacts(cf).first()
    regs = a["regions"]
    assert a["regions_retained"] == 3 and not a["extraction_truncated"]
    java = regs[0]
    assert (java["file_path"], java["start_line"], java["end_line"]) == ("A.java", 2, 5)
    assert java["symbol_name"] == "target" and java["extraction_method"] == "brace_based_function"
    assert java["triggering_changed_lines"] == [3, 4] and len(java["occurrences"]) == 2
    txt = regs[1]
    assert (txt["start_line"], txt["end_line"], txt["extraction_method"]) == (1, 5, "global_window")
    unclosed = regs[2]
    assert (unclosed["start_line"], unclosed["end_line"], unclosed["symbol_name"]) == (1, 1, "f")
    text = a["text"]
    for r in regs:
        for o in r["occurrences"]:
            assert text[o["start_offset"]:o["end_offset"]].startswith(f"{r['file_path']}:{o['triggering_changed_line']}")
            body = text[o["context_start_offset"]:o["context_end_offset"]]
            assert len(body) == r["retained_char_count"]


def test_context_line_cap_flag(spark):
    many = "@@ -1 +1,25 @@\n" + "\n".join(f"+l{i}" for i in range(25))
    content = "\n".join(f"l{i}" for i in range(25))
    cf = spark.createDataFrame([("r", "c", 0, "m.txt", None, many, content)], SCHEMA)
    a = CX.context_artifacts(cf).first()
    assert a["extraction_truncated"]
    assert sum(len(r["occurrences"]) for r in a["regions"]) == 20


def test_hot_commit_bounded_candidates(spark):
    """One commit with thousands of files: the exact candidate bound keeps the result equal
    to the model, and the selection plans a partial group limit before the shuffle."""
    files = [("r", "hot", i, f"f{i}.c", None, f"@@ -1 +1 @@\n+line {i}", None) for i in range(3000)]
    files += [("r", "cold", 0, "a.c", None, "@@ -1 +1 @@\n+x", None)]
    cf = spark.createDataFrame(files, SCHEMA)
    cap = 500
    got = {r["commit_sha"]: r for r in DF.diff_artifacts(cf, max_total=cap, with_files=False).collect()}
    text, kept, cut = _model([(p, d) for _, c, _, p, _, d, _ in files if c == "hot"], 20000, cap)
    assert got["hot"]["text"] == text and got["hot"]["extraction_truncated"] == cut
    assert got["hot"]["files_found"] == 3000 and got["hot"]["files_retained"] == len(kept)
    k = DF.candidate_bound(cap, len(DF.FIELD_SEP))
    sel = DF.select_diff_budget(DF.prepare_diff_files(cf), cap)
    from buildlens.session import scoped_conf
    with scoped_conf(spark, {DF.GROUP_LIMIT_CONF: k + 1}):
        sel.write.format("noop").mode("overwrite").save()
        plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
