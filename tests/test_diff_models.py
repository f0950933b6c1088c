"""Random diff texts: Spark hunk parsing (T8) and changed-line numbering (T11) against small
Python models built segment by segment from the header positions."""

import re
from itertools import accumulate

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildlens.operators import context as CX
from buildlens.operators import diffs as DF
from tests.models import changed_model

HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
LINES = st.sampled_from(["@@ -3,2 +4,3 @@", "@@ -7 +9 @@ fn()", "@@ -1,0 +1 @@", "@@ broken", "+add", "-del",
                         " ctx", "+++ b/f", "--- a/f", "+++x", "\\ No newline at end of file", "", "plain"])


def hunks_model(text, base):
    """Segments between header lines; numbers from per-segment running counts."""
    pieces = text.splitlines(keepends=True)
    starts = list(accumulate([len(p) for p in pieces], initial=base))
    heads = [i for i, p in enumerate(pieces) if HEADER.match(p.rstrip("\r\n"))]
    out = []
    for h, nxt in zip(heads, heads[1:] + [len(pieces)]):
        m = HEADER.match(pieces[h].rstrip("\r\n"))
        o0, n0 = int(m[1]), int(m[3])
        body = [p.rstrip("\r\n") for p in pieces[h + 1:nxt]]
        body = [b for b in body if not (b.startswith("+++ ") or b.startswith("--- "))]
        plus = [b.startswith("+") for b in body]
        minus = [b.startswith("-") and not b.startswith("+") for b in body]
        old_before = list(accumulate([0] + [int(not p) for p in plus[:-1]])) if body else []
        new_before = list(accumulate([0] + [int(not m_) for m_ in minus[:-1]])) if body else []
        out.append({
            "old_start": o0, "old_count": int(m[2] or 1), "new_start": n0, "new_count": int(m[4] or 1),
            "added": [n0 + new_before[i] for i, p in enumerate(plus) if p],
            "removed": [o0 + old_before[i] for i, m_ in enumerate(minus) if m_],
            "start": starts[h], "end": starts[nxt]})
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(LINES, min_size=1, max_size=14), st.sampled_from(["\n", "\r\n"])),
                min_size=1, max_size=6))
def test_random_diffs_against_models(spark, diffs):
    texts = [eol.join(["diff --git a/f b/f"] + lines) for lines, eol in diffs]
    rows = [("r", f"c{i}", 0, "f", None, t, None) for i, t in enumerate(texts)]
    cf = spark.createDataFrame(rows, "repo string, commit_sha string, file_order int, path string, "
                                     "name_status string, diff_text string, content_after string")
    arts = {r["commit_sha"]: r for r in DF.diff_artifacts(cf).collect()}
    changed = {r["commit_sha"]: r["cl"] for r in
               CX.with_changed_lines(cf, "diff_text").select("commit_sha", "cl").collect()}
    for i, t in enumerate(texts):
        stripped = t.strip()
        f = arts[f"c{i}"]["files"][0]
        got = [{"old_start": h["old_start"], "old_count": h["old_count"], "new_start": h["new_start"],
                "new_count": h["new_count"], "added": h["added_line_numbers"], "removed": h["removed_line_numbers"],
                "start": h["start_offset"], "end": h["end_offset"]} for h in f["hunk_ranges"]]
        assert got == hunks_model(stripped, len("f") + len(DF.FIELD_SEP)), t
        n, first = changed_model(stripped)
        assert (changed[f"c{i}"]["n_changed"], changed[f"c{i}"]["first"]) == (n, first), t


def budget_model(files, per_file, total):
    """Plain model of the diff budget: (text, kept paths, starts, original sum, truncated, found)."""
    kept, starts, originals, cut, running = [], [], 0, False, 0
    pieces = []
    for path, diff in files:
        if diff is None or not diff.strip():
            continue
        d = diff.strip()
        r = d[:per_file]
        cut = cut or len(d) > per_file
        starts.append(sum(len(p) for p in pieces) + len(DF.DIFF_FILE_SEP) * len(pieces))
        pieces.append(f"{path}{DF.FIELD_SEP}{r}")
        kept.append(path)
        originals += len(d)
        running += len(pieces[-1])
        if running >= total:
            cut = True
            break
    return DF.DIFF_FILE_SEP.join(pieces), kept, starts, originals, cut, len(files)


DIFF = st.one_of(st.none(), st.just("   "),
                 st.lists(LINES, min_size=1, max_size=12).map(lambda ls: "\n".join(["diff --git a/x b/x"] + ls)))


@settings(max_examples=12, deadline=None)
@given(st.lists(DIFF, min_size=1, max_size=8), st.integers(min_value=10, max_value=120),
       st.integers(min_value=1, max_value=400))
def test_random_budgets_against_model(spark, diffs, per_file, total):
    files = [(f"p{i}.txt", d) for i, d in enumerate(diffs)]
    cf = spark.createDataFrame([("r", "c", i, p, None, d, None) for i, (p, d) in enumerate(files)],
                               "repo string, commit_sha string, file_order int, path string, name_status string, "
                               "diff_text string, content_after string")
    rows = DF.diff_artifacts(cf, per_file, total).collect()
    text, kept, starts, originals, cut, found = budget_model(files, per_file, total)
    if not kept:
        assert rows == [] or rows[0]["files_retained"] == 0
        return
    a = rows[0]
    assert (a["text"], a["retained_file_order"], a["extraction_truncated"], a["files_found"]) == (text, kept, cut, found)
    assert a["original_char_count"] == originals and [f["start_offset"] for f in a["files"]] == starts
