"""Value tables for ids, labels, optional values and Python string semantics."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens.functions import normalize as N
from buildlens.functions.text import py_splitlines, py_splitlines_keepends, py_strip


def test_optional_values_text(spark):
    rows = [("NA",), ("",), ("   ",), (" abc ",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    out = [r[0] for r in df.select(N.normalize_optional(F.col("v"), T.StringType())).collect()]
    # "NA" is only missing when the CSV scan maps it; as a stored string it stays
    assert out == ["NA", None, None, "abc", None]


def test_optional_values_numbers(spark):
    df = spark.createDataFrame([(123.0,), (float("nan"),), (None,), (1.5,), (1e10,)], "v double")
    out = [r[0] for r in df.select(N.normalize_optional(F.col("v"), T.DoubleType())).collect()]
    assert out == ["123", None, None, "1.5", "10000000000"]
    ints = spark.createDataFrame([(123,)], "v long").select(N.normalize_optional(F.col("v"), T.LongType()))
    assert ints.first()[0] == "123"
    b = spark.createDataFrame([(True,), (False,)], "v boolean").select(N.normalize_optional(F.col("v"), T.BooleanType()))
    assert [r[0] for r in b.collect()] == ["True", "False"]


def test_label_text_table(spark):
    cases = {"passed": 1, "success": 1, "1": 1, "True": 1, " Passed ": 1, "failed": 0, "errored": 0,
             "canceled": 0, "0": 0, "False": 0, "started": 0, "1.0": 0, "": None, "  ": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    got = {r[0]: r[1] for r in df.select("v", N.normalize_label(F.col("v"), T.StringType())).collect()}
    for k, v in cases.items():
        assert got[k] == v, k
    assert got[None] is None


def test_label_numbers_and_bools(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(N.normalize_label(F.col("v"), T.DoubleType())).collect()] == [1, 0, 0, None, None]
    b = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert [r[0] for r in b.select(N.normalize_label(F.col("v"), T.BooleanType())).collect()] == [1, 0]


def test_sample_id_digest(spark):
    df = spark.createDataFrame([("r", "c", "42", 7), ("r", "c", None, 7)], "repo string, c string, b string, i long")
    got = [r[0] for r in df.select(N.sample_id(F.col("repo"), F.col("c"), F.col("b"), F.col("i"))).collect()]
    exp = ["sha256:" + hashlib.sha256("\n".join(["r", "c", b or "", "7"]).encode()).hexdigest() for b in ("42", None)]
    assert got == exp


def test_codecs(spark):
    df = spark.createDataFrame([(3, "a/b/c.txt", "shard_00012.pt", "junk")], "i int, p string, n string, j string")
    r = df.select(N.shard_name(F.col("i")), N.portable_path(F.col("p")), N.shard_index_of(F.col("n")),
                  N.shard_index_of(F.col("j"))).first()
    assert tuple(r) == ("shard_00003", "c.txt", 12, None)


def test_diff_git_paths(spark):
    df = spark.createDataFrame([("diff --git a/x.py b/y.py",), ("diff --git a/only",)], "l string")
    out = [tuple(r[0]) for r in df.select(N.diff_git_paths(F.col("l"))).collect()]
    assert out == [("x.py", "y.py"), (None, None)]


def test_threshold_predict(spark):
    df = spark.createDataFrame([(0.0,), (-0.1,), (3.0,)], "x double")
    assert [r[0] for r in df.select(N.threshold_predict(F.col("x"), 0.5)).collect()] == [1, 0, 1]


ALPHABET = st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　x"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=8))
def test_python_string_semantics(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", py_strip(F.col("t")), py_splitlines(F.col("t")), py_splitlines_keepends(F.col("t"))).collect()
    for t, s, lines, keep in rows:
        assert s == t.strip()
        assert lines == t.splitlines()
        assert keep == t.splitlines(keepends=True)


def test_csv_scan_typing(spark, tmp_out):
    """An all-numeric status column is numeric (1.0 -> 1); mixed text stays text ("1.0" -> 0);
    NA tokens are missing; whitespace is kept; the row index follows file order."""
    from buildlens.sources.builds import normalize_builds_csv, read_builds_csv
    num = f"{tmp_out}/num.csv"
    with open(num, "w") as fh:
        fh.write("gh_project_name,git_trigger_commit,tr_status,tr_build_id,git_prev_built_commit\n"
                 "r,c1,1.0,123.0,NA\nr,c2,0,,p1\nr,c3,,7,\n")
    rows = normalize_builds_csv(read_builds_csv(spark, num)).orderBy("source_row_index").collect()
    assert [(r["source_row_index"], r["label"], r["build_id"], r["parent_commit_sha"]) for r in rows] == \
        [(0, 1, "123", None), (1, 0, None, "p1"), (2, None, "7", None)]
    txt = f"{tmp_out}/txt.csv"
    with open(txt, "w") as fh:
        fh.write("gh_project_name,git_trigger_commit,tr_status\nr,c1,1.0\nr,c2, passed \n")
    rows = normalize_builds_csv(read_builds_csv(spark, txt)).orderBy("source_row_index").collect()
    assert [(r["label"], r["raw_status"], r["build_id"]) for r in rows] == [(0, "1.0", None), (1, " passed ", None)]


def test_csv_index_follows_lines_across_splits(spark, tmp_out):
    from buildlens.session import scoped_conf
    from buildlens.sources.builds import read_builds_csv
    path = f"{tmp_out}/big.csv"
    with open(path, "w") as fh:
        fh.write("gh_project_name,git_trigger_commit,tr_status\n")
        for i in range(3000):
            fh.write(f"repo{i % 7},c{i},passed\n")
    with scoped_conf(spark, {"spark.sql.files.maxPartitionBytes": 4096, "spark.sql.files.openCostInBytes": 0}):
        df = read_builds_csv(spark, path)
        assert df.rdd.getNumPartitions() >= 1
        rows = df.select("source_row_index", "git_trigger_commit").collect()
    assert sorted((r[0], r[1]) for r in rows) == [(i, f"c{i}") for i in range(3000)]
