"""What a Python worker keeps after a task, as idle workers of earlier stages count with the next one's."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HELD = """
import re
import sys
import pyarrow as pa
from buildlens.llm import common

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def task(batches):
    for batch in batches:
        rows = [bytes(50_000) for _ in range(3_000)]  # below malloc's threshold for mappings of their own
        stay.append(rows[::300] + rows[-1:])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["x"])
        del rows

stay, before = [], mb()
for _ in (common.tidy(task) if sys.argv[1] == "tidy" else task)([1]):
    _ = None
print(mb() - before)
"""


def _left(how: str) -> float:
    return float(subprocess.run([sys.executable, "-c", HELD, how], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout)


def test_a_task_gives_its_memory_back():
    """150 MB of rows, of which eleven stay; a plain task leaves most of them, and Arrow's copy, with the process."""
    assert _left("plain") > 100 and _left("tidy") < 40


def test_learning_languages_starts_no_other_workers(spark):
    """The shares of the languages went through a second set of workers, which stays for a minute."""
    from buildlens.llm import language

    docs = spark.createDataFrame([(i, "some words of text " * 4, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string").persist()
    docs.count()
    made, plain = [], type(spark.sparkContext).parallelize
    type(spark.sparkContext).parallelize = lambda self, *a, **b: made.append(a) or plain(self, *a, **b)
    try:
        net = language.train(docs)
    finally:
        type(spark.sparkContext).parallelize = plain
        docs.unpersist()
    assert net.langs == ["de", "en"] and not made


def test_few_pairs_are_verified_by_few_tasks(spark):
    """Before, one file and task for each shuffle partition that got a pair, whatever their size."""
    from pyspark.sql import functions as F

    from buildlens.llm import ngram_join
    from buildlens.session import scoped_conf

    texts = [" ".join(f"w{i // 2}x{j}" for j in range(30)) + (" more" if i % 2 else "") for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with scoped_conf(spark, {"spark.sql.shuffle.partitions": "32"}):
        profile = ngram_join._profile(docs, "doc_id", "text")
        reps = profile.select("node", F.col("id").alias("rep"), "mark")
        node = {r["id"]: r["node"] for r in profile.collect()}
        pairs = spark.createDataFrame([(node[i], node[i + 1], node[i], 0, 0) for i in range(0, 80, 2)], "a long, b long, g long, i int, j int")
        good = ngram_join._verify(docs, "doc_id", "text", pairs, reps, 80, 100)
        assert {(r["a"], r["b"]) for r in good.collect()} == {(node[i], node[i + 1]) for i in range(0, 80, 2)}
        assert len(good.inputFiles()) <= 8
