"""CSV records with quoted line ends, read in parallel.

A file is scanned as physical lines, which Spark splits by byte ranges.  Whether a
line starts a record depends on the quotes before it, so there are two passes:

1. each split counts its quotes, and its record starts both for an even and for an odd number
   of quotes before it;
2. a running sum over the splits (one row each) gives every split its true state and the number
   of records before it.  Each split then cuts its records at unquoted line ends, and numbers them.

Only a record that crosses a split travels: its pieces meet on its number.  The number is the row's
place in file order (files by path), so a dense row index needs no sort.

Quotes must be balanced, as the format has it: a quote inside a field is doubled and the field is
quoted.  A file with an odd number of quotes is refused.  Blank lines between records are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


NAMES = ["number", "block", "whole", "first", "rank", "text"]


class UnbalancedQuotesError(ValueError):
    pass


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _spans(batch: pa.RecordBatch):
    """(first row, end, file, block) of the runs of one split in a batch."""
    block = batch.column("block").to_numpy()
    file = batch.column("file").dictionary_encode()
    code = file.indices.to_numpy()
    cut = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
        if b > a:
            yield a, b, file.dictionary[code[a]].as_py(), int(block[a])


def _quotes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(quotes in each line, whether the line is blank)."""
    blank = pc.or_(pc.equal(values, ""), pc.equal(values, "\r"))
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False), blank.to_numpy(zero_copy_only=False)


def _summaries(batches):
    """Per split: quotes, record starts after an even and after an odd number of quotes."""
    total: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for a, b, file, block in _spans(batch):
            own = total.setdefault((file, block), [0, 0, 0])
            quotes, blank = _quotes(batch.column("value").slice(a, b - a))
            odd = (np.cumsum(quotes) - quotes + own[0]) & 1
            own[1] += int(((odd == 0) & ~blank).sum())
            own[2] += int(((odd == 1) & ~blank).sum())
            own[0] += int(quotes.sum())
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([k[0] for k in total], pa.string()), "block": pa.array([k[1] for k in total], pa.int64()),
        **{c: pa.array([v[i] for v in total.values()], pa.int64()) for i, c in enumerate(("quotes", "even", "odd"))}})


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per split: (file, block, inside, before, first, rank) -- whether it starts inside quotes, the records
    before it, the file's first record and the file's rank."""
    parts = _lines(spark, path).mapInArrow(_summaries, "file string, block long, quotes long, even long, odd long") \
        .groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("quotes", "even", "odd")])
    per_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inside", F.coalesce(F.sum("quotes").over(per_file), F.lit(0)) % 2 == 1)
    parts = parts.withColumn("starts", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    # one row per split of the input: a small table
    running = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("starts").over(running), F.lit(0)))
    return parts.select("file", "block", "quotes", "inside", "before", F.min("before").over(Window.partitionBy("file")).alias("first"),
                        F.dense_rank().over(Window.orderBy("file")).alias("rank"))


def _records(batches):
    """Records of each split: (number, block, whole, first, rank, text); a piece of one that crosses splits isn't whole."""
    at, number, odd, held, starts_here, head = None, 0, 0, [], True, (0, 0)
    out: list[tuple] = []

    def close(whole: bool):
        if held:
            text = "\n".join(held)
            out.append((number, at[1], whole and starts_here, *head, text[:-1] if whole and text.endswith("\r") else text))
            held.clear()

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                          NAMES)
        out.clear()
        return made

    for batch in batches:
        for a, b, file, block in _spans(batch):
            if (file, block) != at:
                close(odd == 0)
                at = (file, block)
                if batch.column("before")[a].as_py() is None:
                    raise RuntimeError(f"the input's splits changed between two scans: {at}")
                odd = int(batch.column("inside")[a].as_py())
                number, starts_here = batch.column("before")[a].as_py() - 1, False
                head = (batch.column("first")[a].as_py(), batch.column("rank")[a].as_py())
            values = batch.column("value").slice(a, b - a)
            quotes, blank = _quotes(values)
            before = (np.cumsum(quotes) - quotes + odd) & 1
            odd = int((odd + quotes.sum()) & 1)
            if not before.any() and not blank.any():  # every line is a record; the last may go on
                close(True)
                if out:
                    yield batch_of()
                n = len(values) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(number + 1, number + 1 + n)), pa.array(np.full(n, at[1])), pa.array(np.ones(n, bool)),
                    *(pa.array(np.full(n, h)) for h in head), pc.replace_substring_regex(values.slice(0, n), "\r$", "")], NAMES)
                number, starts_here = number + 1 + n, True
                held.append(values[n].as_py())
                continue
            for line, inside, empty in zip(values.to_pylist(), before.tolist(), blank.tolist(), strict=True):
                if inside:
                    held.append(line)
                elif not empty:
                    close(True)
                    number, starts_here = number + 1, True
                    held.append(line)
        if out:
            yield batch_of()
    if at is not None:
        close(odd == 0)
    if out:
        yield batch_of()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_row_index, record): the records of a header CSV (a file or a folder) as text, without headers."""
    states = split_states(spark, path).checkpoint(eager=True)
    wrong = states.groupBy("file").agg(F.sum("quotes").alias("n")).where("n % 2 = 1").select("file").limit(1).collect()
    if wrong:
        raise UnbalancedQuotesError(f"{wrong[0]['file']} has an odd number of quotes")
    # one row per split; a broadcast join keeps the scan's order
    lines = _lines(spark, path).join(F.broadcast(states.drop("quotes")), ["file", "block"], "left")
    cut = lines.select("value", "file", "block", "inside", "before", "first", "rank") \
        .mapInArrow(_records, "number long, block long, whole boolean, first long, rank long, text string")
    pieces = cut.where("NOT whole").groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.min("first").alias("first"), F.min("rank").alias("rank"))
    joined = pieces.select("number", "first", "rank", F.regexp_replace(F.array_join("p.text", "\n"), "\r$", "").alias("text"))
    rows = cut.where("whole").select("number", "first", "rank", "text").unionByName(joined)
    return rows.where(F.col("number") > F.col("first")).select((F.col("number") - F.col("rank")).alias("source_row_index"), F.col("text").alias("record"))
