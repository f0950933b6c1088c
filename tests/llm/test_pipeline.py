"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib

import corpus_pipeline as C
from buildlens.llm.common import store, table

from .test_model_operators import brute_hits
from .test_text_operators import brute_groups, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "tokens"]
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", None, None, 5), (10**6 + 2, "", "de", "s", 0)], docs.schema)
    first = store(C.by_language(spark, docs.unionByName(extra), SF), "t")
    assert first.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in first.collect()}
    rows = [(r.doc_id, r.text) for r in first.collect()]
    second = store(C.without_repeated_lines(spark, first, SF), "t")
    assert sorted((r.doc_id, r.text) for r in second.collect()) == [(d, t) for d, _, _, t in brute_lines(rows)]
    assert all(r.n_chars == len(r.text) for r in second.collect())
    rows = [(r.doc_id, r.text) for r in second.collect()]
    third = store(C.without_near_duplicates(spark, second, SF), "t")
    assert sorted(r.doc_id for r in third.collect()) == [d for d, n, c in brute_groups(rows) if c == d]
    rows = [(r.doc_id, r.text) for r in third.collect()]
    fourth = store(C.without_benchmark(spark, third, SF), "t")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(r.doc_id for r in fourth.collect()) == [d for d, _, n, _ in brute_hits(rows, items) if not n]
    texts = {r.doc_id: r.text for r in fourth.collect()}
    last = {r.doc_id: r for r in C.to_tokens(spark, fourth, SF).collect()}
    assert {d: r.decoded_sha256 for d, r in last.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
    assert C.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
