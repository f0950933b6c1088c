"""The n-gram join's packed signatures, and the work between its first links and its last pairs."""

import random

import numpy as np
import pyarrow as pa

from buildlens.llm import ngram_join
from buildlens.llm.spans import U64


def _shingles(text: str) -> set:
    w = text.lower().split()
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def _texts() -> list[str]:
    """A family of near copies that differ all over, a chain, and texts that share a half only."""
    rng = random.Random(5)
    word = lambda: "w%05d" % rng.randrange(50_000)
    base, out = [word() for _ in range(160)], []
    for _ in range(40):
        out.append(" ".join(word() if rng.random() < 0.012 else w for w in base))
    chain = [word() for _ in range(120)]
    for _ in range(30):
        at = rng.randrange(110)
        chain = chain[:at] + [word()] + chain[at + 1:]
        out.append(" ".join(chain))
    half = [word() for _ in range(80)]
    return out + [" ".join(half + [word() for _ in range(60)]) for _ in range(30)]


def _components(texts: list[str]) -> list[int]:
    sets, low = [_shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        was = low[:]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
        if low == was:
            return low
    return low


def test_components_are_exact_and_take_fewer_jobs(spark):
    """Before, 429 jobs: every step made all components anew and looked at all groups."""
    texts = _texts()
    sc = spark.sparkContext
    sc.setJobGroup("ngram-work", "")
    got = ngram_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("ngram-work"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [r["component_id"] for r in got] == _components(texts)
    assert jobs < 300


def test_packed_signatures_meet_again_in_few_bytes():
    """Nodes with more signatures in a bucket than a byte counts; 4 bytes a signature and 9 a node and bucket."""
    node = np.array([7, 3, 99], np.int64)
    shared = np.arange(1000, dtype=U64)
    sig = np.concatenate([shared, shared[:300], np.arange(5000, 5010, dtype=U64)])
    row = np.repeat([0, 1, 2], [1000, 300, 10])
    batch = ngram_join._packed(node, sig, row, 1)
    assert batch.nbytes < 4 * len(sig) + 9 * 8 + 100
    found = pa.Table.from_batches(list(ngram_join._meet(0, batch.to_pylist()))).to_pylist()
    assert found == [{"grp": None, "centre": 3, "node": 7, "times": 300}]


def test_packed_signatures_of_many_buckets():
    rng = np.random.default_rng(2)
    sig, row = rng.integers(0, 2**63, 5000).astype(U64), np.sort(rng.integers(0, 20, 5000))
    node = np.arange(100, 120, dtype=np.int64)
    held = {}
    for r in ngram_join._packed(node, sig, row, 50).to_pylist():
        of = np.repeat(np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["times"], np.uint8))
        held[r["bucket"]] = sorted(zip(of.tolist(), np.frombuffer(r["sigs"], np.uint32).tolist(), strict=True))
    want = {}
    for s, i in zip(sig.tolist(), row.tolist(), strict=True):
        want.setdefault((s >> 32) % 50, []).append((int(node[i]), s & 0xFFFFFFFF))
    assert held == {k: sorted(v) for k, v in want.items()}
