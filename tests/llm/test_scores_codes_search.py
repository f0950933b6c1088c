"""Language-model scores, vector codes and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buildlens.llm import ball_search, lm_score, vector_codes
from buildlens.llm.common import table
from buildlens.llm.elias_fano import ChildLists, EliasFano, read_arrays, write_arrays

SF = "/root/testdata/sf0.001"


# ---- Elias-Fano ----

@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 2**64 - 1), (5, 3), (900, 2**63), (5000, 15000), (4000, 1), (3000, 2**64 - 1)])
def test_elias_fano_access_and_search(n, top, tmp_out):
    rnd = np.random.default_rng(n)
    values = np.sort(rnd.integers(0, top, n, dtype=np.uint64, endpoint=True))
    write_arrays(f"{tmp_out}/x", EliasFano.build(values).arrays("x"))
    packed = EliasFano.of(read_arrays(f"{tmp_out}/x"), "x")
    assert (packed.all() == values).all()
    asked = np.concatenate([values, rnd.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, 2**64 - 1], np.uint64)])
    at, equal = packed.find(asked)
    assert (at == np.searchsorted(values, asked)).all()
    assert (equal == np.isin(asked, values)).all()


def test_child_lists():
    rnd = random.Random(3)
    own = {k: sorted(rnd.sample(range(300), rnd.choice([0, 0, 1, 5, 40]))) for k in range(200)}
    node, child = (np.array([x[j] for k in own for x in [(k, c) for c in own[k]]]) for j in (0, 1))
    lists = ChildLists.build(node, child, 200)
    asked = [(rnd.randrange(200), rnd.randrange(320)) for _ in range(3000)]
    at, first = lists.find(*np.array(asked).T)
    start = np.cumsum([0, *(len(own[k]) for k in own)])
    for (k, c), x, s in zip(asked, at.tolist(), first.tolist(), strict=True):
        assert s == start[k] and x == (start[k] + own[k].index(c) if c in own[k] else -1)


# ---- language model ----

def lm_by_hand(rows, learned):
    """(n_tokens, n_known, N, base, score) of each text."""
    def grams(text):
        out = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</>"]
        return list(zip(["<>", "<>", *out], ["<>", *out], out, strict=False))

    one, two, three, after2, after3 = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for text, ok in zip(rows, learned, strict=True):
        for a, b, c in grams(text) if ok else []:
            one[c] += 1
            two[b, c] += 1
            three[a, b, c] += 1
            after2[b].add(c)
            after3[a, b].add(c)
    n2, n3 = Counter(), Counter()
    for (b, _), k in two.items():
        n2[b] += k
    for (a, b, _), k in three.items():
        n3[a, b] += k
    code = lambda x: 10 ** (-min(255, round(-math.log10(x) * lm_score.STEP)) / lm_score.STEP)
    n, v = sum(one.values()), len(one)
    out = []
    for text in rows:
        base = score = 0.0
        for a, b, c in grams(text):
            p1 = (one[c] + 1) / (n + v + 1)
            base += math.log10(p1)
            p = p1 if b not in after2 else code(len(after2[b]) / (n2[b] + len(after2[b]))) * p1 \
                + (code(two[b, c] / (n2[b] + len(after2[b]))) if (b, c) in two else 0)
            if (a, b) in after3:
                p = code(len(after3[a, b]) / (n3[a, b] + len(after3[a, b]))) * p \
                    + (code(three[a, b, c] / (n3[a, b] + len(after3[a, b]))) if (a, b, c) in three else 0)
            score += math.log10(p)
        out.append((len(grams(text)), sum(one[c] > 0 for *_, c in grams(text)), n, base, score))
    return out


TEXTS = [None, "", " \t\n", "the", "THE the The", "a b a b a b a b", "a b c", "x" * 3000, "é ß É naïve 😀 x y", "the " * 4000 + "end"] \
    + [" ".join(random.Random(i).choice(["the", "the", "the", "of", "a", "b", "c", f"w{i % 7}", f"u{i}"]) for _ in range(i % 50)) for i in range(120)]


@pytest.mark.parametrize("shards, block", [(4, 1 << 20), (23, 700)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, shards, block):
    """With many shards, bounds cut the successors of 'the' and its contexts; with small blocks, documents too."""
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "partitions", lambda _: shards)
    rows = [(i if i != 20 else None, t, "x", 1.0, "en") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "y", 2.0, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, score double, known string").repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    held = F.col("doc_id") % 7 == 2
    learned = [not (r[0] is not None and r[0] % 7 == 2) for r in rows]
    want = Counter((r[0], *w[:3], round(w[3], 6), round(w[4], 6)) for r, w in zip(rows, lm_by_hand([r[1] for r in rows], learned), strict=True))
    read = docs.select(F.col("doc_id").alias("id"), "text", (~F.coalesce(held, F.lit(False))).alias("learned"))
    bounds = lm_score.learn(read).bounds
    assert len(bounds) >= shards // 2 and (shards < 9 or len(np.unique(bounds[:, 0])) < len(bounds))
    got = lm_score.score_documents(docs, held_out=held).collect()
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_lm_probabilities_sum_to_one():
    """Over all words and an unseen one, after seen and unseen contexts, but for the rounding of codes."""
    rnd = random.Random(8)
    found = lm_score.Trigrams(*lm_score.tokens(pa.array([" ".join(rnd.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=30)) for _ in range(40)], pa.large_string())))
    times, n = np.diff(found.first), len(found.known)
    count = np.bincount(found.c, times, n)
    trie = lm_score.Trie(lm_score.build_trie(*(x.astype(np.int64) for x in (found.b, found.a, found.c)), times, n, {}, {}))
    ends = np.append(np.flatnonzero(count > 0), n)  # every token, and one that was never seen
    base = np.append(count[ends[:-1]] + 1, 1) / (count.sum() + len(ends) - 1 + 1)
    assert base.sum() == pytest.approx(1)
    for b, a in [(0, 1), (2, 2), (5, n), (n, 0)]:
        p = trie.probabilities(np.full(len(ends), b), np.full(len(ends), a), ends, base)
        assert p.sum() == pytest.approx(1, abs=0.06)


def test_lm_of_empty_and_unlearned_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm_score.score_documents(docs.limit(0)).count() == 0
    rows = lm_score.score_documents(docs, held_out=F.lit(True)).collect()
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_lm_query(spark):
    rows = {r.doc_id: r for r in lm_score.op11_lm_score(spark, SF).collect()}
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    for (i, _), out, w in zip(texts, held, lm_by_hand([t for _, t in texts], [not h for h in held]), strict=True):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)
    # the model beats its base on texts that it hasn't seen
    unseen = [rows[i] for (i, _), h in zip(texts, held, strict=True) if h]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


# ---- vector codes ----

def codes_by_hand(vectors, parts=16, entries=64, rounds=2):
    whole = {k: [math.floor(256 * x) for x in v] for k, v in vectors.items()}
    d = len(next(iter(whole.values()))) // parts
    cut = {k: [v[p * d:(p + 1) * d] for p in range(parts)] for k, v in whole.items()}
    books = [[cut[k][p] for k in sorted(cut)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut.values():
                groups[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    found = {k: [near(v[p], books[p]) for p in range(parts)] for k, v in cut.items()}
    return {k: ("".join(f"{i:02x}" for _, i in f), sum(e for e, _ in f)) for k, f in found.items()}, books


def test_vector_codes_equal_brute_force(spark):
    rnd = random.Random(2)
    scale = [0.01, 0.2, 3.0, 900.0]  # spreads from less than a unit to far cells
    good = {i * 3 + 7: [rnd.gauss(0, scale[j // 8]) for j in range(32)] for i in range(200)}
    good[1] = [0.0] * 32
    good |= {i: good[10] for i in (900, 901)}
    bad = [(2, None), (3, [1.0] * 31 + [None]), (4, [1.0] * 31 + [math.inf]), (5, [math.nan] * 32)]
    odd = [(6, [1.0] * 16), (8, []), (9, [1e30] * 32)]
    rows = [(k, v, k % 3 if k % 4 else None, "x") for k, v in [*good.items(), *bad, *odd]]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(3)
    coded, books = vector_codes.vector_codes(table_)
    got = {r.id: (r.code, r.error) for r in coded.collect()}
    want, book = codes_by_hand(good)
    assert books.tolist() == book
    assert got == want | {k: (None, None) for k, _ in odd}


def test_vector_codes_of_small_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none, books = vector_codes.vector_codes(spark.createDataFrame([], kind))
    assert none.count() == 0 and books.size == 0
    few = {5: [0.5] * 16, 3: [0.25] * 16, 4: [0.5] * 15 + [0.75]}
    coded, books = vector_codes.vector_codes(spark.createDataFrame([(k, v, 0) for k, v in few.items()] + [(None, [0.5] * 16, 0)], kind))
    got = {r.id: (r.code, r.error) for r in coded.collect()}
    assert got[3][0][:2] == "00" and got[None] == got[5] and books.shape == (16, 4, 1)
    odd, _ = vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 17, 0)], kind))
    assert [tuple(r) for r in odd.collect()] == [(1, 0, None, None)]


def test_cells_drop_only_dominated_entries():
    rnd = np.random.default_rng(4)
    book = rnd.integers(-400, 400, (64, 4))
    cache = vector_codes.CellCache(book)
    parts = rnd.integers(-500, 500, (20_000, 4))
    entry, apart = cache.nearest(parts)
    all_ = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == all_.argmin(axis=1)).all() and (apart == all_.min(axis=1)).all()
    assert cache.count.mean() < 32  # less than half are evaluated


# ---- ranked search ----

def ranked_by_hand(docs, items, k=50):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(split(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in own:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


@pytest.mark.parametrize("block", [16, 8192])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ball_search, "BLOCK", block)
    monkeypatch.setattr(ball_search, "LEAF", 4)
    monkeypatch.setattr(ball_search, "ITEMS", 3)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "A1"]
    docs = [(i, " ".join(rnd.choice(words[:rnd.choice([5, 60, 63])]) for _ in range(rnd.randint(0, 30)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(70)] + [(None, "w1 w2 w3"), (400, None), (401, ""), (402, "--- !!"), (403, "w4 " * 5000), (7, "w1 w2 w3")]
    items = [(0, "w1 W2, w3!"), (1, ""), (2, None), (3, "unknown"), (4, "a1 É w7 w7 w7"), (5, " ".join(words)), (6, "w4"), (6, "w5"), (8, "w4 w50")]
    got = ball_search.ranked_search(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, item string").repartition(5),
                                    spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")).collect()
    assert Counter((r.item, r["rank"], r.id, r.score) for r in got) == Counter(ranked_by_hand(docs, items))


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_search.ranked_search(docs.limit(0), items).count() == 0
    assert ball_search.ranked_search(docs, items.limit(0)).count() == 0


def test_bounds_prune_and_hold():
    """On documents of separate subjects most aren't scored, and no bound is below a score under it."""
    rnd = np.random.default_rng(1)
    n, terms = 2000, 400
    at = [np.unique(rnd.integers(0, 20, 12) + 20 * (i % 20)) for i in range(n)]
    off = np.cumsum([0, *map(len, at)])
    x = rnd.integers(100_000, 900_000, off[-1])
    tree = ball_search.BallTree(ball_search.Sparse(off, np.concatenate(at), x), terms)
    weights = np.zeros(terms, np.int64)
    weights[rnd.integers(40, 60, 8)] = rnd.integers(1, 9000, 8)
    scores = np.zeros(n, np.int64)
    scores[tree.order] = tree.rows.dot(0, n, weights)
    assert scores.tolist() == [int((weights[a] * x[off[i]:off[i + 1]]).sum()) for i, a in enumerate(at)]
    dense = weights.astype(float)
    for node in range(len(tree.low)):
        assert tree.bound(node, dense, np.sqrt(dense @ dense)) >= scores[tree.order[tree.low[node]:tree.high[node]]].max()
    best = []
    assert ball_search.search(tree, np.arange(n), weights, 10, best) < n // 5
    assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:10]
