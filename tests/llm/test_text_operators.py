"""Byte-level BPE, token files, line dedup, suffix dedup and n-gram join against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from buildlens.llm import byte_bpe, line_dedup, ngram_join, spans, suffix_dedup, token_files
from buildlens.llm.common import components

P = pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")

ODD = [None, "", " ", "\n", "\n\n", "a", "it's we'll 'd 'x  'sab", "x" * 5000, "é😀 ǅ ٣   z", "tab\tand\x0bmore \r\n end ",
       "<|endoftext|> stays text", "a\x00b\x1c c", "!!!'s'S's  'll  "]


def docs(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return spark.createDataFrame([(*r, "a", 1, b"x") for r in rows], "doc_id long, text string, ids string, n_lines int, decoded binary")


def test_pretokens_equal_the_pattern():
    rnd = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "a", "é", "1", "!", "\t", " "])
                                              for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    pattern = regex.compile(P.PATTERN)
    for at, part in spans.blocks(pa.array(texts), 300):
        joined, units, off = spans.code_points(part)
        start = np.flatnonzero(spans.pretoken_starts(units, off))
        end, cut = np.append(start[1:], len(units)), np.searchsorted(start, off)
        for i in range(len(part)):
            assert [joined[a:b] for a, b in zip(start[cut[i]:cut[i + 1]], end[cut[i]:cut[i + 1]])] == pattern.findall(texts[at + i])


def test_bpe_equals_tiktoken_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode_documents(docs(spark, ODD, extra=True), path)
    got = {r.doc_id: r for r in byte_bpe.decode_documents(coded, path).collect()}
    for i, t in enumerate(ODD):
        assert got[i].ids == known.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].n_lines == 1
    assert byte_bpe.token_digests(docs(spark, [])).count() == 0
    bpe, rnd = byte_bpe.Bpe(ranks), random.Random(5)
    words = ["".join(rnd.choice("abcdeéthinof ") for _ in range(rnd.randint(1, 60))) for _ in range(800)] + ["a" * 3000, "!?" * 900]
    ids, lens = bpe.encode(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [known._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_token_files_round_trip_and_lookup(spark, tmp_out):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(8, "twice"), (8, "again"), (None, "no key"), (99, "twice"), (99, "twice")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(4)
    manifest = token_files.write_token_files(frame, f"{tmp_out}/ids", path, shards=3)
    known = tokenizers.Tokenizer.from_file(path)
    known.encode_special_tokens = True
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.scan_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == want
    asked = spark.createDataFrame([(8,), (99,), (1,), (None,), (12345,), (-20,)], "doc_id long")
    found = sorted((r.key, r.start, len(r.ids)) for r in token_files.lookup(manifest, asked).collect())
    assert found == sorted((k, s, n) for k, s, n, _ in want if k in (8, 99, 1, -20))
    empty = token_files.write_token_files(frame.limit(0), f"{tmp_out}/none", path)
    assert token_files.scan_token_files(empty).count() == 0 and token_files.lookup(empty, asked).count() == 0


def test_token_files_query_equals_the_library(spark, tmp_out):
    tokenizers = pytest.importorskip("tokenizers")
    end = "<|endoftext|>"
    texts = [*ODD, f"a {end} b", end, end * 3, f"{end} x", f"x{end}y it's {end}", "<|endoftext|", f"é😀{end}\n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_out}/documents.parquet")
    known, want, start = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for key, text in enumerate(texts):
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op4_token_files(spark, tmp_out).collect())) == want


def test_key_index_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(2).integers(-2**62, 2**62, 5000))
    index = token_files.KeyIndex.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    shard = token_files.ShardIndex.build(keys, np.ones(len(keys), np.int64), 0)
    shard = token_files.ShardIndex.from_bytes(shard.to_bytes())
    assert (shard.find(keys)[0] == np.arange(len(keys))).all()
    assert (shard.find(keys + 1)[0] >= 0).sum() <= np.isin(keys + 1, keys).sum() + 1


def brute_lines(rows, least=40, most=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(key(x)) < least or len(held[key(x)]) < most or d == max(held[key(x)])]
        out.append((d if d is not None else -1, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(7)
    common = ["Común línea número %d que se repite en muchos textos %s" % (i, "é" * i) for i in range(12)] + ["x" * 39, "y" * 40, "é" * 39, "é" * 40]
    rows = [(i, "\n".join(rnd.choice([c.upper() if c.isascii() else c, f"  {c}\t", c]) if rnd.random() < 0.7 else f"own line {i} {j} " + "z" * 30
                          for j, c in enumerate(rnd.choices(common, k=rnd.randint(0, 6))))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n"), (7, common[0]), (7, common[0]), (None, common[1]), (503, common[2] + "\n" + "\n".join([common[3]] * 50))]
    frame = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, n_dropped int, line string").repartition(4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(frame).collect())
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def brute_repeats(rows, width):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                cover[i:i + width] = b"\1" * width
        spans_ = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((d if d is not None else -1, len(b), sum(cover), spans_, bytes(x for x, c in zip(b, cover) if not c)))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rnd = random.Random(4)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    passage = word("abcdefgh é", 900)
    rows = [(i, word("xyz ", rnd.randint(0, 300)) + passage[rnd.randint(0, 100):rnd.randint(500, 900)] + word("xyz ", rnd.randint(0, 300))) for i in range(40)]
    rows += [(200, "ab" * 700), (201, "c" * 1200), (202, None), (203, ""), (204, "the line\n" * 90), (205, passage * 2), (206, word("pq", 399)),
             (207, word("pqr", 900)), (208, rows[0][1]), (208, rows[0][1]), (None, rows[1][1])]
    frame = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, th string, n_bytes int").repartition(3)
    got = sorted((r.id if r.id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame, hot_limit=hot).collect())
    assert got == brute_repeats(rows, 400)
    if hot == 1:
        assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rnd = random.Random(9)
    raw = "".join(rnd.choice("ab") for _ in range(5000))
    whole = np.zeros(5000 - 399, bool)
    for row, _, off, first, count, _, _ in suffix_dedup.regions(pa.array([raw], pa.large_string()), 400):
        assert row == 0
        for a, n in zip((first + off[0]).tolist(), count.tolist()):
            assert not whole[a:a + n].any()
            whole[a:a + n] = True
    assert whole.all()


def brute_groups(rows, num=80, den=100):
    def shingles(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in regex.split(r"[\x20\x09-\x0D]+", low) if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            same = len(sets[x] & sets[y])
            if sets[x] and sets[y] and den * same >= num * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), low.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def test_ngram_join_equals_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(35):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 6, 9, 12, 30, 60, 200]))]
        texts.append(base)
        for _ in range(rnd.randint(0, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 22))):
                at = rnd.randrange(len(copy))
                if rnd.random() < 0.5:
                    copy[at] = rnd.choice(vocabulary)
                else:
                    copy.insert(at, rnd.choice(vocabulary))
            texts.append(copy)
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    texts += [[rnd.choice(vocabulary) for _ in range(rnd.randint(5, 30))] + passage for _ in range(60)]
    rows = [(i, rnd.choice([" ", "\n"]).join(t).upper() if i % 3 else " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One Two"), (904, "one two"), (5, rows[5][1]), (None, rows[6][1]), (None, "alone here")]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, node int, rep string").repartition(4)
    got = sorted((r.id if r.id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1)
                 for r in ngram_join.similar_documents(frame).collect())
    assert got == brute_groups(rows)
    assert ngram_join.similar_documents(frame.limit(0)).count() == 0


def test_ngram_join_of_near_texts_without_ids(spark):
    def near(name, changes):
        return " ".join(f"{name}x{k}" if k in changes else f"{name}{k}" for k in range(100))

    rows = [(20, near("a", [])), (None, near("a", [20, 40])), (10, near("a", [20, 40, 60, 80])),  # only the text without id bridges
            (None, near("b", [])), (None, near("b", [50])), (None, near("b", [50])),  # no id at all
            (None, near("c", [30])), (7, near("c", [])), (8, near("d", [])), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.id if r.id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1)
                 for r in ngram_join.similar_documents(frame).collect())
    assert got == brute_groups(rows)
    assert (20, 96, 10) in got and (-1, 96, 10) in got and (-1, 96, 7) in got


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(6)
    for size in (4, 5, 9, 20, 47, 150, 600):
        for _ in range(30):
            both = np.sort(rng.integers(0, 2**62, 2 * size, dtype=np.int64).view(np.uint64))
            a = np.unique(rng.choice(both, size, replace=False))
            gone = (len(a) * 20) // 100 // 2
            extra = np.setdiff1d(both, a)[:gone]
            b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), gone, replace=False)), extra]))
            same = len(np.intersect1d(a, b))
            if 100 * same < 80 * (len(a) + len(b) - same) or same == len(a) == len(b):
                continue
            hashes, off = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            sig, row = ngram_join.signatures(hashes, off, ngram_join.Bands(80, 100, 1000))
            assert np.intersect1d(sig[row == 0], sig[row == 1]).size, size


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 301), (301, 300), (302, 302)]
    rnd = random.Random(3)
    rnd.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100: 100}, **{200 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def test_whole_texts_of_a_table(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.token_digests(sample).collect()}
    for r in sample.collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
