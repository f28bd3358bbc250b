import hashlib
import re

import numpy as np
import pytest

from baitline.llm.fm_index import FMIndex, WaveletTree
from baitline.llm.substring_dedup import remove_repeats


def brute(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = split(t)
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < rank(i):
                gone.update(range(a, a + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(8)
    text = lambda n, v=3000: [f"w{k}" for k in rng.integers(0, v, n)]
    passage, short = text(75), text(49)
    rows = []
    for i in range(40):
        body = text(int(rng.integers(0, 200)))
        if i % 2:
            body += passage + text(int(rng.integers(0, 60)))
        if i % 5 == 0:
            body = short + body
        rows.append((int(rng.integers(0, 10_000)), body))
    base = text(400)
    for i in range(12):  # near copies
        near = list(base)
        for _ in range(i % 5):
            near[int(rng.integers(0, 400))] = "odd"
        rows.append((20_000 + i, near))
    rows += [(30_000, ["same"] * 200), (30_001, ["same"] * 130), (30_002, ["a", "b"] * 60), (30_003, ["b", "a"] * 60), (30_004, base[:50]), (30_005, base[:49])]
    rows = [(i, "  ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :])) for i, w in rows]
    return rows + [(31_000, None), (31_001, ""), (31_002, " \t"), (None, " ".join(base)), (31_003, "é " * 120), (31_004, "é x " * 70)] + rows[3:6]


@pytest.mark.parametrize("crowd,shard", [(2000, 600_000), (3, 2_000)])
def test_against_brute_force(spark, crowd, shard):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, ord int, body string").repartition(3)
    got = sorted(map(tuple, remove_repeats(df, crowd=crowd, shard_words=shard).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert got == want and sum(r[2] for r in want) > 2000


def test_words_of_equal_hash_are_told_apart(spark):
    """Thue-Morse words over two letters agree in any polynomial hash modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(1 << 11)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    head, tail = [f"h{k}" for k in range(30)], [f"t{k}" for k in range(30)]
    rows = [(1, " ".join([*head, one, *tail])), (2, " ".join([*head, two, *tail])), (3, "\t".join([*head, two, *tail])), (4, "x " * 60 + one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (2000, 1):
        assert sorted(map(tuple, remove_repeats(df, crowd=crowd).collect())) == sorted(brute(rows))
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 61, 4: 0}


def test_very_long_texts(spark):
    rng = np.random.default_rng(4)
    long = [f"w{k}" for k in rng.integers(0, 50_000, 300_000)]
    rows = [(1, " ".join(long)), (2, "head " + " ".join(long[100_000:200_000]) + " tail"), (3, "z" * 400_000 + " " + " ".join(long[:60]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 100_000, 3: 60}


def test_texts_and_empty(spark):
    text = " ".join(f"t{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in remove_repeats(df, texts=True).collect()} == {1: text, 2: "head tail"}
    assert remove_repeats(df.where("false")).collect() == []


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 300):
        s = rng.integers(0, size, 1000)
        tree = WaveletTree(s, size)
        c, p = rng.integers(0, size, 500), rng.integers(0, 1001, 500)
        assert tree.rank(c, p).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, p)]


def test_windows_of_an_index():
    rng = np.random.default_rng(3)
    for depth, alphabet in ((5, 2), (7, 3), (50, 4), (6, 50)):
        sizes = rng.integers(depth, depth + 40, 20)
        words = rng.integers(0, alphabet, sizes.sum()).astype(np.uint64)
        index = FMIndex(words, sizes, depth)
        seq, start, found = index.windows()
        begin = np.cumsum(sizes) - sizes
        keys = [tuple(words[begin[s] + a : begin[s] + a + depth]) for s, a in zip(seq, start)]
        assert len(keys) == (sizes - depth + 1).sum()
        assert len({*zip(keys, found)}) == len({*keys}) == len({*found})
        value = rng.permutation(20)
        least = index.least(value)
        want = {}
        for k, s in zip(keys, seq):
            want[k] = min(want.get(k, 99), value[s])
        assert all(least[f] == want[k] for k, f in zip(keys, found))
