import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from baitline.llm.periodic import factors, find_runs, looped, periodic_runs


def brute(words, least=12):
    """All maximal stretches of every period; of equal stretches the least period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found(words, least):
    names = np.unique(np.array(words, np.int64), return_inverse=True)[1] if len(words) else np.zeros(0, np.int64)
    s, e, q = find_runs(names, least)
    return list(zip(s.tolist(), (e - s).tolist(), q.tolist()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(2, 12))
def test_runs_of_short_sequences(words, least):
    assert found(words, least) == brute(words, least)


def test_runs_of_structured_sequences():
    rng = np.random.default_rng(5)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 250:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    cases = [[0] * 300, [0, 1] * 100 + [0], fibonacci[1], [0] * 40 + [1] + [0] * 40 + [1] + [0] * 39]
    cases += [[0, 1, 0, 1, 0, 1, 0, 1, 1, 0, 1, 0, 1, 0, 1, 0, 2]]
    for _ in range(300):  # powers of words that are themselves periodic, with damage
        unit = list(rng.integers(0, 2, rng.integers(1, 5))) * int(rng.integers(1, 6)) + list(rng.integers(0, 2, rng.integers(0, 4)))
        case = list(rng.integers(0, 2, 6)) + unit * int(rng.integers(2, 6)) + list(rng.integers(0, 2, 6))
        for _ in range(rng.integers(0, 2)):
            case[rng.integers(0, len(case))] = 3
        cases.append(case)
    for case in cases:
        for least in (2, 12):
            assert found(case, least) == brute(case, least), case


def test_proposals_stay_in_proportion():
    from baitline.llm.periodic import proposals

    words = np.zeros(20_000, np.int64)
    for k, level in enumerate(factors(words)):
        assert len(proposals(level, 1 << k)[0]) <= 8 * len(words)
    assert found(words, 12) == [(0, 20_000, 1)]


TEXTS = [
    (1, "a b c " * 9), (2, None), (3, ""), (4, " \t\n"), (5, "x " * 12), (6, "x " * 11), (7, "only once said"),
    (8, "a b " * 6 + "z " + "c d e " * 5), (9, "é ü ö " * 8), (1, "a b c " * 9), (None, "q " * 30), (10, "head " + "loop one two three four five six " * 2000),
    (11, "\x00 \x1c " * 9),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, runs string, id int").repartition(3)


def test_against_brute_force(spark):
    got = sorted(map(tuple, periodic_runs(frame(spark, TEXTS)).collect()), key=str)
    assert got == sorted([(i, *expected([w.decode() for w in (t or "").encode().split()])) for i, t in TEXTS], key=str)


def test_texts_ids_and_empty(spark):
    df = spark.createDataFrame([("", "a b " * 6 + "end"), ("k", "z")], "doc_id string, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df, texts=True).collect()}
    assert got == {"": (13, [(0, 12, 2)], "a b end"), "k": (1, [], "z")}
    assert periodic_runs(df.where("false")).collect() == []


def test_looped_texts(spark):
    texts = [(i, " ".join(f"w{i}_{k}" for k in range(i % 23))) for i in range(400)] + [(None, "a b"), (500, None)]
    got = {r.doc_id: r.t for r in spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    turned = 0
    for i, text in texts:
        h = 1 if i is None else zlib.crc32(str(i).encode())
        words, g = (text or "").split(), h // 10
        if h % 10 == 0 and words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text, turned = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n)), turned + 1
        assert got[i] == text
    assert turned > 20
