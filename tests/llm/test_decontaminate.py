import re

import numpy as np
import pytest

from baitline.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item string, hash int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = words(s)
            k = min(5, len(v))
            if not k or d is None or i is None:
                continue
            want = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
            have = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            if len(want & have) / len(want) >= 0.8:
                out.add((d, i, len(want), len(want & have)))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 60, 40))] + [(40, None), (41, "!!"), (42, "Été É"), (None, text(9))]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 400, 60))] + [(90, None), (91, ""), (92, "été é ÉTÉ"), (93, "x Été, É.")]
    for k in range(60):
        item = items[int(rng.integers(0, 40))][1].split()
        for _ in range(int(rng.integers(0, 4))):
            item[int(rng.integers(0, len(item)))] = "odd"
        noise = "*** ".join(item).upper()
        docs.append((100 + k, text(int(rng.integers(0, 9000))) + " " + noise + " " + text(int(rng.integers(0, 9000)))))
    docs += [docs[-1], (None, docs[-1][1])]
    got = D.contaminated(
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {tuple(r)[:4] for r in got} == brute(docs, items) and len(got) == len(brute(docs, items))
    assert len(got) > 20


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(docs.where("false"), items).collect() == []
    assert D.contaminated(docs, items.where("false")).collect() == []
    assert D.contaminated(docs, items).count() == 1


@pytest.mark.parametrize("n", [1, 60, 64, 65, 128, 129, 100_000])
def test_partitions_have_room(n):
    part = D.size_class(n)
    bins = 1 << (64 - int(D.bins_shift(part)))
    assert 2 * n <= bins and (part == 0 or bins < 4 * n)


def test_sketch_keeps_most_of_a_set():
    found = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    least = D.minima(found, D.size_class(len(found)))
    assert len(least) > 0.75 * len(found) and set(least) <= set(found)
