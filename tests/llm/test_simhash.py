import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from baitline.llm import simhash as S
from baitline.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    marks = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def groups(values, close):
    values = np.asarray(values)
    root = np.arange(len(values))
    for _ in range(len(values)):
        before = root.copy()
        for i in range(len(values)):
            near = close(values, values[i])
            root[near] = root[near].min()
        if (before == root).all():
            return root
    return root


@pytest.mark.parametrize("crowd", [1000, 3])
def test_links_lose_nothing(spark, crowd):
    """Random values with dense balls around a few of them; crowded keys take the other way."""
    rng = np.random.default_rng(5)
    some = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for centre in some[:4]:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            some.append(centre ^ sum(1 << int(b) for b in flips))
    values = np.unique(np.array([0, 1, 7, 15, 2**64 - 1, *some], np.uint64))
    want = groups(values, lambda v, x: np.bitwise_count(v ^ x) <= 3)
    fps = spark.createDataFrame([(int(v.view(np.int64)),) for v in values], "fp long")
    edges = S.links(fps, crowd)
    for a, b in edges.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    root = {r.node: r.root for r in components(edges).collect()}
    mine = [root.get(int(v.view(np.int64)), int(v.view(np.int64))) for v in values]
    assert len({*zip(mine, want)}) == len({*mine}) == len({*want})


def test_rows(spark):
    long = "the quick brown fox " * 60_000
    rows = [(4, "A b  c\td"), (2, "a B c d"), (9, None), (7, ""), (5, " \n"), (1, "one two"), (None, "a b c d"), (3, long), (8, long + "x"), (4, "A b  c\td"), (6, "É é")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, id string")
    got = S.near_duplicates(df).collect()
    texts = {(i, t) for i, t in rows}
    marks = {t: fingerprint(t) for _, t in texts}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((i is None, i or 0, f"{marks[t]:016x}") for i, t in rows)
    part = {r.doc_id: r.component_id for r in got}
    close = lambda a, b: bin(a ^ b).count("1") <= 3
    for i, t in rows:
        assert part[i] <= min(j for j, u in rows if j is not None and close(marks[t], marks[u]))
    assert part[9] == part[7] == part[5] and part[None] == part[2] == part[4] == 2 and part[3] == part[8]


def test_only_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in S.near_duplicates(df).collect()] == [(None, f"{fingerprint('a b c'):016x}", None)]
    assert S.near_duplicates(df.where("false")).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    edges = spark.range(300).selectExpr("id + 1 AS a", "id AS b").unionByName(
        spark.range(1000, 1500).selectExpr("id AS a", "999L AS b"))
    got = components(edges).groupBy("root").agg(F.count("*").alias("n"), F.countDistinct("node").alias("m"))
    assert sorted(map(tuple, got.collect())) == [(0, 301, 301), (999, 501, 501)]
