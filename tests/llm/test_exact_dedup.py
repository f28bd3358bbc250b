import hashlib

import pytest

from baitline.llm.exact_dedup import build_index, exact_dedup

SCHEMA = "doc_id long, text string, key string, digest int"


def brute(rows):
    strip = lambda t: "".join(c for c in t or "" if c not in "\x20\t\n\x0b\x0c\r")
    out = []
    for i, t in rows:
        group = [(len(u or ""), -j if j is not None else None) for j, u in rows if strip(u) == strip(t)]
        known = [g for g in group if g[1] is not None]
        # most code points first; an id before none
        best = max(group, key=lambda g: (g[0], g[1] is not None, g[1] or 0)) if known else None
        keep = -best[1] if best and best[1] is not None else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    return out


ROWS = [
    (5, "a b"), (3, "ab "), (9, "a\tb\n"), (1, None), (2, ""), (4, " \r\n"), (7, "a b"), (8, "é" * 30_000), (6, "é" * 30_000),
    (11, "ab"), (11, "ab"), (None, "zz"), (12, "zz"), (None, "only"), (13, "x" * 200_000 + " "), (14, "x" * 200_000),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], SCHEMA)
    got = sorted(map(tuple, exact_dedup(df, capacity=2).collect()), key=str)
    assert got == sorted(brute(ROWS), key=str)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 1000) AS text")
    slots, index, max_depth = build_index(df, capacity=33)
    rows = index.collect()
    assert len(rows) == 1000 and sum(r["size"] for r in rows) == 3000
    loads = {}
    for r in rows:
        loads[r["depth"], r["bucket"]] = loads.get((r["depth"], r["bucket"]), 0) + 1
    assert max(loads.values()) <= 33 and len({d for d, _ in loads}) > 1
    # buckets cut the key space: none is a prefix of another
    for d, b in loads:
        assert not any((e, b >> (d - e)) in loads for e in range(d))
    assert slots.count() <= 1 << max_depth and max_depth == 8


def test_ids_need_an_order_only(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(5, "a"), (least, "a "), (least + 1, " a")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup(df).collect()} == {5: least, least: least, least + 1: least}
    df = spark.createDataFrame([("b", "x"), ("", "x"), ("c", "y"), (None, "y")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).collect()} == {("b", "", False), ("", "", True), ("c", "c", True), (None, "c", False)}


@pytest.mark.parametrize("copies", [400])
def test_one_text_holds_most_rows(spark, copies):
    df = spark.range(copies * 2).selectExpr("id AS doc_id", "IF(id % 2 = 0, repeat('same ', 50), concat('d', id)) AS text")
    got = exact_dedup(df).where("kept").count()
    assert got == copies + 1
