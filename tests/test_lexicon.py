"""Dictionaries and name tables of any size against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from baitline.operators.lexicon import deletions, join_keyword_table, nearest_names, with_word_hits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("part_bytes", [1 << 20, 9_000])
def test_ten_thousand_words(spark, part_bytes):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(26_000)})
    assert len(words) > 10_000
    urls = [None, "", *("http://" + "".join(rng.choice("ABcdeé.") for _ in range(rng.randint(1, 40))) for _ in range(150))]
    urls += urls[:20] + ["hot"] * 30
    df = spark.createDataFrame([(u, 1) for u in urls], "url STRING, n INT").repartition(3)
    table = spark.createDataFrame([(w,) for w in [*words, "É", "ABC", "", None]], "word STRING")
    got = {r.keyword: (r.rows, r.urls) for r in join_keyword_table(df, table, part_bytes).collect()}
    want = {}
    for w in {x.lower() for x in [*words, "É", "ABC"]}:
        rows = [u for u in urls if u and w in u.lower()]
        if rows:
            want[w] = (len(rows), len(set(rows)))
    assert got == want


def test_hits_keep_the_rows(spark):
    df = spark.createDataFrame([(1, "A bank of banks"), (1, "A bank of banks"), (2, None), (3, "")], "id INT, text STRING")
    table = spark.createDataFrame([("bank",), ("BANKS",), ("k o",), ("zz",)], "word STRING")
    got = [(r.id, r.text, r.found) for r in with_word_hits(df, "text", table, "found").orderBy("id").collect()]
    assert got == [(1, "A bank of banks", ["bank", "banks", "k o"])] * 2 + [(2, None, []), (3, "", [])]
    assert with_word_hits(df, "text", table.where("false"), "found").filter(F.size("found") > 0).count() == 0


def test_deletions(spark):
    df = spark.createDataFrame([("abca",), ("a",), ("",)], "s STRING")
    got = {r.s: (set(r.one), set(r.two)) for r in df.select("s", deletions(F.col("s"), 1).alias("one"), deletions(F.col("s"), 2).alias("two")).collect()}
    assert got["abca"][0] == {"abca", "bca", "aca", "aba", "abc"}
    assert got["abca"][1] == got["abca"][0] | {"ca", "ba", "bc", "aa", "ac", "ab"}
    assert got["a"] == ({"a", ""}, {"a", ""}) and got[""] == ({""}, {""})


@pytest.mark.parametrize("within", [1, 2])
def test_nearest_names_against_brute_force(spark, within):
    rng = random.Random(within)
    word = lambda low, high: "".join(rng.choice("abcé") for _ in range(rng.randint(low, high)))
    names = [(word(1, 6), i) for i in range(150)] + [("Paypal", 500), ("", 1)]
    labels = [word(1, 8) for _ in range(200)] + ["paypa1", "PAYPAL", "x" * 60, "", None]
    got = nearest_names(spark.createDataFrame([(x,) for x in labels], "label STRING"), spark.createDataFrame(names, "name STRING, place INT"), within)
    table = {}
    for name, place in names:
        if name:
            table[name.lower()] = min(place, table.get(name.lower(), 10**9))
    want = {}
    for label in {x.lower() for x in labels if x} - table.keys():
        best = min(((distance(label, n), p, n) for n, p in table.items()), default=None)
        if best and best[0] <= within:
            want[label] = (best[2], best[0])
    assert {r.label: (r.name, r.distance) for r in got.collect()} == want and len(want) > 30


def test_a_hundred_thousand_names(spark):
    """Labels made from names by at most two changes find a name at that distance or nearer; no cross join is planned."""
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 12))) for _ in range(101_000)})[:100_000]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name STRING, place INT").repartition(8)
    made = {}
    for n in rng.sample(names, 200):
        at, x = rng.randrange(len(n)), rng.choice("qrstuv")
        made[n[:at] + x + n[at + 1 :]] = 1
        made[n[:at] + n[at + 1 :] + x] = 2
    got = nearest_names(spark.createDataFrame([(x,) for x in made], "label STRING"), table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    found = {r.label: r for r in got.collect()}
    known = set(names)
    for label, most in made.items():
        if label not in known:
            assert found[label].distance <= most and found[label].distance == distance(label, found[label].name)
