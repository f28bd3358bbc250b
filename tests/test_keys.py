"""Helpers for hot keys: results must equal the plain definition."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from baitline.functions.keys import latest_before, mark_smallest, top_per_key
from baitline.operators import feeds, training

START = datetime(2024, 1, 1)


def test_top_per_key_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", rng.randint(0, 500)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id INT, k STRING, v INT")
    got = sorted((r.k, r.v, r.id) for r in top_per_key(df, ["k"], [F.col("v"), F.col("id")], 5, salts=8).collect())
    want = []
    for key in {r[1] for r in rows}:
        want += sorted((k, v, i) for i, k, v in rows if k == key)[:5]
    assert got == sorted(want)


@pytest.mark.parametrize("slice_by,per_slice", [("HOUR", 500_000), ("DAY", 20), ("MONTH", 7)])
def test_latest_before_does_not_depend_on_slices(spark, slice_by, per_slice):
    rng = random.Random(5)
    moment = lambda: START + timedelta(minutes=rng.randint(0, 6000))
    left = [(i, rng.choice(["hot", "hot", "a", "b", None]), moment()) for i in range(400)]
    obs = [(rng.choice(["hot", "a", "c"]), moment(), rng.randint(0, 99)) for _ in range(150)]
    rows = spark.createDataFrame(left, "id INT, k STRING, at TIMESTAMP_NTZ")
    table = spark.createDataFrame(obs, "key STRING, observed_at TIMESTAMP_NTZ, n INT").select(F.col("key").alias("owner"), "observed_at", F.struct("n").alias("value"))
    got = {r.id: r.last and r.last.n for r in latest_before(rows, "k", "at", {"last": ([], table)}, slice_by, per_slice).collect()}
    for i, key, at in left:
        earlier = [(t, n) for k, t, n in obs if k == key and t <= at]
        assert got[i] == (max(earlier)[1] if earlier else None)


def test_a_busy_hour_of_one_owner_is_spread(spark):
    """Half of all rows in one hour of one owner: cut by counts, the source read once, the result that of a plain look-up."""
    from baitline.functions.keys import _busy_cuts

    rng = random.Random(9)
    left = [(i, "hot", START + timedelta(seconds=rng.randrange(3600))) for i in range(1000)]
    left += [(1000 + i, f"k{i % 50}", START + timedelta(minutes=rng.randrange(3000))) for i in range(1000)]
    obs = [("hot", START + timedelta(seconds=rng.randrange(-5000, 3600)), rng.randrange(99)) for _ in range(300)]
    obs += [(f"k{i % 50}", START + timedelta(minutes=rng.randrange(3000)), i) for i in range(300)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    schema = "id INT, k STRING, at TIMESTAMP_NTZ"
    rows = spark.createDataFrame(left, schema).mapInArrow(counted, schema)
    table = spark.createDataFrame(obs, "owner STRING, observed_at TIMESTAMP_NTZ, n INT").select("owner", "observed_at", F.struct("n").alias("value"))
    got = {r.id: r.last and r.last.n for r in latest_before(rows, "k", "at", {"last": ([], table)}, per_slice=50).collect()}
    for i, key, at in left:
        earlier = [(t, n) for k, t, n in obs if k == key and t <= at]
        assert got[i] == (max(earlier)[1] if earlier else None)
    assert reads.value == len(left)

    keyed = spark.createDataFrame(left, schema).selectExpr("k AS _key", "date_trunc('HOUR', at) AS _slice", "unix_micros(CAST(at AS TIMESTAMP)) AS _micros")
    cuts = _busy_cuts(keyed, 50)
    assert cuts.count() == 1
    sizes = keyed.join(cuts, ["_key", "_slice"]).groupBy(F.size(F.filter("_cuts", lambda c: c < F.col("_micros")))).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 100


def test_mark_smallest_is_exact(spark):
    rows = [(i % 3, f"u{i}") for i in range(1000)] + [(0, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g INT, u STRING")
    quota = spark.createDataFrame([(0, 37), (1, 5000), (2, 0)], "g INT, quota BIGINT")
    marked = mark_smallest(df, "g", lambda sizes: quota, ["u"], 42, "taken")
    got = {r.g: (r.taken, r.n) for r in marked.groupBy("g").agg(F.count_if("taken").alias("taken"), F.count("*").alias("n")).collect()}
    assert got == {0: (37, 834), 1: (333, 333), 2: (0, 333)}


def test_split_and_balance_read_their_input_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    schema = "url STRING, label INT"
    df = spark.createDataFrame([(f"u{i}", int(i % 4 == 0)) for i in range(800)], schema).mapInArrow(counted, schema)
    assert training.train_split(df).filter("split = 'train'").count() == 640
    assert reads.value == 1600
    assert training.train_balance(df).count() == 400
    assert reads.value == 3200


def test_balance_and_split_sizes(spark):
    df = spark.createDataFrame([(f"u{i}", int(i < 130)) for i in range(1000)], "url STRING, label INT")
    balanced = training.train_balance(df)
    assert {r.label: r["count"] for r in balanced.groupBy("label").count().collect()} == {0: 130, 1: 130}
    split = training.train_split(df)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(1, "train"): 104, (1, "test"): 26, (0, "train"): 696, (0, "test"): 174}
    again = training.train_split(df.repartition(7))
    assert split.exceptAll(again).count() == 0


def fold(attempts, max_errors=5, recovery=300):
    """The breaker, one attempt after the other."""
    state, out = {}, {}
    for i, source, at, status in sorted(attempts, key=lambda a: (a[2], a[0])):
        count, opened = state.get(source, (0, None))
        skip = opened is not None and (at - opened).total_seconds() <= recovery
        if not skip:
            if opened is not None:
                count, opened = 0, None
            count = 0 if status == "healthy" else count + 1
            if count >= max_errors:
                opened = at
        state[source] = (count, opened)
        out[i] = (skip, count, opened is not None)
    return out


@pytest.mark.parametrize("slice_by,healthy,step", [("HOUR", 0.15, 40), ("MINUTE", 0.1, 30), ("DAY", 0.3, 90), ("MINUTE", 0.0, 20)])
def test_circuit_breaker_against_a_fold(spark, slice_by, healthy, step):
    rng = random.Random(step)
    at, attempts = START, []
    for i in range(1500):
        at += timedelta(seconds=rng.randint(0, step))
        if rng.random() < 0.01:
            at += timedelta(minutes=rng.randint(5, 300))
        attempts.append((i, "hot" if rng.random() < 0.7 else "cold", at, "healthy" if rng.random() < healthy else "error"))
    df = spark.createDataFrame(attempts, "attempt_id BIGINT, source STRING, attempted_at TIMESTAMP_NTZ, status STRING")
    want = fold(attempts)
    got = {r.attempt_id: (r.skipped, r.failures_in_row, r.circuit_open) for r in feeds.win_circuit_breaker(df, slice_by=slice_by).collect()}
    assert got == want
    assert any(skip for skip, _, _ in want.values())


def test_feed_status_with_ties_and_without_success(spark):
    t = lambda m: START + timedelta(minutes=m)
    rows = [
        (1, "a", t(0), "healthy", None, 5), (2, "a", t(10), "error", "x", None), (3, "a", t(70), "error", "y", None),
        (4, "b", t(0), "error", "z", None), (5, "c", t(0), "error", "w", None), (6, "c", t(5), "healthy", None, 9),
    ]
    df = spark.createDataFrame(rows, "attempt_id BIGINT, source STRING, attempted_at TIMESTAMP_NTZ, status STRING, error STRING, indicator_count INT")
    got = {r.source: (r.status, r.last_update, r.indicator_count, r.error_count, r.last_error) for r in feeds.win_feed_status(df).collect()}
    assert got == {
        "a": ("error", t(0), 5, 2, "y"), "b": ("error", None, 0, 1, "z"), "c": ("healthy", t(5), 9, 0, None),
    }


def test_latest_before_sorts_as_many_rows_a_task_however_many_there_are(spark, monkeypatch):
    from baitline.functions import keys

    monkeypatch.setattr(keys, "PER_TASK", 50)
    at = datetime(2024, 1, 1)
    table = spark.createDataFrame([("k0", at, (1,))], "owner STRING, observed_at TIMESTAMP_NTZ, value STRUCT<n: INT>")
    for n in (1_000, 4_000):
        rows = spark.createDataFrame([(i, f"k{i % 200}", at + timedelta(hours=i % 50)) for i in range(n)], "id LONG, k STRING, at TIMESTAMP_NTZ")
        found = latest_before(rows, "k", "at", {"last": ([], table)})
        sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(sizes) == n and max(sizes) <= 4 * 50
