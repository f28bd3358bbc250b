import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from baitline.llm import warc as W
from baitline.plans.session import scratch_path

SCHEMA = "page_id long, url string, html string, id int, digest string"
LONG = "<p>é\r\n\r\n</p>" * 20
ROWS = [
    (5, "http://a/", LONG), (2, "http://b/\r\nX: y", LONG), (9, None, LONG), (1, "u", "x" * 99), (3, "u", "x" * 99), (4, "u", "y" * 100), (6, "u", "y" * 100),
    (7, "u", None), (8, "u", ""), (None, "u", LONG), (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 10), (11, "u", "z" * 3_000_000), (2, "again", LONG),
    (None, "v", "only without an id " * 9), (None, "w", "only without an id " * 9),
]


def brute(rows):
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        ids = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        first = min(ids) if ids else None
        again = len(b) >= 100 and first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, u, t, 1, "x") for i, u, t in rows], SCHEMA)


def test_round_trip(spark):
    got = sorted(map(tuple, W.archived(frame(spark, ROWS)).collect()), key=str)
    assert got == sorted(brute(ROWS), key=str)


def test_each_record_is_a_member(spark):
    source, target = scratch_path(spark, "w"), scratch_path(spark, "w")
    W.write_monolithic(frame(spark, ROWS).coalesce(1), source)
    index = sorted(W.normalise(spark, source, target).collect(), key=lambda r: (r.archive, r.offset))
    plain = lambda p: Path(p.removeprefix("file:"))
    (mono,), (split,) = plain(source).glob("*.gz"), plain(target).glob("*.warc.gz")
    data = split.read_bytes()
    assert gzip.decompress(mono.read_bytes()) == gzip.decompress(data)
    assert len(index) == len(ROWS) and sum(r.length for r in index) == len(data)
    at = 0
    for r in index:
        assert r.offset == at and gzip.decompress(data[at : at + r.length]).startswith(b"WARC/1.1\r\n")
        at += r.length
    assert not [p for p in plain(target).iterdir() if p.name.startswith("_")]


def test_records_cut_anywhere():
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"", b"abc", b"\r\n\r\n"))
    for step in (1, 2, 7, 1000):
        assert [b for _, b in W._records(raw[i : i + step] for i in range(0, len(raw), step))] == [b"", b"abc", b"\r\n\r\n"]
    with pytest.raises(ValueError):
        list(W._records([raw[:-1]]))
    two = gzip.compress(raw) + gzip.compress(b"more")
    assert b"".join(W._inflated(two)) == raw + b"more"


def test_damage_is_seen_and_empty(spark):
    source, target = scratch_path(spark, "w"), scratch_path(spark, "w")
    W.write_monolithic(frame(spark, ROWS[:1]), source)
    index = W.normalise(spark, source, target)
    with pytest.raises(Exception):
        W.read_records(index.withColumn("offset", F.col("offset") + 3), target, "bigint").collect()
    assert W.archived(frame(spark, [])).collect() == []
