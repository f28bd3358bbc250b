"""Substring deduplication: words of passages that an earlier document has are removed.

A window is ``WINDOW`` consecutive words; each word is removed that lies in a
window which also starts in a document with a smaller id.  Every window belongs
to one shard, so every shard is searched once and for its own windows only:

1. Anchors.  A window's anchor is the least of its ten-word hashes; consecutive
   windows of one anchor make a segment.  Equal windows have equal anchors.
   Only segments whose anchor occurs in two documents or more go on.
2. Shards.  Equal segments are folded; the distinct ones go to shards by their
   anchor.  An anchor of over ``CROWD`` distinct segments is spread over
   several shards, whose windows are then reconciled by their digests.
3. Search.  A shard's task builds a compressed FM-index of its segments and
   streams them through backward search; for each window the interval names
   the documents that have it, and so the least id.
4. Removal.  Runs of matched windows return to their documents.

Hashes only bring candidates together.  Segments and windows are the same when
the 128-bit BLAKE2 digests of their words' bytes are, and the index of a shard
numbers words by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import stored
from .words import blocks, bounds, hashes, rows_of, shingles

WINDOW, ANCHOR = 50, 10
#: Distinct segments of one anchor in one shard.
CROWD = 2000
#: Words that a shard holds on average.
SHARD = 600_000
#: Words below which a shard is not cut further to give every task one.
LEAST_SHARD = 50_000
_U = np.uint64
_NO_ID = (1 << 63) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Order and text of each row; ``body`` tells apart rows that repeat an id with another text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("ord"),
        F.xxhash64(text).alias("body"), text.alias("text"),
    )


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def segments(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first window within it, number of windows, anchor and first word of every segment of a block."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    rows = rows_of(counts)
    grams = shingles(words, ANCHOR)
    at = np.arange(len(grams), dtype=_U)
    # the place in the low bits makes the least one unique, and gives it back
    least = (grams & ~_U(63)) | (at & _U(63))
    span, width = WINDOW - ANCHOR + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = at[:n] + ((least - at[:n]) & _U(63))
    inside = rows[:n] == rows[WINDOW - 1 :]
    fresh = inside.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(fresh)
    ends = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
    sizes = ends - starts
    row = rows[starts]
    anchor = grams[place[starts].astype(np.int64)] & ~_U(63)
    return row, starts - counts[row], sizes, anchor.view(np.int64), starts


def _occurrences(rows: DataFrame) -> DataFrame:
    """Segments of all rows: ord, body, start, n, anchor, segment."""

    def cut(batches):
        for batch in batches:
            order, body = (batch.column(c).to_numpy() for c in ("ord", "body"))
            for first, _, data, offsets in blocks(batch.column("text")):
                starts, ends, counts = bounds(data, offsets)
                row, start, n, anchor, word = segments(hashes(data, starts, ends), counts)
                # where words stand one space apart, the text itself is the words joined by one space
                odd = np.zeros(len(starts) + 1, np.int64)
                np.cumsum((starts[1:] - ends[:-1] != 1) | (data[ends[:-1]] != 32), out=odd[2:]) if len(starts) > 1 else None
                last = word + n + WINDOW - 2
                plain = odd[last + 1] == odd[word + 1]
                raw = data.tobytes()
                sign = [
                    _digest(raw[a:b] if same else b" ".join(raw[a:b].split()))
                    for a, b, same in zip(starts[word].tolist(), ends[last].tolist(), plain.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[first + row]), pa.array(body[first + row]), pa.array(start.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(sign, pa.binary())],
                    ["ord", "body", "start", "n", "anchor", "segment"],
                )

    return rows.mapInArrow(cut, "ord long, body long, start int, n int, anchor long, segment binary")


def _extracted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted segments (ord, body, start, n, and columns to keep)."""
    kept = ["anchor", "segment", "shard", "spread"]
    lists = wanted.groupBy("ord", "body").agg(F.collect_list(F.struct("start", "n", *kept)).alias("some"))
    once = rows.select("ord", "body", "text")

    def cut(batches):
        for batch in batches:
            some = batch.column("some").to_pylist()
            order = batch.column("ord").to_pylist()
            out = []
            for first, _, data, offsets in blocks(batch.column("text")):
                starts, ends, counts = bounds(data, offsets)
                for row in range(len(offsets) - 1):
                    for s in some[first + row]:
                        low = counts[row] + s["start"]
                        text = data[starts[low] : ends[low + s["n"] + WINDOW - 2]].tobytes()
                        out.append((order[first + row], s["n"], *(s[c] for c in kept), text))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["first", "n", *kept, "text"])

    kind = "first long, n int, anchor long, segment binary, shard int, spread boolean, text binary"
    return once.join(lists, ["ord", "body"]).select("ord", "text", "some").mapInArrow(cut, kind)


def _search(batches):
    """One shard after the other: per segment the runs of its windows that a smaller id has, and, if spread, all window hashes."""
    held, shard = [], None

    def finish():
        table = pa.Table.from_batches(held)
        first = table.column("first").to_numpy()
        number: dict[bytes, int] = {}
        named = number.setdefault
        texts = [text.split() for text in table.column("text").to_pylist()]
        sizes = table.column("n").to_numpy().astype(np.int64) + WINDOW - 1
        words = np.fromiter((named(w, len(number)) for text in texts for w in text), np.int64, int(sizes.sum()))
        index = FMIndex(words, sizes, WINDOW)
        sequence, start, found = index.windows()
        least = index.least(first)[found]
        order = np.lexsort((start, sequence))
        sequence, start, least = sequence[order], start[order], least[order]
        hit = least < first[sequence]
        edge = np.ones(len(hit), bool)
        edge[1:] = (sequence[1:] != sequence[:-1]) | (hit[1:] != hit[:-1])
        heads = np.flatnonzero(edge)
        length = np.diff(np.append(heads, len(hit)))
        heads, length = heads[hit[heads]], length[hit[heads]]
        runs = [[] for _ in range(len(first))]
        for s, a, n in zip(sequence[heads].tolist(), start[heads].tolist(), length.tolist()):
            runs[s].append({"at": a, "n": n})
        spread = table.column("spread").to_numpy()
        signs = [
            [_digest(b" ".join(text[i : i + WINDOW])) for i in range(len(text) - WINDOW + 1)] if x else [] for text, x in zip(texts, spread)
        ]
        return pa.RecordBatch.from_arrays(
            [table.column("anchor").combine_chunks(), table.column("segment").combine_chunks(), table.column("first").combine_chunks(),
             pa.array(runs, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))), pa.array(signs, pa.list_(pa.binary()))],
            ["anchor", "segment", "first", "runs", "windows"],
        )

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(shards)]):
            if high == low:
                continue
            if shard is not None and shards[low] != shard:
                yield finish()
                held = []
            shard = shards[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield finish()


def matches(rows: DataFrame, crowd: int = CROWD, shard_words: int = SHARD) -> DataFrame:
    """Runs of windows to remove: ord, body, start, n (as windows of that row)."""
    every = stored(_occurrences(rows), "substring-segments")
    # stored, so that the join below reads two plain shuffles and a hot anchor's side can be split
    common = stored(
        every.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b").select("anchor"), "substring-anchors"
    )
    shared = stored(every.join(common, "anchor"), "substring-shared")
    distinct = shared.groupBy("anchor", "segment").agg(
        F.min(F.struct("ord", "body", "start", "n")).alias("at")
    ).select("anchor", "segment", "at.*")
    distinct = stored(distinct, "substring-distinct")
    words = distinct.agg(F.coalesce(F.sum(F.col("n") + WINDOW - 1), F.lit(0))).first()[0]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-words // shard_words), min(parts, words // LEAST_SHARD))
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd)
    salt = F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("segment"), F.ceil(F.col("m") / crowd)))
    placed = distinct.join(crowded, "anchor", "left").withColumns({
        "shard": F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int"), "spread": F.col("m").isNotNull(),
    }).drop("m")
    kind = "anchor long, segment binary, first long, runs array<struct<at:int,n:int>>, windows array<binary>"
    dealt = _extracted(rows, placed).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    found = stored(dealt.mapInArrow(_search, kind), "substring-runs")
    # windows of anchors that lie in several shards
    apart = found.where(F.size("windows") > 0).select("anchor", "segment", "first", F.posexplode("windows").alias("at", "sign"))
    least = apart.groupBy("sign").agg(F.min("first").alias("least"))
    met = apart.join(least, "sign").where("least < first").select("anchor", "segment", "at", F.lit(1).alias("n"))
    inner = found.select("anchor", "segment", F.explode("runs").alias("r")).select("anchor", "segment", "r.at", "r.n").unionByName(met)
    mine = distinct.select("anchor", "segment", F.col("ord").alias("first"))
    # a later row of the same segment loses all of its windows, the first one those found in others
    later = shared.join(mine, ["anchor", "segment"]).where("ord > first").select("ord", "body", "start", "n")
    own = shared.join(mine, ["anchor", "segment"]).where("ord = first").select("anchor", "segment", "ord", "body", "start")
    return later.unionByName(
        own.join(inner, ["anchor", "segment"]).select("ord", "body", (F.col("start") + F.col("at")).cast("int").alias("start"), F.col("n").cast("int").alias("n"))
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, shard_words: int = SHARD,
    texts: bool = False,
) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256; with ``texts`` also the kept words.

    Ids are integers.  A null text has no words.  A row without an id counts as later than all
    others: it loses what any of them has, and no other loses to it.  Rows that
    repeat an id are one document's, none earlier than the other.  Other
    columns are not read.
    """
    rows = _keyed(docs, id_col, text_col)
    runs = matches(rows, crowd, shard_words).groupBy("ord", "body").agg(
        F.array_distinct(F.collect_list(F.struct("start", "n"))).alias("runs")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches):
        for batch in batches:
            runs = batch.column("runs")
            spans = runs.flatten()
            low, size = (spans.field(c).to_numpy() for c in ("start", "n"))
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(runs.value_lengths().to_numpy(zero_copy_only=False)))]).astype(np.int64)
            out = [], [], [], []
            for first, _, data, offsets in blocks(batch.column("text")):
                starts, stops, counts = bounds(data, offsets)
                for row in range(len(offsets) - 1):
                    a, b = counts[row], counts[row + 1]
                    depth = np.zeros(b - a + 1, np.int64)
                    mine = slice(ends[first + row], ends[first + row + 1])
                    np.add.at(depth, low[mine], 1)
                    np.add.at(depth, low[mine] + size[mine] + WINDOW - 1, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    begin, end = starts[a:b][keep], stops[a:b][keep]
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    text = b" ".join(raw.split() if keep.all() else [raw[s:e] for s, e in zip((begin - offsets[row]).tolist(), (end - offsets[row]).tolist())])
                    out[0].append(b - a)
                    out[1].append(b - a - len(begin))
                    out[2].append(hashlib.sha256(text).hexdigest())
                    out[3].append(text if texts else b"")
            columns = [batch.column("id"), *(pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.binary()]))]
            names = [id_col, "n_words", "n_removed", "kept_sha256", "kept"]
            if texts:
                columns[4] = columns[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns[: 4 + texts], names[: 4 + texts])

    joined = rows.join(runs, ["ord", "body"], "left").select("id", "text", "runs")
    return joined.mapInArrow(remove, f"{id_col} {kind}, n_words long, n_removed long, kept_sha256 string{', kept string' if texts else ''}")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, coalesce(js, []) AS js FROM d LEFT JOIN cut USING (doc_id)),
pos AS (
  SELECT k.doc_id, list(k.w[k.j] ORDER BY k.j) AS kw
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM kept) k
  ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.j = k.j GROUP BY k.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kw, ' '), '')) AS kept_sha256
FROM kept LEFT JOIN pos USING (doc_id)
"""
