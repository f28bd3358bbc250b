"""Packing documents into sequences of at most so many tokens, by exact complements.

1. Every document is encoded, closed by an end token, and cut only if it is
   longer than a sequence; the first piece takes the remainder.
2. Pieces are counted by length.  Only these counts, at most one per possible
   length, reach the driver.  There bins are planned for counts, never for
   single pieces: a bin opens with the longest length left, the gap is looked up
   among single lengths, sums of two (kept as an index under the counts at hand)
   and sums of three (a single and an indexed sum of two).  A bin without such
   a complement takes the length that fits best, the longest one, and asks again;
   what is left at the end is packed by best fit alone.  A filling is repeated as
   often as the counts allow.
3. Each piece has a number among the pieces of its length: its number within
   its task plus the counts of the tasks before.  The plan gives ranges of such
   numbers a place, so every piece finds its sequence and offset by itself.

Texts are read once and never shuffled; a length shared by a third of all pieces
is spread like any other.  The plan has at most some ten thousand ranges,
whatever the number of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .wordcodes import coder

#: Tokens of a sequence.
LIMIT = 2048


class _Stock:
    """Counts of lengths, with an index of the sums of two lengths at hand."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64)
        self.sums = np.zeros(2 * len(counts), np.int64)
        for x in np.flatnonzero(self.counts):
            here = np.flatnonzero(self.counts[: x + 1])
            self.sums[x + here] += 1
            self.sums[2 * x] -= self.counts[x] == 1

    def change(self, x: int, by: int) -> None:
        old = int(self.counts[x])
        new = old + by
        if (old > 0) != (new > 0):
            others = np.flatnonzero(self.counts)
            self.sums[x + others[others != x]] += 1 if new else -1
        self.sums[2 * x] += (new > 1) - (old > 1)
        self.counts[x] = new

    def two(self, total: int) -> tuple[int, ...]:
        """Two lengths of this sum, the greater as great as can be."""
        if total >= len(self.sums) or self.sums[total] <= 0:
            return ()
        top = min(total - 1, len(self.counts) - 1)
        x = np.arange(top, (total - 1) // 2, -1)
        good = (self.counts[x] > 0) & (self.counts[total - x] > (x == total - x))
        return (int(x[good.argmax()]), int(total - x[good.argmax()]))

    def three(self, total: int) -> tuple[int, ...]:
        """Three lengths of this sum, the greatest as great as can be."""
        x = np.arange(min(total - 2, len(self.counts) - 1), 0, -1)
        x = x[(self.counts[x] > 0) & (self.sums[total - x] > 0)]
        for first in x.tolist():
            self.counts[first] -= 1
            rest = total - first
            y = np.arange(min(rest - 1, len(self.counts) - 1), (rest - 1) // 2, -1)
            good = (self.counts[y] > 0) & (self.counts[rest - y] > (y == rest - y))
            self.counts[first] += 1
            if good.any():
                second = int(y[good.argmax()])
                return first, second, rest - second
        return ()

    def exact(self, gap: int, most: int) -> tuple[int, ...]:
        """At most so many lengths that fill the gap exactly."""
        if self.counts[gap] > 0:
            return (gap,)
        return (most > 1 and self.two(gap)) or (most > 2 and self.three(gap)) or ()

    def longest(self, most: int) -> int:
        here = np.flatnonzero(self.counts[: most + 1])
        return int(here[-1]) if len(here) else 0


def plan_bins(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``counts[length]`` pieces, none longer than ``len(counts) - 1``: ([(length, times), ...], copies).

    Complements of up to three lengths can use up short pieces that later bins
    miss, so the plan is made with complements of up to three, two and one
    length, and the one with the fewest bins counts.
    """
    return min((_fill(counts, most) for most in (3, 2, 1)), key=lambda bins: sum(copies for _, copies in bins))


def _fill(counts: np.ndarray, most: int) -> list[tuple[list[tuple[int, int]], int]]:
    limit, stock, bins = len(counts) - 1, _Stock(counts), []
    while stock.longest(limit):
        taken, gap = [], limit
        while gap:
            # Without a complement the longest length that fits leaves the least room.
            found = stock.exact(gap, most) or ((longest,) if (longest := stock.longest(gap)) else ())
            if not found:
                break
            for x in found:
                stock.change(x, -1)
            taken += found
            gap -= sum(found)
        need = {x: taken.count(x) for x in taken}
        more = min(int(stock.counts[x]) // times for x, times in need.items())
        for x, times in need.items():
            stock.change(x, -more * times)
        bins.append((sorted(need.items(), reverse=True), 1 + more))
    return bins


def places(bins: list[tuple[list[tuple[int, int]], int]], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of piece numbers: rows (first number, copies, length, first sequence, first offset), and the first number per length."""
    rows, sequence = [], 0
    for content, copies in bins:
        offset = 0
        for x, times in content:
            rows.append((x, times * copies, copies, sequence, offset))
            offset += x * times
        sequence += copies
    rows = np.array(rows, np.int64).reshape(-1, 5)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first = np.cumsum(rows[:, 1]) - rows[:, 1]
    per_length = np.zeros(limit + 1, np.int64)
    np.add.at(per_length, rows[:, 0], rows[:, 1])
    return np.column_stack((first, rows[:, 2], rows[:, 0], rows[:, 3], rows[:, 4])), np.cumsum(per_length) - per_length


def _cut(docs: DataFrame, path: str, id_col: str, text_col: str, limit: int, end_id: int, tokens: bool) -> DataFrame:
    """All pieces with their task and their number among the task's pieces of that length."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        met, task = np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        ids_of = coder(path).ids
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                coded = (ids_of(text) if text else b"") + end
                total = len(coded) // 4
                begin, stop = 0, (total - 1) % limit + 1
                number = 0
                while begin < total:
                    part = coded[4 * begin : 4 * stop]
                    row.append(at), piece.append(number), start.append(begin), length.append(stop - begin)
                    crc.append(zlib.crc32(part))
                    if tokens:
                        ids.append(np.frombuffer(part, "<i4"))
                    begin, stop, number = stop, stop + limit, number + 1
            size = np.array(length, np.int64)
            order = np.argsort(size, kind="stable")
            many = np.bincount(size, minlength=limit + 1)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(np.cumsum(many) - many, many)
            nth += met[size]
            met += many
            arrays = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int64()), pa.array(start, pa.int64()),
                pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), task, np.int64)), pa.array(nth),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if tokens:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, piece long, start long, length long, ids_crc32 long, task long, nth long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if tokens else ""))


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = 0,
    tokens: bool = False,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset; with ``tokens`` also its ids.

    A document is its ids by the tokenizer file ``path`` (on every machine),
    without added special tokens, and then ``end_id``; null and empty texts are
    the end token alone.  Pieces of a sequence follow each other without gaps
    from offset 0.  Rows are packed one by one: repeated ids and rows each get
    pieces, null ids stay null, other columns are not read, an empty table gives
    no row.  Sequence ids run from 0; which equal-length piece goes where is not
    defined.
    """
    pieces = stored(_cut(docs, path, id_col, text_col, limit, end_id, tokens), "pieces")
    by_task = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("many")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(limit + 1, np.int64)
    for length, many in by_task.groupBy("length").agg(F.sum("many")).collect():  # one row per length, so at most ``limit``
        counts[length] = many
    plan, first = places(plan_bins(counts), limit)

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            number = first[size] + rank
            found = plan[np.searchsorted(plan[:, 0], number, "right") - 1]
            layer, copy = np.divmod(number - found[:, 0], found[:, 1])
            places_of = [pa.array(found[:, 3] + copy), pa.array(found[:, 4] + layer * size)]
            kept = [batch.column(k) for k in (*range(5), *range(6, batch.num_columns))]
            yield pa.RecordBatch.from_arrays(kept[:5] + places_of + kept[5:], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * tokens
    # The bases grow with the number of tasks, so they are not to be broadcast.
    ranked = pieces.join(bases.hint("merge"), ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"), *["ids"] * tokens
    )
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema + (", ids array<int>" if tokens else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence: sequence_id, ids, and the start of each piece in it, from ``pack(..., tokens=True)``.

    A sequence is one row of at most ``limit`` tokens, so no group is large.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.offset").alias("starts")
    )


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
