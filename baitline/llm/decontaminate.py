"""Benchmark decontamination by size-partitioned MinHash containment search.

An item (a short test text) contaminates a document when at least ``SHARE`` of
its five-word shingles occur in the document.  Documents are far larger than
items, so their similarity as sets says nothing; documents are therefore
partitioned by size and every partition gets its own sketch:

* one-permutation MinHash: the hash space is cut into bins, a set is sketched by
  the least hash of each bin.  A partition of up to u shingles has 2 u bins, so
  that an item's shingle is a document's least hash with probability above 3/4,
  however long the document.  An item and a document that share a least hash in
  any bin are candidates.
* an item of fewer than ``SMALL`` shingles could be missed that way; for those
  every shingle is a bin of its own.
* each candidate is then verified by exact containment over the texts of the
  shingles.

The document side is one narrow pass.  It sends out only what hits a bitmap of
fixed size (``BITMAP`` bits) of the items' shingles, which is the one thing
broadcast; the search itself is an equi-join on sketch values, and grows with
the documents and with the items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import LOWER, NOT_WORD, blocks, bounds, hashes, shingles

SIZE, SHARE = 5, 0.8
#: Items below so many shingles are searched without thinning.
SMALL = 10
#: Bits of the bitmap (a power of two): one megabyte.
BITMAP = 1 << 23
#: Size partitions double from this many shingles on.
FIRST = 64
_U = np.uint64


def size_class(n: int) -> int:
    """Number of the size partition of a set of ``n`` shingles: up to FIRST, 2 FIRST, 4 FIRST ..."""
    return max(0, int(max(n, 1) - 1).bit_length() - FIRST.bit_length() + 1)


def bins_shift(part: int) -> np.uint64:
    """Bits to drop from a hash to get its bin among 2 * FIRST * 2 ** part."""
    return _U(64 - (FIRST.bit_length() + part))


def minima(found: np.ndarray, part: int) -> np.ndarray:
    """Least hash of each bin of a sorted array of distinct hashes."""
    bins = found >> bins_shift(part)
    keep = np.ones(len(found), bool)
    keep[1:] = bins[1:] != bins[:-1]
    return found[keep]


def _word_lists(column: pa.Array):
    """Per row: bytes, starts, ends and hashes of its words (lower case, letters and digits)."""
    for _, _, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, counts = bounds(data, offsets, NOT_WORD)
        marks = hashes(data, starts, ends)
        for row in range(len(offsets) - 1):
            at = slice(counts[row], counts[row + 1])
            yield data, starts[at], ends[at], marks[at]


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[at : at + size], ends[at : at + size]))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per item: item, width (words of its shingles), q (their number), hash and text of each distinct one.

    An item of fewer words than ``size`` has one shingle, its whole text; one
    without words has none and matches nothing.
    """
    kind = items.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows = []
            for item, (data, starts, ends, marks) in zip(batch.column("item").to_pylist(), _word_lists(batch.column("text"))):
                width = min(size, len(marks))
                if width and item is not None:
                    found, first = np.unique(shingles(marks, width), return_index=True)
                    rows += [
                        (item, width, len(found), int(h), _text(data, starts, ends, i, width))
                        for h, i in zip(found.view(np.int64), first)
                    ]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [batch.schema.field("item").type, pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "width", "q", "hash", "shingle"]
            )

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).dropDuplicates()
    return rows.mapInArrow(cut, f"item {kind}, width int, q int, hash long, shingle binary")


def _bitmap(found: DataFrame) -> np.ndarray:
    """The items' hashes as a bitmap of fixed size; Spark gathers 64-bit words of it."""
    place = F.expr(f"hash & {BITMAP - 1}L")
    words = found.select(F.shiftright(place, 6).alias("slot"), F.expr(f"shiftleft(1L, CAST(hash & 63L AS INT))").alias("bit"))
    out = np.zeros(BITMAP >> 6, np.int64)
    for slot, bits in words.groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect():
        out[slot] = bits
    return out.view(_U)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", size: int = SIZE, share: float = SHARE,
) -> DataFrame:
    """One row per document and item found in it: id, item, n_item, n_shared, containment.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased,
    so that spacing, punctuation and case do not hide a copy.  Null and wordless
    texts contain nothing.  Rows without an id, on either side, are left out.
    A repeated document row counts once, texts of rows that repeat an id are
    taken together.  Other columns are not read.
    """
    found = stored(item_shingles(items, item_col, item_text, size), "benchmark-shingles")
    bitmap = _bitmap(found)
    widths = sorted(r[0] for r in found.select("width").distinct().collect())
    kind = docs.schema[id_col].dataType.simpleString()

    def search(batches):
        for batch in batches:
            ids, parts, kinds, values, seen = [], [], [], [], []
            id_column = batch.column("id").to_pylist()
            for row, (data, starts, ends, marks) in zip(id_column, _word_lists(batch.column("text"))):
                for width in widths:
                    every = shingles(marks, width)
                    bit = every & _U(BITMAP - 1)
                    hit = np.flatnonzero(bitmap[bit >> _U(6)] >> (bit & _U(63)) & _U(1))
                    if row is None or not len(hit):
                        continue
                    every_sorted = np.unique(every)
                    part = size_class(len(every_sorted))
                    least = minima(every_sorted, part)
                    hashed, first = np.unique(every[hit], return_index=True)
                    ids.append(row)
                    parts.append(part)
                    kinds.append(width)
                    sketched = np.isin(hashed, least, assume_unique=True)
                    values.append([(int(h), bool(m)) for h, m in zip(hashed.view(np.int64), sketched)])
                    seen.append([_text(data, starts, ends, i, width) for i in hit[first]])
            value = pa.list_(pa.struct([("hash", pa.int64()), ("least", pa.bool_())]))
            values = [[{"hash": h, "least": m} for h, m in row] for row in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("id").type), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()),
                 pa.array(values, value), pa.array(seen, pa.list_(pa.binary()))],
                ["id", "width", "part", "sketch", "seen"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = stored(
        rows.mapInArrow(
            search, f"id {kind}, width int, part int, sketch array<struct<hash:long,least:boolean>>, seen array<binary>"
        ), "benchmark-hits",
    )
    return _verified(hits, found, share).withColumnsRenamed({"id": id_col, "item": item_col})


def _item_sketches(found: DataFrame, parts: list[int]) -> DataFrame:
    """Sketch values of the items for each size partition in use: part, width, hash, item; small items whole."""
    shifts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(int(bins_shift(p))).alias("drop")) for p in parts)))
    spread = found.withColumn("at", shifts).select("item", "width", "q", "hash", "at.part", F.expr("shiftrightunsigned(hash, at.drop)").alias("bin"))
    # hashes are unsigned: flipping the top bit gives their order to signed longs
    order = F.expr("hash ^ (-9223372036854775807L - 1L)")
    least = spread.where(f"q >= {SMALL}").groupBy("item", "width", "part", "bin").agg(F.min_by("hash", order).alias("hash"))
    columns = ["part", "width", "hash", "item"]
    return least.select(*columns, F.lit(True).alias("thin")).unionByName(
        spread.where(f"q < {SMALL}").select(*columns, F.lit(False).alias("thin"))
    )


def _verified(hits: DataFrame, found: DataFrame, share: float) -> DataFrame:
    parts = sorted(r[0] for r in hits.select("part").distinct().collect())
    sizes = found.groupBy("item", "width").agg(F.first("q").alias("n_item"), F.collect_list("shingle").alias("wanted"))
    if not parts:
        parts = [0]
    values = hits.select("id", "width", "part", F.explode("sketch").alias("s")).select("id", "width", "part", "s.hash", "s.least")
    met = values.join(_item_sketches(found, parts), ["part", "width", "hash"]).where("least OR NOT thin")
    candidates = met.select("id", "width", "item").distinct()
    shown = hits.groupBy("id", "width").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    shared = candidates.join(shown, ["id", "width"]).join(sizes, ["item", "width"]).select(
        "id", "item", "n_item", F.size(F.array_intersect("seen", "wanted")).alias("n_shared")
    )
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= share)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _shingle_sql(table: str, key: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
  SELECT {key}, w, len(w) AS n FROM (
    SELECT {key}, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL) WHERE len(w) > 0"""


OP1_SQL = f"""
WITH b AS ({_shingle_sql('benchmark', 'item_id')}),
bs AS (
  SELECT DISTINCT item_id, least(n, {SIZE}) AS width,
         array_to_string(w[i : i + least(n, {SIZE}) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, n - least(n, {SIZE}) + 2)) AS i FROM b)),
widths AS (SELECT DISTINCT width FROM bs),
ds AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT d.doc_id, d.w, x.width, unnest(range(1, d.n - x.width + 2)) AS i
        FROM ({_shingle_sql('documents', 'doc_id')}) d, widths x)),
q AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS INT) AS n_item, CAST(n_shared AS INT) AS n_shared, n_shared / n_item AS containment
FROM m JOIN q USING (item_id) WHERE n_shared / n_item >= {SHARE}
"""
