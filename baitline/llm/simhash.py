"""SimHash near-duplicates, with candidates pruned on a ring of segments.

A fingerprint is cut into ``SEGMENTS`` segments on a ring.  If two fingerprints
differ in at most ``DISTANCE`` bits, then from some segment on, every run of l
consecutive segments differs in at most l * DISTANCE / SEGMENTS bits.  With
eight segments and three bits the budgets are 0 0 1 1 1 2 2 3, so:

* the first two segments of that run agree, and of the next three at least two;
  these four (32 bits) with the start and the place of the odd one are the key
  of an equi-join: 24 keys for each *distinct* fingerprint;
* a joined pair must keep within all budgets from its start, before the full
  number of differing bits is counted.

Keys that over ``CROWD`` fingerprints share are not joined pair by pair.  Their
members differ in the other 32 bits only; each member x stands for all values
at up to two flips of these, and is tied to the least member y at up to one
flip of such a value.  Every such tie is a link, every link is made of such
ties, and the rows are 529 for each member.  Components are found on distinct
fingerprints.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stored

DISTANCE, SEGMENTS, WIDTH = 3, 8, 8
BUDGETS = [DISTANCE * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
#: Fingerprints with one key above which pairs are not formed.
CROWD = 1000
_SLICE = 50_000


def _bits(data: bytes, size: int, seed: int) -> int:
    """Majority bits over the hashes of all shingles of one text."""
    words = data.lower().split()
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, total, _SLICE):
        part = words[at : at + _SLICE + size - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
        found = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64)
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            counts += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """Id and 64-bit fingerprint (``fp``, as a long) of every row; null and wordless texts get 0."""

    def sign(batches):
        for batch in batches:
            data = batch.column("text").cast(pa.binary())
            marks = (_bits(x.as_py() or b"", size, seed) for x in data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.fromiter(marks, np.int64, len(data)))], ["id", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, f"id {kind}, fp long")


def _turned(value: str, start: str) -> str:
    """``value`` turned on the ring so that segment ``start`` is lowest."""
    return f"(shiftrightunsigned({value}, {WIDTH} * {start}) | shiftleft({value}, 64 - {WIDTH} * {start}))"


def _low(segments: int) -> int:
    return (1 << WIDTH * segments) - 1


def _key_mask(odd: int) -> int:
    return sum(255 << WIDTH * s for s in (0, 1, 2, 3, 4) if s != odd)


def keyed(fps: DataFrame) -> DataFrame:
    """The 24 keys of each fingerprint: start, odd, part (the agreeing bits), fp."""
    places = [(s, o) for s in range(SEGMENTS) for o in (2, 3, 4)]
    place = F.explode(F.array(*(F.struct(F.lit(s).alias("start"), F.lit(o).alias("odd")) for s, o in places)))
    mask = F.expr(f"CASE odd WHEN 2 THEN {_key_mask(2)}L WHEN 3 THEN {_key_mask(3)}L ELSE {_key_mask(4)}L END")
    opened = fps.select("fp", place.alias("place")).select("fp", "place.start", "place.odd")
    return opened.withColumn("part", F.expr(_turned("fp", "start")).bitwiseAND(mask))


def _within() -> Column:
    """Every run from the start keeps within its budget; the last run is the whole ring."""
    out = F.lit(True)
    for n, budget in enumerate(BUDGETS[:-1], 1):
        out = out & (F.bit_count(F.col("turned").bitwiseAND(F.lit(_low(n)))) <= budget)
    return out & (F.bit_count("turned") <= BUDGETS[-1])


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all close pairs."""
    keys = keyed(fps)
    shared = keys.groupBy("start", "odd", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keys.join(shared, ["start", "odd", "part"]), "simhash-keys")
    few = members.where(F.col("n") <= crowd)
    left, right = (few.select("start", "odd", "part", F.col("fp").alias(x)) for x in "ab")
    pairs = left.join(right, ["start", "odd", "part"]).where("a < b").withColumn(
        "turned", F.expr(_turned("(a ^ b)", "start"))
    )
    near = pairs.where(_within()).select("a", "b").distinct()
    return near.unionByName(_crowded(members.where(F.col("n") > crowd)))


def _crowded(members: DataFrame) -> DataFrame:
    """Ties of the members of large keys, each to the least member near the same value."""
    free = {o: [p for p in range(64) if not _key_mask(o) >> p & 1] for o in (2, 3, 4)}

    def flips(odd: int) -> str:
        some = [0, *(1 << p for p in free[odd]), *(1 << p | 1 << q for p, q in combinations(free[odd], 2))]
        return "array(" + ", ".join(f"{x - (1 << 64) if x >> 63 else x}L" for x in some) + ")"

    opened = None
    for odd in (2, 3, 4):
        part = members.where(F.col("odd") == odd).select(
            "start", "odd", "part", "fp", F.expr(f"explode({flips(odd).replace('-9223372036854775808L', '(-9223372036854775807L - 1L)')})").alias("flip")
        )
        opened = part if opened is None else opened.unionByName(part)
    met = opened.withColumn("value", F.expr(_turned("fp", "start")).bitwiseXOR(F.col("flip"))).drop("part", "flip").withColumn(
        "near", F.bit_count(F.expr(_turned("fp", "start")).bitwiseXOR(F.col("value"))) <= 1
    )
    hubs = met.where("near").groupBy("start", "odd", "value").agg(F.min("fp").alias("hub"))
    return met.join(hubs, ["start", "odd", "value"]).where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, crowd: int = CROWD
) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null and wordless texts have fingerprint zero and are linked like any other.
    Repeated ids and rows give a row each.  A null id stays null; it takes its
    component's smallest id, null if there is none.  Other columns are not read.
    """
    signed = stored(fingerprints(docs, id_col, text_col, size, seed), "simhash")
    known = signed.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(known.select("fp"), crowd))
    grouped = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return signed.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
