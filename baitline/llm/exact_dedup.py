"""Exact deduplication through an extendible-hash index on shared files.

Texts are equal when they agree byte for byte once ASCII white space is taken
out.  The index is built and probed with DataFrame operations only:

1. Pages.  Rows of equal key *and* equal bytes are folded inside each task, then
   once more by key (``groupBy`` on the normalised text compares the bytes), so
   a text that a third of all rows share travels once per task.  What is stored
   per content is narrow: key, length, digest, count, winner.
2. Directory.  Contents are counted per cell, a prefix of their keys, whose
   length follows from the number of contents.  The directory doubles for as
   long as some bucket holds over ``capacity`` contents; a bucket keeps the
   least depth at which it fits.
3. Owners.  Buckets are ranges of keys.  Each task owns a range, chains the
   contents whose keys collide and writes its part of the index.
4. Probe.  Rows find their bucket in the directory by their cell, and within it
   their content by key, digest and length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: ASCII white space, deleted before texts are compared.
SPACES = "[\\x20\\x09-\\x0D]"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, code points, normalised text and 64-bit key of every row; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(
        F.col(id_col).alias("id"), F.length(text).alias("points"), F.regexp_replace(text, SPACES, "").alias("body")
    )
    return plain.withColumn("key", F.xxhash64("body"))


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per content: key, digest, n_bytes, size, keep_id.

    The row with the most code points stays, then the smallest id; null ids come last.
    """
    folded = keyed(docs, id_col, text_col).groupBy("key", "body", "points").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n")
    )
    narrow = folded.select(
        "key", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("n_bytes"), "points", "id", "n"
    )
    # the least (-points, no id, id): ids need an order only, so texts and structs will do
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("id").isNull().alias("unknown"), "id"))
    return narrow.groupBy("key", "digest", "n_bytes").agg(F.sum("n").alias("size"), best.alias("best")).select(
        "key", "digest", "n_bytes", "size", F.col("best.id").alias("keep_id")
    )


def directory(contents: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """Per cell the bucket that holds it: cell, depth (local), bucket (prefix of that depth)."""
    cells = contents.groupBy(_cell(max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    prefix = F.expr(f"shiftright(cell, {max_depth} - depth)")
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth)))).withColumn("bucket", prefix)
    full = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("load"))
    fits = full.where((F.col("load") <= capacity) | (F.col("depth") == max_depth))
    return (
        levels.join(fits, ["depth", "bucket"]).groupBy("cell")
        .agg(F.min(F.struct("depth", "bucket")).alias("at")).select("cell", "at.depth", "at.bucket")
    )


def _cell(max_depth: int):
    return F.expr(f"shiftrightunsigned(key, {64 - max_depth})")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000
) -> tuple[DataFrame, DataFrame, int]:
    """Directory and index, both stored in the shared folder, and the depth up to which the directory was let double.

    That depth leaves eight cells for each bucket that even keys would need, so
    a bucket still too full there holds keys that hardly differ.  Index rows: bucket, depth, key, chain (place among contents of an equal
    key), digest, n_bytes, size, keep_id.
    """
    contents = stored(pages(docs, id_col, text_col), "dedup-pages")
    max_depth = min(40, max(1, (8 * contents.count() // capacity).bit_length()))
    slots = stored(directory(contents, capacity, max_depth), "dedup-directory")
    owned = (
        contents.withColumn("cell", _cell(max_depth))
        .join(slots, "cell")
        .repartitionByRange("cell", "key")
        .withColumn("chain", F.row_number().over(Window.partitionBy("cell", "key").orderBy("digest", "n_bytes")))
    )
    index = stored(
        owned.select("bucket", "depth", "key", "chain", "digest", "n_bytes", "size", "keep_id"), "dedup-index"
    )
    return slots, index, max_depth


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000
) -> DataFrame:
    """Per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Ids may be of any type with an order.  Null and blank texts are equal to each other.  A row without an id is
    compared like any other and stays only where its whole group has none (the
    group's ``keep_id`` is then null).  Rows that repeat an id with the same
    text are one document: all of them carry the same decision.  Other columns
    are not read; an empty table gives no row.
    """
    slots, index, max_depth = build_index(docs, id_col, text_col, capacity)
    probes = keyed(docs, id_col, text_col).select(
        "id", "key", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("n_bytes")
    )
    aimed = probes.withColumn("cell", _cell(max_depth)).join(slots.select("cell", "bucket"), "cell")
    found = aimed.join(index, ["bucket", "key", "digest", "n_bytes"])
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
"""
