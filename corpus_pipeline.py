"""From raw documents to token counts, stage by stage.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame.  Each result is written as Parquet to the shared
folder and read again as the next stage's documents.  All stages but the last
return the columns of their input, so a document is kept whole or not at all.

Stages decide row by row: operators run on a private key of each row that
orders rows as ``doc_id`` does, rows without an id last.  So null and repeated
ids hide no copy and take no other row along; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm.bpe import encode
from baitline.llm.decontaminate import contaminated
from baitline.llm.exact_dedup import exact_dedup
from baitline.llm.language import keep_identified, train
from baitline.llm.simhash import near_duplicates
from baitline.llm.store import row_keyed, stored


def _of(keyed: DataFrame, key: str, chosen: DataFrame, how: str) -> DataFrame:
    """Rows whose key is (or is not) among the chosen, without the key."""
    return keyed.join(chosen.select(key).distinct(), key, how).drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go.

    Without a labelled row no language can be learned; then those without any letter go all the same.
    """
    return keep_identified(docs, train(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one of most code points, then least id, then first in its file."""
    keyed, key = row_keyed(docs, "doc_id")
    return _of(keyed, key, exact_dedup(keyed, key).where("kept"), "left_semi").select(docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id (then first in its file) of each component of close fingerprints."""
    keyed, key = row_keyed(docs, "doc_id")
    first = near_duplicates(keyed, key).where(F.col(key) == F.col("component_id"))
    return _of(keyed, key, first, "left_semi").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is contained."""
    keyed, key = row_keyed(docs, "doc_id")
    found = contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _of(keyed, key, found, "left_anti").select(docs.columns)


def byte_pair_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicate_groups),
    ("decontamination", benchmark_decontamination),
    ("byte_bpe", byte_pair_encoding),
]

#: Language identification is a trained model and encoding a merge loop: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
