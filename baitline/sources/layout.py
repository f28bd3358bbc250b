"""Layouts that let look-ups and searches open few files.

``write_keyed`` deals a table over files by its key, sorts it there and adds
Parquet Bloom filters, so that a look-up by key reads the row groups that can
hold it.  ``write_postings`` notes which three-letter pieces occur in which
data file, so that a search opens only files that have all pieces of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_keyed(df: DataFrame, path: str, key: str, files: int | None = None, rows_per_file: int = 2_000_000) -> None:
    """Write ``df`` for look-ups by ``key``: dealt by it, sorted, with Bloom filters.

    Reading it is plain ``spark.read.parquet``: an equality on the key skips row
    groups by their bounds and Bloom filters.  Rows of one key share a file, so
    a key of very many rows makes a large file.  ``df`` is counted unless
    ``files`` is given.
    """
    n = files or max(1, -(-df.count() // rows_per_file))
    writer = df.repartition(n, key).sortWithinPartitions(key).write.mode("overwrite")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_file)).parquet(path)


def write_postings(spark: SparkSession, path: str, postings: str, column: str = "url") -> None:
    """Distinct (gram, file) of a folder of Parquet files: every three letters that occur in ``column``, in lower case.

    Pieces are made distinct within each task first, so a text of very many
    rows is one entry.  Files are named by their path; a changed folder needs
    new postings, new files can be noted beside the old (see ``search_files``).
    """
    low = F.lower(column)
    rows = spark.read.parquet(path).select(low.alias("_text"), F.col("_metadata.file_path").alias("file"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text") - 2), lambda i: F.substr("_text", i, F.lit(3))))
    pairs = rows.filter(F.length("_text") > 2).distinct().select("file", F.explode(grams).alias("gram")).distinct()
    pairs.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("overwrite").parquet(postings)


def search_files(spark: SparkSession, postings: str, text: str) -> list[str] | None:
    """Files that can hold ``text`` anywhere in the noted column; None where postings cannot tell.

    That is for texts under three letters and for ``%`` and ``_``, which act as
    wildcards, where a run of letters between them is shorter than three.  The
    files found must each have all pieces.
    """
    runs = [run for run in text.lower().replace("_", "%").split("%") if len(run) > 2]
    wanted = sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})
    if not wanted:
        return None
    met = spark.read.parquet(postings).filter(F.col("gram").isin(wanted)).groupBy("file").agg(F.count_distinct("gram").alias("n"))
    return [r["file"] for r in met.filter(F.col("n") == len(wanted)).collect()]  # at most one entry per data file


def read_candidates(spark: SparkSession, path: str, postings: str, text: str) -> DataFrame:
    """The rows of the files that can hold ``text``; all rows where postings cannot tell.  The caller filters exactly."""
    whole = spark.read.parquet(path)
    files = search_files(spark, postings, text)
    if files is None:
        return whole
    return spark.read.schema(whole.schema).parquet(*files) if files else spark.createDataFrame([], whole.schema)
