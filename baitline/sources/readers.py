"""Readers of landed feed files, corpora and pasted lists.

Every reader takes a path Spark can list (a file, a folder or a glob) and
returns a lazy DataFrame with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed, urls as U
from ..operators.suffix import suffix_rules

PHISHTANK_SCHEMA = T.StructType([
    T.StructField("phish_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("phish_detail_url", T.StringType()),
    T.StructField("submission_time", T.StringType()),
    T.StructField("verified", T.StringType()),
    T.StructField("verification_time", T.StringType()),
    T.StructField("online", T.StringType()),
    T.StructField("target", T.StringType()),
])
URLHAUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("url_status", T.StringType()),
    T.StructField("date_added", T.StringType()),
    T.StructField("threat", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("urlhaus_link", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("reporter", T.StringType()),
])
POST_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("num_comments", T.IntegerType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("author", T.StringType()),
])
TRAINING_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
])


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def src_line_feed(
    spark: SparkSession, path: str, source: str, threat_type: str, limit: int | None = None
) -> DataFrame:
    """One URL per line; only the URLhaus dump has ``#`` comment lines."""
    lines = spark.read.text(path)
    keep = F.trim("value") != ""
    if source == "urlhaus":
        keep = keep & ~F.col("value").startswith("#")
    rows = lines.filter(keep).select(
        F.trim("value").alias("url"), F.lit(source).alias("source"), F.lit(threat_type).alias("threat_type")
    )
    return _first(rows, limit)


def src_phishtank_csv(
    spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV dump with a header; rows without a URL are dropped, empty fields are NULL.

    A file is split among tasks unless ``multi_line`` allows line feeds in fields.
    """
    rows = (
        spark.read.schema(PHISHTANK_SCHEMA)
        .option("header", True).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", False)
        .csv(path)
    )
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns]
    return _first(rows.select(*fields).filter(F.col("url").isNotNull()), limit)


def src_phishtank_json(
    spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True
) -> DataFrame:
    """JSON arrays of entries: one array per file, or per line without ``multi_line``.

    A file with one array cannot be split; land large dumps one array per line.
    """
    return _first(spark.read.schema(PHISHTANK_SCHEMA).option("multiLine", multi_line).json(path), limit)


def src_urlhaus_json(
    spark: SparkSession, path: str, tag: str | None = None, limit: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Envelopes ``{"urls": [...]}`` to rows, optionally only those with ``tag``."""
    envelope = T.StructType([T.StructField("urls", T.ArrayType(URLHAUS_SCHEMA))])
    rows = (
        spark.read.schema(envelope).option("multiLine", multi_line).json(path)
        .select(F.explode("urls").alias("row")).select("row.*")
    )
    if tag is not None:
        rows = rows.filter(F.array_contains("tags", tag))
    return _first(rows, limit)


def src_posts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Community posts, one JSON object per line."""
    return _first(spark.read.schema(POST_SCHEMA).json(path), limit)


def src_labeled_csv(
    spark: SparkSession,
    path: str,
    label_hints: tuple[str, ...] = ("label", "class", "status"),
    malicious: list[str] = fixed.LABELS_MALICIOUS,
    benign: list[str] = fixed.LABELS_BENIGN,
) -> DataFrame:
    """Labelled corpus with discovered columns; (url, label) with label 1 or 0.

    The URL column is the first whose name contains ``url``, the label column
    the first whose name contains one of ``label_hints``.  Rows with another
    label word are dropped.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    names = [(c, c.lower().strip()) for c in raw.columns]
    url_col = next((c for c, n in names if "url" in n), None)
    label_col = next((c for c, n in names if any(h in n for h in label_hints)), None)
    if url_col is None or label_col is None:
        raise ValueError(f"no URL or label column among {raw.columns}")
    url, word = F.trim(raw[url_col]), F.lower(F.trim(raw[label_col]))
    label = F.when(word.isin(malicious), 1).when(word.isin(benign), 0)
    return (
        raw.select(url.alias("url"), label.alias("label"))
        .filter((F.col("url") != "") & (F.col("url") != "nan") & F.col("label").isNotNull())
        .withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url")))
    )


def src_ranked_domains(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """``rank,domain`` lines; the first ``n`` ranks with a domain."""
    rows = (
        spark.read.schema("rank BIGINT, domain STRING").csv(path)
        .select("rank", F.trim("domain").alias("domain"))
        .filter(F.col("domain") != "")
    )
    return rows if n is None else rows.filter(F.col("rank") <= n)


def src_training_json(spark: SparkSession, path: str) -> DataFrame:
    """``[{url, label, source}]`` as an array per file or one object per line."""
    return spark.read.schema(TRAINING_SCHEMA).json(path)


def src_url_batch(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Pasted list: (position, url, is_valid); with ``cap`` only the first lines, in order.

    Invalid lines are kept and flagged so that the caller can show them.
    """
    text = F.trim("value")
    valid = (
        F.col("line").rlike(r"(?i)^https?://")
        | F.col("line").rlike(r"^\d{1,3}(\.\d{1,3}){3}")
        | F.col("line").rlike(r"(?i)^[\w.-]+\.[a-z]{2,}(/|$)")
    )
    rows = (
        spark.read.text(path)
        .select(F.monotonically_increasing_id().alias("position"), text.alias("line"))
        .filter(F.col("line") != "")
        .select(
            "position",
            F.when(F.col("line").startswith("http") | ~valid, F.col("line"))
            .otherwise(F.concat(F.lit("https://"), "line")).alias("url"),
            valid.alias("is_valid"),
        )
    )
    return rows if cap is None else rows.orderBy("position").limit(cap)


def src_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """A public-suffix rule file as the table that ``operators.suffix`` joins: (ending, extra)."""
    return suffix_rules(spark.read.text(path))
