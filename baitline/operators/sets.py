"""Set operations on feeds and caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def set_union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all feeds, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def set_union_distinct(*parts: DataFrame) -> DataFrame:
    """Distinct URLs of all feeds."""
    return reduce(DataFrame.unionByName, [p.select("url") for p in parts]).distinct()


def set_feed_overlap(indicators: DataFrame) -> DataFrame:
    """For each two feeds, the URLs both list.

    URLs are first reduced to the set of feeds that list them and counted per
    set; pairs are then formed on those few sets, not on the URLs.
    """
    feeds = indicators.groupBy("url").agg(F.sort_array(F.collect_set("source")).alias("feeds"))
    per_set = feeds.groupBy("feeds").agg(F.count("*").alias("n")).filter(F.size("feeds") > 1)
    left = per_set.select("feeds", "n", F.posexplode("feeds").alias("i", "source_a"))
    pairs = left.select("source_a", "n", F.explode(F.slice("feeds", F.col("i") + 2, F.size("feeds"))).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.sum("n").alias("shared_urls"))


def set_expired(cache: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(cache without its expired rows, number of rows removed)."""
    at = F.lit(as_of).cast("timestamp_ntz")
    kept = cache.filter(F.col("expires_at") >= at)
    removed = cache.filter(F.col("expires_at") < at).agg(F.count("*").alias("removed"))
    return kept, removed
