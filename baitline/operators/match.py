"""Matching URL tables against feeds, reports and caches.

A URL matches a feed entry when the entry is one of its variants (scheme
swapped, trailing slash toggled).  All variants share ``match_key``, so the
join is an equi-join at one row per URL, and the exact test runs as its
residual condition.  URL tables repeat hot URLs: they are made distinct first,
which Spark does within each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, urls as U


def _entries(indicators: DataFrame, *extra: str) -> DataFrame:
    """Distinct feed entries with their key; feeds repeat entries as well."""
    columns = [F.col("url").alias("_entry"), U.match_key(F.col("url")).alias("_key"), *extra]
    return indicators.filter(F.coalesce("url", F.lit("")) != "").select(*columns).distinct()


def _keyed(urls: DataFrame) -> DataFrame:
    return urls.select("url").filter(F.col("url").isNotNull()).distinct().withColumn("_key", U.match_key(F.col("url")))


def _is_variant(urls: DataFrame, entries: DataFrame) -> Column:
    return (urls["_key"] == entries["_key"]) & F.array_contains(U.variants(urls["url"]), entries["_entry"])


def join_known_threat(urls: DataFrame, indicators: DataFrame) -> DataFrame:
    """Distinct URLs listed in a feed under any variant."""
    left, right = _keyed(urls), _entries(indicators)
    return left.join(right, _is_variant(left, right), "left_semi").select("url")


def join_unseen_urls(urls: DataFrame, indicators: DataFrame) -> DataFrame:
    """Distinct URLs listed in no feed."""
    left, right = _keyed(urls), _entries(indicators)
    return left.join(right, _is_variant(left, right), "left_anti").select("url")


def join_matched_variant(urls: DataFrame, indicators: DataFrame) -> DataFrame:
    """Known URLs with the first variant that matched, NULL for the URL itself.

    A URL has at most four variants, so its group is at most four entries.
    """
    left, right = _keyed(urls), _entries(indicators)
    place = F.array_position(U.variants(left["url"]), right["_entry"])
    hits = left.join(right, _is_variant(left, right)).select(left["url"], "_entry", place.alias("_place"))
    return hits.groupBy("url").agg(F.min(F.struct("_place", "_entry")).alias("_first")).select(
        "url", F.when(F.col("_first._entry") != F.col("url"), F.col("_first._entry")).alias("matched_variant")
    )


def source_ordinal(source: Column, order: list[str] = fixed.FEED_ORDER) -> Column:
    """Place of a feed in the fixed order; unknown feeds come last."""
    place = F.array_position(U.word_array(order), source)
    return F.when(place == 0, len(order) + 1).otherwise(place).cast("int")


def feed_hits(urls: DataFrame, indicators: DataFrame) -> DataFrame:
    """(url, source, threat_type, target_brand) of each URL and feed that lists it under any variant.

    indicators: url, source and, when present, threat_type, target_brand.
    First the entries are reduced to one row per (URL, feed); after that a URL
    has at most as many rows as there are feeds.
    """
    entries = indicators
    for column in ("threat_type", "target_brand"):
        if column not in entries.columns:
            entries = entries.withColumn(column, F.lit(None).cast("string"))
    left = _keyed(urls)
    right = (
        entries.filter(F.coalesce("url", F.lit("")) != "")
        .groupBy(F.col("url").alias("_entry"), "source")
        .agg(
            F.min(F.when(F.col("threat_type") != "", F.col("threat_type"))).alias("threat_type"),
            F.max(F.when(F.col("target_brand") != "", F.col("target_brand"))).alias("target_brand"),
        )
        .withColumn("_key", U.match_key(F.col("_entry")))
    )
    hits = left.join(right, _is_variant(left, right)).select(left["url"], "source", "threat_type", "target_brand")
    return hits.groupBy("url", "source").agg(
        F.min("threat_type").alias("threat_type"), F.max("target_brand").alias("target_brand")
    )


def report_hits(found: DataFrame, source: str) -> DataFrame:
    """Result of a stored-report job (one row per URL that it flags) as hits with details."""
    rest = [c for c in found.columns if c not in ("url", "threat_type")]
    kind = F.col("threat_type") if "threat_type" in found.columns else F.lit(None).cast("string")
    return found.select(
        "url", F.lit(source).alias("source"), kind.alias("threat_type"), F.lit(None).cast("string").alias("target_brand"),
        F.to_json(F.struct(*rest)).alias("details"),
    )


def mention_hits(urls: DataFrame, mentions: DataFrame, source: str = "reddit") -> DataFrame:
    """URLs whose domain posts report (see ``posts.post_mentions``) as hits with details."""
    asked = _keyed(urls).select("url", U.page_domain(F.col("url")).alias("domain"))
    return report_hits(asked.join(mentions, "domain").drop("domain"), source)


def join_hits_verdict(hits: DataFrame) -> DataFrame:
    """One row per URL with what its sources say, in source order.

    hits: url, source, threat_type, target_brand and, when present, details; one
    row per URL and source.
    """
    if "details" not in hits.columns:
        hits = hits.withColumn("details", F.lit(None).cast("string"))
    placed = hits.withColumn("_place", source_ordinal(F.col("source")))
    return (
        placed.groupBy("url")
        .agg(
            F.array_sort(F.collect_list(F.struct("_place", "source", "details"))).alias("_found"),
            F.min(F.when(F.col("threat_type").isNotNull(), F.struct("_place", "source", "threat_type"))).alias("_type"),
            F.max(F.when(F.col("target_brand").isNotNull(), F.struct("_place", "source", "target_brand"))).alias("_brand"),
        )
        .select(
            "url",
            F.lit(True).alias("is_known_threat"),
            F.col("_found.source").alias("sources"),
            F.col("_type.threat_type").alias("threat_type"),
            F.col("_brand.target_brand").alias("target_brand"),
            F.lit("phishing").alias("verdict"),
            F.lit(0.98).alias("confidence"),
            F.transform(F.col("_found.source"), lambda s: F.concat(F.lit("known_threat:"), s)).alias("matched_rules"),
            F.transform("_found", lambda f: F.struct(f["source"].alias("source"), f["details"].alias("details"))).alias("details"),
        )
    )


def join_feed_verdict(urls: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row per known URL with what the feeds say, in feed order."""
    return join_hits_verdict(feed_hits(urls, indicators)).drop("details")


def check_all_sources(urls: DataFrame, indicators: DataFrame, *reports: DataFrame) -> DataFrame:
    """Feeds, stored vendor reports and posts in one verdict per URL, with the details of each source.

    ``reports`` are hits by exact URL (``report_hits``, ``mention_hits``); a
    source that both a feed and a report give counts once, with the feed's type.
    The result is what ``verdict.with_feed_verdict`` takes.
    """
    said = F.to_json(F.struct("threat_type", "target_brand"))
    hits = feed_hits(urls, indicators).withColumn("details", said).withColumn("_rank", F.lit(0))
    asked = _keyed(urls).select("url")
    for rank, report in enumerate(reports, 1):
        hits = hits.unionByName(report.join(asked, "url", "left_semi").withColumn("_rank", F.lit(rank)))
    fields = ("threat_type", "target_brand", "details")
    first = hits.groupBy("url", "source").agg(F.min(F.struct("_rank", *fields)).alias("_first"))
    return join_hits_verdict(first.select("url", "source", *[F.col(f"_first.{c}").alias(c) for c in fields]))


def join_vendor_report(urls: DataFrame, reports: DataFrame) -> DataFrame:
    """URLs with their stored report; reports: (report_key, report)."""
    keyed = urls.withColumn("report_key", U.report_key(F.col("url")))
    return keyed.join(reports, "report_key", "left")


def join_cache_lookup(requests: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Cached explanation of each request, if it has not expired at ``as_of``."""
    live = cache.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
    found = requests.join(live.withColumn("_hit", F.lit(True)), "cache_key", "left")
    return found.withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def join_scan_indicator(scans: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per scanned URL: when and where feeds listed it, and the lead time.

    Both sides shrink to one row per URL before they meet.
    """
    first_scan = scans.groupBy("url").agg(F.min("created_at").alias("first_scan"), F.count("*").alias("scans"))
    listed = indicators.groupBy("url").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )
    lead = F.unix_micros(F.col("first_scan").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))
    return first_scan.join(listed, "url").withColumn("lead_seconds", F.floor(lead / 1000000).cast("long"))


def join_range_dates(entries: DataFrame, start: str, end: str, time: str = "submission_time") -> DataFrame:
    """Entries from the start of day ``start`` to the end of day ``end``."""
    first = F.lit(f"{start} 00:00:00").cast("timestamp_ntz")
    after = (F.lit(f"{end} 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return entries.filter((F.col(time) >= first) & (F.col(time) < after))
