"""Look-ups, top lists and per-key windows over stored tables.

Filters are plain predicates on stored columns so that they reach the Parquet
reader; ``orderBy().limit()`` becomes a top-k per task and never a full sort.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.keys import first_per_key, top_per_key
from .match import join_range_dates


def _equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _newest(df: DataFrame, time: str, key: str, limit: int | None, offset: int = 0) -> DataFrame:
    """Newest rows first; all of them without a limit."""
    if (limit is not None and limit < 1) or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    ordered = df.orderBy(F.desc(time), F.desc(key))
    rest = ordered.offset(offset) if offset else ordered
    return rest if limit is None else rest.limit(limit)


def top_recent_scans(
    scans: DataFrame, limit: int | None = None, offset: int = 0, verdict: str | None = None, severity: str | None = None
) -> DataFrame:
    return _newest(_equal(scans, verdict=verdict, severity=severity), "created_at", "scan_id", limit, offset)


def _like(column: str, text: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` in the text act as wildcards, a backslash as itself."""
    escaped = text.lower().replace("\\", "\\\\")
    return F.lower(column).like(f"%{escaped}%")


def top_search_scans(scans: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return _newest(scans.filter(_like("url", text)), "created_at", "scan_id", limit)


def top_scans_filtered(
    scans: DataFrame,
    start: str | None = None,
    end: str | None = None,
    verdict: str | None = None,
    severity: str | None = None,
    text: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    rows = _equal(scans, verdict=verdict, severity=severity)
    if start is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("created_at") < F.lit(end).cast("timestamp_ntz"))
    if text is not None:
        rows = rows.filter(_like("url", text))
    return _newest(rows, "created_at", "scan_id", limit)


def top_indicators(
    indicators: DataFrame,
    source: str | None = None,
    threat_type: str | None = None,
    since: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    rows = _equal(indicators, source=source, threat_type=threat_type)
    if since is not None:
        rows = rows.filter(F.col("last_seen") >= F.lit(since).cast("timestamp_ntz"))
    return _newest(rows, "last_seen", "id", limit)


def top_recent_phish(entries: DataFrame, limit: int | None = None, include_offline: bool = False) -> DataFrame:
    rows = entries if include_offline else entries.filter(F.col("online") == "yes")
    return _newest(rows, "submission_time", "phish_id", limit)


def top_phish_by_target(entries: DataFrame, target: str, limit: int | None = None, verified_only: bool = True) -> DataFrame:
    wanted = (target or "").strip().lower()
    if not wanted:
        raise ValueError("Target parameter is required")
    rows = entries.filter(F.lower("target").contains(wanted))
    if verified_only:
        rows = rows.filter(F.col("verified") == "yes")
    return _newest(rows, "submission_time", "phish_id", limit)


def top_phish_by_date(entries: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    try:
        first, last = date.fromisoformat(start), date.fromisoformat(end)
    except (TypeError, ValueError) as error:
        raise ValueError("Invalid date format. Use YYYY-MM-DD") from error
    if first > last:
        raise ValueError("Start date must be before end date")
    return _newest(join_range_dates(entries, start, end), "submission_time", "phish_id", limit)


def get_scan(scans: DataFrame, scan_id: int) -> DataFrame:
    return scans.filter(F.col("scan_id") == scan_id).limit(1)


def get_indicator(indicators: DataFrame, url: str, source: str | None = None) -> DataFrame:
    """The most recently seen indicator of a URL."""
    return _newest(_equal(indicators, url=url, source=source), "last_seen", "id", 1)


def get_phish(entries: DataFrame, phish_id: int | DataFrame) -> DataFrame:
    """The entry of an id, or those of a table of ids (column phish_id)."""
    if isinstance(phish_id, DataFrame):
        return entries.join(phish_id.select("phish_id").distinct(), "phish_id", "left_semi")
    return entries.filter(F.col("phish_id") == phish_id).limit(1)


def check_url_list(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Each requested URL against the phish table, with a summary sentence.

    A URL entered several times counts as verified if any entry is; the lowest
    such id is named.  Entries shrink to one row per URL before the join.
    """
    known = entries.groupBy("url").agg(
        F.max(F.col("verified") == "yes").alias("verified"),
        F.min(F.struct((F.col("verified") != "yes").alias("later"), "phish_id")).alias("_first"),
    ).select("url", "verified", F.col("_first.phish_id").alias("phish_id"))
    url = F.trim("url")
    asked = requests.withColumn("url", url).withColumn("valid", U.is_absolute(F.col("url")))
    joined = asked.join(known, "url", "left")
    found = F.col("phish_id").isNotNull()
    number = F.col("phish_id").cast("string")
    summary = (
        F.when(F.col("url") == "", "URL parameter is required")
        .when(~F.col("valid"), "Invalid URL format. Must include protocol (http:// or https://)")
        .when(~found, "URL not found in PhishTank database (likely safe)")
        .when(F.col("verified"), F.concat(F.lit("PHISHING DETECTED - Verified phishing URL (ID: "), number, F.lit(")")))
        .otherwise(F.concat(F.lit("URL found in database but not yet verified (ID: "), number, F.lit(")")))
    )
    return joined.select(
        *requests.columns,
        F.col("valid").alias("success"),
        (F.col("valid") & found).alias("in_database"),
        (F.col("valid") & F.coalesce("verified", F.lit(False))).alias("verified"),
        F.when(F.col("valid"), F.col("phish_id")).alias("phish_id"),
        summary.alias("summary"),
    )


def check_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def win_latest_scan(scans: DataFrame) -> DataFrame:
    """Most recent scan of each URL."""
    return first_per_key(scans, ["url"], [F.desc("created_at"), F.desc("scan_id")])


def win_first_by_url(indicators: DataFrame) -> DataFrame:
    """First indicator of each URL."""
    return first_per_key(indicators, ["url"], [F.col("first_seen"), F.col("id")])


def win_top_per_source(indicators: DataFrame, n: int = 100, order: str = "id") -> DataFrame:
    return top_per_key(indicators, ["source"], [F.col(order)], n)
