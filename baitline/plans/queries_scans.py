"""Queries over scan history, indicators, phish entries, caches and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..operators import feeds, history, match, posts, sets, stats
from ..sources import layout
from .session import scratch_path
from .registry import AS_OF, query
from .views import Tables

_AT = f"TIMESTAMP '{AS_OF}'"
_SCAN = "scan_id, url, verdict, confidence, severity, target_brand, user_id, created_at"
_INDICATOR = "id, url, source, threat_type, first_seen, last_seen, confidence"
_PHISH = "phish_id, url, submission_time, verified, online, target"


def _scans(t: Tables) -> DataFrame:
    return t.scan_history


def _indicators(t: Tables) -> DataFrame:
    return t.threat_indicators_raw.select(*_INDICATOR.split(", "))


# --- aggregations ------------------------------------------------------------

@query("agg_summary", f"""
SELECT count(*) AS total_scans, count(*) FILTER (verdict = 'phishing') AS phishing_detected,
 count(*) FILTER (verdict = 'safe') AS safe_urls, count(*) FILTER (verdict = 'suspicious') AS suspicious,
 round(coalesce(avg(confidence), 0.0), 6) AS avg_confidence, 7 AS period_days
FROM scan_history WHERE created_at >= {_AT} - INTERVAL 7 DAY""")
def _(t):
    return stats.agg_summary(_scans(t), AS_OF).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("agg_verdict_dist", f"""
WITH r AS (SELECT verdict FROM scan_history WHERE created_at >= {_AT} - INTERVAL 7 DAY),
 v AS (SELECT unnest(['phishing', 'safe', 'suspicious']) AS verdict),
 n AS (SELECT count(*) AS total FROM r)
SELECT v.verdict, count(r.verdict) AS count, round(count(r.verdict) / any_value(n.total) * 100, 1) AS percentage
FROM v CROSS JOIN n LEFT JOIN r ON r.verdict = v.verdict WHERE n.total > 0 GROUP BY v.verdict""")
def _(t):
    return stats.agg_verdict_dist(_scans(t), AS_OF)


@query("agg_severity_dist", f"""
SELECT severity, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage
FROM scan_history WHERE created_at >= {_AT} - INTERVAL 7 DAY GROUP BY severity""")
def _(t):
    return stats.agg_severity_dist(_scans(t), AS_OF)


_DAYS = f"""
WITH d AS (SELECT CAST(unnest(generate_series({_AT} - INTERVAL {{n}} DAY, {_AT}, INTERVAL 1 DAY)) AS DATE) AS day),
 v AS (SELECT unnest(['phishing', 'safe', 'suspicious']) AS verdict),
 c AS (SELECT CAST(created_at AS DATE) AS day, verdict, count(*) AS n FROM scan_history
       WHERE created_at >= {_AT} - INTERVAL {{m}} DAY AND created_at <= {_AT} GROUP BY ALL),
 f AS (SELECT d.day, v.verdict, coalesce(c.n, 0) AS count FROM d CROSS JOIN v LEFT JOIN c ON c.day = d.day AND c.verdict = v.verdict)
"""


@query("agg_trend_daily", _DAYS.format(n=6, m=7) + "SELECT day, verdict, count FROM f")
def _(t):
    return stats.agg_trend_daily(_scans(t), AS_OF)


@query("agg_trend_hourly", f"""
WITH d AS (SELECT unnest(generate_series({_AT} - INTERVAL 1 DAY, {_AT}, INTERVAL 1 HOUR)) AS hour),
 v AS (SELECT unnest(['phishing', 'safe', 'suspicious']) AS verdict),
 c AS (SELECT date_trunc('hour', created_at) AS hour, verdict, count(*) AS n FROM scan_history
       WHERE created_at >= {_AT} - INTERVAL 1 DAY AND created_at <= {_AT} GROUP BY ALL)
SELECT d.hour, v.verdict, coalesce(c.n, 0) AS count
FROM d CROSS JOIN v LEFT JOIN c ON c.hour = d.hour AND c.verdict = v.verdict""")
def _(t):
    return stats.agg_trend_hourly(_scans(t), AS_OF)


@query("agg_trend_pivot", _DAYS.format(n=6, m=7) + """
SELECT day, CAST(sum(count) AS BIGINT) AS total_scans,
 CAST(sum(CASE WHEN verdict = 'phishing' THEN count ELSE 0 END) AS BIGINT) AS phishing,
 CAST(sum(CASE WHEN verdict = 'safe' THEN count ELSE 0 END) AS BIGINT) AS safe,
 CAST(sum(CASE WHEN verdict = 'suspicious' THEN count ELSE 0 END) AS BIGINT) AS suspicious
FROM f GROUP BY day""")
def _(t):
    return stats.agg_trend_pivot(_scans(t), AS_OF)


@query("win_trend_delta", _DAYS.format(n=13, m=14) + """,
 g AS (SELECT day, CAST(sum(count) AS BIGINT) AS scans FROM f GROUP BY day)
SELECT day, scans, scans - lag(scans) OVER (ORDER BY day) AS change,
 round(avg(scans) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7_days FROM g""")
def _(t):
    return stats.win_trend_delta(_scans(t), AS_OF).withColumn("mean_7_days", F.round("mean_7_days", 6))


@query("agg_top_brands", """
SELECT target_brand, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage
FROM scan_history WHERE verdict = 'phishing' AND target_brand IS NOT NULL
GROUP BY target_brand ORDER BY count DESC, target_brand LIMIT 10""")
def _(t):
    return stats.agg_top_brands(_scans(t), AS_OF, limit=10)


@query("agg_phish_stats", f"""
SELECT count(*) AS total_phish, count(*) FILTER (verified = 'yes') AS total_verified,
 count(*) FILTER (online = 'yes') AS total_online, CAST({_AT} - INTERVAL 7 DAY AS DATE) AS from_date,
 CAST({_AT} AS DATE) AS to_date
FROM phish_entries WHERE submission_time >= {_AT} - INTERVAL 7 DAY""")
def _(t):
    return stats.agg_phish_stats(t.phish_entries, AS_OF)


@query("agg_top_targets", f"""
SELECT target, count(*) AS count FROM phish_entries
WHERE submission_time >= {_AT} - INTERVAL 7 DAY AND target <> '' GROUP BY target ORDER BY count DESC, target LIMIT 10""")
def _(t):
    return stats.agg_top_targets(t.phish_entries, AS_OF, k=10)


@query("agg_duplicate_urls", """
SELECT count(*) AS duplicate_urls FROM (SELECT url FROM threat_indicators_raw GROUP BY url HAVING count(*) > 1)""")
def _(t):
    return stats.agg_duplicate_urls(_indicators(t))


@query("agg_merge_sources", """
SELECT url, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
 string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(confidence) AS confidence,
 (SELECT string_agg(DISTINCT g, ',' ORDER BY g) FROM (
   SELECT unnest(string_split(string_agg(i.tags_text, ','), ',')) AS g)) AS tags
FROM threat_indicators_raw i GROUP BY url""")
def _(t):
    tagged = t.threat_indicators_raw.withColumn("tags", F.split("tags_text", ","))
    return stats.agg_merge_sources(tagged).withColumn("sources", F.array_join("sources", ",")).withColumn(
        "tags", F.array_join("tags", ","))


@query("agg_cache_stats", """
SELECT count(*) AS total_entries, count(*) FILTER (expires_at > TIMESTAMP '2024-01-15 00:00:00') AS active_entries,
 count(*) FILTER (expires_at <= TIMESTAMP '2024-01-15 00:00:00') AS expired_entries FROM cache_entries""")
def _(t):
    return stats.agg_cache_stats(t.cache_entries, "2024-01-15 00:00:00")


@query("agg_usage", """
SELECT CAST(called_at AS DATE) AS day, count(*) AS total_requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
 count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses,
 count(*) FILTER (is_error) AS errors, max(called_at) AS last_request_time
FROM call_log GROUP BY ROLLUP (CAST(called_at AS DATE))""")
def _(t):
    return stats.agg_usage(t.call_log)


_METRICS = """
WITH c AS (SELECT model, min(ordinal) AS ordinal, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction <> 1) AS fn,
  count(*) FILTER (label <> 1 AND prediction <> 1) AS tn FROM predictions GROUP BY model),
 m AS (SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c)
"""


@query("agg_model_metrics", _METRICS + "SELECT model, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM m")
def _(t):
    rated = stats.agg_model_metrics(t.predictions)
    return rated.select("model", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("agg_best_model", _METRICS + "SELECT model, f1 FROM m ORDER BY f1 DESC, ordinal LIMIT 1")
def _(t):
    return stats.agg_best_model(t.predictions).withColumn("f1", F.round("f1", 9))


@query("agg_dashboard_cube", f"""
SELECT verdict, severity, target_brand, day, CAST(grouping(verdict, severity, target_brand, day) AS INT) AS grouping_set, count(*) AS scans
FROM (SELECT verdict, severity, target_brand, CAST(created_at AS DATE) AS day FROM scan_history
      WHERE created_at >= {_AT} - INTERVAL 7 DAY)
GROUP BY GROUPING SETS ((verdict), (severity), (target_brand), (day), ())""")
def _(t):
    return stats.agg_dashboard_cube(_scans(t), AS_OF)


@query("agg_distinct_urls", """
SELECT source, count(DISTINCT url) AS distinct_urls FROM threat_indicators_raw GROUP BY source""")
def _(t):
    return stats.agg_distinct_urls(_indicators(t))


#: Spans asked of the stored sketches.
_SPANS = (("2024-01-01", "2024-01-31"), ("2024-01-05", "2024-01-12"), ("2024-01-20", "2024-01-20"))
_IN_SPANS = " UNION ALL ".join(
    f"SELECT '{a}' AS since, source, url FROM threat_indicators_raw WHERE CAST(first_seen AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in _SPANS)


@query("agg_distinct_urls_sketched", f"""
SELECT since, source, count(DISTINCT url) AS distinct_urls, true AS within_3_percent FROM ({_IN_SPANS}) GROUP BY since, source
UNION ALL SELECT since, 'all', count(DISTINCT url), true FROM ({_IN_SPANS}) GROUP BY since""")
def _(t):
    """Estimates from stored sketches beside exact counts; they agree within 3 %."""
    path = scratch_path(t.spark, "sketches")
    stats.url_sketches(t.threat_indicators_raw).write.partitionBy("day").parquet(path)
    sketches, out = t.spark.read.parquet(path), None
    for since, until in _SPANS:
        span = sketches.filter(F.col("day").between(since, until))
        estimate = stats.distinct_urls_of(span, "source").unionByName(stats.distinct_urls_of(span).filter("distinct_urls > 0").withColumn("source", F.lit("all")))
        rows = t.threat_indicators_raw.filter(F.to_date("first_seen").between(since, until))
        exact = stats.agg_distinct_urls(rows).unionByName(stats.agg_distinct_urls(rows.withColumn("source", F.lit("all"))))
        near = F.abs(F.col("estimated") - F.col("distinct_urls")) <= F.greatest(F.lit(1.0), 0.03 * F.col("distinct_urls"))
        part = exact.join(estimate.withColumnRenamed("distinct_urls", "estimated"), "source", "full").select(
            F.lit(since).alias("since"), "source", "distinct_urls", near.alias("within_3_percent"))
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_threat_trend", """
SELECT CAST(date_trunc('week', first_seen) AS DATE) AS period, threat_type, target_brand, count(*) AS indicators
FROM threat_indicators_raw GROUP BY ALL""")
def _(t):
    return stats.agg_threat_trend(t.threat_indicators_raw)


# --- windows -----------------------------------------------------------------

@query("win_latest_scan", f"""
SELECT {_SCAN} FROM scan_history QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at DESC, scan_id DESC) = 1""")
def _(t):
    return history.win_latest_scan(_scans(t))


@query("win_first_by_url", f"""
SELECT {_INDICATOR} FROM threat_indicators_raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen, id) = 1""")
def _(t):
    return history.win_first_by_url(_indicators(t))


@query("win_top_per_source", f"""
SELECT {_INDICATOR} FROM threat_indicators_raw QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 100""")
def _(t):
    return history.win_top_per_source(_indicators(t))


@query("win_feed_status", """
WITH s AS (SELECT source, max(attempted_at) FILTER (status = 'healthy') AS last_update, max(attempted_at) AS last_attempt,
  arg_max(status, (attempted_at, attempt_id)) AS status,
  arg_max(indicator_count, (attempted_at, attempt_id)) FILTER (indicator_count IS NOT NULL) AS indicator_count
 FROM feed_attempts GROUP BY source)
SELECT s.source, s.status, s.last_update, s.last_attempt, coalesce(s.indicator_count, 0) AS indicator_count,
 count(a.error) AS error_count, arg_max(a.error, (a.attempted_at, a.attempt_id)) AS last_error
FROM s LEFT JOIN feed_attempts a ON a.source = s.source AND a.error IS NOT NULL
 AND (s.last_update IS NULL OR a.attempted_at > s.last_update)
GROUP BY ALL""")
def _(t):
    return feeds.win_feed_status(t.feed_attempts)


BREAKER_SQL = """
WITH RECURSIVE a AS (SELECT attempt_id, source, attempted_at, status <> 'healthy' AS failed,
  row_number() OVER (PARTITION BY source ORDER BY attempted_at, attempt_id) AS i FROM feed_attempts),
 b AS (
  SELECT attempt_id, source, attempted_at, i, false AS skipped, CAST(failed AS INT) AS n, CAST(NULL AS TIMESTAMP) AS since
  FROM a WHERE i = 1
  UNION ALL
  SELECT x.attempt_id, x.source, x.attempted_at, x.i, x.skip,
   CASE WHEN x.skip THEN x.n ELSE x.next_n END,
   CASE WHEN x.skip THEN x.since WHEN x.next_n >= 5 THEN x.attempted_at END
  FROM (SELECT a.*, b.since, b.n, coalesce(a.attempted_at <= b.since + INTERVAL 300 SECOND, false) AS skip,
     CASE WHEN NOT a.failed THEN 0 WHEN b.since IS NOT NULL THEN 1 ELSE b.n + 1 END AS next_n
    FROM b JOIN a ON a.source = b.source AND a.i = b.i + 1) x)
SELECT attempt_id, source, attempted_at, skipped, n AS failures_in_row, since IS NOT NULL AS circuit_open FROM b"""


@query("win_circuit_breaker", BREAKER_SQL)
def _(t):
    return feeds.win_circuit_breaker(t.feed_attempts)


# --- look-ups and top lists --------------------------------------------------

@query("top_recent_scans", f"""
SELECT {_SCAN} FROM scan_history WHERE verdict = 'phishing' AND severity = 'high'
ORDER BY created_at DESC, scan_id DESC LIMIT 50 OFFSET 10""")
def _(t):
    return history.top_recent_scans(_scans(t), 50, 10, "phishing", "high")


@query("top_search_scans", f"""
SELECT {_SCAN} FROM scan_history WHERE lower(url) LIKE '%paypa1_secure%' ORDER BY created_at DESC, scan_id DESC LIMIT 20""")
def _(t):
    return history.top_search_scans(_scans(t), "PayPa1_secure", limit=20)


@query("top_search_scans_indexed", f"""
SELECT {_SCAN} FROM scan_history WHERE lower(url) LIKE '%paypa1_secure%' ORDER BY created_at DESC, scan_id DESC LIMIT 20""")
def _(t):
    """The same search, opening only the files whose postings allow it."""
    path, postings = scratch_path(t.spark, "scans"), scratch_path(t.spark, "postings")
    _scans(t).repartitionByRange(16, "url").write.parquet(path)
    layout.write_postings(t.spark, path, postings)
    return history.top_search_scans(layout.read_candidates(t.spark, path, postings, "PayPa1_secure"), "PayPa1_secure", limit=20)


@query("top_scans_filtered", f"""
SELECT {_SCAN} FROM scan_history WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00'
 AND created_at < TIMESTAMP '2024-01-25 00:00:00' AND verdict = 'suspicious' AND lower(url) LIKE '%example%'
ORDER BY created_at DESC, scan_id DESC LIMIT 100""")
def _(t):
    return history.top_scans_filtered(
        _scans(t), "2024-01-05 00:00:00", "2024-01-25 00:00:00", verdict="suspicious", text="example", limit=100)


@query("top_indicators", f"""
SELECT {_INDICATOR} FROM threat_indicators_raw WHERE source = 'urlhaus' AND threat_type = 'malware'
 AND last_seen >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY last_seen DESC, id DESC LIMIT 100""")
def _(t):
    return history.top_indicators(_indicators(t), "urlhaus", "malware", "2024-01-10 00:00:00", limit=100)


@query("top_recent_phish", f"""
SELECT {_PHISH} FROM phish_entries WHERE online = 'yes' ORDER BY submission_time DESC, phish_id DESC LIMIT 100""")
def _(t):
    return history.top_recent_phish(t.phish_entries, limit=100)


@query("top_phish_by_target", f"""
SELECT {_PHISH} FROM phish_entries WHERE contains(lower(target), 'paypal') AND verified = 'yes'
ORDER BY submission_time DESC, phish_id DESC LIMIT 50""")
def _(t):
    return history.top_phish_by_target(t.phish_entries, " PayPal ", limit=50)


@query("top_phish_by_date", f"""
SELECT {_PHISH} FROM phish_entries WHERE CAST(submission_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
ORDER BY submission_time DESC, phish_id DESC LIMIT 100""")
def _(t):
    return history.top_phish_by_date(t.phish_entries, "2024-01-03", "2024-01-20", limit=100)


@query("join_range_dates", f"""
SELECT {_PHISH} FROM phish_entries WHERE CAST(submission_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'""")
def _(t):
    return match.join_range_dates(t.phish_entries, "2024-01-03", "2024-01-20")


@query("get_scan", f"SELECT {_SCAN} FROM scan_history WHERE scan_id = 123")
def _(t):
    return history.get_scan(_scans(t), 123)


@query("get_scan_keyed", f"SELECT {_SCAN} FROM scan_history WHERE scan_id = 123")
def _(t):
    """The same look-up in a table laid out for it."""
    path = scratch_path(t.spark, "keyed")
    layout.write_keyed(_scans(t), path, "scan_id")
    return history.get_scan(t.spark.read.parquet(path), 123)


@query("get_indicator", f"""
SELECT {_INDICATOR} FROM threat_indicators_raw WHERE url = 'http://user@evil7.xyz/%41%42'
ORDER BY last_seen DESC, id DESC LIMIT 1""")
def _(t):
    return history.get_indicator(_indicators(t), "http://user@evil7.xyz/%41%42")


@query("get_phish", f"""
SELECT {_PHISH} FROM phish_entries WHERE phish_id = (SELECT min(phish_id) FROM phish_entries)""")
def _(t):
    return history.get_phish(t.phish_entries, t.phish_entries.agg(F.min("phish_id").alias("phish_id")))


@query("check_url_list", """
WITH k AS (SELECT url, bool_or(verified = 'yes') AS verified,
  coalesce(min(phish_id) FILTER (verified = 'yes'), min(phish_id)) AS phish_id FROM phish_entries GROUP BY url),
 asked AS (SELECT page_id, trim(u) AS url FROM (
   SELECT page_id, CASE WHEN page_id % 10 = 9 THEN regexp_replace(url, '^https?://', '') ELSE url END AS u FROM url_corpus))
SELECT a.page_id, a.url, contains(a.url, '://') AS success, contains(a.url, '://') AND k.url IS NOT NULL AS in_database,
 contains(a.url, '://') AND coalesce(k.verified, false) AS verified,
 CASE WHEN contains(a.url, '://') THEN k.phish_id END AS phish_id,
 CASE WHEN NOT contains(a.url, '://') THEN 'Invalid URL format. Must include protocol (http:// or https://)'
  WHEN k.url IS NULL THEN 'URL not found in PhishTank database (likely safe)'
  WHEN k.verified THEN concat('PHISHING DETECTED - Verified phishing URL (ID: ', k.phish_id, ')')
  ELSE concat('URL found in database but not yet verified (ID: ', k.phish_id, ')') END AS summary
FROM asked a LEFT JOIN k ON k.url = a.url""")
def _(t):
    bare = F.regexp_replace("url", r"^https?://", "")
    asked = t.url_corpus.withColumn("url", F.when(F.col("page_id") % 10 == 9, bare).otherwise(F.col("url")))
    return history.check_url_list(asked, t.phish_entries)


# --- sets --------------------------------------------------------------------

@query("set_union_distinct", """
SELECT url FROM threat_indicators_raw UNION SELECT url FROM phish_entries""")
def _(t):
    return sets.set_union_distinct(_indicators(t), t.phish_entries)


@query("set_union_all", """
SELECT url, 'indicator' AS origin FROM threat_indicators_raw UNION ALL SELECT url, 'phish' FROM phish_entries""")
def _(t):
    return sets.set_union_all(
        _indicators(t).select("url", F.lit("indicator").alias("origin")),
        t.phish_entries.select("url", F.lit("phish").alias("origin")),
    )


@query("set_feed_overlap", """
WITH d AS (SELECT DISTINCT url, source FROM threat_indicators_raw)
SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared_urls
FROM d a JOIN d b ON a.url = b.url AND a.source < b.source GROUP BY ALL""")
def _(t):
    return sets.set_feed_overlap(_indicators(t))


@query("set_expired", """
SELECT entry_id, cache_key, summary, created_at, expires_at,
 (SELECT count(*) FROM cache_entries WHERE expires_at < TIMESTAMP '2024-01-15 00:00:00') AS removed
FROM cache_entries WHERE expires_at >= TIMESTAMP '2024-01-15 00:00:00'""")
def _(t):
    kept, removed = sets.set_expired(t.cache_entries, "2024-01-15 00:00:00")
    return kept.join(F.broadcast(removed))  # one row


# --- posts -------------------------------------------------------------------

_POST_KEEP = "post_id, title, score, num_comments, subreddit, author, created_utc, permalink, is_self"


def _oracle_post_urls(pattern: str, score: int, extra: str = "", where: str = "") -> str:
    pattern = pattern.replace("'", "''")
    return f"""
 found AS (SELECT {_POST_KEEP}{extra}, unnest(list_distinct(list_concat(
   CASE WHEN NOT is_self AND url <> '' THEN [url] ELSE [] END,
   regexp_extract_all(selftext, '{pattern}')))) AS url FROM posts WHERE score >= {score} {where}),
 outside AS (SELECT * FROM found WHERE NOT contains(url, 'reddit.com') AND NOT contains(url, 'redd.it'))
"""


@query("post_urls", "WITH " + _oracle_post_urls(fixed.POST_URL_PATTERN, 10) + f"SELECT {_POST_KEEP}, url FROM outside")
def _(t):
    return posts.post_urls(t.posts)


@query("post_urls_training", "WITH " + _oracle_post_urls(fixed.POST_URL_PATTERN_TRAINING, 5)
       + f"SELECT {_POST_KEEP}, url FROM outside WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')")
def _(t):
    return posts.post_urls_training(t.posts)


_PLACE = """, CASE WHEN contains(lower(title || ' ' || selftext), 'ransomware') THEN 0
  WHEN contains(lower(title || ' ' || selftext), 'phishing') THEN 1 END AS place"""


_WEEK = """AND created_utc > epoch(TIMESTAMP '2024-01-08 12:00:00') - 7 * 86400
  AND created_utc <= epoch(TIMESTAMP '2024-01-08 12:00:00')"""


@query("post_keyword_search", "WITH " + _oracle_post_urls(fixed.POST_URL_PATTERN, 10, _PLACE, _WEEK) + f"""
SELECT {_POST_KEEP}, url FROM outside WHERE place IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY url ORDER BY place, post_id) = 1""")
def _(t):
    return posts.post_keyword_search(t.posts, ["ransomware", "phishing"], as_of="2024-01-08 12:00:00")


#: Strong mentions (CTE ``s``) of the domains in question (CTE ``w``).
MENTIONS = """
WITH w AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www\\.', '', 'g') AS domain
  FROM (SELECT url FROM posts UNION ALL SELECT regexp_extract(selftext, 'https://site[0-9]+[^ ]*$') FROM posts
        UNION ALL SELECT url FROM url_corpus)),
 n AS (SELECT DISTINCT post_id, subreddit, score, title, replace(unnest(regexp_extract_all(
   lower(title || ' ' || selftext || ' ' || url), '[a-z0-9_-]+(?:\\.[a-z0-9_-]+)+')), 'www.', '') AS domain
  FROM posts WHERE score >= 3 AND subreddit IN ('phishing', 'cybersecurity', 'scams')
   AND created_utc > epoch(TIMESTAMP '2024-01-31 00:00:00') - 365 * 86400 AND created_utc <= epoch(TIMESTAMP '2024-01-31 00:00:00')),
 b AS (SELECT n.* FROM n WHERE domain IN (SELECT domain FROM w WHERE domain <> '')),
 s AS (SELECT *, CASE subreddit WHEN 'phishing' THEN 1 WHEN 'cybersecurity' THEN 2 ELSE 3 END AS place FROM b
  WHERE score >= 50 AND regexp_matches(lower(title), 'phishing|scam|malware|malicious|fraud|spoof')
  AND NOT regexp_matches(lower(title), 'impersonating|fake|beware|warning|alert'))"""


@query("post_mentions", MENTIONS + """
SELECT domain, count(*) AS total_mentions, 'reported' AS threat_type,
 array_to_string(list(concat(post_id, ':', title, ':', score) ORDER BY place, score DESC, post_id), ',') AS mentions
FROM s GROUP BY domain HAVING count(*) >= 2""")
def _(t):
    from ..functions import urls as U
    last = F.regexp_extract("selftext", "https://site[0-9]+[^ ]*$", 0)
    known = t.posts.select("url").union(t.posts.select(last)).union(t.url_corpus.select("url"))
    domains = known.select(U.page_domain(F.col("url")).alias("domain")).filter("domain <> ''")
    found = posts.post_mentions(t.posts, domains, as_of=AS_OF)
    line = F.transform("mentions", lambda m: F.concat_ws(":", m["post_id"], m["title"], m["score"].cast("string")))
    return found.withColumn("mentions", F.array_join(line, ","))


@query("post_keyword_trend", """
WITH k AS (SELECT unnest(['phishing', 'phish', 'scam', 'malware', 'ransomware', 'credential', 'stealer', 'fraud']) AS keyword)
SELECT date_trunc('day', make_timestamp(created_utc * 1000000)) AS period, k.keyword, count(*) AS posts,
 CAST(sum(score + num_comments) AS BIGINT) AS engagement
FROM posts p JOIN k ON contains(lower(p.title || ' ' || p.selftext), k.keyword) GROUP BY ALL""")
def _(t):
    return posts.post_keyword_trend(t.posts)
