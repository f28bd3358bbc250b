"""Queries over feed files and sinks.

The readers need files, so each query first lets Spark write the matching
domain table to the shared folder in the feed's own format and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..operators import normalize as norm
from ..sources import readers, upsert, writers
from .registry import AS_OF, query
from .session import scratch_path
from .views import Tables

_ROWS_PER_LINE = 1000


def _path(t: Tables, name: str) -> str:
    return scratch_path(t.spark, name)


def _json_lines(rows: DataFrame, key: str, envelope: str | None = None) -> DataFrame:
    """Rows as JSON text, at most a thousand (by key range) per line."""
    entries = F.collect_list(F.struct(*rows.columns))
    lines = rows.groupBy(F.floor(F.col(key).cast("long") / _ROWS_PER_LINE)).agg(entries.alias("entries"))
    value = F.struct(F.col("entries").alias(envelope)) if envelope else F.col("entries")
    return lines.select(F.to_json(value).alias("value"))


def urlhaus_raw(t: Tables) -> DataFrame:
    return t.urlhaus_rows.withColumn("tags", F.split("tags_text", ",")).drop("tags_text")


# --- sources -----------------------------------------------------------------

@query("src_line_feed", "SELECT url, 'urlhaus' AS source, 'malware_download' AS threat_type FROM url_corpus")
def _(t):
    path = _path(t, "lines")
    commented = F.array(F.lit("# comment"), F.concat(F.lit("  "), "url", F.lit(" ")), F.lit(" "))
    t.url_corpus.select(F.explode(commented).alias("value")).write.text(path)
    return readers.src_line_feed(t.spark, path, "urlhaus", "malware_download")


_PHISH_ROW = "phish_id, url, phish_detail_url, submission_time, verified, verification_time, online, target"


@query("src_phishtank_csv", f"SELECT {_PHISH_ROW[:-6]}nullif(target, '') AS target FROM phishtank_rows WHERE url <> ''")
def _(t):
    path = _path(t, "phish-csv")
    t.phishtank_rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.src_phishtank_csv(t.spark, path)


@query("src_phishtank_json", f"SELECT {_PHISH_ROW} FROM phishtank_rows")
def _(t):
    path = _path(t, "phish-json")
    _json_lines(t.phishtank_rows, "phish_id").write.text(path)
    return readers.src_phishtank_json(t.spark, path, multi_line=False)


@query("src_urlhaus_json", """
SELECT id, url, url_status, date_added, threat, tags_text AS tags, urlhaus_link, host, reporter FROM urlhaus_rows
WHERE list_contains(string_split(tags_text, ','), 'exe')""")
def _(t):
    path = _path(t, "haus-json")
    _json_lines(urlhaus_raw(t), "id", "urls").write.text(path)
    return readers.src_urlhaus_json(t.spark, path, tag="exe", multi_line=False).withColumn("tags", F.array_join("tags", ","))


@query("src_posts", "SELECT post_id, title, selftext, url, is_self, score, num_comments, created_utc, permalink, subreddit, author FROM posts")
def _(t):
    path = _path(t, "posts")
    t.posts.write.json(path)
    return readers.src_posts(t.spark, path)


@query("src_labeled_csv", """
SELECT CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS url,
 CASE WHEN lower(label) IN ('bad', 'phishing', 'defacement') THEN 1 ELSE 0 END AS label FROM labeled_lines WHERE label <> 'unknown'""")
def _(t):
    path = _path(t, "labeled")
    t.labeled_lines.select(F.col("url").alias("Site_URL "), F.col("label").alias("Class Label")).write.option("header", True).csv(path)
    return readers.src_labeled_csv(t.spark, path)


@query("src_ranked_domains", "SELECT rank, domain FROM ranked_domains")
def _(t):
    path = _path(t, "ranked")
    t.ranked_domains.select("rank", "domain").write.csv(path)
    return readers.src_ranked_domains(t.spark, path)


@query("src_training_json", """
SELECT url, CASE label WHEN 1 THEN 'phishing' ELSE 'legitimate' END AS label, 'corpus' AS source FROM samples""")
def _(t):
    path = _path(t, "training")
    word = F.when(F.col("label") == 1, "phishing").otherwise("legitimate")
    writers.write_training_json(t.samples.select("url", word.alias("label"), F.lit("corpus").alias("source")), path)
    return readers.src_training_json(t.spark, path)


@query("src_url_batch", """
WITH l AS (SELECT trim(line) AS line FROM pasted_lines WHERE trim(line) <> ''),
 v AS (SELECT line, regexp_matches(line, '(?i)^https?://') OR regexp_matches(line, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}')
  OR regexp_matches(line, '(?i)^[\\w.-]+\\.[a-z]{2,}(/|$)') AS is_valid FROM l)
SELECT CASE WHEN starts_with(line, 'http') OR NOT is_valid THEN line ELSE 'https://' || line END AS url, is_valid FROM v""")
def _(t):
    path = _path(t, "pasted")
    t.pasted_lines.select("line").write.text(path)
    return readers.src_url_batch(t.spark, path, cap=None).drop("position")


# --- sinks -------------------------------------------------------------------

@query("snk_scans", "SELECT *, CAST(created_at AS DATE) AS scan_date FROM scan_history")
def _(t):
    path = _path(t, "scans")
    writers.snk_scans(t.scan_history, path)
    return t.spark.read.parquet(path)


def _merged_by_halves(t, name: str, rows, time: str, keys: list[str], merge):
    """Both halves of a table upserted, the second one twice, and the state read back."""
    path = _path(t, name)
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    for batch, part in ((0, F.col(time) < half), (1, F.col(time) >= half), (1, F.col(time) >= half)):
        upsert.upsert(path, rows.filter(part), keys, merge, batch)
    return upsert.read_merged(t.spark, path, rows.schema)


@query("snk_indicators", """
WITH m AS (SELECT url, source, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  arg_max((id, threat_type, target_brand, confidence), (last_seen, id)) AS latest FROM threat_indicators_raw GROUP BY url, source)
SELECT url, source, first_seen, last_seen, latest[1] AS id, latest[2] AS threat_type, latest[3] AS target_brand, latest[4] AS confidence FROM m""")
def _(t):
    rows = t.threat_indicators_raw.drop("tags_text")
    return _merged_by_halves(t, "indicators", rows, "last_seen", ["url", "source"], writers.snk_indicators)


@query("snk_cache", """
SELECT * FROM cache_entries QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, entry_id DESC) = 1""")
def _(t):
    return _merged_by_halves(t, "cache", t.cache_entries, "created_at", ["cache_key"], writers.snk_cache)


@query("snk_export_json", "SELECT scan_id, url, verdict, confidence, severity FROM scan_history")
def _(t):
    path = _path(t, "export-json")
    rows = t.scan_history.select("scan_id", "url", "verdict", "confidence", "severity")
    writers.snk_export_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("snk_export_csv", """
SELECT url, verdict, concat(CAST(round(confidence * 100) AS INT), '%') AS confidence,
 CASE WHEN severity = 'low' THEN '' ELSE severity END AS severity FROM scan_history""")
def _(t):
    path = _path(t, "export-csv")
    rows = t.scan_history.withColumn("severity", F.when(F.col("severity") != "low", F.col("severity")))
    writers.snk_export_csv(rows, path)
    read = t.spark.read.option("header", True).option("escape", '"').schema(
        "url STRING, verdict STRING, confidence STRING, severity STRING").csv(path)
    return read.fillna("", ["severity"])


# --- normalisation -----------------------------------------------------------

def flat(indicators: DataFrame, *metadata: str) -> DataFrame:
    """Indicators with lists and the named metadata entries as text columns."""
    kept = [F.try_element_at("metadata", F.lit(m)).alias(f"meta_{m}") for m in metadata]
    return indicators.select(
        "url", "threat_type", "source", "source_id", "first_seen", "last_seen", "target_brand",
        F.round("confidence", 6).alias("confidence"), F.array_join("tags", ",").alias("tags"), *kept)


def _brand(text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{k}') THEN '{v}'" for k, v in fixed.BRAND_TAGS) + " END"


_TIME = "coalesce(TRY_CAST(regexp_replace(replace({c}, 'T', ' '), '(Z|[+]00:00)$', '') AS TIMESTAMP), TIMESTAMP '" + AS_OF + "')"

_NORM_PHISH = f"""
SELECT url, 'phishing' AS threat_type, 'phishtank' AS source, phish_id AS source_id, {_TIME.format(c='submission_time')} AS first_seen,
 CASE WHEN verification_time IS NULL THEN {_TIME.format(c='submission_time')} ELSE {_TIME.format(c='verification_time')} END AS last_seen,
 coalesce({_brand('target')}, {_brand('url')}) AS target_brand, CASE verified WHEN 'yes' THEN 1.0E0 ELSE 0.7E0 END AS confidence,
 CASE verified WHEN 'yes' THEN 'phishing,verified' ELSE 'phishing,unverified' END AS tags"""
_NORM_HAUS = f"""
SELECT url, CASE WHEN lower(threat) IN ('malware_download', 'malware_download_2', 'c2', 'payload_delivery') THEN 'malware'
  WHEN lower(threat) IN ('phishing', 'spam', 'suspicious') THEN lower(threat) ELSE 'other' END AS threat_type,
 'urlhaus' AS source, id AS source_id, CAST(replace(date_added, ' UTC', '') AS TIMESTAMP) AS first_seen,
 CAST(replace(date_added, ' UTC', '') AS TIMESTAMP) AS last_seen, {_brand('url')} AS target_brand, 0.9E0 AS confidence,
 concat_ws(',', CASE WHEN lower(threat) IN ('malware_download', 'malware_download_2', 'c2', 'payload_delivery') THEN 'malware'
  WHEN lower(threat) IN ('phishing', 'spam', 'suspicious') THEN lower(threat) ELSE 'other' END, tags_text) AS tags"""
_NORM_POST = f"""
SELECT url, k AS threat_type, 'reddit' AS source, post_id AS source_id, make_timestamp(created_utc * 1000000) AS first_seen,
 TIMESTAMP '{AS_OF}' AS last_seen, coalesce({_brand('url')}, {_brand('title')}) AS target_brand,
 round(least(0.5 + score / 100, 0.95), 6) AS confidence, 'community-reported,' || k AS tags"""
_POST_FROM = """
 FROM (SELECT *, CASE WHEN contains(lower(title), 'phish') THEN 'phishing' WHEN regexp_matches(lower(title), 'malware|ransomware') THEN 'malware'
  WHEN regexp_matches(lower(title), 'scam|fraud') THEN 'spam' ELSE 'other' END AS k FROM posts)
 WHERE url <> '' AND NOT contains(url, 'reddit.com') AND NOT contains(url, 'redd.it')"""


@query("norm_phishtank", _NORM_PHISH + """,
 phish_detail_url AS meta_detail_url, CASE verified WHEN 'yes' THEN 'true' ELSE 'false' END AS meta_verified,
 CASE online WHEN 'yes' THEN 'true' ELSE 'false' END AS meta_online FROM phishtank_rows WHERE url <> ''""")
def _(t):
    return flat(norm.norm_phishtank(t.phishtank_rows, AS_OF), "detail_url", "verified", "online")


@query("norm_urlhaus", _NORM_HAUS + ", url_status AS meta_url_status, host AS meta_host, reporter AS meta_reporter FROM urlhaus_rows WHERE url <> ''")
def _(t):
    return flat(norm.norm_urlhaus(urlhaus_raw(t), AS_OF), "url_status", "host", "reporter")


@query("norm_reddit", _NORM_POST + ", title AS meta_title, CAST(score AS VARCHAR) AS meta_score, 'https://reddit.com' || permalink AS meta_permalink" + _POST_FROM)
def _(t):
    return flat(norm.norm_reddit(t.posts, AS_OF), "title", "score", "permalink")


def normalized(t: Tables) -> DataFrame:
    return norm.norm_all({"phishtank": t.phishtank_rows, "urlhaus": urlhaus_raw(t), "reddit": t.posts}, AS_OF)


_NORM_ALL = (
    f"{_NORM_PHISH} FROM phishtank_rows WHERE url <> '' UNION ALL {_NORM_HAUS} FROM urlhaus_rows WHERE url <> '' "
    f"UNION ALL {_NORM_POST} {_POST_FROM}")


@query("norm_all", _NORM_ALL)
def _(t):
    return flat(normalized(t))


@query("norm_brand_tag", f"SELECT page_id, url, {_brand('url')} AS brand FROM url_corpus")
def _(t):
    return norm.norm_brand_tag(t.url_corpus, "url")


@query("norm_timestamps", f"""
SELECT phish_id, submission_time, {_TIME.format(c='submission_time')} AS parsed_at FROM phishtank_rows
UNION ALL SELECT id, date_added, CAST(replace(date_added, ' UTC', '') AS TIMESTAMP) FROM urlhaus_rows""")
def _(t):
    texts = t.phishtank_rows.select("phish_id", "submission_time").union(t.urlhaus_rows.select("id", "date_added"))
    return norm.norm_timestamps(texts, "submission_time", AS_OF)


@query("norm_fetch_all", f"""
WITH n AS ({_NORM_ALL})
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY CAST(source_id AS BIGINT)) <= 100""")
def _(t):
    ordered = flat(normalized(t)).withColumn("place", F.col("source_id").cast("long"))
    return norm.norm_fetch_all(ordered, limit_per_source=100, order="place").drop("place")


@query("norm_live_feed", """
SELECT id, url, source, count(*) OVER (PARTITION BY source) AS source_total, count(*) OVER () AS overall_total
FROM threat_indicators_raw QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 200""")
def _(t):
    return norm.norm_live_feed(t.threat_indicators_raw.select("id", "url", "source"), limit=200)


@query("norm_fetch_all_unlimited", _NORM_ALL)
def _(t):
    return norm.norm_fetch_all(flat(normalized(t)))


@query("norm_live_feed_unlimited", """
SELECT id, url, source, count(*) OVER (PARTITION BY source) AS source_total, count(*) OVER () AS overall_total
FROM threat_indicators_raw""")
def _(t):
    return norm.norm_live_feed(t.threat_indicators_raw.select("id", "url", "source"))


@query("norm_tag_explode", """
SELECT tag, count(*) AS indicators, count(DISTINCT url) AS urls
FROM (SELECT url, unnest(string_split(tags_text, ',')) AS tag FROM threat_indicators_raw) GROUP BY tag""")
def _(t):
    return norm.norm_tag_explode(t.threat_indicators_raw.withColumn("tags", F.split("tags_text", ",")))
