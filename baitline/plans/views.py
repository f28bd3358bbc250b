"""Domain tables derived from the driver's parquet tables.

The driver ships generic tables (events, pages, documents, labels, ...).  Each
view below turns them into a table of this domain: URLs, scans, indicators,
feed rows, posts, reports.  The text is plain SQL that Spark and DuckDB both
run, so a query and its oracle start from the same rows.
``{name}`` stands for the table or view it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "events", "pages", "documents", "labels", "conversations",
)

_PAGE_OF_EVENT = """(SELECT e0.*, e0.event_id % (SELECT count(*) FROM {pages}) AS page_no FROM {events} e0)"""


# A probe of kind k follows k redirects.
_HOPS = " UNION ALL ".join(f"SELECT {k} AS probe, {h} AS hop" for k in range(1, 7) for h in range(1, k + 1))


def _engine_results() -> str:
    parts = []
    for i in range(8):
        category = (
            f"CASE WHEN (p + {i}) % 4 = 0 THEN 'malicious' "
            f"WHEN (p + {i}) % 5 = 0 THEN 'suspicious' ELSE 'harmless' END"
        )
        parts.append(
            f"""'"engine{i}":{{{{"category":"', {category}, '","result":"verdict{i}"}}}}'"""
        )
    return ", ',', ".join(parts)


def _scan_results(every: bool = False) -> str:
    """Twelve results; with ``every`` they are malicious by turns for all URLs, else for some URLs alone."""
    parts = []
    for i in range(12):
        if every:
            parts.append(
                f"""'{{{{"_id":"r', CAST(p AS STRING), '-{i}","task":{{{{"method":"',
  CASE WHEN (p + {i}) % 2 = 0 THEN 'automatic' ELSE 'manual' END,
  '","time":"2024-01-{i + 1:02d}T00:00:00Z"}}}},"verdicts":{{{{"overall":{{{{"malicious":',
  CASE WHEN (p + {i}) % 5 = 0 THEN 'true' ELSE 'false' END,
  '}}}}}}}},"stats":{{{{"phishing":', CAST((p + {i}) % 3 AS STRING), '}}}}}}}}'"""
            )
            continue
        parts.append(
            f"""'{{{{"_id":"r', CAST(p AS STRING), '-{i}","task":{{{{"method":"',
  CASE WHEN (p + {i}) % 2 = 0 THEN 'automatic' ELSE 'manual' END,
  '","time":"2024-01-{i + 1:02d}T00:00:00Z"}}}},"verdicts":{{{{"overall":{{{{"malicious":',
  CASE WHEN p % 12 = 0 AND (p + {i}) % 5 = 0 THEN 'true' ELSE 'false' END,
  '}}}}}}}},"stats":{{{{"phishing":', CASE WHEN p % 14 = 0 THEN CAST((p + {i}) % 3 AS STRING) ELSE '0' END, '}}}}}}}}'"""
        )
    return ", ',', ".join(parts)


VIEWS: dict[str, str] = {
    "url_corpus": """
SELECT page_id, CASE page_id % 12
 WHEN 1 THEN concat('https://paypa1-secure', CAST(page_id AS STRING), '.com/login')
 WHEN 2 THEN concat('http://192.168.', CAST(page_id % 256 AS STRING), '.1/verify')
 WHEN 3 THEN concat('http://login-account', CAST(page_id AS STRING), '.tk/confirm.php?id=', CAST(page_id AS STRING))
 WHEN 4 THEN 'https://www.google.com/search?q=a&b=c'
 WHEN 5 THEN concat('https://a.b.c.d.site', CAST(page_id AS STRING), '.co.uk/x/y//z/')
 WHEN 6 THEN 'https://g00gle.com'
 WHEN 7 THEN concat('http://user@evil', CAST(page_id AS STRING), '.xyz/%41%42')
 WHEN 8 THEN concat('https://bit.ly/', CAST(page_id AS STRING))
 WHEN 9 THEN concat('https://long', CAST(page_id AS STRING), '.info/', repeat('abcdefghij', 16))
 ELSE url END AS url
FROM {pages}
UNION ALL
SELECT page_id + 1000000000, CASE page_id % 12 WHEN 1 THEN concat('https://secure-paypal', CAST(page_id AS STRING), '.com.mt/signin')
 WHEN 2 THEN concat('https://news.foo', CAST(page_id AS STRING), '.com.es:8443/a?b=1#c') ELSE url END
FROM {pages} WHERE page_id % 12 BETWEEN 1 AND 9
UNION ALL
SELECT page_id + 2000000000, url FROM {pages} WHERE page_id % 12 IN (1, 2)""",
    # Hosts under wildcard, exception, international, nested and unlisted suffixes, bare suffixes and final dots.
    "suffix_urls": """
SELECT page_id, CASE page_id % 15 WHEN 1 THEN concat('https://a.site', CAST(page_id AS STRING), '.anything.ck/x') WHEN 2 THEN 'http://www.ck/login'
 WHEN 3 THEN 'http://shop.www.ck' WHEN 4 THEN concat('https://b', CAST(page_id AS STRING), '.ward.kawasaki.jp') WHEN 5 THEN 'https://tour.city.kawasaki.jp:8443/'
 WHEN 6 THEN concat('https://firma', CAST(page_id AS STRING), '.公司.cn/') WHEN 7 THEN concat('https://firma', CAST(page_id AS STRING), '.XN--55QX5D.cn/')
 WHEN 8 THEN concat('http://user@host', CAST(page_id AS STRING), '.nolist/p') WHEN 9 THEN 'https://anything.ck' WHEN 10 THEN 'http://co.uk/'
 WHEN 11 THEN 'https://Paypa1.CO.uk./secure-login' WHEN 12 THEN 'http://10.0.0.7/x' WHEN 13 THEN 'http://localhost/' ELSE url END AS url
FROM {pages}
UNION ALL SELECT page_id, url FROM {url_corpus}""",
    "scan_history": f"""
SELECT e.event_id AS scan_id, u.url AS url,
 CASE e.event_type WHEN 'error' THEN 'phishing' WHEN 'click' THEN 'suspicious' ELSE 'safe' END AS verdict,
 CAST((e.event_id * 37) % 100 AS DOUBLE) / 100 AS confidence,
 CASE WHEN e.event_type = 'error' AND e.event_id % 5 = 0 THEN 'critical' WHEN e.event_type = 'error' THEN 'high'
      WHEN e.event_type = 'click' THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN e.event_type = 'error' THEN CASE e.event_id % 4 WHEN 0 THEN 'PayPal' WHEN 1 THEN 'Apple'
      WHEN 2 THEN 'Microsoft' ELSE 'Amazon' END END AS target_brand,
 e.user_id AS user_id, e.ts AS created_at
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no""",
    # The feeds list the look-alike, raw-address, free-domain, deep-host and
    # user-info URLs of the corpus, each in one of its spellings.
    "threat_indicators_raw": f"""
SELECT e.event_id AS id,
 CASE e.event_id % 5
  WHEN 0 THEN concat(u.url, '/')
  WHEN 1 THEN concat('http://', substr(u.url, strpos_of_host))
  ELSE u.url END AS url,
 CASE e.user_id % 3 WHEN 0 THEN 'phishtank' WHEN 1 THEN 'urlhaus' ELSE 'reddit' END AS source,
 CASE e.user_id % 3 WHEN 1 THEN 'malware' ELSE 'phishing' END AS threat_type,
 CASE e.event_id % 4 WHEN 0 THEN 'PayPal' WHEN 1 THEN 'Apple' WHEN 2 THEN '' END AS target_brand,
 CASE e.event_id % 3 WHEN 0 THEN 'exe,emotet' WHEN 1 THEN 'kit' ELSE 'exe,kit' END AS tags_text,
 e.ts AS first_seen, e.ts AS last_seen,
 CASE e.user_id % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.9E0 ELSE 0.7E0 END AS confidence
FROM {_PAGE_OF_EVENT} e JOIN
 (SELECT page_id, url, CASE WHEN url LIKE 'https://%' THEN 9 ELSE 8 END AS strpos_of_host FROM {{url_corpus}}) u
 ON u.page_id = e.page_no
WHERE e.event_type IN ('error', 'view')
 AND (u.url LIKE 'https://paypa1-%' OR u.url LIKE 'http://192.168.%' OR u.url LIKE '%.tk/%'
      OR u.url LIKE '%.co.uk/%' OR u.url LIKE 'http://user@%')""",
    "phish_entries": f"""
SELECT e.event_id AS phish_id, u.url AS url, e.ts AS submission_time,
 CASE WHEN e.event_id % 4 = 0 THEN 'no' ELSE 'yes' END AS verified,
 CASE WHEN e.event_id % 3 = 0 THEN 'no' ELSE 'yes' END AS online,
 CASE e.event_id % 6 WHEN 0 THEN 'PayPal' WHEN 1 THEN 'Apple' WHEN 2 THEN 'paypal-login' WHEN 3 THEN '' ELSE 'Other' END AS target
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no
WHERE e.event_type = 'error'""",
    "feed_attempts": """
SELECT event_id AS attempt_id,
 CASE user_id % 3 WHEN 0 THEN 'phishtank' WHEN 1 THEN 'urlhaus' ELSE 'reddit' END AS source,
 ts AS attempted_at,
 CASE WHEN event_type IN ('error', 'click') THEN 'error' ELSE 'healthy' END AS status,
 CASE WHEN event_type IN ('error', 'click') THEN concat('HTTP ', CAST(429 + event_id % 2 AS STRING)) END AS error,
 CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE CAST(floor(value) AS INT) END AS indicator_count
FROM {events}""",
    "posts": """
SELECT CAST(doc_id AS STRING) AS post_id,
 concat(CASE doc_id % 5 WHEN 0 THEN 'New phishing kit spotted' WHEN 1 THEN 'Ransomware wave' WHEN 2 THEN 'Bank fraud report'
   WHEN 3 THEN 'Beware fake Apple phishing' ELSE 'Weekly thread' END, ' #', CAST(doc_id AS STRING)) AS title,
 CAST((doc_id * 7) % 150 AS INT) AS score,
 CAST(doc_id % 23 AS INT) AS num_comments,
 CASE doc_id % 3 WHEN 0 THEN 'phishing' WHEN 1 THEN 'cybersecurity' ELSE 'scams' END AS subreddit,
 concat('user', CAST(doc_id % 17 AS STRING)) AS author,
 1704067200 + doc_id * 3600 AS created_utc,
 concat('/r/post/', CAST(doc_id AS STRING), '/') AS permalink,
 doc_id % 4 <> 0 AS is_self,
 concat('http://link', CAST(doc_id % 50 AS STRING), '.example.org/p') AS url,
 concat(text, CASE WHEN doc_id % 30 < 20 THEN concat(' via https://long', CAST(CAST((doc_id - doc_id % 30) / 30 AS BIGINT) % 20 * 12 + 9 AS STRING), '.info/x') ELSE '' END, CASE doc_id % 2
   WHEN 0 THEN concat(' see https://site', CAST(doc_id % 40 AS STRING), '.example.com/a and http://reddit.com/r/x')
   ELSE concat(' seen at https://site', CAST(doc_id % 40 AS STRING), '.example.com/a') END) AS selftext
FROM {documents}""",
    "predictions": """
SELECT doc_id, 'toxic_flag' AS model, 0 AS ordinal, quality AS label, toxic AS prediction FROM {labels}
UNION ALL SELECT doc_id, 'inverse_flag', 1, quality, 1 - toxic FROM {labels}
UNION ALL SELECT doc_id, 'always_malicious', 2, quality, 1 FROM {labels}""",
    "phishtank_rows": """
SELECT CAST(phish_id AS STRING) AS phish_id, url,
 concat('https://phish.example/detail?phish_id=', CAST(phish_id AS STRING)) AS phish_detail_url,
 CASE phish_id % 7 WHEN 0 THEN 'not-a-date'
   WHEN 1 THEN substr(CAST(submission_time AS STRING), 1, 19)
   WHEN 2 THEN concat(replace(substr(CAST(submission_time AS STRING), 1, 19), ' ', 'T'), 'Z')
   ELSE concat(replace(substr(CAST(submission_time AS STRING), 1, 19), ' ', 'T'), '+00:00') END AS submission_time,
 verified,
 CASE WHEN verified = 'yes' THEN concat(replace(substr(CAST(submission_time AS STRING), 1, 19), ' ', 'T'), '+00:00') END AS verification_time,
 online, target
FROM {phish_entries}""",
    "urlhaus_rows": f"""
SELECT CAST(e.event_id AS STRING) AS id, CASE WHEN e.event_id % 11 = 0 THEN '' ELSE u.url END AS url,
 CASE WHEN e.event_id % 2 = 0 THEN 'online' ELSE 'offline' END AS url_status,
 concat(substr(CAST(e.ts AS STRING), 1, 19), ' UTC') AS date_added,
 CASE e.event_id % 6 WHEN 0 THEN 'malware_download' WHEN 1 THEN 'C2' WHEN 2 THEN 'phishing' WHEN 3 THEN 'spam'
   WHEN 4 THEN 'payload_delivery' ELSE 'botnet' END AS threat,
 CASE e.event_id % 3 WHEN 0 THEN 'exe,trickbot' WHEN 1 THEN 'elf' END AS tags_text,
 concat('https://haus.example/url/', CAST(e.event_id AS STRING), '/') AS urlhaus_link,
 concat('host', CAST(u.page_id AS STRING), '.example') AS host,
 concat('user', CAST(e.user_id AS STRING)) AS reporter
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no
WHERE e.event_type = 'view'""",
    "call_log": """
SELECT event_id AS call_id, ts AS called_at,
 event_type = 'view' AS cache_hit, event_type = 'error' AS is_error,
 CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
 CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(floor(value * 3) AS BIGINT) END AS output_tokens
FROM {events}""",
    "cache_entries": f"""
SELECT e.event_id AS entry_id, md5(u.url) AS cache_key, concat('text ', CAST(e.event_id AS STRING)) AS summary,
 e.ts AS created_at, e.ts + INTERVAL 24 HOUR AS expires_at
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no
WHERE e.event_type = 'click'""",
    # Deep hosts are registered under their parent, which the corpus does not list.
    "registrations": f"""
SELECT u.page_id AS page_id, CASE WHEN u.url LIKE 'https://a.b.c.d.%' THEN replace(u.url, 'a.b.c.d.', 'www.') ELSE u.url END AS url, e.event_id AS obs_id, e.ts AS observed_at,
 CAST(e.event_id * 13 % 400 AS INT) AS age_at_observation
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no
WHERE e.event_type = 'signup'""",
    "certificates": f"""
SELECT u.page_id AS page_id, u.url AS url, e.event_id AS obs_id, e.ts AS observed_at,
 e.event_id % 3 <> 0 AS ssl_valid,
 CASE e.event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Authority A' ELSE 'Authority B' END AS ssl_issuer
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no
WHERE e.event_type = 'purchase'""",
    "redirect_hops": f"""
SELECT u.url AS url, e.event_id AS obs_id, e.ts AS observed_at, h.hop AS hop,
 concat('https://hop', CAST(h.hop AS STRING), '.example/', CAST(e.event_id AS STRING)) AS target
FROM {_PAGE_OF_EVENT} e JOIN {{url_corpus}} u ON u.page_id = e.page_no
JOIN ({_HOPS}) h ON h.probe = e.event_id % 7
WHERE e.event_type = 'purchase'""",
    "corpus_urls": """
SELECT url, min(page_id) AS p FROM {url_corpus} GROUP BY url""",
    "engine_reports": f"""
SELECT url, concat('{{{{"data":{{{{"attributes":{{{{"reputation":', CAST(0 - p % 9 AS STRING),
 ',"last_analysis_stats":{{{{"malicious":', CASE WHEN p % 10 = 0 THEN CAST(p % 4 AS STRING) ELSE '0' END,
 ',"suspicious":', CASE WHEN p % 10 < 2 THEN CAST(p % 3 AS STRING) ELSE '0' END,
 ',"harmless":60}}}},"last_analysis_results":{{{{', {_engine_results()}, '}}}}}}}}}}}}}}}}') AS report
FROM {{corpus_urls}}""",
    "blocklist_reports": """
SELECT url, CASE p % 16 WHEN 1 THEN '{{"matches":[{{"threatType":"SOCIAL_ENGINEERING","platformType":"ANY_PLATFORM","cacheDuration":"300s"}},{{"threatType":"MALWARE","platformType":"ANY_PLATFORM","cacheDuration":"200s"}}]}}'
 WHEN 2 THEN '{{"matches":[{{"threatType":"MALWARE","platformType":"WINDOWS","cacheDuration":"100s"}}]}}' ELSE '{{}}' END AS report
FROM {corpus_urls}""",
    "domain_reports": f"""
SELECT url, concat('{{{{"total":', CAST(p % 40 AS STRING), ',"results":[', {_scan_results()}, ']}}}}') AS report
FROM {{corpus_urls}}""",
    # The reports of the three vendor jobs, which most URLs are named in; the views above, where
    # most URLs are clean, are for the verdicts of all sources.
    "vendor_engine_reports": f"""
SELECT url, concat('{{{{"data":{{{{"attributes":{{{{"reputation":', CAST(0 - p % 9 AS STRING),
 ',"last_analysis_stats":{{{{"malicious":', CAST(p % 4 AS STRING), ',"suspicious":', CAST(p % 3 AS STRING),
 ',"harmless":60}}}},"last_analysis_results":{{{{', {_engine_results()}, '}}}}}}}}}}}}}}}}') AS report
FROM {{corpus_urls}}""",
    "vendor_blocklist_reports": """
SELECT url, CASE p % 3 WHEN 0 THEN '{{}}'
 WHEN 1 THEN '{{"matches":[{{"threatType":"SOCIAL_ENGINEERING","platformType":"ANY_PLATFORM","cacheDuration":"300s"}},{{"threatType":"MALWARE","platformType":"ANY_PLATFORM","cacheDuration":"200s"}}]}}'
 ELSE '{{"matches":[{{"threatType":"MALWARE","platformType":"WINDOWS","cacheDuration":"100s"}}]}}' END AS report
FROM {corpus_urls}""",
    "vendor_domain_reports": f"""
SELECT url, concat('{{{{"total":', CAST(p % 40 AS STRING), ',"results":[', {_scan_results(every=True)}, ']}}}}') AS report
FROM {{corpus_urls}}""",
    "lookup_reports": """
SELECT url, CASE p % 18 WHEN 4 THEN concat('{{"query_status":"ok","id":"', CAST(p AS STRING), '","url_status":"online","threat":"malware_download","tags":["exe","kit',
  CAST(p % 3 AS STRING), '"],"urlhaus_reference":"https://haus.example/url/', CAST(p AS STRING), '/","date_added":"2024-01-0', CAST(1 + p % 8 AS STRING), ' 00:00:00 UTC"}}')
 WHEN 5 THEN '{{"query_status":"ok","threat":"","tags":[]}}' WHEN 6 THEN 'no reply' ELSE '{{"query_status":"no_results"}}' END AS report
FROM {corpus_urls}""",
    # What a caller hands in: every seventeenth line is missing, blank or no URL.
    "submitted": """
SELECT page_id, CASE page_id % 51 WHEN 3 THEN NULL WHEN 20 THEN '  ' WHEN 37 THEN concat('no url ', CAST(page_id AS STRING)) ELSE url END AS url
FROM {url_corpus}""",
    "samples": """
SELECT u.page_id AS page_id, u.url AS url, CASE WHEN i.url IS NULL THEN 0 ELSE 1 END AS label
FROM {url_corpus} u LEFT JOIN (SELECT DISTINCT url FROM {threat_indicators_raw}) i ON i.url = u.url""",
    "distinct_samples": """
SELECT url, label, min(page_id) AS page_id FROM {samples} GROUP BY url, label""",
    "ranked_domains": """
SELECT min(page_id) + 1 AS rank, split_part(split_part(url, '://', 2), '/', 1) AS domain
FROM {pages} WHERE contains(url, '://') GROUP BY split_part(split_part(url, '://', 2), '/', 1)""",
    # Words to look for: the first label, the host and the start of the path of every page, in mixed case.
    "url_words": """
SELECT split_part(domain, '.', 1) AS word FROM {ranked_domains}
UNION SELECT domain FROM {ranked_domains}
UNION SELECT upper(split_part(split_part(url, '://', 2), '/', 2)) FROM {pages}
UNION SELECT substr(url, 9, 5) FROM {pages}""",
    "brand_names": """
SELECT split_part(domain, '.', 2) AS name, min(rank) AS place FROM {ranked_domains} GROUP BY split_part(domain, '.', 2)
UNION ALL SELECT split_part(domain, '.', 1), min(rank) FROM {ranked_domains} GROUP BY split_part(domain, '.', 1)
UNION ALL SELECT 'google', 0 UNION ALL SELECT 'paypal', 1 UNION ALL SELECT 'evil', 2""",
    "pasted_lines": """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('  ', url, '  ') WHEN 1 THEN concat('site', CAST(page_id AS STRING), '.com/x')
 WHEN 2 THEN concat('10.0.0.', CAST(page_id % 256 AS STRING), '/a') WHEN 3 THEN concat('not a url ', CAST(page_id AS STRING))
 WHEN 4 THEN '' ELSE concat('HTTP://Example', CAST(page_id AS STRING), '.org') END AS line
FROM {url_corpus}""",
    "labeled_lines": """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(url, 'https://', ''), 'http://', '') ELSE url END AS url,
 CASE page_id % 6 WHEN 0 THEN 'bad' WHEN 1 THEN 'Good' WHEN 2 THEN 'phishing' WHEN 3 THEN 'benign' WHEN 4 THEN 'unknown' ELSE 'defacement' END AS label
FROM {url_corpus}""",
    "replies": """
SELECT doc_id, CASE doc_id % 6
 WHEN 0 THEN concat('{{"summary":"s', CAST(doc_id AS STRING), '","explanation":"e","risk_factors":["a","b"],"severity":"high","recommended_action":"Block","target_brand":"PayPal"}}')
 WHEN 1 THEN concat('```json', chr(10), '{{"summary":"s', CAST(doc_id AS STRING), '","severity":"extreme"}}', chr(10), '```')
 WHEN 2 THEN concat('```', chr(10), '{{"explanation":"only this","severity":"low"}}', chr(10), '```')
 WHEN 3 THEN concat('Sorry, here is prose about document ', CAST(doc_id AS STRING), ': ', text)
 WHEN 4 THEN '{{"summary":"cut off'
 ELSE concat('  {{"summary":"t', CAST(doc_id AS STRING), '","explanation":"f","risk_factors":[],"severity":"critical","recommended_action":"Stop","target_brand":null}}  ') END AS reply
FROM {documents}""",
}


def _inputs(name: str) -> list[str]:
    text = VIEWS[name].replace("{{", "").replace("}}", "")
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """The driver's tables and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in VIEWS:
                inputs = {n: getattr(self, n) for n in _inputs(name)}
                self._known[name] = self.spark.sql(VIEWS[name], **inputs)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]


def with_views(query: str) -> str:
    """Prefix an oracle with the views it names, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    plain = {n: n for n in (*BASE_TABLES, *VIEWS)}
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in needed)
    query = query.strip()
    if not ctes:
        return query
    if query[:5].upper() == "WITH ":
        rest = query[5:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes},\n{rest[10:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{query}"
