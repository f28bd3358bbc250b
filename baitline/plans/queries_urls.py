"""Queries over URLs: matching, features, rules, scores, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, urls as U
from ..operators import explain, features as feat, lexicon, match, rules, stats, suffix, text, verdict
from ..sources import readers, writers
from . import oracle_text as O
from .queries_scans import MENTIONS
from .registry import AS_OF, query
from .session import scratch_path
from .views import Tables

_PLAIN = f"src AS (SELECT {O.DEFAULT_NETWORK} FROM url_corpus)"
_CORE = (
    "page_id, url, domain_age_days, ssl_valid, ssl_issuer, redirect_count, redirect_chain, typosquat_target, typosquat_distance, "
    "has_ip_address, url_length, path_depth, subdomain_count, has_https, has_suspicious_keywords, suspicious_tld"
)


def joined(df: DataFrame, *columns: str, sep: str = ",") -> DataFrame:
    """Lists as text, so that both engines return the same type."""
    for c in columns:
        df = df.withColumn(c, F.array_join(c, sep))
    return df


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def core(t: Tables) -> DataFrame:
    return feat.feat_core(t.url_corpus)


def rated(t: Tables) -> DataFrame:
    return rules.with_verdict(rules.with_rules(core(t)))


# --- matching ----------------------------------------------------------------

@query("join_known_threat", "WITH " + O.feed_hits("url_corpus") + " SELECT DISTINCT url FROM hit")
def _(t):
    return match.join_known_threat(t.url_corpus, t.threat_indicators_raw)


@query("join_unseen_urls", "WITH " + O.feed_hits("url_corpus") + """
 SELECT DISTINCT url FROM url_corpus WHERE url NOT IN (SELECT url FROM hit)""")
def _(t):
    return match.join_unseen_urls(t.url_corpus, t.threat_indicators_raw)


@query("join_matched_variant", "WITH " + O.feed_hits("url_corpus") + """
 SELECT url, nullif(arg_min(v, pos), url) AS matched_variant FROM hit GROUP BY url""")
def _(t):
    return match.join_matched_variant(t.url_corpus, t.threat_indicators_raw)


@query("join_feed_verdict", "WITH " + O.feed_hits("url_corpus") + "," + O.FEED_VERDICT + """
 SELECT url, true AS is_known_threat, sources, threat_type, target_brand, 'phishing' AS verdict, 0.98E0 AS confidence, matched_rules
 FROM feed_said""")
def _(t):
    return joined(match.join_feed_verdict(t.url_corpus, t.threat_indicators_raw), "sources", "matched_rules")


@query("join_typosquat", "WITH " + O.parts("url_corpus") + f"""
 SELECT page_id, url, label, ([{', '.join("'" + n + ".com'" for n in fixed.SQUAT_NAMES_CORE)}])[near % 1000 + 1] AS typosquat_target,
  CAST(coalesce(near // 1000, 0) AS INT) AS typosquat_distance
 FROM (SELECT *, {O._near('lower(label)', fixed.SQUAT_NAMES_CORE, 2)} AS near FROM hosts)""")
def _(t):
    return feat.join_typosquat(t.url_corpus)


@query("join_keyword_hits", f"""
WITH k AS (SELECT unnest([{', '.join("'" + w + "'" for w in fixed.KEYWORDS_CORE + fixed.BRANDS_CORE)}]) AS keyword)
SELECT keyword, count(*) AS rows, count(DISTINCT url) AS urls FROM url_corpus JOIN k ON contains(lower(url), keyword) GROUP BY keyword""")
def _(t):
    return feat.join_keyword_hits(t.url_corpus, fixed.KEYWORDS_CORE + fixed.BRANDS_CORE)


@query("join_keyword_table", """
WITH k AS (SELECT DISTINCT lower(word) AS keyword FROM url_words WHERE word <> '')
SELECT keyword, count(*) AS rows, count(DISTINCT url) AS urls FROM url_corpus JOIN k ON contains(lower(url), keyword) GROUP BY keyword""")
def _(t):
    return lexicon.join_keyword_table(t.url_corpus, t.url_words)


@query("join_typosquat_table", "WITH " + O.parts("url_corpus") + """,
 names AS (SELECT lower(name) AS name, min(place) AS place FROM brand_names WHERE name <> '' GROUP BY lower(name)),
 near AS (SELECT l.label, arg_min((n.name, levenshtein(l.label, n.name)), (levenshtein(l.label, n.name), n.place, n.name)) AS best
  FROM (SELECT DISTINCT lower(label) AS label FROM hosts WHERE label <> '') l JOIN names n ON levenshtein(l.label, n.name) <= 2
  WHERE l.label NOT IN (SELECT name FROM names) GROUP BY l.label)
 SELECT page_id, url, h.label, best[1] AS typosquat_target, CAST(coalesce(best[2], 0) AS INT) AS typosquat_distance
 FROM hosts h LEFT JOIN near n ON n.label = lower(h.label)""")
def _(t):
    return lexicon.join_typosquat_table(t.url_corpus, t.brand_names)


#: A rule file in small: plain, nested, wildcard, exception and international rules; ``nolist`` and others are not in it.
RULE_LINES = [
    "// generic", "com", "net", "org", "info", "tk", "xyz  trailing words are no part of a rule", "", "// countries", "uk", "*.uk", "de", "fr", "es",
    "ck", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "cn", "公司.cn", "mt", "com.mt", "com",
]
_LISTED = "WITH " + O.suffix_rows(RULE_LINES) + ", "


def listed_suffixes(t: Tables) -> DataFrame:
    """The rules as their reader gives them, from a file in the shared folder."""
    path = scratch_path(t.spark, "suffix-rules")
    t.spark.createDataFrame([(line,) for line in RULE_LINES], "value STRING").write.text(path)
    return readers.src_suffix_rules(t.spark, path)


@query("join_public_suffix", _LISTED + O.parts("suffix_urls", True) + """
 SELECT page_id, url, rhost AS host, array_to_string(labels[1:greatest(0, len(labels) - nsuffix - 1)], '.') AS subdomain, label AS domain, suffix
 FROM hosts WHERE NOT rip
 UNION ALL SELECT page_id, url, rhost, '', rhost, '' FROM hosts WHERE rip""")
def _(t):
    return suffix.join_public_suffix(t.suffix_urls, listed_suffixes(t))


@query("join_typosquat_listed", _LISTED + O.parts("suffix_urls", True) + f"""
 SELECT page_id, url, label, ([{', '.join("'" + n + ".com'" for n in fixed.SQUAT_NAMES_CORE)}])[near % 1000 + 1] AS typosquat_target,
  CAST(coalesce(near // 1000, 0) AS INT) AS typosquat_distance
 FROM (SELECT *, {O._near('lower(label)', fixed.SQUAT_NAMES_CORE, 2)} AS near FROM hosts)""")
def _(t):
    return feat.join_typosquat(t.suffix_urls, suffixes=listed_suffixes(t))


@query("join_vendor_report", """
WITH r AS (SELECT rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS report_key, report FROM engine_reports)
SELECT u.page_id, u.url, rtrim(translate(to_base64(encode(u.url)), '+/', '-_'), '=') AS report_key, r.report
FROM url_corpus u LEFT JOIN r ON r.report_key = rtrim(translate(to_base64(encode(u.url)), '+/', '-_'), '=')""")
def _(t):
    reports = t.engine_reports.select(U.report_key(F.col("url")).alias("report_key"), "report")
    return match.join_vendor_report(t.url_corpus, reports)


@query("join_cache_lookup", """
SELECT s.scan_id, md5(s.url) AS cache_key, c.entry_id, c.summary, c.created_at, c.expires_at, c.entry_id IS NOT NULL AS cache_hit
FROM scan_history s LEFT JOIN (
 SELECT * FROM cache_entries QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, entry_id DESC) = 1) c
 ON c.cache_key = md5(s.url) AND c.expires_at > TIMESTAMP '2024-01-29 00:00:00'""")
def _(t):
    from ..sources.writers import snk_cache

    cache = snk_cache(t.cache_entries, t.cache_entries.limit(0))
    requests = t.scan_history.select("scan_id", F.md5("url").alias("cache_key"))
    return match.join_cache_lookup(requests, cache, "2024-01-29 00:00:00")


@query("join_scan_indicator", """
WITH s AS (SELECT url, min(created_at) AS first_scan, count(*) AS scans FROM scan_history GROUP BY url),
 i AS (SELECT url, min(first_seen) AS first_seen, max(last_seen) AS last_seen, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
  FROM threat_indicators_raw GROUP BY url)
SELECT s.url, first_scan, scans, first_seen, last_seen, sources,
 CAST(floor((epoch_us(first_scan) - epoch_us(first_seen)) / 1000000) AS BIGINT) AS lead_seconds FROM s JOIN i ON s.url = i.url""")
def _(t):
    return joined(match.join_scan_indicator(t.scan_history, t.threat_indicators_raw), "sources")


def enriched(t: Tables, suffixes: DataFrame | None = None) -> DataFrame:
    regs = t.registrations.select(
        "url", "observed_at",
        (F.to_date("observed_at") - F.col("age_at_observation")).alias("registered_at"),
    )
    certs = t.certificates.select("url", "observed_at", "ssl_valid", "ssl_issuer")
    hops = t.redirect_hops.select("url", "observed_at", "hop", "target")
    return feat.join_asof_enrich(t.scan_history.select("scan_id", "url", "created_at"), regs, certs, hops, suffixes=suffixes)


def _enriched(listed: bool = False) -> str:
    return f"""
 observed AS (SELECT url FROM url_corpus UNION SELECT url FROM registrations),
 domain_of AS (WITH {O.parts("observed", listed)} SELECT url, nullif(lower(rhost), '') AS host, lower(scheme) = 'https' AS secure,
   nullif(lower(CASE WHEN rip OR suffix = '' THEN rhost WHEN label = '' THEN suffix ELSE label || '.' || suffix END), '') AS domain FROM hosts),
 s AS (SELECT scan_id, s.url, created_at, domain, CASE WHEN secure THEN host END AS host FROM scan_history s JOIN domain_of d ON d.url = s.url),
 reg AS (SELECT domain, observed_at, max(CAST(observed_at AS DATE) - age_at_observation) AS registered_at
  FROM registrations r JOIN domain_of d ON d.url = r.url GROUP BY ALL),
 cert AS (SELECT host, observed_at, ssl_valid, ssl_issuer FROM certificates c JOIN domain_of d ON d.url = c.url),
 probe AS (SELECT url, observed_at, count(*) AS redirect_count, url || ',' || string_agg(target, ',' ORDER BY hop) AS redirect_chain
  FROM redirect_hops GROUP BY url, observed_at),
 enriched AS (SELECT s.scan_id, s.url, s.created_at,
  CAST(greatest(0, coalesce(date_diff('day', r.registered_at, CAST(s.created_at AS DATE)), 0)) AS INT) AS domain_age_days,
  coalesce(c.ssl_valid, false) AS ssl_valid, c.ssl_issuer, CAST(coalesce(p.redirect_count, 0) AS INT) AS redirect_count, p.redirect_chain
 FROM s ASOF LEFT JOIN reg r ON r.domain = s.domain AND r.observed_at <= s.created_at
  ASOF LEFT JOIN cert c ON c.host = s.host AND c.observed_at <= s.created_at
  ASOF LEFT JOIN probe p ON p.url = s.url AND p.observed_at <= s.created_at)"""


_ENRICHED = _enriched()


@query("join_asof_enrich_listed", _LISTED + _enriched(True) + " SELECT * FROM enriched")
def _(t):
    return joined(enriched(t, listed_suffixes(t)), "redirect_chain")


@query("join_asof_enrich", "WITH " + _ENRICHED + " SELECT * FROM enriched")
def _(t):
    return joined(enriched(t), "redirect_chain")


# --- features ----------------------------------------------------------------

@query("feat_core", f"WITH {_PLAIN}, {O.core('src')} SELECT {_CORE} FROM core")
def _(t):
    return joined(core(t), "redirect_chain")


_LISTED_SRC = f"{_LISTED} src AS (SELECT {O.DEFAULT_NETWORK} FROM suffix_urls), "


@query("feat_core_listed", _LISTED_SRC + O.core("src", True) + f" SELECT {_CORE} FROM core")
def _(t):
    return joined(feat.feat_core(t.suffix_urls, listed_suffixes(t)), "redirect_chain")


@query("feat_lexical17_listed", _LISTED + O.lexical17("suffix_urls", True) + f" SELECT page_id, url, {', '.join(fixed.VECTOR17)} FROM lexical")
def _(t):
    return feat.feat_lexical17(t.suffix_urls, listed_suffixes(t))


@query("feat_vector11", f"WITH {_PLAIN}, {O.core('src')} SELECT page_id, url, concat_ws(',', " + ", ".join(
    f"CAST({c} AS INT)" for c in fixed.VECTOR11) + ") AS raw, concat_ws(',', " + ", ".join(
    f"CAST({'least(domain_age_days, 3650)' if c == 'domain_age_days' else 'least(url_length, 500)' if c == 'url_length' else c} AS INT)"
    for c in fixed.VECTOR11) + ") AS clipped FROM core")
def _(t):
    vectors = feat.feat_vector11(core(t))
    for c in ("raw", "clipped"):
        vectors = vectors.withColumn(c, F.array_join(F.col(c).cast("array<int>"), ","))
    return vectors


@query("feat_lexical17", f"WITH {O.lexical17('url_corpus')} SELECT page_id, url, {', '.join(fixed.VECTOR17)} FROM lexical")
def _(t):
    return feat.feat_lexical17(t.url_corpus)


_L32 = (
    "url_length domain_length path_length query_length num_dots num_hyphens num_underscores num_slashes num_equals num_at_symbols "
    "num_question_marks num_ampersands num_digits digit_ratio special_char_ratio digit_ratio_domain has_https has_ip_address "
    "has_double_slash has_at_symbol has_suspicious_tld is_free_tld has_suspicious_keywords uses_shortener domain_has_hyphen "
    "num_subdomains num_query_params domain_entropy brand_in_path path_has_php num_encoded_chars typosquat_distance"
).split()


@query("feat_lexical32", f"WITH {O.lexical32('url_corpus')} SELECT page_id, url, {', '.join(_L32)} FROM lexical")
def _(t):
    return feat.feat_lexical32(t.url_corpus)


@query("feat_entropy", f"WITH {O.lexical32('url_corpus')} SELECT page_id, url, domain, domain_entropy FROM lexical")
def _(t):
    return feat.feat_entropy(t.url_corpus)


_CHAR = """
 words AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(url), '\\s+'), lambda w: w <> '')) AS w FROM url_corpus),
 padded AS (SELECT page_id, ' ' || w || ' ' AS w FROM words),
 sized AS (SELECT page_id, w, unnest(range(2, least(6, length(w)) + 1)) AS n FROM padded),
 grams AS (SELECT page_id, substr(w, unnest(range(1, length(w) - n + 2)), n) AS term FROM sized),
 counted AS (SELECT page_id, term, count(*) AS tf FROM grams GROUP BY ALL),
 vocabulary AS (SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS document_count FROM counted GROUP BY term
  ORDER BY corpus_count DESC, term LIMIT 10000)"""
_TOKEN = """
 grams AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(url), '[/?=&._\\-]'), lambda w: w <> '')) AS term FROM url_corpus),
 counted AS (SELECT page_id, term, count(*) AS tf FROM grams GROUP BY ALL),
 vocabulary AS (SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS document_count FROM counted GROUP BY term
  ORDER BY corpus_count DESC, term LIMIT 2000)"""


@query("feat_char_ngrams", "WITH " + _CHAR + " SELECT * FROM vocabulary")
def _(t):
    return text.feat_char_ngrams(t.url_corpus)


@query("feat_token_terms", "WITH " + _TOKEN + " SELECT * FROM vocabulary")
def _(t):
    return text.feat_token_terms(t.url_corpus)


def _tfidf(terms: str) -> str:
    return "WITH " + terms + """,
 n AS (SELECT count(*) AS n FROM url_corpus),
 w AS (SELECT c.page_id, c.term, (1 + ln(tf)) * (ln((1.0 + n.n) / (1 + v.document_count)) + 1) AS w
  FROM counted c JOIN vocabulary v ON v.term = c.term CROSS JOIN n)
SELECT page_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY page_id)), 6) AS weight FROM w"""


@query("feat_tfidf", _tfidf(_TOKEN))
def _(t):
    vocabulary = text.feat_token_terms(t.url_corpus)
    return rounded(text.feat_tfidf(t.url_corpus, vocabulary, "token"), "weight", digits=6)


@query("feat_tfidf_char", _tfidf(_CHAR))
def _(t):
    vocabulary = text.feat_char_ngrams(t.url_corpus)
    return rounded(text.feat_tfidf(t.url_corpus, vocabulary, "char"), "weight", digits=6)


@query("feat_scale", f"WITH {_PLAIN}, {O.core('src')} SELECT page_id, url, " + ", ".join(
    f"round(coalesce((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 0), 6) + 0 AS {c}"
    for c in fixed.VECTOR11) + " FROM core")
def _(t):
    scaled = feat.feat_scale(core(t))
    return scaled.select("page_id", "url", *[(F.round(c, 6) + 0).alias(c) for c in fixed.VECTOR11])


_FLAGS = ["ssl_valid", "has_ip_address", "has_suspicious_keywords", "has_https", "suspicious_tld"]
_NUMBERS = ["domain_age_days", "redirect_count", "typosquat_distance", "url_length", "path_depth", "subdomain_count"]


@query("feat_risk_profile", "WITH " + _ENRICHED + ", " + O.core("enriched") + """,
 labelled_scans AS (SELECT c.*, h.verdict AS label2 FROM core c JOIN scan_history h ON h.scan_id = c.scan_id)
SELECT label2 AS label, count(*) AS urls, """ + ", ".join(
    [f"round(avg(CAST({c} AS INT)), 6) AS share_{c}" for c in _FLAGS]
    + [f"round(avg({c}), 6) AS mean_{c}" for c in _NUMBERS]
    + [f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in _NUMBERS]
    + [f"round(quantile_cont({c}, 0.9), 6) AS p90_{c}" for c in _NUMBERS]) + " FROM labelled_scans GROUP BY label2")
def _(t):
    labels = t.scan_history.select("scan_id", F.col("verdict").alias("label"))
    profile = feat.feat_risk_profile(feat.feat_core(enriched(t)).join(labels, "scan_id"))
    return rounded(profile, *[c for c in profile.columns if c not in ("label", "urls")], digits=6)


# --- vendor reports ----------------------------------------------------------

_ENGINE = """
WITH a AS (SELECT url, json_extract(report, '$.data.attributes') AS a FROM engine_reports),
 c AS (SELECT url, CAST(json_extract(a, '$.last_analysis_stats.malicious') AS BIGINT) AS malicious_count,
  CAST(json_extract(a, '$.last_analysis_stats.suspicious') AS BIGINT) AS suspicious_count,
  CAST(json_extract(a, '$.last_analysis_stats.harmless') AS BIGINT) AS harmless, CAST(json_extract(a, '$.reputation') AS INT) AS reputation,
  json_extract(a, '$.last_analysis_results') AS results FROM a),
 e AS (SELECT url, unnest(range(0, 8)) AS i, results FROM c),
 f AS (SELECT url, i, json_extract_string(results, concat('$.engine', i, '.result')) AS result FROM e
  WHERE json_extract_string(results, concat('$.engine', i, '.category')) IN ('malicious', 'suspicious')),
 g AS (SELECT url, array_to_string(list(concat('engine', i, '=', result) ORDER BY i), ',') AS threats FROM f GROUP BY url)
SELECT c.url, malicious_count, suspicious_count, malicious_count + suspicious_count + harmless AS total_engines, reputation,
 coalesce(threats, '') AS threats, CASE WHEN malicious_count > suspicious_count THEN 'malware' ELSE 'suspicious' END AS threat_type
FROM c LEFT JOIN g ON g.url = c.url WHERE malicious_count > 0 OR suspicious_count > 0"""


@query("vendor_multi_engine", _ENGINE.replace("FROM engine_reports", "FROM vendor_engine_reports"))
def _(t):
    from ..operators import vendors

    found = vendors.vendor_multi_engine(t.vendor_engine_reports).drop("first_submitted", "last_analysis")
    pairs = F.transform("threats", lambda x: F.concat(x["engine"], F.lit("="), x["result"]))
    return found.withColumn("threats", F.array_join(pairs, ","))


_BLOCKLIST = """
WITH m AS (SELECT url, p % 16 AS k FROM corpus_urls)
SELECT b.url, CASE WHEN contains(b.report, 'SOCIAL_ENGINEERING') THEN 'phishing' ELSE 'malware' END AS threat_type,
 CASE k WHEN 1 THEN 'MALWARE,SOCIAL_ENGINEERING' ELSE 'MALWARE' END AS threat_types,
 CASE k WHEN 1 THEN 'ANY_PLATFORM' ELSE 'WINDOWS' END AS platforms, CASE k WHEN 1 THEN '300s' ELSE '100s' END AS cache_duration
FROM blocklist_reports b JOIN m ON m.url = b.url WHERE k IN (1, 2)"""


@query("vendor_blocklist", """
WITH m AS (SELECT url, p % 3 AS k FROM corpus_urls)
SELECT b.url, CASE WHEN contains(b.report, 'SOCIAL_ENGINEERING') THEN 'phishing' ELSE 'malware' END AS threat_type,
 CASE k WHEN 1 THEN 'MALWARE,SOCIAL_ENGINEERING' ELSE 'MALWARE' END AS threat_types,
 CASE k WHEN 1 THEN 'ANY_PLATFORM' ELSE 'WINDOWS' END AS platforms, CASE k WHEN 1 THEN '300s' ELSE '100s' END AS cache_duration
FROM vendor_blocklist_reports b JOIN m ON m.url = b.url WHERE k <> 0""")
def _(t):
    from ..operators import vendors

    return joined(vendors.vendor_blocklist(t.vendor_blocklist_reports), "threat_types", "platforms")


_HISTORY = """
WITH e AS (SELECT url, report, unnest(range(0, 12)) AS i FROM domain_reports),
 f AS (SELECT url, i, CAST(json_extract(report, '$.total') AS BIGINT) AS total_scans,
  json_extract_string(report, concat('$.results[', i, ']._id')) AS id, json_extract_string(report, concat('$.results[', i, '].task.time')) AS seen FROM e
  WHERE json_extract_string(report, concat('$.results[', i, '].verdicts.overall.malicious')) = 'true'
   OR (json_extract_string(report, concat('$.results[', i, '].task.method')) = 'automatic'
    AND CAST(json_extract(report, concat('$.results[', i, '].stats.phishing')) AS INT) > 0))
SELECT url, total_scans, CAST(count(*) AS INT) AS malicious_count, array_to_string(list(id ORDER BY i), ',') AS scan_ids,
 arg_min(seen, i) AS first_seen FROM f GROUP BY url, total_scans"""


@query("vendor_scan_history", _HISTORY.replace("FROM domain_reports", "FROM vendor_domain_reports"))
def _(t):
    from ..operators import vendors

    return joined(vendors.vendor_scan_history(t.vendor_domain_reports), "scan_ids")


_LOOKUP = """
SELECT url, json_extract_string(report, '$.threat') AS threat_type, json_extract_string(report, '$.id') AS id,
 json_extract_string(report, '$.url_status') AS status, array_to_string(from_json(json_extract(report, '$.tags'), '["VARCHAR"]'), ',') AS tags,
 json_extract_string(report, '$.urlhaus_reference') AS urlhaus_link, json_extract_string(report, '$.date_added') AS date_added,
 json_extract_string(report, '$.tld_guess') AS target
FROM lookup_reports WHERE json_valid(report) AND json_extract_string(report, '$.query_status') = 'ok' AND json_extract_string(report, '$.threat') <> ''"""


@query("vendor_url_lookup", _LOOKUP)
def _(t):
    from ..operators import vendors

    return joined(vendors.vendor_url_lookup(t.lookup_reports), "tags")


def checked_everywhere(t: Tables) -> DataFrame:
    """What feeds, the four stored-report jobs and posts say of the corpus."""
    from ..operators import posts, vendors

    domains = t.url_corpus.select(U.page_domain(F.col("url")).alias("domain")).filter("domain <> ''")
    reports = [
        match.report_hits(vendors.vendor_url_lookup(t.lookup_reports), "urlhaus"),
        match.report_hits(vendors.vendor_multi_engine(t.engine_reports), "virustotal"),
        match.report_hits(vendors.vendor_blocklist(t.blocklist_reports), "google_safebrowsing"),
        match.report_hits(vendors.vendor_scan_history(t.domain_reports), "urlscan"),
        match.mention_hits(t.url_corpus, posts.post_mentions(t.posts, domains, as_of=AS_OF)),
    ]
    return match.check_all_sources(t.url_corpus, t.threat_indicators_raw, *reports)


def _texts(c: str) -> str:
    return f"string_split({c}, ',')"


# What every source says, from the stored reports themselves; details as JSON of their non-null fields.
_KNOWN = O.feed_hits("url_corpus") + f""",
 feed_row AS (SELECT url, source, ordinal, min(threat_type) FILTER (threat_type <> '') AS threat_type,
  max(target_brand) FILTER (target_brand <> '') AS target_brand FROM hit GROUP BY ALL),
 mentioned AS (WITH asked AS (SELECT DISTINCT url, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www\\.', '', 'g') AS domain
   FROM url_corpus),
  strong AS ({MENTIONS} SELECT s.*, p.permalink, p.created_utc FROM s JOIN posts p ON p.post_id = s.post_id),
  told AS (SELECT domain, to_json({{'total_mentions': count(*), 'mentions': list({{'post_id': post_id, 'title': title, 'score': score, 'permalink': permalink,
    'created_utc': created_utc}} ORDER BY place, score DESC, post_id)}})::VARCHAR AS details FROM strong GROUP BY domain HAVING count(*) >= 2)
  SELECT url, details FROM asked JOIN told ON told.domain = asked.domain),
 said_row AS (
  SELECT url, source, ordinal, 0 AS rank, threat_type, target_brand, CASE WHEN threat_type IS NULL AND target_brand IS NULL THEN '{{}}'
   WHEN threat_type IS NULL THEN to_json({{'target_brand': target_brand}})::VARCHAR WHEN target_brand IS NULL THEN to_json({{'threat_type': threat_type}})::VARCHAR
   ELSE to_json({{'threat_type': threat_type, 'target_brand': target_brand}})::VARCHAR END AS details FROM feed_row
  UNION ALL SELECT url, 'urlhaus', 1, 1, threat_type, NULL, to_json({{'id': id, 'status': status, 'tags': {_texts("tags")}, 'urlhaus_link': urlhaus_link,
   'date_added': date_added}})::VARCHAR FROM ({_LOOKUP})
  UNION ALL SELECT url, 'virustotal', 3, 2, threat_type, NULL, to_json({{'malicious_count': malicious_count, 'suspicious_count': suspicious_count,
   'total_engines': total_engines, 'reputation': reputation, 'threats': list_transform(list_filter({_texts("threats")}, lambda x: x <> ''),
    lambda x: {{'engine': split_part(x, '=', 1), 'result': split_part(x, '=', 2)}})}})::VARCHAR FROM ({_ENGINE})
  UNION ALL SELECT url, 'google_safebrowsing', 4, 3, threat_type, NULL, to_json({{'threat_types': {_texts("threat_types")}, 'platforms': {_texts("platforms")},
   'cache_duration': cache_duration}})::VARCHAR FROM ({_BLOCKLIST})
  UNION ALL SELECT url, 'urlscan', 5, 4, NULL, NULL, to_json({{'total_scans': total_scans, 'malicious_count': malicious_count, 'scan_ids': {_texts("scan_ids")},
   'first_seen': first_seen}})::VARCHAR FROM ({_HISTORY})
  UNION ALL SELECT url, 'reddit', 6, 5, 'reported', NULL, details FROM mentioned),
 one_row AS (SELECT * FROM said_row QUALIFY row_number() OVER (PARTITION BY url, source ORDER BY rank) = 1),
 feed_said AS (SELECT url, string_agg(source, ',' ORDER BY ordinal) AS sources, arg_min(threat_type, ordinal) AS threat_type,
  string_agg('known_threat:' || source, ',' ORDER BY ordinal) AS matched_rules, CAST(count(*) AS INT) AS n_details,
  string_agg(chr(10) || '- ' || source || ': ' || details, '' ORDER BY ordinal) AS details FROM one_row GROUP BY url)"""


@query("check_all_sources", "WITH " + _KNOWN + """
SELECT url, sources, threat_type, 'phishing' AS verdict, n_details, details FROM feed_said""")
def _(t):
    out = checked_everywhere(t)
    kept = out.select(
        "url", "sources", "threat_type", "verdict", F.size("details").alias("n_details"),
        F.array_join(F.transform("details", lambda d: F.concat(F.lit("\n- "), d["source"], F.lit(": "), d["details"])), "").alias("details"))
    return joined(kept, "sources")


# --- rules and scores --------------------------------------------------------

_RULES = f"WITH {_PLAIN}, {O.rules('src')}"
_JUDGED = f"WITH {_PLAIN}, {O.verdicts('src', 'page_id')}"


@query("rule_eval", _RULES + " SELECT page_id, url, rule_name, triggered, severity, description, score FROM rated")
def _(t):
    return rules.rule_eval(core(t))


@query("rule_verdict", _JUDGED + """
 SELECT page_id, url, round(risk_score, 9) AS risk_score, matched_rules, verdict, round(confidence, 9) AS confidence FROM judged""")
def _(t):
    judged = rules.rule_verdict(core(t)).select("page_id", "url", "risk_score", "matched_rules", "verdict", "confidence")
    return rounded(joined(judged, "matched_rules"), "risk_score", "confidence")


@query("rule_hit_stats", "WITH " + _ENRICHED + ", " + O.rules("enriched") + """
 SELECT rule_name, count(*) AS hits, round(avg(score), 9) AS mean_score, count(*) FILTER (severity = 'low') AS hits_low,
  count(*) FILTER (severity = 'medium') AS hits_medium, count(*) FILTER (severity = 'high') AS hits_high,
  count(*) FILTER (severity = 'critical') AS hits_critical FROM rated WHERE triggered GROUP BY rule_name""")
def _(t):
    return rounded(rules.rule_hit_stats(feat.feat_core(enriched(t))), "mean_score")


_ML = """CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 5 >= 2 THEN 'phishing' ELSE 'safe' END"""
_MLC = """CAST(50 + page_id * 7 % 50 AS DOUBLE) / 100"""


@query("score_combine", _JUDGED + f""",
 m AS (SELECT *, {_ML} AS ml_verdict, {_MLC} AS ml_confidence FROM judged),
 s AS (SELECT *, 0.6 * CASE WHEN ml_verdict = 'phishing' THEN ml_confidence ELSE 1 - ml_confidence END + 0.4 * risk_score AS s FROM m),
 d AS (SELECT *, CASE WHEN s >= 0.6 THEN 'phishing' WHEN s >= 0.3 THEN 'suspicious' ELSE 'safe' END AS v,
  CASE WHEN s >= 0.6 THEN least(0.7 + s * 0.29, 0.99) WHEN s >= 0.3 THEN 0.5 + s * 0.2 ELSE 0.7 + (1 - s) * 0.25 END AS c FROM s)
 SELECT page_id, url, CASE WHEN ml_verdict IS NULL THEN verdict WHEN contains(matched_rules, 'suspicious_pattern') THEN 'phishing' ELSE v END AS verdict,
  round(CASE WHEN ml_verdict IS NULL THEN confidence WHEN contains(matched_rules, 'suspicious_pattern') THEN greatest(c, 0.9) ELSE c END, 9) AS confidence
 FROM d""")
def _(t):
    scored = rated(t).withColumn("ml_verdict", F.expr(_ML)).withColumn("ml_confidence", F.expr(_MLC))
    return rounded(verdict.score_combine(scored).select("page_id", "url", "verdict", "confidence"), "confidence")


@query("score_importance", _RULES + "," + O.importance("page_id") + """,
 ml(feature, m) AS (VALUES ('url_length', 0.5), ('has_https', 0.25), ('feature_0', 0.25)),
 names AS (SELECT feature FROM named UNION SELECT feature FROM ml),
 mixed AS (SELECT p.page_id, p.url, n.feature, 0.6 * coalesce(ml.m, 0) + 0.4 * coalesce(w.weight, 0) AS x
  FROM url_corpus p CROSS JOIN names n LEFT JOIN ml ON ml.feature = n.feature
  LEFT JOIN weighed w ON w.page_id = p.page_id AND w.feature = n.feature)
 SELECT page_id, url, feature, round(x / max(x) OVER (PARTITION BY page_id), 9) AS importance FROM mixed""")
def _(t):
    weights = {"url_length": 0.5, "has_https": 0.25, "feature_0": 0.25}
    return rounded(verdict.score_importance(rated(t), weights), "importance")


_ANALYZED = "WITH " + _ENRICHED + ", " + O.verdicts("enriched", "scan_id") + ", " + O.importance("scan_id") + ", " + _KNOWN + """,
 analyzed AS (SELECT j.scan_id, j.url, CASE WHEN f.url IS NOT NULL THEN 'phishing' ELSE j.verdict END AS verdict,
  round(CASE WHEN f.url IS NOT NULL THEN 0.98 ELSE j.confidence END, 9) AS confidence,
  CASE WHEN f.url IS NOT NULL THEN f.matched_rules ELSE j.matched_rules END AS matched_rules, f.sources, f.threat_type, f.details,
  CASE WHEN f.url IS NOT NULL THEN 'threat_feed' ELSE 'rules' END AS prediction_source
  FROM judged j LEFT JOIN feed_said f ON f.url = j.url)"""


def analyzed(t: Tables) -> DataFrame:
    return verdict.analyze_urls(enriched(t), known=checked_everywhere(t))


@query("analyze_urls", _ANALYZED + """
 SELECT a.* EXCLUDE (details), CASE WHEN a.prediction_source = 'threat_feed' THEN 'threat_feed_match=1.000000' ELSE w.importance END AS importance
 FROM analyzed a JOIN (SELECT scan_id, string_agg(feature || '=' || printf('%.6f', weight), ',' ORDER BY feature) AS importance
  FROM weighed GROUP BY scan_id) w ON w.scan_id = a.scan_id""")
def _(t):
    pairs = F.transform(
        F.array_sort(F.map_entries("feature_importance")),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])),
    )
    out = analyzed(t).withColumn("importance", F.array_join(pairs, ",")).select(
        "scan_id", "url", "verdict", "confidence", "matched_rules", "sources", "threat_type", "prediction_source", "importance")
    return rounded(joined(out, "matched_rules", "sources"), "confidence")


_ABSOLUTE = f"(coalesce(regexp_extract(url, '{fixed.URL_PATTERN}', 1) <> '' AND regexp_extract(url, '{fixed.URL_PATTERN}', 2) <> '', false))"
_BATCH = "WITH src AS (SELECT " + O.DEFAULT_NETWORK + " FROM submitted), " + O.verdicts("src", "page_id") + ", " + _KNOWN + f""",
 batch AS (SELECT j.page_id, j.url, CASE WHEN NOT {_ABSOLUTE.replace("(url", "(j.url")} THEN 'error' WHEN f.url IS NOT NULL THEN 'phishing' ELSE j.verdict END AS verdict
  FROM judged j LEFT JOIN feed_said f ON f.url = j.url)"""


def batch(t: Tables) -> DataFrame:
    """A batch as it is handed in: NULL, blank and unparseable lines among the URLs."""
    return verdict.analyze_urls(t.submitted, known=checked_everywhere(t))


@query("batch_report", _BATCH + """
 SELECT count(*) FILTER (verdict <> 'error') AS processed, count(*) FILTER (verdict = 'error') AS failed, count(*) FILTER (verdict = 'phishing') AS phishing,
  count(*) FILTER (verdict = 'safe') AS safe, count(*) FILTER (verdict = 'suspicious') AS suspicious FROM batch""")
def _(t):
    return verdict.batch_report(batch(t))


@query("batch_ranked", _BATCH + """
 SELECT page_id, url, verdict, CASE verdict WHEN 'phishing' THEN 0 WHEN 'error' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'safe' THEN 3 ELSE 9 END AS urgency
 FROM batch ORDER BY urgency, url""")
def _(t):
    return verdict.batch_ranked(batch(t).select("page_id", "url", "verdict"))


# --- explanations ------------------------------------------------------------

_EXPLAIN = _ANALYZED + """,
 full_result AS (SELECT a.*, c.* EXCLUDE (scan_id, url) FROM analyzed a JOIN core c ON c.scan_id = a.scan_id)"""


_TOLD = _EXPLAIN + f""",
 p AS (SELECT *, printf('%.0f%%', confidence * 100) AS pct, sources IS NOT NULL AS known, replace(sources, ',', ', ') AS feeds,
  CASE WHEN matched_rules = '' THEN 0 ELSE len(string_split(matched_rules, ',')) END AS n FROM full_result),
 told AS (SELECT scan_id, url, verdict, confidence,
  CASE WHEN known THEN printf('{explain.SUMMARY_FEED}', feeds, pct) ELSE printf('{explain.SUMMARY_RULES}', verdict, pct) END AS summary,
  CASE WHEN known THEN printf('{explain.EXPLAINED_FEED}', url, feeds) ELSE printf('{explain.EXPLAINED_RULES}', url, n, verdict) END AS explanation,
  coalesce(nullif(concat_ws(';', CASE WHEN known THEN '{explain.TEXT_FEED}' || feeds END,
   CASE WHEN typosquat_target IS NOT NULL THEN '{explain.TEXT_SQUAT}' || typosquat_target END,
   CASE WHEN domain_age_days BETWEEN 1 AND 29 THEN 'Recently registered domain (' || domain_age_days || ' days old)' END,
   CASE WHEN NOT ssl_valid THEN '{explain.TEXT_SSL}' END, CASE WHEN has_ip_address THEN '{explain.TEXT_IP}' END,
   CASE WHEN suspicious_tld THEN '{explain.TEXT_TLD}' END, CASE WHEN has_suspicious_keywords THEN '{explain.TEXT_KEYWORDS}' END,
   CASE WHEN redirect_count > 2 THEN 'Multiple redirects (' || redirect_count || ')' END), ''), '{explain.TEXT_NONE}') AS risk_factors,
  CASE WHEN verdict = 'phishing' AND known THEN 'critical' WHEN verdict = 'phishing' THEN 'high' WHEN verdict = 'suspicious' THEN 'medium' ELSE 'low' END AS severity,
  CASE verdict WHEN 'phishing' THEN '{explain.ACTION_PHISHING}' WHEN 'suspicious' THEN '{explain.ACTION_SUSPICIOUS}' ELSE '{explain.ACTION_SAFE}' END AS recommended_action,
  typosquat_target AS target_brand FROM p)"""


@query("explain_rules", _TOLD + " SELECT * FROM told")
def _(t):
    return rounded(joined(explain.explain_rules(analyzed(t)), "risk_factors", sep=";"), "confidence")


@query("snk_scan_records", _TOLD + """
 SELECT t.scan_id, t.url, t.verdict, t.confidence, t.severity, t.target_brand, c.url_length, c.has_https, c.typosquat_distance, c.domain_age_days, c.ssl_issuer,
  c.redirect_chain, a.matched_rules, a.sources, a.details, a.prediction_source, t.summary, t.explanation, t.risk_factors, t.recommended_action,
  CAST(h.created_at AS DATE) AS scan_date, CASE WHEN a.prediction_source = 'threat_feed' THEN 1.0 ELSE round(w.weight, 6) END AS top_weight
 FROM told t JOIN core c ON c.scan_id = t.scan_id JOIN analyzed a ON a.scan_id = t.scan_id JOIN scan_history h ON h.scan_id = t.scan_id
 JOIN (SELECT scan_id, max(weight) AS weight FROM weighed GROUP BY scan_id) w ON w.scan_id = t.scan_id""")
def _(t):
    """Whole scan records written by day and read back."""
    path = scratch_path(t.spark, "scan-records")
    writers.snk_scans(writers.scan_records(analyzed(t)), path)
    back = t.spark.read.parquet(path)
    lines = F.transform("details", lambda d: F.concat(F.lit("\n- "), d["source"], F.lit(": "), d["details"]))
    out = back.select(
        "scan_id", "url", "verdict", "confidence", "severity", "target_brand",
        *[F.col(f"features.{c}").alias(c) for c in ("url_length", "has_https", "typosquat_distance", "domain_age_days", "ssl_issuer", "redirect_chain")],
        "matched_rules", "sources", F.array_join(lines, "").alias("details"), "prediction_source",
        *[F.col(f"ai_explanation.{c}").alias(c) for c in ("summary", "explanation", "risk_factors", "recommended_action")],
        "scan_date", F.round(F.array_max(F.map_values("feature_importance")), 6).alias("top_weight"),
    )
    return rounded(joined(joined(out, "redirect_chain", "matched_rules", "sources"), "risk_factors", sep=";"), "confidence")


@query("explain_prompts", _EXPLAIN + f""",
 h AS (SELECT *, concat('URL: ', url, chr(10), 'Verdict: ', verdict, chr(10), 'Confidence: ', printf('%.2f%%', confidence * 100)) AS head FROM full_result)
 SELECT scan_id, url, verdict, CASE WHEN verdict = 'safe' THEN concat('This scanned URL looks safe. Confirm briefly.', chr(10), chr(10), head)
  ELSE concat('Judge how risky the URL below is.', chr(10), chr(10), head,
   CASE WHEN sources IS NOT NULL THEN chr(10) || 'Listed by threat feeds: ' || replace(sources, ',', ', ') || details ELSE '' END, chr(10), 'Features:', chr(10),
   '- Domain age (days): ', domain_age_days, chr(10), '- SSL valid: ', ssl_valid, chr(10), '- SSL issuer: ', coalesce(ssl_issuer, 'Unknown'), chr(10),
   '- Redirects: ', redirect_count, chr(10), '- Typosquat target: ', coalesce(typosquat_target, 'None'), chr(10), '- Typosquat distance: ', typosquat_distance, chr(10),
   '- IP address as host: ', has_ip_address, chr(10), '- URL length: ', url_length, chr(10), '- Path depth: ', path_depth, chr(10), '- Subdomains: ', subdomain_count, chr(10),
   '- HTTPS: ', has_https, chr(10), '- Suspicious keywords: ', has_suspicious_keywords, chr(10), '- Suspicious TLD: ', suspicious_tld, chr(10),
   'Matched rules: ', CASE WHEN matched_rules = '' THEN 'None' ELSE replace(matched_rules, ',', ', ') END) END
  || chr(10) || chr(10) || 'Reply with one JSON object and nothing else. Fields: {explain.REPLY_FIELDS}.' AS prompt FROM h""")
def _(t):
    return explain.explain_prompts(analyzed(t))


@query("explain_ingest", """
WITH c AS (SELECT doc_id, reply, trim(regexp_replace(regexp_replace(trim(reply, chr(10) || chr(9) || ' '), '^```(json)?', ''), '```$', ''), chr(10) || chr(9) || ' ') AS body FROM replies),
 j AS (SELECT doc_id, reply, CASE WHEN json_valid(body) AND starts_with(body, '{') THEN body END AS j FROM c)
SELECT doc_id, CASE WHEN j IS NULL THEN 'Unable to generate AI explanation' ELSE coalesce(json_extract_string(j, '$.summary'), 'Analysis completed') END AS summary,
 CASE WHEN j IS NULL THEN reply ELSE coalesce(json_extract_string(j, '$.explanation'), 'Unable to generate detailed explanation') END AS explanation,
 coalesce(array_to_string(from_json(json_extract(j, '$.risk_factors'), '["VARCHAR"]'), ','), '') AS risk_factors,
 CASE WHEN json_extract_string(j, '$.severity') IN ('low', 'medium', 'high', 'critical') THEN json_extract_string(j, '$.severity') ELSE 'medium' END AS severity,
 coalesce(json_extract_string(j, '$.recommended_action'), 'Review manually') AS recommended_action, json_extract_string(j, '$.target_brand') AS target_brand
FROM j""")
def _(t):
    return joined(explain.explain_ingest(t.replies), "risk_factors")


@query("explain_cache_key", "WITH " + _ENRICHED + ", " + O.core("enriched") + """,
 k AS (SELECT url, sha256(concat('{"features": {"domain_age_days": ', domain_age_days, ', "has_https": ', has_https, ', "has_ip_address": ', has_ip_address,
  ', "has_suspicious_keywords": ', has_suspicious_keywords, ', "path_depth": ', path_depth, ', "redirect_count": ', redirect_count, ', "ssl_valid": ', ssl_valid,
  ', "subdomain_count": ', subdomain_count, ', "suspicious_tld": ', suspicious_tld, ', "typosquat_distance": ', typosquat_distance,
  ', "typosquat_target": ', coalesce('"' || typosquat_target || '"', 'null'), ', "url_length": ', url_length, '}, "url": "', url, '"}')) AS cache_key FROM core)
SELECT cache_key, url, count(*) AS scans FROM k GROUP BY ALL""")
def _(t):
    return explain.explain_cache_key(feat.feat_core(enriched(t)))
