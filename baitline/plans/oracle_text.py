"""SQL fragments shared by the oracles of the URL queries.

They say in SQL what the operators say with column expressions, written
separately so that a mistake in one does not hide in the other.
"""

from __future__ import annotations

from ..functions import fixed


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(column: str, words: list[str]) -> str:
    return f"{column} IN ({', '.join(_q(w) for w in words)})"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _brand_misused(text: str, host: str, brands: list[str]) -> str:
    return "(" + " OR ".join(
        f"(contains({text}, {_q(b)}) AND {host} NOT IN ({_q(b)}, {_q(b + '.com')}))" for b in brands) + ")"


def _near(label: str, names: list[str], within: int) -> str:
    """distance * 1000 + ordinal of the nearest name, NULL if none or exact."""
    cases = ", ".join(
        f"CASE WHEN levenshtein({label}, {_q(n)}) <= {within} THEN levenshtein({label}, {_q(n)}) * 1000 + {i} END"
        for i, n in enumerate(names))
    return f"CASE WHEN NOT ({_in(label, names)}) THEN least({cases}) END"


def suffix_rows(lines: list[str]) -> str:
    """CTE ``listed_suffix``: the rules of a suffix file, international ones in both spellings."""
    rows = set()
    for line in lines:
        rule = line.split("//")[0].strip().lower() if line.lstrip().startswith("//") else (line.split() or [""])[0].lower()
        extra = 1 if rule.startswith("*.") else -1 if rule.startswith("!") else 0
        ending = rule.removeprefix("*.").removeprefix("!")
        if ending:
            rows |= {(ending, extra), (ending.encode("idna").decode(), extra)}
    return "listed_suffix(ending, extra) AS (VALUES " + ", ".join(f"({_q(e)}, {x})" for e, x in sorted(rows)) + ")"


_BY_RULES = """
ending AS (SELECT DISTINCT lower(rhost) AS h, string_split(lower(rhost), '.') AS ls FROM labelled),
walked AS (SELECT h, ls, unnest(range(len(ls))) AS i FROM ending),
suffix_of AS (SELECT h, coalesce(max(len(ls) - i - 1) FILTER (extra < 0), max(len(ls) - i + extra)) AS n
  FROM walked JOIN listed_suffix l ON l.ending = array_to_string(ls[i + 1:], '.') WHERE extra < 1 OR i > 0 GROUP BY h),
counted AS (SELECT b.*, CASE WHEN rip OR len(labels) < 2 THEN 0 ELSE coalesce(s.n, 1) END AS nsuffix FROM labelled b
  LEFT JOIN suffix_of s ON s.h = lower(b.rhost)),"""


def parts(source: str, listed: bool = False) -> str:
    """CTEs ``parts`` and ``hosts``: the URL split and the host's labels.

    ``listed``: suffixes by the rules of CTE ``listed_suffix`` (see ``suffix_rows``).
    """
    u = fixed.URL_PATTERN.replace("'", "''")
    ip = fixed.IPV4_PATTERN
    shipped = f"""
counted AS (SELECT *, CASE WHEN rip OR len(labels) < 2 THEN 0
  WHEN regexp_matches(lower(array_to_string(labels[-2:], '.')), '^({'|'.join(fixed.SUFFIX_SECOND_LEVELS)})\\.[a-z]{{2}}$')
   OR {_in("lower(array_to_string(labels[-2:], '.'))", fixed.SUFFIXES_TWO_LABELS)} THEN 2 ELSE 1 END AS nsuffix FROM labelled),"""
    return f"""
parts AS (SELECT *, lower(url) AS low, lower(regexp_extract(url, '{u}', 1)) AS scheme, regexp_extract(url, '{u}', 2) AS netloc,
  regexp_replace(regexp_extract(url, '{u}', 3), ';[^/]*$', '') AS path, regexp_extract(url, '{u}', 4) AS query,
  rtrim(split_part(list_last(string_split(regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?([^/?#]*)', 1), '@')), ':', 1), '.') AS rhost
  FROM {source}),
labelled AS (SELECT *, split_part(netloc, ':', 1) AS host, string_split(rhost, '.') AS labels, regexp_matches(rhost, '{ip}') AS rip,
  regexp_matches(split_part(netloc, ':', 1), '{ip}') AS ip FROM parts),{_BY_RULES if listed else shipped}
hosts AS (SELECT *, CASE WHEN rip THEN rhost WHEN len(labels) - nsuffix >= 1 THEN labels[len(labels) - nsuffix] ELSE '' END AS label,
  CASE WHEN nsuffix = 0 THEN '' ELSE array_to_string(labels[len(labels) - nsuffix + 1:], '.') END AS suffix,
  CASE WHEN rip THEN 0 ELSE greatest(0, len(labels) - nsuffix - 1) END AS nsub FROM counted)"""


DEFAULT_NETWORK = (
    "*, 0 AS domain_age_days, false AS ssl_valid, CAST(NULL AS VARCHAR) AS ssl_issuer, "
    "0 AS redirect_count, CAST(NULL AS VARCHAR) AS redirect_chain"
)


def core(source: str, listed: bool = False) -> str:
    """CTE ``core``: the 14 features.  ``source`` has the network columns."""
    targets = ", ".join(_q(f"{n}.com") for n in fixed.SQUAT_NAMES_CORE)
    return parts(source, listed) + f""",
owned AS (SELECT *, lower(CASE WHEN ip THEN host WHEN label = '' OR suffix = '' THEN netloc ELSE label || '.' || suffix END) AS owner,
  CASE WHEN NOT ip THEN {_near('lower(label)', fixed.SQUAT_NAMES_CORE, 2)} END AS near FROM hosts),
core AS (SELECT * EXCLUDE (domain_age_days), CASE WHEN ip THEN 0 ELSE domain_age_days END AS domain_age_days,
  ([{targets}])[near % 1000 + 1] AS typosquat_target, CAST(coalesce(near // 1000, 0) AS INT) AS typosquat_distance,
  ip AS has_ip_address, CAST(length(url) AS INT) AS url_length,
  CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS INT) AS path_depth,
  CAST(CASE WHEN ip THEN 0 ELSE nsub END AS INT) AS subdomain_count, scheme = 'https' AS has_https,
  NOT {_in('owner', fixed.TRUSTED_CORE)} AND ({_has('low', fixed.KEYWORDS_CORE)} OR {_brand_misused('low', 'owner', fixed.BRANDS_CORE)})
    AS has_suspicious_keywords,
  NOT ip AND {_in('lower(suffix)', fixed.TLDS_CORE)} AS suspicious_tld FROM owned)"""


def lexical17(source: str, listed: bool = False) -> str:
    """CTE ``lexical``."""
    return parts(source, listed) + f""",
nearest AS (SELECT *, CASE WHEN label <> '' THEN {_near('lower(label)', fixed.SQUAT_NAMES_LEXICAL17, 3)} END AS near FROM hosts),
lexical AS (SELECT *, CAST(least(length(url), 500) AS INT) AS url_length,
  CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS INT) AS path_depth, scheme = 'https' AS has_https,
  CAST(nsub AS INT) AS subdomain_count, ip AS has_ip_address, {_in('lower(suffix)', fixed.TLDS_LEXICAL17)} AS suspicious_tld,
  {_has('low', fixed.KEYWORDS_LEXICAL17)} AS has_suspicious_keywords, CAST(coalesce(near // 1000, 0) AS INT) AS typosquat_distance,
  length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url) AS digit_ratio,
  length(regexp_replace(url, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length(url) AS special_char_ratio,
  CAST(least(length(path), 200) AS INT) AS path_length, CAST(least(length(query), 200) AS INT) AS query_length,
  CAST(least(len(string_split(url, '.')) - 1, 20) AS INT) AS num_dots, CAST(least(len(string_split(url, '-')) - 1, 20) AS INT) AS num_hyphens,
  contains(url, '@') AS has_at_symbol, contains(url, '://') AND contains(substr(url, 9), '//') AS has_double_slash,
  {_in("lower(CASE WHEN label = '' OR suffix = '' OR rip THEN netloc ELSE label || '.' || suffix END)", fixed.SHORTENERS_LEXICAL17)} AS uses_shortener
  FROM nearest)"""


def lexical32(source: str) -> str:
    """CTE ``lexical``."""
    def n(char: str) -> str:
        return f"CAST(len(string_split(url, {_q(char)})) - 1 AS INT)"

    def flag(condition: str) -> str:
        return f"CAST(({condition}) AS INT)"

    def ends(tlds: list[str]) -> str:
        return flag(" OR ".join(f"suffix_of(host, {_q('.' + x)})" for x in tlds)).replace("suffix_of", "ends_with")

    squats = " OR ".join(
        f"(contains(label, {_q(b)}) AND label <> {_q(b)}) OR levenshtein(label, {_q(b)}) <= 2"
        for b in fixed.SQUAT_NAMES_LEXICAL32)
    return f"""
cut AS (SELECT *, lower(url) AS low, starts_with(url, 'https') AS https,
  regexp_extract(replace(replace(url, 'http://', ''), 'https://', ''), '^([^/?#:]*)', 1) AS domain,
  CASE WHEN contains(url, '?') THEN string_split(url, '?')[2] ELSE '' END AS query FROM {source}),
rest AS (SELECT *, lower(domain) AS host, lower(split_part(domain, '.', 1)) AS label,
  CASE WHEN https THEN length(url) - CASE WHEN contains(url, 'https://') THEN 8 ELSE 0 END
   ELSE length(url) - CASE WHEN contains(url, 'http://') THEN 7 ELSE 0 END END
   - CASE WHEN contains(url, domain) THEN length(domain) ELSE 0 END AS rest_length FROM cut),
chars AS (SELECT domain AS d, round(-sum(p * log2(p)), 4) AS entropy FROM (
   SELECT domain, count(*) / any_value(length(domain)) AS p FROM (
     SELECT domain, unnest(string_split(domain, '')) AS c FROM (SELECT DISTINCT domain FROM rest)) GROUP BY domain, c) GROUP BY domain),
lexical AS (SELECT *, CAST(length(url) AS INT) AS url_length, CAST(length(domain) AS INT) AS domain_length, CAST(rest_length AS INT) AS path_length,
  CAST(length(query) AS INT) AS query_length, {n('.')} AS num_dots, {n('-')} AS num_hyphens, {n('_')} AS num_underscores, {n('/')} AS num_slashes,
  {n('=')} AS num_equals, {n('@')} AS num_at_symbols, {n('?')} AS num_question_marks, {n('&')} AS num_ampersands,
  CAST(length(regexp_replace(url, '[^0-9]', '', 'g')) AS INT) AS num_digits, length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url) AS digit_ratio,
  length(regexp_replace(url, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length(url) AS special_char_ratio,
  length(regexp_replace(domain, '[^0-9]', '', 'g')) / length(domain) AS digit_ratio_domain,
  {flag('https')} AS has_https, {flag(f"regexp_matches(domain, '{fixed.IPV4_PATTERN}')")} AS has_ip_address,
  {flag("contains(substr(url, 9), '//')")} AS has_double_slash, {flag("contains(url, '@')")} AS has_at_symbol,
  {ends(fixed.TLDS_CORE)} AS has_suspicious_tld, {ends(fixed.TLDS_FREE)} AS is_free_tld,
  {flag(f"NOT {_in('host', fixed.TRUSTED_LEXICAL32)} AND {_has('low', fixed.KEYWORDS_LEXICAL32)}")} AS has_suspicious_keywords,
  {flag(_in('host', fixed.SHORTENERS_LEXICAL32))} AS uses_shortener, {flag("contains(domain, '-')")} AS domain_has_hyphen,
  CAST(greatest(0, len(string_split(domain, '.')) - 2) AS INT) AS num_subdomains,
  CAST(CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS INT) AS num_query_params, entropy AS domain_entropy,
  {flag(_brand_misused('low', 'host', fixed.BRANDS_LEXICAL32))} AS brand_in_path, {flag("contains(low, '.php')")} AS path_has_php,
  {n('%')} AS num_encoded_chars, {flag(squats)} AS typosquat_distance
  FROM rest JOIN chars ON chars.d = rest.domain)"""


def rules(source: str) -> str:
    """CTE ``rated`` (one row per URL and rule) over ``core``; ``source`` feeds ``core``."""
    trusted = _in("lower(netloc)", fixed.TRUSTED_RULES)
    levels = []
    for patterns, severity, score in ((fixed.PATTERNS_HIGH_RISK, "critical", 3.5), (fixed.PATTERNS_SUSPICIOUS, "high", 2.5)):
        levels += [f"WHEN regexp_matches(low, {_q(p)}) THEN row({_q(d)}, '{severity}', {score}E0)" for p, d in patterns]
    def row(text: str, severity: str = "low", score: float = 0.0) -> str:
        return f"row({text}, '{severity}', {score}E0)"
    cases = {
        "typosquatting": f"""WHEN typosquat_target IS NOT NULL AND typosquat_distance <= 2
            THEN {row("concat('Domain typosquats ', typosquat_target, ' (distance: ', typosquat_distance, ')')", 'high', 3.0)}
            ELSE {row("'No typosquatting detected'")}""",
        "domain_age": f"""WHEN domain_age_days = 0 THEN {row("'Domain age unknown'")}
            WHEN domain_age_days < 30 THEN {row("concat('Domain registered ', domain_age_days, ' days ago')", 'high', 2.5)}
            ELSE {row("concat('Domain age: ', domain_age_days, ' days')")}""",
        "ssl_certificate": f"""WHEN trusted THEN {row("'Trusted domain, SSL check skipped'")}
            WHEN NOT has_https THEN {row("'No HTTPS - insecure connection'", 'medium', 1.5)}
            WHEN NOT ssl_valid THEN {row("'Invalid SSL certificate'", 'high', 2.0)}
            ELSE {row("concat('Valid SSL from ', coalesce(ssl_issuer, 'unknown'))")}""",
        "redirects": f"""WHEN redirect_count >= 5 THEN {row("concat('Excessive redirects (', redirect_count, ')')", 'high', 2.0)}
            WHEN redirect_count >= 3 THEN {row("concat('Multiple redirects (', redirect_count, ')')", 'medium', 1.0)}
            ELSE {row("concat('Redirect count: ', redirect_count)")}""",
        "ip_address": f"""WHEN has_ip_address THEN {row("'URL uses IP address instead of domain'", 'high', 2.5)}
            ELSE {row("'URL uses domain name'")}""",
        "url_length": f"""WHEN url_length > 150 THEN {row("concat('Very long URL (', url_length, ' characters)')", 'medium', 1.0)}
            ELSE {row("concat('URL length: ', url_length)")}""",
        "suspicious_keywords": f"""WHEN trusted THEN {row("'Trusted domain, keyword check skipped'")}
            WHEN has_suspicious_keywords THEN {row("'URL contains suspicious keywords'", 'medium', 1.5)}
            ELSE {row("'No suspicious keywords'")}""",
        "subdomains": f"""WHEN trusted THEN {row("'Trusted domain, subdomain check skipped'")}
            WHEN subdomain_count >= 4 THEN {row("concat('Excessive subdomains (', subdomain_count, ')')", 'high', 2.0)}
            WHEN subdomain_count >= 2 THEN {row("concat('Multiple subdomains (', subdomain_count, ')')", 'medium', 1.0)}
            ELSE {row("concat('Subdomain count: ', subdomain_count)")}""",
        "suspicious_tld": f"""WHEN suspicious_tld THEN {row("'Domain uses suspicious TLD'", 'high', 2.0)}
            ELSE {row("'TLD appears legitimate'")}""",
        "suspicious_pattern": " ".join(levels) + f" ELSE {row(_q('No suspicious patterns'))}",
        "protocol": f"""WHEN trusted THEN {row("'Trusted domain, protocol check skipped'")}
            WHEN NOT has_https THEN {row("'Uses insecure HTTP protocol'", 'medium', 1.0)}
            ELSE {row("'Uses HTTPS protocol'")}""",
    }
    selects = " UNION ALL ".join(
        f"SELECT *, {i} AS rule_no, '{name}' AS rule_name, CASE {case} END AS r FROM trusting"
        for i, (name, case) in enumerate(cases.items()))
    return core(source) + f""",
trusting AS (SELECT *, {trusted} AS trusted FROM core),
ruled AS ({selects}),
rated AS (SELECT * EXCLUDE (r), r[1] AS description, r[2] AS severity, r[3] AS score, r[3] > 0 AS triggered FROM ruled)"""


def verdicts(source: str, key: str) -> str:
    """CTE ``judged``: one row per key with risk_score, hits, matched_rules, verdict, confidence."""
    return rules(source) + f""",
summed AS (SELECT {key}, any_value(url) AS url, least(sum(score) / 15.0, 1.0) AS risk_score, count(*) FILTER (triggered) AS hits,
  coalesce(string_agg(rule_name, ',' ORDER BY rule_no) FILTER (triggered), '') AS matched_rules FROM rated GROUP BY {key}),
judged AS (SELECT *, CASE WHEN risk_score >= 0.6 OR hits >= 5 THEN 'phishing' WHEN risk_score >= 0.3 OR hits >= 2 THEN 'suspicious' ELSE 'safe' END AS verdict,
  CASE WHEN risk_score >= 0.6 OR hits >= 5 THEN least(0.7 + risk_score * 0.3, 0.99) WHEN risk_score >= 0.3 OR hits >= 2 THEN 0.5 + risk_score * 0.3
   WHEN hits > 0 THEN 0.6 - risk_score * 0.2 ELSE 0.85 - risk_score * 0.1 END AS confidence FROM summed)"""


def importance(key: str) -> str:
    """CTE ``weighed`` over ``rated``: (key, feature, weight) for all 11 features."""
    pairs = ", ".join(
        f"('{rule}', '{f}', {len(names)})" for rule, names in fixed.RULE_FEATURES.items() for f in names)
    names = ", ".join(f"('{f}')" for f in fixed.VECTOR11)
    return f"""
spoken(rule_name, feature, share) AS (VALUES {pairs}),
named(feature) AS (VALUES {names}),
scored AS (SELECT {key}, s.feature, sum(score / share) AS w FROM rated JOIN spoken s USING (rule_name) WHERE triggered GROUP BY ALL),
filled AS (SELECT k.{key}, n.feature, coalesce(w, 0) AS w FROM (SELECT DISTINCT {key} FROM rated) k CROSS JOIN named n
  LEFT JOIN scored s ON s.{key} = k.{key} AND s.feature = n.feature),
weighed AS (SELECT {key}, feature, CASE WHEN max(w) OVER (PARTITION BY {key}) > 0 THEN w / max(w) OVER (PARTITION BY {key}) ELSE w END AS weight FROM filled)"""


def feed_hits(urls: str) -> str:
    """CTEs ``variant`` (url, pos, v) and ``hit`` (url, source, ordinal, threat_type, target_brand)."""
    order = ", ".join(f"('{s}', {i + 1})" for i, s in enumerate(fixed.FEED_ORDER))
    return f"""
given AS (SELECT DISTINCT url, CASE WHEN starts_with(url, 'https://') THEN 'http://' || substr(url, 9)
  WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) END AS swapped FROM {urls}),
spelled AS (SELECT url, 0 AS pos, url AS v FROM given UNION ALL SELECT url, 1, swapped FROM given WHERE swapped IS NOT NULL),
variant AS (SELECT * FROM spelled UNION ALL
  SELECT url, pos + 2, CASE WHEN ends_with(v, '/') THEN rtrim(v, '/') ELSE v || '/' END FROM spelled),
feed_order(source, ordinal) AS (VALUES {order}),
hit AS (SELECT DISTINCT x.url, x.pos, x.v, i.source, o.ordinal, i.threat_type, i.target_brand
  FROM variant x JOIN threat_indicators_raw i ON i.url = x.v JOIN feed_order o ON o.source = i.source)"""


FEED_VERDICT = """
feed_row AS (SELECT url, source, ordinal, min(threat_type) FILTER (threat_type <> '') AS threat_type,
  max(target_brand) FILTER (target_brand <> '') AS target_brand FROM hit GROUP BY ALL),
feed_said AS (SELECT url, string_agg(source, ',' ORDER BY ordinal) AS sources, arg_min(threat_type, ordinal) AS threat_type,
  arg_max(target_brand, ordinal) AS target_brand, string_agg('known_threat:' || source, ',' ORDER BY ordinal) AS matched_rules
  FROM feed_row GROUP BY url)"""
