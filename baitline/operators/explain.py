"""Explanations: rule-based text, prompts for an outside model, its replies, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed


def _percent(c: Column, decimals: int = 0) -> Column:
    """``0.98`` as ``98%`` or ``98.00%``."""
    return F.format_string(f"%.{decimals}f%%", F.col("confidence") * 100)


def _listed(names: Column) -> Column:
    return F.array_join(names, ", ")


# --- fixed values: texts of the rule-based explanation -----------------------
TEXT_FEED = "Flagged by threat intelligence feed(s): "
TEXT_SQUAT = "Typosquatting detected: impersonating "
TEXT_YOUNG = "Recently registered domain (%d days old)"
TEXT_SSL = "Invalid or missing SSL certificate"
TEXT_IP = "URL uses IP address instead of domain name"
TEXT_TLD = "Uses suspicious top-level domain"
TEXT_KEYWORDS = "Contains suspicious keywords commonly used in phishing"
TEXT_REDIRECTS = "Multiple redirects (%d)"
TEXT_NONE = "Nothing stands out"
ACTION_PHISHING = "Keep users away from this link and tell those in charge of security"
ACTION_SUSPICIOUS = "Have someone look at the link before it is opened"
ACTION_SAFE = "Nothing to do"
# --- our own wording ---------------------------------------------------------
SUMMARY_FEED = "Listed as a threat by %s (%s sure)"
SUMMARY_RULES = "Rated %s by its own features (%s sure)"
EXPLAINED_FEED = "%s stands in these collections of harmful links: %s. No further test of the link itself was needed."
EXPLAINED_RULES = "%s set off %d of the checks on its features, which rates it %s."


def explain_rules(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Explanation of each analysed URL without an outside model.

    Needs the output of ``analyze_urls``; ``keep`` names columns of it to pass
    on as ``_{name}``.  Age 0 means unknown, not young.
    """
    known = F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0
    age = F.col("domain_age_days")
    factors = F.filter(
        F.array(
            F.when(known, F.concat(F.lit(TEXT_FEED), _listed(F.col("sources")))),
            F.when(F.col("typosquat_target").isNotNull(), F.concat(F.lit(TEXT_SQUAT), F.col("typosquat_target"))),
            F.when((age > 0) & (age < 30), F.format_string(TEXT_YOUNG, age)),
            F.when(~F.col("ssl_valid"), F.lit(TEXT_SSL)),
            F.when(F.col("has_ip_address"), F.lit(TEXT_IP)),
            F.when(F.col("suspicious_tld"), F.lit(TEXT_TLD)),
            F.when(F.col("has_suspicious_keywords"), F.lit(TEXT_KEYWORDS)),
            F.when(F.col("redirect_count") > 2, F.format_string(TEXT_REDIRECTS, F.col("redirect_count"))),
        ),
        lambda f: f.isNotNull(),
    )
    verdict = F.col("verdict")
    phishing, suspicious = verdict == "phishing", verdict == "suspicious"
    percent = _percent(F.col("confidence"))
    key = [c for c in ("page_id", "scan_id") if c in results.columns]
    return results.select(
        *key, "url", "verdict", "confidence", *[F.col(c).alias(f"_{c}") for c in keep or ()],
        F.when(known, F.format_string(SUMMARY_FEED, _listed(F.col("sources")), percent))
        .otherwise(F.format_string(SUMMARY_RULES, verdict, percent)).alias("summary"),
        F.when(known, F.format_string(EXPLAINED_FEED, F.col("url"), _listed(F.col("sources"))))
        .otherwise(F.format_string(EXPLAINED_RULES, F.col("url"), F.size("matched_rules"), verdict)).alias("explanation"),
        F.when(F.size(factors) > 0, factors).otherwise(F.array(F.lit(TEXT_NONE))).alias("risk_factors"),
        F.when(phishing & known, "critical").when(phishing, "high").when(suspicious, "medium").otherwise("low").alias("severity"),
        F.when(phishing, ACTION_PHISHING).when(suspicious, ACTION_SUSPICIOUS).otherwise(ACTION_SAFE).alias("recommended_action"),
        F.col("typosquat_target").alias("target_brand"),
    )


REPLY_FIELDS = "summary, explanation, risk_factors (list), severity (low|medium|high|critical), recommended_action, target_brand (or null)"


def explain_prompts(results: DataFrame) -> DataFrame:
    """One prompt per URL for an outside model: full, or short for safe URLs.

    The full one names the sources that list the URL and, where the results
    carry them, what each source says.
    """
    def text(c: Column, missing: str) -> Column:
        return F.coalesce(c.cast("string"), F.lit(missing))

    head = F.concat(
        F.lit("URL: "), F.col("url"), F.lit("\nVerdict: "), F.col("verdict"),
        F.lit("\nConfidence: "), _percent(F.col("confidence"), 2),
    )
    lines = [
        ("Domain age (days)", text(F.col("domain_age_days"), "0")),
        ("SSL valid", text(F.col("ssl_valid"), "false")),
        ("SSL issuer", text(F.col("ssl_issuer"), "Unknown")),
        ("Redirects", text(F.col("redirect_count"), "0")),
        ("Typosquat target", text(F.col("typosquat_target"), "None")),
        ("Typosquat distance", text(F.col("typosquat_distance"), "0")),
        ("IP address as host", text(F.col("has_ip_address"), "false")),
        ("URL length", text(F.col("url_length"), "0")),
        ("Path depth", text(F.col("path_depth"), "0")),
        ("Subdomains", text(F.col("subdomain_count"), "0")),
        ("HTTPS", text(F.col("has_https"), "false")),
        ("Suspicious keywords", text(F.col("has_suspicious_keywords"), "false")),
        ("Suspicious TLD", text(F.col("suspicious_tld"), "false")),
    ]
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), value) for name, value in lines])
    known = F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0
    feeds = F.when(known, F.concat(F.lit("\nListed by threat feeds: "), _listed(F.col("sources")))).otherwise("")
    if "details" in results.columns:
        said = F.filter(F.coalesce("details", F.array().cast("array<struct<source:string,details:string>>")), lambda d: d["details"].isNotNull())
        lines_of = F.transform(said, lambda d: F.concat(F.lit("\n- "), d["source"], F.lit(": "), d["details"]))
        feeds = F.concat(feeds, F.array_join(lines_of, ""))
    matched = F.when(F.size("matched_rules") > 0, _listed(F.col("matched_rules"))).otherwise("None")
    ask = F.lit(f"\n\nReply with one JSON object and nothing else. Fields: {REPLY_FIELDS}.")
    full = F.concat(
        F.lit("Judge how risky the URL below is.\n\n"), head, feeds,
        F.lit("\nFeatures:\n"), facts, F.lit("\nMatched rules: "), matched, ask,
    )
    short = F.concat(F.lit("This scanned URL looks safe. Confirm briefly.\n\n"), head, ask)
    key = [c for c in ("page_id", "scan_id") if c in results.columns]
    return results.select(*key, "url", "verdict", F.when(F.col("verdict") == "safe", short).otherwise(full).alias("prompt"))


def explain_ingest(replies: DataFrame, col: str = "reply") -> DataFrame:
    """Reply texts to explanations; a reply that is not one JSON object, and nothing else, becomes a fallback.

    Missing fields get defaults; an explicit null stays null.  Values of other
    types are kept as text, and risk factors that are no array as a single one.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(F.col(col), r"^\s+|\s+$", ""), r"^```(?:json)?", ""), r"```$", ""))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    # as the only element of an array: whatever follows the object breaks the array
    only = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    staged = replies.withColumn("_v", F.when(body.startswith("{") & body.endswith("}"), only))
    staged = staged.withColumn("_r", F.try_variant_get("_v", "$[0]", "map<string,variant>")).withColumn(
        "_bad", F.col("_r").isNull() | F.try_variant_get("_v", "$[1]", "variant").isNotNull())

    def text(name: str) -> Column:
        value = F.try_element_at("_r", F.lit(name))
        return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))

    def field(name: str, missing: str) -> Column:
        return F.when(F.map_contains_key("_r", name), text(name)).otherwise(F.lit(missing))

    severity = text("severity")
    none = F.array().cast("array<string>")
    risks = F.try_element_at("_r", F.lit("risk_factors"))
    factors = F.when(F.map_contains_key("_r", "risk_factors"), F.coalesce(
        F.try_variant_get(risks, "$", "array<string>"), F.when(~F.is_variant_null(risks), F.array(text("risk_factors")))
    )).otherwise(none)
    own = [c for c in replies.columns if c != col]
    bad = F.col("_bad")
    return staged.select(
        *own,
        F.when(bad, "Unable to generate AI explanation").otherwise(field("summary", "Analysis completed")).alias("summary"),
        F.when(bad, F.col(col)).otherwise(field("explanation", "Unable to generate detailed explanation")).alias("explanation"),
        F.when(bad, none).otherwise(factors).alias("risk_factors"),
        F.when(~bad & severity.isin(fixed.SEVERITIES), severity).otherwise("medium").alias("severity"),
        F.when(bad, "Review manually").otherwise(field("recommended_action", "Review manually")).alias("recommended_action"),
        F.when(~bad, text("target_brand")).alias("target_brand"),
    )


def _json_text(c: Column) -> Column:
    """A JSON string literal, or null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", 1), F.lit(""))


def canonical_json(results: DataFrame) -> Column:
    """Sorted-key JSON of URL and features, without redirect chain and issuer."""
    numbers = {
        "domain_age_days": "n", "has_https": "n", "has_ip_address": "n", "has_suspicious_keywords": "n",
        "path_depth": "n", "redirect_count": "n", "ssl_valid": "n", "subdomain_count": "n",
        "suspicious_tld": "n", "typosquat_distance": "n", "typosquat_target": "t", "url_length": "n",
    }
    fields = []
    for name, kind in sorted(numbers.items()):
        value = F.col(name).cast("string") if kind == "n" else F.when(
            F.col(name).isNull(), F.lit("null")).otherwise(_json_text(F.col(name)))
        fields.append(F.concat(F.lit(f'"{name}": '), value))
    return F.concat(
        F.lit('{"features": {'), F.concat_ws(", ", *fields), F.lit('}, "url": '), _json_text(F.col("url")), F.lit("}")
    )


def explain_cache_key(results: DataFrame) -> DataFrame:
    """SHA-256 key per distinct (URL, features), with the number of scans that share it."""
    keyed = results.select("url", F.sha2(canonical_json(results), 256).alias("cache_key"))
    return keyed.groupBy("cache_key", "url").agg(F.count("*").alias("scans"))
