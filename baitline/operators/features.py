"""URL features.  Input: a table with a ``url`` column; output: new columns.

Everything is a column expression on the row itself: no join, no shuffle, no
Python worker.  Parsing happens in one projection and the features in the
next, so that each regular expression runs once per row.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, urls as U
from ..functions.keys import latest_before
from .suffix import split_host_by, with_suffix_labels

CORE_FIELDS = [
    "domain_age_days", "ssl_valid", "ssl_issuer", "redirect_count", "redirect_chain",
    "typosquat_target", "typosquat_distance", "has_ip_address", "url_length", "path_depth",
    "subdomain_count", "has_https", "has_suspicious_keywords", "suspicious_tld",
]
NETWORK_DEFAULTS = {
    "domain_age_days": "0",
    "ssl_valid": "false",
    "ssl_issuer": "CAST(NULL AS STRING)",
    "redirect_count": "0",
    "redirect_chain": "CAST(NULL AS ARRAY<STRING>)",
}


def _parsed(df: DataFrame) -> DataFrame:
    """Working columns ``_scheme``, ``_netloc``, ``_host``, ``_path``, ``_query``, ``_registry_host``."""
    url = F.col("url")
    return df.select(
        "*",
        U.scheme(url).alias("_scheme"),
        U.netloc(url).alias("_netloc"),
        U.without_params(U.path(url)).alias("_path"),
        U.query(url).alias("_query"),
        U.registry_host(url).alias("_registry_host"),
        F.lower("url").alias("_lower"),
    ).withColumn("_host", F.substring_index("_netloc", ":", 1)).withColumn("_ip", U.is_ipv4(F.col("_host")))


def _without_work(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def _split_host(df: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    return split_host_by(df, "_registry_host", suffixes, "_label", "_suffix", "_subdomains")


def _brand_misused(text: Column, host: Column, brands: list[str]) -> Column:
    """A brand occurs in ``text`` and ``host`` is not that brand's own."""
    return F.exists(
        U.word_array(brands),
        lambda b: text.contains(b) & (host != b) & (host != F.concat(b, F.lit(".com"))),
    )


def feat_core(urls: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """The 14 features of a URL; public suffixes by a rule table (``suffix.suffix_rules``) or the shipped list.

    Domain age, certificate and redirects are observations, not properties of
    the string: columns of these names are used when present (see
    ``join_asof_enrich``), unknown values otherwise.
    """
    own = [c for c in urls.columns if c not in CORE_FIELDS]
    network = [
        (F.coalesce(F.col(c), F.expr(default)) if c in urls.columns else F.expr(default)).alias(f"_{c}")
        for c, default in NETWORK_DEFAULTS.items()
    ]
    staged = _split_host(_parsed(urls.select(*own, *network)), suffixes).withColumn("_name", F.lower("_label"))
    registered = F.when((F.col("_label") == "") | (F.col("_suffix") == ""), F.col("_netloc")).otherwise(
        F.concat_ws(".", "_label", "_suffix")
    )
    staged = staged.select(
        "*",
        F.lower(F.when(F.col("_ip"), F.col("_host")).otherwise(registered)).alias("_owner"),
        F.when(~F.col("_ip"), U.nearest_name(F.col("_name"), fixed.SQUAT_NAMES_CORE, 2)).alias("_near"),
    )
    keywords = ~F.col("_owner").isin(fixed.TRUSTED_CORE) & (
        U.contains_any(F.col("_lower"), fixed.KEYWORDS_CORE)
        | _brand_misused(F.col("_lower"), F.col("_owner"), fixed.BRANDS_CORE)
    )
    return staged.select(
        *own,
        F.when(F.col("_ip"), 0).otherwise(F.col("_domain_age_days")).alias("domain_age_days"),
        F.col("_ssl_valid").alias("ssl_valid"),
        F.col("_ssl_issuer").alias("ssl_issuer"),
        F.col("_redirect_count").alias("redirect_count"),
        F.col("_redirect_chain").alias("redirect_chain"),
        U.name_at(F.col("_near"), fixed.SQUAT_NAMES_CORE).alias("typosquat_target"),
        U.name_distance(F.col("_near")).alias("typosquat_distance"),
        F.col("_ip").alias("has_ip_address"),
        F.length("url").alias("url_length"),
        U.path_depth(F.col("_path")).alias("path_depth"),
        F.when(F.col("_ip"), 0).otherwise(F.col("_subdomains")).alias("subdomain_count"),
        (F.col("_scheme") == "https").alias("has_https"),
        keywords.alias("has_suspicious_keywords"),
        (~F.col("_ip") & F.lower("_suffix").isin(fixed.TLDS_CORE)).alias("suspicious_tld"),
    )


def vector11(clipped: bool = True) -> list[Column]:
    """The 11 numbers of the model vector in order."""
    limits = {"domain_age_days": 3650, "url_length": 500} if clipped else {}
    return [
        (F.least(F.col(c), F.lit(limits[c])) if c in limits else F.col(c)).cast("double").alias(c)
        for c in fixed.VECTOR11
    ]


def with_vector(features: DataFrame) -> DataFrame:
    """Add the ML column ``vector`` with the clipped entries."""
    inputs = [c.alias(f"_{name}") for c, name in zip(vector11(), fixed.VECTOR11)]
    assembler = VectorAssembler(inputCols=[f"_{c}" for c in fixed.VECTOR11], outputCol="vector")
    return _without_work(assembler.transform(features.select("*", *inputs)))


def feat_vector11(features: DataFrame) -> DataFrame:
    """The vector as arrays: ``raw`` and ``clipped``."""
    own = [c for c in features.columns if c not in CORE_FIELDS]
    return features.select(
        *own, F.array(*vector11(clipped=False)).alias("raw"), F.array(*vector11()).alias("clipped")
    )


def feat_lexical17(urls: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """17 features of the string alone, clipped; public suffixes by a rule table or the shipped list."""
    staged = _split_host(_parsed(urls), suffixes).withColumn("_name", F.lower("_label"))
    near = F.when(F.col("_name") != "", U.nearest_name(F.col("_name"), fixed.SQUAT_NAMES_LEXICAL17, 3))
    registered = F.lower(
        F.when((F.col("_label") == "") | (F.col("_suffix") == "") | U.is_ipv4(F.col("_registry_host")), F.col("_netloc"))
        .otherwise(F.concat_ws(".", "_label", "_suffix"))
    )
    url = F.col("url")
    n = F.length(url)

    def clip(c: Column, limit: int) -> Column:
        return F.least(c, F.lit(limit))

    return staged.select(
        *urls.columns,
        clip(n, 500).alias("url_length"),
        U.path_depth(F.col("_path")).alias("path_depth"),
        (F.col("_scheme") == "https").alias("has_https"),
        F.col("_subdomains").alias("subdomain_count"),
        F.col("_ip").alias("has_ip_address"),
        F.lower("_suffix").isin(fixed.TLDS_LEXICAL17).alias("suspicious_tld"),
        U.contains_any(F.col("_lower"), fixed.KEYWORDS_LEXICAL17).alias("has_suspicious_keywords"),
        U.name_distance(near).alias("typosquat_distance"),
        U.ratio(U.digits(url), n).alias("digit_ratio"),
        U.ratio(U.specials(url), n).alias("special_char_ratio"),
        clip(F.length("_path"), 200).alias("path_length"),
        clip(F.length("_query"), 200).alias("query_length"),
        clip(U.count_of(url, "."), 20).alias("num_dots"),
        clip(U.count_of(url, "-"), 20).alias("num_hyphens"),
        url.contains("@").alias("has_at_symbol"),
        (url.contains("://") & F.substr(url, F.lit(9)).contains("//")).alias("has_double_slash"),
        registered.isin(fixed.SHORTENERS_LEXICAL17).alias("uses_shortener"),
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits, 4 decimals; 0 for the empty string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")

    def add(total: Column, c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.log2(p)

    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), add)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.round(bits, 4))


def _domain_of_string(url: Column) -> Column:
    """Host as the 32-feature set cuts it out of the string."""
    bare = F.replace(F.replace(url, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return F.regexp_extract(bare, r"^([^/?#:]*)", 1)


def feat_entropy(urls: DataFrame) -> DataFrame:
    staged = urls.withColumn("domain", _domain_of_string(F.col("url")))
    return staged.withColumn("domain_entropy", entropy(F.col("domain")))


def _drop_first(text: Column, part: Column) -> Column:
    """``text`` without the first occurrence of ``part``."""
    at = F.position(part, text)
    return F.when((at == 0) | (F.length(part) == 0), text).otherwise(
        F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))
    )


def feat_lexical32(urls: DataFrame) -> DataFrame:
    """32 features of the string alone; ``fixed.VECTOR26`` names the model's part."""
    url = F.col("url")
    staged = urls.select(
        "*",
        F.lower("url").alias("_lower"),
        url.startswith("https").alias("_https"),
        _domain_of_string(url).alias("_domain"),
        F.length("url").alias("_n"),
        U.digits(url).alias("_digits"),
        F.coalesce(F.get(F.split(url, r"\?"), F.lit(1)), F.lit("")).alias("_query"),
    )
    staged = staged.select(
        "*",
        F.lower("_domain").alias("_host"),
        F.lower(F.substring_index("_domain", ".", 1)).alias("_label"),
        _drop_first(url, F.when(F.col("_https"), "https://").otherwise("http://")).alias("_rest"),
    )
    host, label = F.col("_host"), F.col("_label")
    squats = F.exists(
        U.word_array(fixed.SQUAT_NAMES_LEXICAL32),
        lambda n: (label.contains(n) & (label != n)) | (F.levenshtein(label, n, 2) >= 0),
    )

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    def ends_with(tlds: list[str]) -> Column:
        return flag(host.rlike(r"\.(?:" + "|".join(tlds) + ")$"))

    trusted = host.isin(fixed.TRUSTED_LEXICAL32)
    return staged.select(
        *urls.columns,
        F.col("_n").alias("url_length"),
        F.length("_domain").alias("domain_length"),
        F.length(_drop_first(F.col("_rest"), F.col("_domain"))).alias("path_length"),
        F.length("_query").alias("query_length"),
        *[
            U.count_of(url, char).alias(name)
            for name, char in (
                ("num_dots", "."), ("num_hyphens", "-"), ("num_underscores", "_"), ("num_slashes", "/"),
                ("num_equals", "="), ("num_at_symbols", "@"), ("num_question_marks", "?"), ("num_ampersands", "&"),
            )
        ],
        F.col("_digits").alias("num_digits"),
        U.ratio(F.col("_digits"), F.col("_n")).alias("digit_ratio"),
        U.ratio(U.specials(url), F.col("_n")).alias("special_char_ratio"),
        U.ratio(U.digits(F.col("_domain")), F.length("_domain")).alias("digit_ratio_domain"),
        flag(F.col("_https")).alias("has_https"),
        flag(U.is_ipv4(F.col("_domain"))).alias("has_ip_address"),
        flag(F.substr(url, F.lit(9)).contains("//")).alias("has_double_slash"),
        flag(url.contains("@")).alias("has_at_symbol"),
        ends_with(fixed.TLDS_CORE).alias("has_suspicious_tld"),
        ends_with(fixed.TLDS_FREE).alias("is_free_tld"),
        flag(~trusted & U.contains_any(F.col("_lower"), fixed.KEYWORDS_LEXICAL32)).alias("has_suspicious_keywords"),
        flag(host.isin(fixed.SHORTENERS_LEXICAL32)).alias("uses_shortener"),
        flag(F.col("_domain").contains("-")).alias("domain_has_hyphen"),
        F.greatest(F.lit(0), F.size(F.split("_domain", r"\.")) - 2).alias("num_subdomains"),
        F.when(F.col("_query") == "", 0).otherwise(U.count_of(F.col("_query"), "&") + 1).alias("num_query_params"),
        entropy(F.col("_domain")).alias("domain_entropy"),
        flag(_brand_misused(F.col("_lower"), host, fixed.BRANDS_LEXICAL32)).alias("brand_in_path"),
        flag(F.col("_lower").contains(".php")).alias("path_has_php"),
        U.count_of(url, "%").alias("num_encoded_chars"),
        flag(squats).alias("typosquat_distance"),
    )


def join_typosquat(
    urls: DataFrame, names: list[str] = fixed.SQUAT_NAMES_CORE, max_distance: int = 2, suffixes: DataFrame | None = None
) -> DataFrame:
    """Nearest name of a list to the domain label, ties by list order.

    The list is part of the plan, so the nearest-neighbour look-up is a narrow
    projection; ``levenshtein`` with a threshold gives up early.
    """
    staged = split_host_by(urls.withColumn("_host", U.registry_host(F.col("url"))), "_host", suffixes, "label", "_suffix", "_n")
    staged = staged.withColumn("_name", F.lower("label"))
    staged = staged.withColumn("_near", U.nearest_name(F.col("_name"), names, max_distance))
    return staged.select(
        *urls.columns, "label",
        U.name_at(F.col("_near"), names).alias("typosquat_target"),
        U.name_distance(F.col("_near")).alias("typosquat_distance"),
    )


def join_keyword_hits(urls: DataFrame, words: list[str]) -> DataFrame:
    """Per word: rows and distinct URLs that contain it."""
    lowered = F.lower("url")
    hits = F.filter(
        F.array(*[F.when(lowered.contains(w), F.lit(w)) for w in words]), lambda w: w.isNotNull()
    )
    per_url = urls.select("url", F.explode(hits).alias("keyword")).groupBy("keyword", "url").agg(F.count("*").alias("n"))
    return per_url.groupBy("keyword").agg(F.sum("n").alias("rows"), F.count("*").alias("urls"))


def join_asof_enrich(
    scans: DataFrame,
    registrations: DataFrame,
    certificates: DataFrame,
    redirects: DataFrame,
    time: str = "created_at",
    slice_by: str = "HOUR",
    suffixes: DataFrame | None = None,
    per_slice: int = 500_000,
) -> DataFrame:
    """Domain age, certificate and redirects as last observed when scanned.

    registrations: (url, observed_at, registered_at)
    certificates:  (url, observed_at, ssl_valid, ssl_issuer)
    redirects:     (url, observed_at, hop, target), one row per hop
    A registration belongs to the registered domain, so that every host below
    it is as old; a certificate to a host, and it counts for https alone; a
    redirect chain to a URL, with which it starts.  A URL without a host has none.
    """
    regs = _owned(registrations, suffixes).select("owner", "observed_at", F.struct("registered_at").alias("value"))
    certs = _owned(certificates, suffixes).select(
        "owner", F.col("_host").alias("_https_host"), "observed_at", F.struct("ssl_valid", "ssl_issuer").alias("value")
    )
    # A probe follows a bounded number of hops, so a chain is a short list.
    probes = _owned(
        redirects.groupBy("url", "observed_at")
        .agg(F.array_sort(F.collect_list(F.struct("hop", "target"))).alias("hops"))
        .select("url", "observed_at", F.struct(
            F.size("hops").alias("redirect_count"),
            F.concat(F.array("url"), F.col("hops.target")).alias("redirect_chain"),
        ).alias("value")),
        suffixes,
    ).select("owner", "url", "observed_at", "value")
    keep = [c for c in scans.columns if c not in NETWORK_DEFAULTS]
    base = _owned(scans.select(*keep), suffixes).withColumn(
        "_https_host", F.when(F.lower("url").startswith("https://"), F.col("_host"))
    ).drop("_host")
    rows = latest_before(
        base, "owner", time, {"_r": ([], regs), "_c": (["_https_host"], certs), "_p": (["url"], probes)}, slice_by, per_slice
    )
    age = F.datediff(F.col(time), F.col("_r.registered_at"))
    return rows.select(
        *keep,
        F.greatest(F.lit(0), F.coalesce(age, F.lit(0))).alias("domain_age_days"),
        F.coalesce("_c.ssl_valid", F.lit(False)).alias("ssl_valid"),
        F.col("_c.ssl_issuer").alias("ssl_issuer"),
        F.coalesce("_p.redirect_count", F.lit(0)).alias("redirect_count"),
        F.col("_p.redirect_chain").alias("redirect_chain"),
    )


def _owned(df: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Add ``owner``, the registered domain (an address, single name or bare suffix: itself), and ``_host``."""
    host = F.nullif(F.lower(U.registry_host(F.col("url"))), F.lit(""))
    staged = df.withColumn("_host", U.computed_once(host))
    if suffixes is None:
        labels = U.suffix_labels(F.col("_host"))
        own = F.when(labels == 1, F.substring_index("_host", ".", -2)).when(labels == 2, F.substring_index("_host", ".", -3))
    else:
        staged = with_suffix_labels(staged, "_host", suffixes, "_nsuffix")
        parts = F.split("_host", r"\.")
        size = F.least(F.col("_nsuffix") + 1, F.size(parts))
        own = F.when(F.col("_nsuffix") > 0, F.array_join(F.slice(parts, F.size(parts) - size + 1, size), "."))
    return staged.withColumn("owner", U.computed_once(F.coalesce(own, F.col("_host")))).drop("_nsuffix")


def fit_scaler(features: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each vector entry (one small row)."""
    columns = {c: F.col(c).cast("double") for c in fixed.VECTOR11}
    row = features.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in columns.items()],
        *[F.stddev_pop(v).alias(f"s_{c}") for c, v in columns.items()],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def feat_scale(features: DataFrame, stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Standardised vector entries; a constant entry becomes 0."""
    usable = features.filter(F.coalesce("url", F.lit("")) != "")
    stats = stats or fit_scaler(usable)
    own = [c for c in features.columns if c not in CORE_FIELDS]
    return usable.select(
        *own,
        *[((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in stats.items()],
    )


def unusable_urls(urls: DataFrame) -> DataFrame:
    """The rows ``feat_scale`` cannot turn into a vector."""
    return urls.filter(F.coalesce("url", F.lit("")) == "")


def feat_risk_profile(features: DataFrame, label: str = "label") -> DataFrame:
    """Per class: share of each flag; mean, median and 90th percentile of each number.

    The numbers are small integers, so exact percentiles merge as counts per value.
    """
    flags = ["ssl_valid", "has_ip_address", "has_suspicious_keywords", "has_https", "suspicious_tld"]
    numbers = ["domain_age_days", "redirect_count", "typosquat_distance", "url_length", "path_depth", "subdomain_count"]
    return features.groupBy(label).agg(
        F.count("*").alias("urls"),
        *[F.avg(F.col(c).cast("int")).alias(f"share_{c}") for c in flags],
        *[F.avg(c).alias(f"mean_{c}") for c in numbers],
        *[F.percentile(c, 0.5).alias(f"median_{c}") for c in numbers],
        *[F.percentile(c, 0.9).alias(f"p90_{c}") for c in numbers],
    )
