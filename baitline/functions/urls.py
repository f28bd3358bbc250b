"""Column expressions on URL strings (no UDF, all inside code generation).

``parse_url`` is not used: it yields NULL for many of the malformed URLs that
are normal in this domain.  One regular expression splits any string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, fixed.URL_PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def without_params(path_: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(path_, r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Network location up to its first colon."""
    return F.substring_index(netloc(url), ":", 1)


def is_ipv4(name: Column) -> Column:
    return name.rlike(fixed.IPV4_PATTERN)


def is_absolute(url: Column) -> Column:
    """Both a scheme and a network location are present."""
    return (scheme(url) != "") & (netloc(url) != "")


def path_depth(path_: Column) -> Column:
    """Number of non-empty path segments."""
    segments = F.filter(F.split(path_, "/"), lambda s: s != "")
    return F.size(segments)


def registry_host(url: Column) -> Column:
    """Host as the registry sees it: no scheme, user info, port or final dots."""
    authority = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?([^/?#]*)", 1)
    without_user = F.substring_index(authority, "@", -1)
    return F.rtrim(F.substring_index(without_user, ":", 1), F.lit("."))


def suffix_labels(host_: Column) -> Column:
    """How many trailing labels of ``host_`` form the public suffix (0, 1 or 2)."""
    last_two = F.lower(F.substring_index(host_, ".", -2))
    usual = rf"^({'|'.join(fixed.SUFFIX_SECOND_LEVELS)})\.[a-z]{{2}}$"
    return (
        F.when(~host_.contains(".") | is_ipv4(host_), 0)
        .when(last_two.rlike(usual) | last_two.isin(fixed.SUFFIXES_TWO_LABELS), 2)
        .otherwise(1)
    )


def split_host(df: DataFrame, host_: str, label: str, suffix: str, subdomains: str, counted: str | None = None) -> DataFrame:
    """Add the registrable label, the public suffix and the number of subdomains.

    The number of labels of the suffix is that of column ``counted``, or by the
    shipped rule.  An IP address is its own label, without suffix and subdomains.
    """
    name = F.col(host_)
    staged = df.withColumn("_nsuffix", F.col(counted) if counted else suffix_labels(name)).withColumn("_labels", F.split(name, r"\."))
    n, labels = F.col("_nsuffix"), F.col("_labels")
    at = F.size(labels) - n - 1
    numeric = is_ipv4(name)
    return staged.select(
        *df.columns,
        F.when(numeric, name).otherwise(F.coalesce(F.get(labels, at), F.lit(""))).alias(label),
        F.when(n == 0, "").otherwise(F.array_join(F.slice(labels, at + 2, n), ".")).alias(suffix),
        F.when(numeric, 0).otherwise(F.greatest(F.lit(0), at)).alias(subdomains),
    )


def word_array(words: list[str]) -> Column:
    """An array literal.  As SQL text it is one call to the JVM, not one per word."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when one of ``words`` occurs.

    A word that contains another listed word adds nothing and is left out.
    Plain substring tests are several times faster than one alternation.
    """
    needed = [w for w in words if not any(other != w and other in w for other in words)]
    return F.exists(word_array(needed), lambda w: text.contains(w))


def first_tag(text: Column, tags: list[tuple[str, str]]) -> Column:
    """Name of the first key of the ordered list that occurs in ``text``."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(key), F.lit(name)) for key, name in tags])


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


ASCII_DIGITS = "0123456789"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _left_after(text: Column, ascii_chars: str, pattern: str) -> Column:
    """Length without the given characters; the pattern is for non-ASCII text."""
    return F.when(
        F.octet_length(text) == F.length(text), F.length(F.translate(text, ascii_chars, ""))
    ).otherwise(F.length(F.regexp_replace(text, pattern, "")))


def digits(text: Column) -> Column:
    return F.length(text) - _left_after(text, ASCII_DIGITS, r"\p{Nd}")


def specials(text: Column) -> Column:
    return _left_after(text, ASCII_DIGITS + ASCII_LETTERS, r"[\p{L}\p{N}]")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def nearest_name(label: Column, names: list[str], within: int) -> Column:
    """The closest of ``names`` to a lower-case label, as distance * 1000 + place.

    NULL for a name of the list itself and beyond ``within``.  Built-in
    ``levenshtein`` with a threshold gives up early and says -1, which sorts
    last here.  The list is part of the plan: no join and no shuffle.  It is
    walked by ``transform``, which keeps the generated code short enough for
    the JVM to compile.
    """
    ranks = F.transform(
        word_array(names),
        lambda name, place: F.pmod(F.levenshtein(label, name, within), F.lit(100)) * 1000 + place,
    )
    nearest = F.array_min(ranks)
    return F.when(~label.isin(names) & (nearest < 99_000), nearest)


def name_distance(nearest: Column) -> Column:
    return F.coalesce(F.floor(nearest / 1000).cast("int"), F.lit(0))


def name_at(nearest: Column, names: list[str]) -> Column:
    return F.get(word_array([f"{n}.com" for n in names]), nearest % 1000)


def computed_once(value: Column) -> Column:
    """Mark a costly column so that Spark keeps it in its own projection.

    A later filter on something derived from the column would otherwise be
    pushed below it, with the whole expression copied into the condition once
    per reference.  The condition is always true; Spark just cannot move it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def variants(url: Column) -> Column:
    """The spellings under which a feed may list ``url``, in order of preference."""
    swapped = F.when(url.startswith("https://"), F.concat(F.lit("http://"), F.substr(url, F.lit(9)))).when(
        url.startswith("http://"), F.concat(F.lit("https://"), F.substr(url, F.lit(8)))
    )
    as_given = F.filter(F.array(url, swapped), lambda u: u.isNotNull())
    slash_toggled = F.transform(
        as_given,
        lambda u: F.when(u.endswith("/"), F.rtrim(u, F.lit("/"))).otherwise(F.concat(u, F.lit("/"))),
    )
    return F.concat(as_given, slash_toggled)


def match_key(url: Column) -> Column:
    """Equal for all URLs that can be variants of each other.

    Joining on this key instead of exploding the variants keeps the URL side of
    a feed match at one row per URL.
    """
    bare = F.regexp_replace(url, r"^https?://", "")
    return F.rtrim(bare, F.lit("/"))


def report_key(url: Column) -> Column:
    """Unpadded url-safe base64, the key of stored multi-engine reports."""
    encoded = F.translate(F.base64(F.encode(url, "UTF-8")), "+/", "-_")
    return F.rtrim(F.regexp_replace(encoded, r"\s", ""), F.lit("="))


def page_domain(url: Column) -> Column:
    """Network location without ``www.``, the key of domain-level reports."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))
