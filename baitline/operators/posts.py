"""Community posts: URLs they report, domains they name, words they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, urls as U
from ..functions.keys import first_per_key, top_per_key

INTERNAL = ["reddit.com", "redd.it"]


def _post_urls(pattern: str) -> Column:
    """Distinct URLs of a post: its link, unless a text post, and those in its body."""
    linked = F.when(~F.col("is_self") & (F.coalesce("url", F.lit("")) != ""), F.array("url"))
    in_body = F.regexp_extract_all(F.coalesce("selftext", F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.concat(F.coalesce(linked, F.array().cast("array<string>")), in_body))


def _exploded(posts: DataFrame, pattern: str) -> DataFrame:
    found = posts.withColumn("_found", F.explode(_post_urls(pattern)))
    own = [c for c in posts.columns if c not in ("url", "selftext")]
    return found.select(*own, F.col("_found").alias("url")).filter(~U.contains_any(F.col("url"), INTERNAL))


def post_urls(posts: DataFrame, min_score: int = 10) -> DataFrame:
    """Raw feed rows for ``norm_reddit``: one per URL reported by a well-rated post."""
    return _exploded(posts.filter(F.col("score") >= min_score), fixed.POST_URL_PATTERN)


def post_urls_training(posts: DataFrame, min_score: int = 5) -> DataFrame:
    """Valid URLs of posts by the strict pattern, for training."""
    rows = _exploded(posts.filter(F.col("score") >= min_score), fixed.POST_URL_PATTERN_TRAINING)
    return rows.filter(U.is_absolute(F.col("url")))


def _since(posts: DataFrame, as_of: str | None, days: int) -> DataFrame:
    """Posts of the ``days`` before ``as_of``; all without it."""
    if as_of is None:
        return posts
    end = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return posts.filter((F.col("created_utc") > end - days * 86400) & (F.col("created_utc") <= end))


def post_keyword_search(
    posts: DataFrame, keywords: list[str], min_score: int = 10, as_of: str | None = None, days: int = 7
) -> DataFrame:
    """URLs of posts with any keyword; each URL once, from its first post.

    With ``as_of`` only posts of the week (``days``) before it.

    Keyword order is search order, so the first post of a URL is the one with
    the earliest keyword, then the lowest id.
    """
    text = F.lower(F.concat_ws(" ", "title", "selftext"))
    place = F.coalesce(*[F.when(text.contains(k.lower()), F.lit(i)) for i, k in enumerate(keywords)])
    matching = _since(posts, as_of, days).filter(F.col("score") >= min_score).withColumn("_place", place).filter(F.col("_place").isNotNull())
    rows = _exploded(matching, fixed.POST_URL_PATTERN)
    return first_per_key(rows, ["url"], [F.col("_place"), F.col("post_id")]).drop("_place")


def _dotted_names() -> Column:
    """Names such as ``site.example.com`` in link, title and body, without ``www.``.

    The look-behind and the possessive quantifiers keep the search linear: a
    word without a dot is given up once and not tried again from its middle.
    """
    text = F.lower(F.concat_ws(" ", "title", "selftext", "url"))
    names = F.regexp_extract_all(text, F.lit(r"(?<![a-z0-9_-])[a-z0-9_-]++(?:\.[a-z0-9_-]++)+"), F.lit(0))
    return F.transform(names, lambda n: F.replace(n, F.lit("www."), F.lit("")))


def post_mentions(
    posts: DataFrame,
    domains: DataFrame,
    min_score: int = 3,
    strong_score: int = 50,
    subreddits: list[str] = fixed.MENTION_SUBREDDITS,
    per_subreddit: int | None = None,
    as_of: str | None = None,
    days: int = 365,
) -> DataFrame:
    """Domains that posts report as malicious.

    posts: post_id, title, score, subreddit, selftext, url; domains: domain.
    The dotted names in a post are taken out of its text, so the match is an
    equi-join on the name and not a search of every post for every domain.
    Posts score ``min_score`` or more; with ``per_subreddit`` only the
    best-rated so many of each subreddit and domain count, chosen before low
    scores go; with ``as_of`` only the year (``days``) before it.  Strong:
    score >= 50, a threat word and no impersonation word in the title.  Found
    from two strong ones; ``mentions`` has all of them with their details.
    """
    named = (
        _since(posts, as_of, days).filter(F.col("subreddit").isin(subreddits))
        .select(
            "post_id", "subreddit", "score", "title", "created_utc", "permalink",
            F.explode(F.array_distinct(_dotted_names())).alias("domain"),
        )
        .join(domains.select("domain").distinct(), "domain", "left_semi")
    )
    best = named if per_subreddit is None else top_per_key(
        named, ["domain", "subreddit"], [F.desc("score"), F.col("post_id")], per_subreddit)
    best = best.filter(F.col("score") >= min_score)
    title = F.lower("title")
    strong = (
        (F.col("score") >= strong_score)
        & U.contains_any(title, fixed.MENTION_THREAT_WORDS)
        & ~U.contains_any(title, fixed.MENTION_IMPERSONATION_WORDS)
    )
    order = F.array_position(F.array(*[F.lit(s) for s in subreddits]), F.col("subreddit"))
    return (
        best.filter(strong).groupBy("domain")
        .agg(
            F.count("*").alias("total_mentions"),
            F.array_sort(F.collect_list(F.struct(
                order.alias("place"), (-F.col("score")).alias("rank"), "post_id", "title", "score", "permalink", "created_utc"
            ))).alias("_all"),
        )
        .filter(F.col("total_mentions") >= 2)
        .select(
            "domain", "total_mentions", F.lit("reported").alias("threat_type"),
            F.transform("_all", lambda m: F.struct(
                m["post_id"].alias("post_id"), m["title"].alias("title"), m["score"].alias("score"),
                m["permalink"].alias("permalink"), m["created_utc"].alias("created_utc"),
            )).alias("mentions"),
        )
    )


def post_keyword_trend(posts: DataFrame, keywords: list[str] = fixed.POST_KEYWORDS, period: str = "DAY") -> DataFrame:
    """Posts per period and threat keyword, also weighted by score and comments."""
    text = F.lower(F.concat_ws(" ", "title", "selftext"))
    words = F.filter(F.array(*[F.when(text.contains(k), F.lit(k)) for k in keywords]), lambda k: k.isNotNull())
    when = F.date_trunc(period, F.timestamp_seconds("created_utc")).cast("timestamp_ntz")
    return (
        posts.select(when.alias("period"), "score", "num_comments", F.explode(words).alias("keyword"))
        .groupBy("period", "keyword")
        .agg(F.count("*").alias("posts"), F.sum(F.col("score") + F.col("num_comments")).alias("engagement"))
    )
