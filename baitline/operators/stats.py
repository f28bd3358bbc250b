"""Aggregations over scans, indicators, caches, call logs and predictions.

Counts come from one pass with ``count_if``; totals for percentages are taken
over the few aggregated rows, never over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _days_before(as_of: str, days: int) -> Column:
    return _at(as_of) - F.make_dt_interval(F.lit(days))


def recent(scans: DataFrame, as_of: str, days: int | None, time: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days; the bound is a constant, so it reaches the scan."""
    return scans if days is None else scans.filter(F.col(time) >= _days_before(as_of, days))


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 1)


def agg_summary(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return recent(scans, as_of, days).agg(
        F.count("*").alias("total_scans"),
        F.count_if(F.col("verdict") == "phishing").alias("phishing_detected"),
        F.count_if(F.col("verdict") == "safe").alias("safe_urls"),
        F.count_if(F.col("verdict") == "suspicious").alias("suspicious"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.lit(days).alias("period_days"),
    )


def agg_verdict_dist(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """All three verdicts with count and percentage; empty when nothing was scanned."""
    counts = agg_summary(scans, as_of, days).filter(F.col("total_scans") > 0)
    rows = F.array(*[
        F.struct(F.lit(v).alias("verdict"), F.col(c).alias("count"), _percent(F.col(c), F.col("total_scans")).alias("percentage"))
        for v, c in zip(fixed.VERDICTS, ("phishing_detected", "safe_urls", "suspicious"))
    ])
    return counts.select(F.inline(rows))


def agg_severity_dist(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    per = recent(scans, as_of, days).groupBy("severity").agg(F.count("*").alias("count"))
    return per.withColumn("percentage", _percent(F.col("count"), F.sum("count").over(Window.partitionBy())))


def _calendar(scans: DataFrame, first: Column, last: Column, step: str) -> DataFrame:
    """Every period and verdict; its size depends on the period only."""
    one = scans.sparkSession.range(1)
    return one.select(F.explode(F.sequence(first, last, F.expr(f"INTERVAL 1 {step}"))).alias("period")).select(
        "period", F.explode(F.array(*[F.lit(v) for v in fixed.VERDICTS])).alias("verdict")
    )


def _trend(scans: DataFrame, as_of: str, days: int, step: str) -> DataFrame:
    last = F.date_trunc(step, _at(as_of)).cast("timestamp_ntz")
    start = _days_before(as_of, days)
    if step == "DAY":
        first = last - F.make_dt_interval(F.lit(days - 1))
    else:
        first = F.date_trunc(step, start).cast("timestamp_ntz")
    counts = (
        recent(scans, as_of, days)
        .filter(F.col("created_at") <= _at(as_of))
        .groupBy(F.date_trunc(step, "created_at").cast("timestamp_ntz").alias("period"), "verdict")
        .agg(F.count("*").alias("n"))
    )
    filled = _calendar(scans, first, last, step).join(counts, ["period", "verdict"], "left")
    return filled.select("period", "verdict", F.coalesce("n", F.lit(0)).alias("count"))


def agg_trend_daily(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return _trend(scans, as_of, days, "DAY").withColumnRenamed("period", "day").withColumn("day", F.to_date("day"))


def agg_trend_hourly(scans: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    return _trend(scans, as_of, days, "HOUR").withColumnRenamed("period", "hour")


def agg_trend_pivot(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    daily = agg_trend_daily(scans, as_of, days)
    return daily.groupBy("day").agg(
        F.sum("count").alias("total_scans"),
        *[F.sum(F.when(F.col("verdict") == v, F.col("count")).otherwise(0)).alias(v) for v in fixed.VERDICTS],
    )


def agg_top_brands(scans: DataFrame, as_of: str, days: int | None = None, limit: int | None = None) -> DataFrame:
    """Brands most often imitated by phishing scans."""
    per = (
        recent(scans, as_of, days).filter((F.col("verdict") == "phishing") & F.col("target_brand").isNotNull())
        .groupBy("target_brand").agg(F.count("*").alias("count"))
    )
    # one row; its sum is formed within tasks first
    total = per.agg(F.sum("count").alias("_total"))
    top = per if limit is None else per.orderBy(F.desc("count"), "target_brand").limit(limit)
    shares = top.join(F.broadcast(total)).withColumn("percentage", _percent(F.col("count"), F.col("_total")))
    return shares.drop("_total").orderBy(F.desc("count"), "target_brand")


def _at_least_one(**numbers: int) -> None:
    for name, value in numbers.items():
        if value < 1:
            raise ValueError(f"{name} must be 1 or more")


def agg_phish_stats(entries: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    _at_least_one(days=days)
    return recent(entries, as_of, days, "submission_time").agg(
        F.count("*").alias("total_phish"),
        F.count_if(F.col("verified") == "yes").alias("total_verified"),
        F.count_if(F.col("online") == "yes").alias("total_online"),
        F.to_date(_days_before(as_of, days)).alias("from_date"),
        F.to_date(_at(as_of)).alias("to_date"),
    )


def agg_top_targets(entries: DataFrame, as_of: str, days: int = 7, k: int | None = None) -> DataFrame:
    _at_least_one(days=days, **({} if k is None else {"k": k}))
    per = (
        recent(entries, as_of, days, "submission_time").filter(F.col("target") != "")
        .groupBy("target").agg(F.count("*").alias("count"))
    )
    ordered = per.orderBy(F.desc("count"), "target")
    return ordered if k is None else ordered.limit(k)


def agg_duplicate_urls(indicators: DataFrame) -> DataFrame:
    per = indicators.groupBy("url").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return per.agg(F.count("*").alias("duplicate_urls"))


def agg_merge_sources(indicators: DataFrame) -> DataFrame:
    """One row per URL.  Sets are built from distinct elements, so a URL listed
    a billion times costs no more than the sources and tags it has."""
    tagged = indicators.select("url", "first_seen", "last_seen", "source", "confidence", F.explode_outer("tags").alias("tag"))
    tags = F.array_sort(F.collect_set("tag"))
    return tagged.groupBy("url").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.max("confidence").alias("confidence"),
        F.when(F.size(tags) > 0, tags).alias("tags"),
    )


def agg_cache_stats(cache: DataFrame, as_of: str) -> DataFrame:
    return cache.agg(
        F.count("*").alias("total_entries"),
        F.count_if(F.col("expires_at") > _at(as_of)).alias("active_entries"),
        F.count_if(F.col("expires_at") <= _at(as_of)).alias("expired_entries"),
    )


def agg_usage(calls: DataFrame) -> DataFrame:
    """Usage per day and in all (day NULL)."""
    return calls.rollup(F.to_date("called_at").alias("day")).agg(
        F.count("*").alias("total_requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        F.count_if("is_error").alias("errors"),
        F.max("called_at").alias("last_request_time"),
    )


def agg_model_metrics(predictions: DataFrame) -> DataFrame:
    """Confusion matrix and metrics per model (label and prediction are 0 or 1)."""
    label, guess = F.col("label") == 1, F.col("prediction") == 1
    cells = predictions.groupBy("model").agg(
        F.count_if(label & guess).alias("tp"),
        F.count_if(~label & guess).alias("fp"),
        F.count_if(label & ~guess).alias("fn"),
        F.count_if(~label & ~guess).alias("tn"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    tp = F.col("tp")
    return cells.select(
        "*",
        share(tp + F.col("tn"), tp + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        share(tp, tp + F.col("fp")).alias("precision"),
        share(tp, tp + F.col("fn")).alias("recall"),
        share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    )


def agg_best_model(predictions: DataFrame) -> DataFrame:
    """The model with the largest F1; the first one wins ties."""
    order = predictions.groupBy("model").agg(F.min("ordinal").alias("ordinal"))
    rated = agg_model_metrics(predictions).join(order, "model")
    return rated.agg(
        F.max_by("model", F.struct("f1", -F.col("ordinal"))).alias("model"), F.max("f1").alias("f1")
    )


def agg_collection_stats(samples: DataFrame) -> DataFrame:
    """Counts per (label, source), per label and in all."""
    return samples.rollup("label", "source").agg(F.count("*").alias("samples"))


def agg_dashboard_cube(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Counts per verdict, severity, brand and day and in all, from one scan."""
    dims = ["verdict", "severity", "target_brand", "day"]
    rows = recent(scans, as_of, days).select("verdict", "severity", "target_brand", F.to_date("created_at").alias("day"))
    sets = [[F.col(d)] for d in dims] + [[]]
    return rows.groupingSets(sets, *dims).agg(
        F.count("*").alias("scans"), F.grouping_id(*dims).alias("grouping_set")
    ).select(*dims, F.col("grouping_set").cast("int").alias("grouping_set"), "scans")


def agg_distinct_urls(indicators: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct URLs per source.

    Exact: distinct (source, url) pairs first, then a count, so one large
    source is spread over all tasks.
    """
    if approximate:
        return indicators.groupBy("source").agg(F.approx_count_distinct("url").alias("distinct_urls"))
    return indicators.select("source", "url").distinct().groupBy("source").agg(F.count("*").alias("distinct_urls"))


def url_sketches(indicators: DataFrame, log_k: int = 14, time: str = "first_seen") -> DataFrame:
    """One sketch of the distinct URLs per day and source: day, source, sketch.

    Rows are folded into sketches of a few KB within their tasks.  Stored, the
    sketches answer for any span and set of sources (``distinct_urls_of``)
    without the rows; new days are appended.  Null URLs are not counted.
    """
    day = F.to_date(time).alias("day")
    return indicators.filter(F.col("url").isNotNull()).groupBy(day, "source").agg(F.hll_sketch_agg("url", log_k).alias("sketch"))


def distinct_urls_of(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated distinct URLs per group (or in all) from stored sketches alone.

    With ``log_k`` 14 the relative standard error is about 0.7 %.  A URL that
    several days or sources have counts once.
    """
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_urls"))


def agg_threat_trend(indicators: DataFrame, period: str = "WEEK") -> DataFrame:
    """Indicators per period, threat type and brand."""
    when = F.to_date(F.date_trunc(period, "first_seen")).alias("period")
    return indicators.groupBy(when, "threat_type", "target_brand").agg(F.count("*").alias("indicators"))


def win_trend_delta(scans: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Daily totals with the change to the day before and a 7-day mean.

    The windows run over the calendar rows (one per day), not over scans.
    """
    daily = agg_trend_daily(scans, as_of, days).groupBy("day").agg(F.sum("count").alias("scans"))
    by_day = Window.orderBy("day")
    return daily.select(
        "day", "scans",
        (F.col("scans") - F.lag("scans").over(by_day)).alias("change"),
        F.avg("scans").over(by_day.rowsBetween(-6, 0)).alias("mean_7_days"),
    )
