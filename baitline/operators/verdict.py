"""Scores, combined verdicts, importance and the batch report."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, urls as U
from . import features as feat, match, rules as R


def score_model(vectors: DataFrame, model: Model) -> DataFrame:
    """ml_probability of phishing, ml_verdict and ml_confidence."""
    scored = model.transform(vectors).withColumn("ml_probability", F.get(vector_to_array("probability"), F.lit(1)))
    p = F.col("ml_probability")
    return scored.select(
        "*",
        F.when(p > 0.5, "phishing").otherwise("safe").alias("ml_verdict"),
        F.greatest(p, 1 - p).alias("ml_confidence"),
    ).drop("probability", "rawPrediction", "prediction")


def score_combine(rated: DataFrame, ml_weight: float = 0.6) -> DataFrame:
    """Merge the model's and the rules' verdict.

    Needs verdict, confidence, risk_score and matched_rules of the rules and,
    where a model ran, ml_verdict and ml_confidence (NULL: rules alone).
    """
    ml = F.when(F.col("ml_verdict") == "phishing", F.col("ml_confidence")).otherwise(1 - F.col("ml_confidence"))
    staged = rated.withColumn("_s", F.lit(ml_weight) * ml + F.lit(1 - ml_weight) * F.col("risk_score"))
    s = F.col("_s")
    by_score = F.when(s >= 0.6, "phishing").when(s >= 0.3, "suspicious").otherwise("safe")
    sure = (
        F.when(s >= 0.6, F.least(0.7 + s * 0.29, F.lit(0.99)))
        .when(s >= 0.3, 0.5 + s * 0.2)
        .otherwise(0.7 + (1 - s) * 0.25)
    )
    pattern = F.array_contains("matched_rules", "suspicious_pattern")
    no_model = F.col("ml_verdict").isNull()
    return staged.select(
        *[c for c in rated.columns if c not in ("verdict", "confidence")],
        F.when(no_model, F.col("verdict")).when(pattern, "phishing").otherwise(by_score).alias("verdict"),
        F.when(no_model, F.col("confidence")).when(pattern, F.greatest(sure, F.lit(0.9))).otherwise(sure).alias("confidence"),
    )


def rule_importance(scores: str) -> Column:
    """The 11 features' shares of the rule scores (``scores``: a map column by rule name)."""
    totals = []
    for feature in fixed.VECTOR11:
        shares = [
            f"coalesce(try_element_at({scores}, '{rule}'), 0D) / {len(names)}"
            for rule, names in fixed.RULE_FEATURES.items() if feature in names
        ]
        totals.append(" + ".join(shares) or "0D")
    return F.expr(f"array({', '.join(totals)})")


def _scaled(values: Column) -> Column:
    top = F.array_max(values)
    return F.transform(values, lambda v: F.when(top > 0, v / top).otherwise(v))


def with_importance(rated: DataFrame, ml_importance: dict[str, float] | None = None, ml_weight: float = 0.6) -> DataFrame:
    """Add the map ``feature_importance``; needs ``rules``."""
    names = list(fixed.VECTOR11)
    scores = F.map_from_arrays(F.col("rules.rule_name"), F.col("rules.score"))
    staged = rated.withColumn("_scores", scores).withColumn("_w", rule_importance("_scores"))
    staged = staged.drop("_scores").withColumn("_w", _scaled(F.col("_w")))
    if ml_importance:
        names += [n for n in ml_importance if n not in names]
        mixed = [
            F.lit(ml_weight * ml_importance.get(n, 0.0))
            + F.lit(1 - ml_weight) * (F.get(F.col("_w"), F.lit(i)) if i < len(fixed.VECTOR11) else F.lit(0.0))
            for i, n in enumerate(names)
        ]
        staged = staged.withColumn("_w", F.array(*mixed)).withColumn("_w", _scaled(F.col("_w")))
    keys = U.word_array(names)
    return staged.withColumn("feature_importance", F.map_from_arrays(keys, F.col("_w"))).drop("_w")


def score_importance(
    rated: DataFrame, ml_importance: dict[str, float] | None = None, ml_weight: float = 0.6
) -> DataFrame:
    """One row per URL and feature."""
    key = [c for c in ("page_id", "scan_id", "url") if c in rated.columns]
    explained = with_importance(rated, ml_importance, ml_weight)
    return explained.select(*key, F.explode_outer("feature_importance").alias("feature", "importance"))


def analyze_urls(
    urls: DataFrame,
    indicators: DataFrame | None = None,
    model: Model | None = None,
    rules: list[R.Rule] | None = None,
    ml_weight: float = 0.6,
    ml_importance: dict[str, float] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Analyse each URL: feeds first, then rules and model.

    ``known`` is one row per URL that any source lists, from
    ``match.check_all_sources``; it takes the place of ``indicators``, which
    match feeds alone.

    ``urls`` may carry the network columns of ``join_asof_enrich``.  Features
    and rules are computed for every row; a feed match then decides alone.
    The only shuffles are those of the feed match, which sees distinct URLs.
    A ``model`` reads column ``vector``: that of ``urls`` where it has one (see
    ``text.feat_assemble``), else the clipped 11-value vector.
    A NULL, blank or unparseable URL gets the verdict ``error``.
    """
    if indicators is not None and known is not None:
        raise ValueError("give indicators or known, not both: known holds what the feeds say")
    rated = R.with_verdict(R.with_rules(feat.feat_core(urls), rules))
    if model is not None:
        rated = score_model(rated if "vector" in urls.columns else feat.with_vector(rated), model).drop("vector")
        rated = score_combine(rated, ml_weight).withColumn("prediction_source", F.lit("ml_and_rules"))
    else:
        rated = rated.withColumn("prediction_source", F.lit("rules"))
    explained = with_importance(rated, ml_importance, ml_weight).drop("rules")
    explained = _with_errors(explained)
    if known is not None:
        return with_feed_verdict(explained, known)
    if indicators is None:
        return explained.withColumn("sources", F.lit(None).cast("array<string>")).withColumn(
            "threat_type", F.lit(None).cast("string"))
    return with_feed_verdict(explained, match.join_feed_verdict(urls, indicators))


def with_feed_verdict(rated: DataFrame, hits: DataFrame) -> DataFrame:
    """Let the sources decide where they list the URL; ``hits`` has one row per URL.

    ``details`` per source are passed on where ``hits`` has them.
    """
    if "details" not in hits.columns:
        hits = hits.withColumn("details", F.lit(None).cast("array<struct<source:string,details:string>>"))
    hits = hits.select(
        "url", "is_known_threat", F.col("sources").alias("_sources"), F.col("threat_type").alias("_threat"),
        F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"),
        F.col("matched_rules").alias("_matched"), F.col("details").alias("_details"),
    )
    known = F.coalesce("is_known_threat", F.lit(False))
    replaced = {
        "verdict": F.col("_verdict"),
        "confidence": F.col("_confidence"),
        "matched_rules": F.col("_matched"),
        "feature_importance": F.create_map(F.lit("threat_feed_match"), F.lit(1.0)),
        "prediction_source": F.lit("threat_feed"),
    }
    own = [c for c in rated.columns if c not in ("sources", "threat_type", "details")]
    return rated.select(*own).join(hits, "url", "left").select(
        *[F.when(known, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in own],
        F.col("_sources").alias("sources"), F.col("_threat").alias("threat_type"), F.col("_details").alias("details"),
    )


def _with_errors(rated: DataFrame) -> DataFrame:
    """Rows that hold no URL: verdict ``error``, confidence 0, no rules."""
    bad = ~F.coalesce(U.is_absolute(F.col("url")), F.lit(False))
    kinds = dict(rated.dtypes)
    said = {
        "verdict": F.lit("error"), "confidence": F.lit(0.0), "prediction_source": F.lit("error"),
        "matched_rules": F.array().cast(kinds["matched_rules"]),
        "feature_importance": F.create_map().cast(kinds["feature_importance"]),
    }
    return rated.select(*[F.when(bad, said[c]).otherwise(F.col(c)).alias(c) if c in said else F.col(c) for c in rated.columns])


def batch_report(results: DataFrame) -> DataFrame:
    """Processed, failed and verdict counts of a batch in one pass."""
    return results.agg(
        F.count_if(F.col("verdict") != "error").alias("processed"),
        F.count_if(F.col("verdict") == "error").alias("failed"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in fixed.VERDICTS],
    )


def batch_ranked(results: DataFrame) -> DataFrame:
    """Most urgent first: phishing, error, suspicious, safe.

    The other columns break ties, so that a URL scanned very often can still be
    spread over several sorted partitions.
    """
    rank = (
        F.when(F.col("verdict") == "phishing", 0).when(F.col("verdict") == "error", 1)
        .when(F.col("verdict") == "suspicious", 2).when(F.col("verdict") == "safe", 3).otherwise(9)
    )
    rest = [c for c, kind in results.dtypes if c != "url" and not kind.startswith("map")]
    return results.withColumn("urgency", rank).orderBy("urgency", "url", *rest)
