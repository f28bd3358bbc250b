"""Normalisation, look-ups, explanations, text features, models and streams on small tables."""

import json
import math
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from baitline.operators import explain, features as feat, history, match, normalize as norm, text, training, verdict
from baitline.plans.queries_jobs import assembled
from baitline.sources import readers, writers
from baitline.streaming import streams

AS_OF = "2024-02-01 00:00:00"


def phish(spark, *rows):
    names = ["phish_id", "url", "phish_detail_url", "submission_time", "verified", "verification_time", "online", "target"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], readers.PHISHTANK_SCHEMA)


def test_phishtank_rows(spark):
    raw = phish(
        spark,
        {"phish_id": "1", "url": "http://a.com", "verified": "yes", "submission_time": "2024-01-15T10:30:00+00:00", "target": "PayPal"},
        {"phish_id": "2", "url": "http://paypal-x.com", "verified": "no", "submission_time": "2024-01-15T10:30:00+02:00"},
        {"phish_id": "3", "url": "", "verified": "yes"},
        {"phish_id": "4", "url": "http://b.com", "verified": "no", "submission_time": "not-a-date"},
    )
    got = {r.source_id: r for r in norm.norm_phishtank(raw, AS_OF).collect()}
    assert set(got) == {"1", "2", "4"}
    assert (got["1"].confidence, got["1"].tags, got["1"].target_brand) == (1.0, ["phishing", "verified"], "PayPal")
    assert (got["2"].confidence, got["2"].tags, got["2"].target_brand) == (0.7, ["phishing", "unverified"], "PayPal")
    assert got["2"].first_seen == datetime(2024, 1, 15, 8, 30)
    assert got["4"].first_seen == datetime(2024, 2, 1)
    assert got["1"].metadata["verified"] == "true"
    assert norm.rejected_rows(raw, "phishtank").count() == 1


def test_urlhaus_and_post_rows(spark):
    raw = spark.createDataFrame(
        [("9", "http://x.com/m.exe", "online", "2024-01-15 10:30:00 UTC", "malware_download", ["exe", "trickbot"], None, "x.com", "u")],
        readers.URLHAUS_SCHEMA)
    row = norm.norm_urlhaus(raw, AS_OF).first()
    assert (row.threat_type, row.confidence, row.tags) == ("malware", 0.9, ["malware", "exe", "trickbot"])
    assert row.first_seen == row.last_seen == datetime(2024, 1, 15, 10, 30)
    posts = spark.createDataFrame(
        [("p", "Found this phishing site", "", "http://s.example", False, 42, 5, 1705315800, "/r/x/", "cybersecurity", "u"),
         ("q", "link", "", "https://reddit.com/r/x", False, 42, 5, 1705315800, "/r/x/", "cybersecurity", "u")],
        readers.POST_SCHEMA)
    rows = norm.norm_reddit(posts, AS_OF).collect()
    assert [(r.source_id, r.threat_type, r.target_brand, r.confidence) for r in rows] == [("p", "phishing", None, pytest.approx(0.92))]


def test_unknown_source_is_an_error(spark):
    with pytest.raises(ValueError, match="Unknown feed source"):
        norm.norm_all({"elsewhere": phish(spark)}, AS_OF)


def test_target_search_and_dates(spark):
    df = spark.createDataFrame(
        [(1, "u1", "yes", "PayPal", datetime(2024, 1, 1)), (2, "u2", "no", "paypal", datetime(2024, 1, 2)), (3, "u3", "yes", "Apple", datetime(2024, 1, 3, 23, 59))],
        "phish_id BIGINT, url STRING, verified STRING, target STRING, submission_time TIMESTAMP_NTZ")
    assert [r.phish_id for r in history.top_phish_by_target(df, "paypal").collect()] == [1]
    assert [r.phish_id for r in history.top_phish_by_date(df, "2024-01-02", "2024-01-03").collect()] == [3, 2]
    for bad in (("2024-01-03", "2024-01-02"), ("03.01.2024", "2024-01-04")):
        with pytest.raises(ValueError):
            history.top_phish_by_date(df, *bad)


def test_merge_keeps_first_and_last(spark, tmp_path):
    schema = "url STRING, source STRING, id BIGINT, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, threat_type STRING"
    old = spark.createDataFrame([("u", "s", 1, datetime(2024, 1, 2), datetime(2024, 1, 5), "phishing")], schema)
    new = spark.createDataFrame([("u", "s", 2, datetime(2024, 1, 1), datetime(2024, 1, 9), "malware"), ("u", "t", 3, datetime(2024, 1, 1), datetime(2024, 1, 1), "spam")], schema)
    path = str(tmp_path / "merged")
    writers.snk_indicators(old, new, path)
    rows = {r.source: r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 2
    assert (rows["s"].first_seen, rows["s"].last_seen, rows["s"].threat_type) == (datetime(2024, 1, 1), datetime(2024, 1, 9), "malware")


def test_replies(spark):
    replies = [
        ('{"summary": "s", "explanation": "e", "risk_factors": ["a"], "severity": "high", "recommended_action": "r", "target_brand": "B"}',
         ("s", "e", ["a"], "high", "r", "B")),
        ('```json\n{"summary": "s", "severity": "extreme"}\n```', ("s", "Unable to generate detailed explanation", [], "medium", "Review manually", None)),
        ("no json", ("Unable to generate AI explanation", "no json", [], "medium", "Review manually", None)),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i INT, reply STRING")
    for row in explain.explain_ingest(df).collect():
        assert (row.summary, row.explanation, row.risk_factors, row.severity, row.recommended_action, row.target_brand) == replies[row.i][1]


def test_cache_key_is_sorted_json(spark):
    import hashlib

    url = 'https://a.com/?q="x"\\y'
    result = feat.feat_core(spark.createDataFrame([(url,)], "url STRING"))
    row, key = result.first(), explain.explain_cache_key(result).first()
    features = {k: v for k, v in row.asDict().items() if k not in ("url", "redirect_chain", "ssl_issuer")}
    want = hashlib.sha256(json.dumps({"url": url, "features": features}, sort_keys=True).encode()).hexdigest()
    assert key.cache_key == want


def test_report_key(spark):
    import base64

    from baitline.functions import urls as U

    urls = ["https://a.com/?x=1", "http://é.com/~", "ab", "https://" + "long/" * 40]
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    for row in df.select("url", U.report_key(F.col("url")).alias("k")).collect():
        assert row.k == base64.urlsafe_b64encode(row.url.encode()).decode().strip("=")


def brute_grams(url):
    out = []
    for word in url.lower().split():
        padded = f" {word} "
        for n in range(2, 7):
            if n >= len(padded):
                out.append(padded)
                break
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return Counter(out)


def test_ngrams_and_weights_against_brute_force(spark):
    urls = ["http://aa.aa/aa", "b", "x y zz", "http://Aa.com/aaaa?b=aa"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING")
    counts = [brute_grams(u) for u in urls]
    vocabulary = {r.term: (r.corpus_count, r.document_count) for r in text.feat_char_ngrams(df).collect()}
    terms = set().union(*counts)
    assert vocabulary == {t: (sum(c[t] for c in counts), sum(t in c for c in counts)) for t in terms}
    got = {(r.page_id, r.term): r.weight for r in text.feat_tfidf(df, text.feat_char_ngrams(df), "char").collect()}
    for i, c in enumerate(counts):
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(urls)) / (1 + vocabulary[t][1])) + 1) for t, n in c.items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        for t, w in raw.items():
            assert got[i, t] == pytest.approx(w / size)


def test_assembled_vectors(spark, tables):
    vectors = assembled(tables, 50, 20)
    row = vectors.first()
    assert row.vector.size == 50 + 20 + 26
    blocks = [(r.vector.toArray()[:50], r.vector.toArray()[50:70]) for r in vectors.collect()]
    for chars, tokens in blocks:
        for block in (chars, tokens):
            size = math.sqrt(float((block ** 2).sum()))
            assert size == 0 or size == pytest.approx(1.0)


def test_models_learn_a_simple_rule(spark):
    rows = [(f"https://site{i}.{'tk' if i % 2 else 'com'}/p{i % 7}", i % 2) for i in range(200)]
    samples = training.train_split(spark.createDataFrame(rows, "url STRING, label INT"))
    vectors = feat.with_vector(feat.feat_core(samples))
    models, predictions = training.train_models(vectors, trees=30, rounds=10, depth=5, rounds_depth=3)
    assert set(models) == {"gradient_boosting", "random_forest", "logistic_regression"}
    right = predictions.groupBy("model").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("share"))
    assert {r.model for r in right.filter("share >= 0.9").collect()} == set(models)
    scored = verdict.score_model(vectors, models["random_forest"])
    assert scored.filter("ml_confidence < 0.5").count() == 0


def test_known_threat_decides_alone(spark):
    urls = spark.createDataFrame([(1, "https://evil.com/a"), (2, "https://evil.com/a"), (3, "https://fine.com")], "page_id INT, url STRING")
    feeds = spark.createDataFrame([("http://evil.com/a/", "phishtank", "phishing", ""), ("https://evil.com/a", "urlhaus", "malware", "X")],
                                  "url STRING, source STRING, threat_type STRING, target_brand STRING")
    got = {r.page_id: r for r in verdict.analyze_urls(urls, feeds).collect()}
    assert len(got) == 3
    assert (got[1].verdict, got[1].confidence, got[1].sources, got[1].threat_type) == ("phishing", 0.98, ["urlhaus", "phishtank"], "malware")
    assert got[2].feature_importance == {"threat_feed_match": 1.0}
    assert (got[3].verdict, got[3].sources, got[3].prediction_source) == ("safe", None, "rules")
    assert match.join_unseen_urls(urls, feeds).collect()[0].url == "https://fine.com"


def test_streams_equal_batch(spark):
    plans = entry.queries()
    folder = "/root/testdata/sf0.001"
    stream = plans["st_circuit"](spark, folder)
    batch = plans["win_circuit_breaker"](spark, folder)
    assert stream.select(*batch.columns).exceptAll(batch).count() == 0
    assert stream.count() == batch.count()


def test_recheck_lets_through_after_the_ttl(spark, tmp_path):
    from datetime import datetime, timedelta

    from baitline.streaming import streams

    start = datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else "b", start + timedelta(seconds=40 * i)) for i in range(60)]
    spark.createDataFrame(rows, "scan_id BIGINT, url STRING, created_at TIMESTAMP_NTZ").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("scan_id BIGINT, url STRING, created_at TIMESTAMP_NTZ").parquet(f"{tmp_path}/in")
    streams.run_available(streams.st_recheck_ttl(stream, 300, 0), f"{tmp_path}/out", f"{tmp_path}/state")
    want, last = set(), {}
    for i, url, at in rows:
        if url not in last or at >= last[url] + timedelta(seconds=300):
            last[url] = at
            want.add(i)
    assert {r.scan_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_rows_without_a_url_are_errors(spark):
    from baitline.operators import verdict

    df = spark.createDataFrame([(1, None), (2, ""), (3, "no url"), (4, "https://example.com/a")], "page_id INT, url STRING")
    got = verdict.analyze_urls(df)
    assert {r.page_id: r.verdict == "error" for r in got.collect()} == {1: True, 2: True, 3: True, 4: False}
    report = verdict.batch_report(got).first()
    assert (report.processed, report.failed) == (1, 3)


def test_limits_are_honoured_or_refused(spark):
    from baitline.operators import stats, vendors

    df = spark.range(1500).selectExpr("id AS phish_id", "'yes' AS online", "timestamp_ntz'2024-01-02' AS submission_time", "'t' AS target")
    assert history.top_recent_phish(df, 1200).count() == 1200
    with pytest.raises(ValueError):
        history.top_recent_phish(df, 0)
    with pytest.raises(ValueError):
        stats.agg_phish_stats(df, "2024-01-03", days=0)
    late = [{"_id": f"r{i}", "task": {"method": "manual", "time": "t"}, "verdicts": {"overall": {"malicious": i == 10}}} for i in range(11)]
    report = spark.createDataFrame([("u", json.dumps({"total": 11, "results": late}))], "url STRING, report STRING")
    assert vendors.vendor_scan_history(report).first().scan_ids == ["r10"]


def test_search_takes_a_backslash_as_itself(spark):
    from datetime import datetime

    df = spark.createDataFrame([(1, "http://a/x\\y", datetime(2024, 1, 1)), (2, "http://a/xy", datetime(2024, 1, 1))], "scan_id INT, url STRING, created_at TIMESTAMP_NTZ")
    assert [r.scan_id for r in history.top_search_scans(df, "x\\Y").collect()] == [1]
    assert [r.scan_id for r in history.top_search_scans(df, "x\\").collect()] == [1]


def test_replies_are_read_strictly(spark):
    from baitline.operators import explain

    rows = ['{"summary":"s"} Hope this helps!', "{'summary':'q'}", '{"risk_factors":"one","summary":null}', '```json\n{"summary":"s","severity":"high"}\n```', '{"summary":5}', '[1]']
    got = {r.i: r for r in explain.explain_ingest(spark.createDataFrame(list(enumerate(rows)), "i INT, reply STRING")).collect()}
    fallback = "Unable to generate AI explanation"
    assert [got[i].summary for i in range(6)] == [fallback, fallback, None, "s", "5", fallback]
    assert got[2].risk_factors == ["one"] and got[3].severity == "high" and got[4].risk_factors == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registered_models_are_trained_at_full_size(tables, monkeypatch):
    from baitline.plans import queries_jobs, registry

    class Seen(Exception):
        pass

    def seen(vectors, names=None, seed=42, **sizes):
        raise Seen(vectors.first().vector.size, names, sizes)

    registry.queries()
    monkeypatch.setattr(queries_jobs, "_TRAINED", {})
    monkeypatch.setattr(training, "train_models", seen)
    for key in ("train_models", "train_importance", "score_model", "analyze_urls_with_model"):
        with pytest.raises(Seen) as caught:
            registry._PLANS[key](tables)
        assert caught.value.args == (10_000 + 2_000 + 26, None, {})


def test_vectors_equal_long_rows(spark):
    """The Arrow pass against the exploded form, with odd characters, blanks and vocabularies that end in each other."""
    urls = ["http://aa.aa/aa", "b", "x y  zz\tq", "http://Aa.com/aaaa?b=aa", "https://例え.jp/ä\U0001f600", "", " ", "http://new.example/unseen", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING").repartition(3)
    known = df.filter("page_id < 7")
    for chars, tokens in ((10_000, 2_000), (40, 5), (1, 1)):
        c = text.numbered(text.feat_char_ngrams(known, chars), chars)
        w = text.numbered(text.feat_token_terms(known, tokens), tokens)
        got = text.feat_assemble(df, c, w, chars, tokens, documents=7)
        assert got.count() == len(urls)
        rows = {(r.page_id, r.entry): r.weight for r in text.vector_entries(got, "page_id").filter(f"entry < {chars + tokens}").collect()}
        want = {}
        for kind, vocabulary, first in (("char", c, 0), ("token", w, chars)):
            for r in text.feat_tfidf(df.filter("url IS NOT NULL"), vocabulary, kind, documents=7).join(vocabulary, "term").collect():
                want[r.page_id, first + r.place] = r.weight
        assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want) and len(want) > 3
    with pytest.raises(ValueError):
        text.vectorizer("char", c, text.MOST_TERMS + 1, 7)


def _small(rows, seed=42, **sizes):
    from pyspark.ml.classification import LogisticRegression

    return {"logistic_regression": LogisticRegression(featuresCol="vector", labelCol="label", maxIter=10, regParam=0.1)}


def test_models_are_stored_and_score_streams(spark, tables, tmp_path, monkeypatch):
    """A stored logistic model: its score by SQL over long rows, and the same on a stream as on a table."""
    monkeypatch.setattr(training, "classifiers", _small)
    samples = training.train_split(tables.distinct_samples)
    train = samples.filter("split = 'train'")
    chars, tokens = text.numbered(text.feat_char_ngrams(train, 300), 300), text.numbered(text.feat_token_terms(train, 60), 60)
    n = train.count()
    vectors = text.feat_assemble(samples, chars, tokens, 300, 60, n)
    models, _ = training.train_models(vectors)
    training.save_models(models, chars, tokens, n, str(tmp_path / "m"))
    model, known = training.load_model(spark, "logistic_regression", str(tmp_path / "m"))
    assert known[2] == n
    urls = tables.url_corpus.select("page_id", "url")
    batch = text.feat_assemble(urls, *known[:2], 300, 60, n)
    weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.coefficients.toArray())], "entry INT, coefficient DOUBLE")
    by_sql = text.vector_entries(batch, "page_id").join(weights, "entry").groupBy("page_id").agg(
        (1 / (1 + F.exp(-(F.sum(F.col("weight") * F.col("coefficient")) + F.lit(model.intercept))))).alias("p"))
    scored = verdict.score_model(batch, model).join(by_sql, "page_id")
    assert scored.count() == urls.count()
    assert scored.filter("abs(p - ml_probability) > 1e-9").count() == 0

    urls.write.parquet(str(tmp_path / "in"))
    stream = text.feat_assemble(spark.readStream.schema(urls.schema).parquet(str(tmp_path / "in")), *known[:2], 300, 60, n)
    listed = urls.limit(3).selectExpr(
        "url", "true AS is_known_threat", "array('urlhaus') AS sources", "'malware' AS threat_type", "'phishing' AS verdict", "0.98D AS confidence",
        "array('known_threat:urlhaus') AS matched_rules").distinct()
    columns = ["page_id", "url", "verdict", "confidence", "prediction_source"]
    streams.run_available(streams.st_score(stream, model, listed).select(*columns), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = verdict.analyze_urls(batch, model=model, known=listed).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert got.filter("prediction_source = 'threat_feed'").count() >= 3


def test_models_of_a_data_set_are_fitted_once(spark, tables, monkeypatch):
    from baitline.plans import queries_jobs as Q

    fits = []

    def small(vectors, names=None, seed=42, **sizes):
        fits.append(1)
        return fit(vectors, names, seed)

    fit = training.train_models
    monkeypatch.setattr(training, "train_models", small)
    monkeypatch.setattr(training, "classifiers", _small)
    monkeypatch.setattr(Q, "_TRAINED", {})
    monkeypatch.setattr(Q, "CHARS", 200)
    monkeypatch.setattr(Q, "TOKENS", 50)
    Q.best_model(tables)
    model, vectors = Q._scoring(tables)
    seen = spark.read.parquet(f"{Q.trained(tables)}/trained-on")
    assert len(fits) == 1 and vectors.join(seen, "url").count() == 0 and vectors.count() > 0


def test_importances_are_those_of_the_last_block():
    from types import SimpleNamespace

    from pyspark.ml.linalg import Vectors

    model = SimpleNamespace(featureImportances=Vectors.sparse(6, [0, 4, 5], [0.5, 0.2, 0.3]))
    assert training.importances(model, ["a", "b", "c"]) == {"a": 0.0, "b": 0.2, "c": 0.3}


def test_analysis_scores_the_vector_it_is_given(spark):
    rows = [(i, f"https://site{i}.com/p", i % 2) for i in range(40)]
    vectors = feat.with_vector(feat.feat_core(spark.createDataFrame(rows, "page_id INT, url STRING, label INT"))).select(
        "page_id", "url", F.col("label").cast("double").alias("label"))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["label"], outputCol="vector").transform(vectors)
    model = LogisticRegression(featuresCol="vector", labelCol="label", regParam=0.01).fit(vectors)
    got = verdict.analyze_urls(vectors, None, model).select("page_id", "ml_probability").collect()
    assert {r.page_id % 2 == 1 for r in got if r.ml_probability > 0.5} == {True}
    assert sum(r.ml_probability > 0.5 for r in got) == 20


def test_all_sources_are_asked(spark):
    from types import SimpleNamespace

    from baitline.plans import registry

    registry.queries()
    urls = ["https://feed.com/a", "https://scanned.com/a", "https://posted.com/a", "https://clean.com/a", "https://looked.up/a"]
    history = {"total": 1, "results": [{"_id": "r", "task": {"method": "manual", "time": "t"}, "verdicts": {"overall": {"malicious": True}}}]}
    reports = "url STRING, report STRING"
    t = SimpleNamespace(
        url_corpus=spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING"),
        threat_indicators_raw=spark.createDataFrame([(urls[0], "urlhaus", "malware", "")], "url STRING, source STRING, threat_type STRING, target_brand STRING"),
        engine_reports=spark.createDataFrame([], reports),
        blocklist_reports=spark.createDataFrame([(urls[3], "{}")], reports),
        domain_reports=spark.createDataFrame([(urls[1], json.dumps(history))], reports),
        lookup_reports=spark.createDataFrame([
            (urls[4], json.dumps({"query_status": "ok", "threat": "malware_download", "tags": ["exe"]})),
            (urls[0], json.dumps({"query_status": "ok", "threat": "other"})), (urls[3], json.dumps({"query_status": "ok", "threat": ""})),
            (urls[3], "no reply")], reports),
        posts=spark.createDataFrame(
            [(str(i), "New phishing kit spotted", 80, "phishing", "see https://www.posted.com/x", None, 1704067200, f"/r/{i}/") for i in range(2)],
            "post_id STRING, title STRING, score INT, subreddit STRING, selftext STRING, url STRING, created_utc BIGINT, permalink STRING"),
    )
    got = {r.url: (r.sources, r.threat_type, r.n_details) for r in registry._PLANS["check_all_sources"](t).collect()}
    assert got == {urls[0]: ("urlhaus", "malware", 1), urls[1]: ("urlscan", None, 1), urls[2]: ("reddit", "reported", 1),
                   urls[4]: ("urlhaus", "malware_download", 1)}

    from baitline.plans.queries_urls import checked_everywhere

    result = {r.url: (r.verdict, r.confidence) for r in verdict.analyze_urls(t.url_corpus, known=checked_everywhere(t)).collect()}
    assert [result[u] for u in urls[:3]] == [("phishing", 0.98)] * 3 and result[urls[3]][0] != "phishing"


def test_sources_of_the_corpus_differ(tables):
    """The fixtures have clean URLs, and URLs that one source alone knows."""
    from baitline.plans.queries_urls import checked_everywhere

    known = [r.sources for r in checked_everywhere(tables).select("sources").collect()]
    assert 0 < len(known) < 0.8 * tables.corpus_urls.count()
    assert {s[0] for s in known if len(s) == 1} >= {"urlhaus", "virustotal", "google_safebrowsing", "urlscan"}
    assert {s for sources in known for s in sources} >= {"reddit", "phishtank"}


def test_prompts_carry_the_details(tables):
    from baitline.operators import explain
    from baitline.plans.queries_urls import batch

    told = explain.explain_prompts(batch(tables)).filter("prompt LIKE '%\\n- urlscan: {\"total_scans\"%'")
    assert told.count() > 0


def test_no_limit_is_no_limit(spark):
    from types import SimpleNamespace

    from baitline.operators import stats
    from pyspark.ml.linalg import Vectors

    df = spark.range(150).selectExpr(
        "id AS phish_id", "id AS scan_id", "'u' AS url", "'yes' AS online", "'yes' AS verified", "concat('t', id) AS target",
        "concat('t', id) AS target_brand", "'phishing' AS verdict", "timestamp_ntz'2024-01-02' AS submission_time", "timestamp_ntz'2024-01-02' AS created_at")
    for rows in (
        history.top_recent_scans(df), history.top_search_scans(df, "u"), history.top_scans_filtered(df), history.top_recent_phish(df),
        history.top_phish_by_target(df, "t"), history.top_phish_by_date(df, "2024-01-01", "2024-01-03"),
        stats.agg_top_brands(df, "2024-01-03 00:00:00"), stats.agg_top_targets(df, "2024-01-03 00:00:00"),
    ):
        assert rows.count() == 150
    model = SimpleNamespace(featureImportances=Vectors.dense([0.1] * 12))
    assert training.train_importance(model, [f"f{i}" for i in range(12)], df).count() == 12


def test_unlimited_feed_queries_return_all(spark, tables):
    from baitline.plans import registry

    plans = entry.queries()
    folder = "/root/testdata/sf0.001"
    assert plans["norm_fetch_all_unlimited"](spark, folder).count() == plans["norm_all"](spark, folder).count()
    assert plans["norm_live_feed_unlimited"](spark, folder).count() == tables.threat_indicators_raw.count()
    assert {"norm_fetch_all_unlimited", "norm_live_feed_unlimited"} <= set(registry.oracle_sql())


def test_vendor_jobs_find_all_urls_that_the_reports_name(spark):
    import __spark_entry__ as entry
    from baitline.operators import vendors
    from baitline.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    number = [r.p for r in t.corpus_urls.collect()]
    found = {k: entry.queries()[k](spark, t.sf_dir).count() for k in ("vendor_multi_engine", "vendor_blocklist", "vendor_scan_history")}
    assert found["vendor_multi_engine"] == sum(p % 4 > 0 or p % 3 > 0 for p in number)
    assert found["vendor_blocklist"] == sum(p % 3 > 0 for p in number)
    assert found["vendor_scan_history"] == len(number)
    clean = '{"total":1,"results":[{"_id":"r","task":{"method":"manual","time":"t"},"verdicts":{"overall":{"malicious":false}},"stats":{"phishing":2}}]}'
    assert vendors.vendor_scan_history(spark.createDataFrame([("u", clean)], "url STRING, report STRING")).count() == 0


def test_an_arrow_batch_is_looked_up_in_pieces(spark, monkeypatch):
    """However many rows a batch has, the terms of a few are held at once, and the vectors are the same."""
    import pandas as pd

    assert text.AT_ONCE <= 1_000
    seen, weigh = [], text._weights
    monkeypatch.setattr(text, "_weights", lambda rows, places, n, idf, size: (seen.append(n), weigh(rows, places, n, idf, size))[1])
    monkeypatch.setattr(text, "_checked", lambda vocabulary, size: (["a", "ab", "b/", "c"], [1, 2, 3, 4]))
    monkeypatch.setattr(text.F, "pandas_udf", lambda kind: lambda f: f)
    urls = pd.Series([None if i % 7 == 0 else f"ab/c{i}" for i in range(2_500)])
    for kind in ("char", "token"):
        build = text.vectorizer(kind, None, 4, 10)
        seen.clear()
        whole = build(urls)
        assert seen == [1000, 1000, 500] and len(whole) == len(urls)
        for i in (0, 1, 999, 1000, 2499):
            alone = build(urls.iloc[[i]].reset_index(drop=True))
            assert whole["indices"][i].tolist() == alone["indices"][0].tolist() and whole["values"][i].tolist() == alone["values"][0].tolist()


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    """No fit waits for another one's many short jobs."""
    import threading

    together = threading.Barrier(3)

    class Fit:
        def __init__(self, rate):
            self.rate = rate

        def fit(self, train):
            together.wait(60)
            assert train.count() == 3
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(self.rate))

    monkeypatch.setattr(training, "classifiers", lambda rows, seed: {"c": Fit(1.0), "a": Fit(0.0), "b": Fit(1.0)})
    rows = spark.createDataFrame([(f"u{i}", i % 2, "train" if i < 3 else "test") for i in range(5)], "url STRING, label INT, split STRING")
    models, predictions = training.train_models(rows)
    assert list(models) == ["c", "a", "b"]
    assert {(r.model, r.ordinal, r.prediction) for r in predictions.collect()} == {("c", 0, 1), ("a", 1, 0), ("b", 2, 1)}
    assert predictions.count() == 6


def test_a_pass_of_a_fit_is_one_wave_of_even_tasks(spark, monkeypatch):
    """The fits are many short jobs: a second wave or a stage that adds up many sums costs more than the rows do."""
    dealt = {}

    class Fit:
        def __init__(self, name):
            self.name = name

        def fit(self, train):
            dealt[self.name] = [len(part) for part in train.select("url").rdd.glom().collect()]
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(0.0))

    models = ("gradient_boosting", "random_forest", "logistic_regression")
    monkeypatch.setattr(training, "classifiers", lambda rows, seed: {name: Fit(name) for name in models})

    def fitted(n):
        training.train_models(spark.range(n + 5).repartition(9).selectExpr(
            "CASE WHEN id > 0 THEN concat('u', id) END AS url", "CAST(id % 2 AS INT) AS label", f"IF(id < {n}, 'train', 'test') AS split"))

    cores = spark.sparkContext.defaultParallelism
    fitted(50_000)
    assert all(sum(parts) == 50_000 for parts in dealt.values())
    assert len(dealt["logistic_regression"]) == 1
    for name in models[:2]:
        assert len(dealt[name]) == min(12, max(cores - 1, 2)) and max(dealt[name]) < 1.1 * 50_000 / len(dealt[name])
    fitted(500)
    assert [len(parts) for parts in dealt.values()] == [1, 1, 1] and all(sum(parts) == 500 for parts in dealt.values())
