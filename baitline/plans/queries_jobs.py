"""Queries that train, score or stream."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..operators import normalize as norm, stats, text, training, verdict
from ..sources import upsert, writers
from ..streaming import streams
from . import oracle_text as O
from .queries_scans import BREAKER_SQL
from .queries_urls import _KNOWN, checked_everywhere
from .registry import AS_OF, query
from .session import scratch_path
from .views import Tables, VIEWS

# --- training data -----------------------------------------------------------


@query("train_dedup", "SELECT DISTINCT url, label FROM samples")
def _(t):
    return training.train_dedup(t.samples.select("url", "label"))


@query("train_legit_expand", f"""
WITH p AS (SELECT unnest([{', '.join(repr(x) for x in fixed.LEGIT_PATHS)}]) AS p),
 r AS (SELECT domain, p, row_number() OVER (PARTITION BY domain ORDER BY md5(concat('42|', domain, '|', p)), p) AS i FROM ranked_domains, p)
SELECT domain, 'https://' || domain AS url FROM ranked_domains UNION ALL SELECT domain, 'https://www.' || domain FROM ranked_domains
UNION ALL SELECT domain, 'https://' || domain || p FROM r WHERE i <= 3""")
def _(t):
    return training.train_legit_expand(t.ranked_domains)


@query("train_legit_rooted", f"""
WITH p AS (SELECT unnest([{', '.join(repr(x) for x in fixed.COMMON_PATHS)}]) AS p),
 lucky AS (SELECT domain FROM ranked_domains WHERE CAST('0x' || substr(md5(concat('42|', domain, '|extra')), 1, 8) AS BIGINT) < 0.3 * 4294967296)
SELECT domain, 'https://' || domain || '/' AS url FROM ranked_domains
UNION ALL SELECT domain, 'https://' || domain || arg_min(p, md5(concat('42|', domain, '|', p))) FROM lucky, p GROUP BY domain""")
def _(t):
    return training.train_legit_expand(t.ranked_domains, style="rooted")


@query("train_balance", """
SELECT url, label FROM distinct_samples QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', url)), url)
 <= (SELECT min(n) FROM (SELECT count(*) AS n FROM distinct_samples GROUP BY label))""")
def _(t):
    return training.train_balance(t.distinct_samples.select("url", "label"))


@query("train_split", """
SELECT url, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', url)), url)
 <= floor(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split FROM distinct_samples""")
def _(t):
    return training.train_split(t.distinct_samples.select("url", "label"))


@query("agg_collection_stats", """
SELECT CASE label WHEN 1 THEN 'phishing' ELSE 'legitimate' END AS label, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS source,
 count(*) AS samples FROM samples GROUP BY ROLLUP (CASE label WHEN 1 THEN 'phishing' ELSE 'legitimate' END, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END)""")
def _(t):
    rows = t.samples.select(
        F.when(F.col("label") == 1, "phishing").otherwise("legitimate").alias("label"),
        F.when(F.col("url").startswith("https"), "secure").otherwise("plain").alias("source"),
    )
    return stats.agg_collection_stats(rows)


# --- models ------------------------------------------------------------------

#: Sizes of the character and token blocks of the model vector.
CHARS, TOKENS = 10_000, 2_000
#: Samples of a task that counts terms or makes vectors.
SAMPLES_PER_TASK = 2_000


def split_samples(t: Tables) -> DataFrame:
    """Distinct samples with ``split``, stored once for the several passes of training.

    Rows are small and their terms are many: a file holds few rows, so that
    terms are counted and vectors made by all cores.
    """
    path = scratch_path(t.spark, "samples")
    split = training.train_split(t.distinct_samples)
    split.write.parquet(path)
    stored = t.spark.read.parquet(path)
    pieces = stored.count() // SAMPLES_PER_TASK
    return stored.repartition(pieces, "url") if pieces > stored.rdd.getNumPartitions() else stored


def vocabularies(samples: DataFrame, char_size: int, token_size: int) -> tuple[DataFrame, DataFrame, int]:
    """Numbered vocabularies of the training rows alone, and the number of those rows."""
    train = samples.filter(F.col("split") == "train")
    chars = text.numbered(text.feat_char_ngrams(train, char_size), char_size)
    tokens = text.numbered(text.feat_token_terms(train, token_size), token_size)
    return chars, tokens, train.count()


def _vectors(t: Tables, urls: DataFrame, known: tuple[DataFrame, DataFrame, int], char_size: int, token_size: int) -> DataFrame:
    """Model vectors of the URLs, stored once for the several passes over them."""
    path = scratch_path(t.spark, "vectors")
    chars, tokens, documents = known
    text.feat_assemble(urls, chars, tokens, char_size, token_size, documents=documents).write.parquet(path)
    return t.spark.read.parquet(path)


def assembled(t: Tables, char_size: int, token_size: int) -> DataFrame:
    """Model vectors of the split samples; vocabularies come from the training rows alone."""
    samples = split_samples(t)
    return _vectors(t, samples, vocabularies(samples, char_size, token_size), char_size, token_size)


_SPLIT = """split_rows AS (SELECT page_id, url, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', url)), url)
  <= floor(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split FROM distinct_samples)"""
_LEXICAL_ROWS = " UNION ALL ".join(
    f"SELECT page_id, {CHARS + TOKENS + i} AS entry, CAST({c} AS DOUBLE) AS weight FROM lexical" for i, c in enumerate(fixed.VECTOR26))


def _tfidf_rows(kind: str, grams: str, size: int, first: int) -> str:
    """CTE ``{kind}_rows`` (page_id, entry, weight) from the occurrences ``grams`` (page_id, split, term)."""
    return f"""
 {kind}_grams AS ({grams}),
 {kind}_counts AS (SELECT page_id, split, term, count(*) AS tf FROM {kind}_grams GROUP BY ALL),
 {kind}_best AS (SELECT term, sum(tf) AS n, count(*) AS documents FROM {kind}_counts WHERE split = 'train' GROUP BY term ORDER BY n DESC, term LIMIT {size}),
 {kind}_terms AS (SELECT term, documents, row_number() OVER (ORDER BY term) - 1 AS place FROM {kind}_best),
 {kind}_weights AS (SELECT page_id, place, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM split_rows WHERE split = 'train')) / (1 + documents)) + 1) AS w
  FROM {kind}_counts JOIN {kind}_terms USING (term)),
 {kind}_rows AS (SELECT page_id, CAST({first} + place AS BIGINT) AS entry, w / sqrt(sum(w * w) OVER (PARTITION BY page_id)) AS weight FROM {kind}_weights)"""


_ASSEMBLED = "WITH " + _SPLIT + "," + _tfidf_rows("char", """SELECT page_id, split, substr(w, unnest(range(1, length(w) - n + 2)), n) AS term
   FROM (SELECT page_id, split, w, unnest(range(2, least(6, length(w)) + 1)) AS n
    FROM (SELECT page_id, split, ' ' || unnest(list_filter(regexp_split_to_array(lower(url), '\\s+'), lambda w: w <> '')) || ' ' AS w FROM split_rows))""",
    CHARS, 0) + "," + _tfidf_rows("token", """SELECT page_id, split,
   unnest(list_filter(regexp_split_to_array(lower(url), '[/?=&._\\-]'), lambda w: w <> '')) AS term FROM split_rows""", TOKENS, CHARS) + ",\n " + O.lexical32("(SELECT page_id, url FROM split_rows)") + f""",
 entries AS (SELECT * FROM char_rows UNION ALL SELECT * FROM token_rows UNION ALL SELECT * FROM ({_LEXICAL_ROWS}) WHERE weight <> 0)
SELECT e.page_id, s.label, s.split, CAST(entry AS INT) AS entry, round(weight, 6) AS weight FROM entries e JOIN split_rows s ON s.page_id = e.page_id"""


@query("feat_assemble", _ASSEMBLED)
def _(t):
    entries = text.vector_entries(assembled(t, CHARS, TOKENS), "page_id", "label", "split")
    return entries.withColumn("weight", F.round("weight", 6))


#: Where the models of a data set are stored, by application and folder: every query after the first one loads them.
_TRAINED: dict[tuple[str, str], str] = {}


def trained(t: Tables) -> str:
    """The folder of the models fitted on the data set's samples, which are fitted once."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _TRAINED:
        samples = split_samples(t)
        known = vocabularies(samples, CHARS, TOKENS)
        models, predictions = training.train_models(_vectors(t, samples, known, CHARS, TOKENS))
        path = scratch_path(t.spark, "models")
        training.save_models(models, *known, path)
        predictions.write.parquet(f"{path}/predictions")
        samples.filter("split = 'train'").select("url").write.parquet(f"{path}/trained-on")
        _TRAINED[key] = path
    return _TRAINED[key]


@query("train_models")
def _(t):
    return stats.agg_model_metrics(t.spark.read.parquet(f"{trained(t)}/predictions"))


def best_model(t: Tables) -> tuple[Model, tuple[DataFrame, DataFrame, int]]:
    """The stored model of the greatest F1 on the test rows, and the vocabularies its vectors need."""
    path = trained(t)
    best = stats.agg_best_model(t.spark.read.parquet(f"{path}/predictions")).first()["model"]
    return training.load_model(t.spark, best, path)


def _scoring(t: Tables) -> tuple[Model, DataFrame]:
    """The best model and the vectors of the corpus URLs that it was not fitted on."""
    model, known = best_model(t)
    fresh = t.url_corpus.join(t.spark.read.parquet(f"{trained(t)}/trained-on"), "url", "left_anti").select("page_id", "url")
    return model, _vectors(t, fresh, known, CHARS, TOKENS)


@query("train_importance")
def _(t):
    model, _ = best_model(t)
    return training.train_importance(model, fixed.VECTOR26, t.url_corpus, k=10)


@query("score_model")
def _(t):
    model, vectors = _scoring(t)
    scored = verdict.score_model(vectors, model)
    return scored.select("page_id", "url", "ml_probability", "ml_verdict", "ml_confidence")


@query("analyze_urls_with_model")
def _(t):
    model, vectors = _scoring(t)
    result = verdict.analyze_urls(vectors, known=checked_everywhere(t), model=model)
    return result.select("page_id", "url", "verdict", "confidence", "prediction_source", "ml_probability")


# --- streams -----------------------------------------------------------------

def _stream(t: Tables, view: str) -> DataFrame:
    """A view over the events, with the events read as a stream."""
    # As a pattern the path may name one file as well as a folder of files.
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")
    named = {"events": events, "pages": t.pages, "url_corpus": t.url_corpus}
    return t.spark.sql(VIEWS[view], **{n: df for n, df in named.items() if "{" + n + "}" in VIEWS[view]})


def _landed(t: Tables, name: str, stream: DataFrame) -> DataFrame:
    """Run the stream over what has landed and read what it wrote."""
    path, checkpoint = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-checkpoint")
    streams.run_available(stream, path, checkpoint)
    return t.spark.read.schema(stream.schema).parquet(path)


@query("st_ingest", "SELECT DISTINCT url, 'urlhaus' AS source FROM urlhaus_rows WHERE url <> ''")
def _(t):
    raw = _stream(t, "urlhaus_rows").withColumn("tags", F.split("tags_text", ",")).drop("tags_text")
    return _landed(t, "ingest", streams.st_ingest(raw, norm.norm_urlhaus, AS_OF, "60 days").select("url", "source"))


@query("st_ingest_merge", """
SELECT url, 'urlhaus' AS source, count(*) > 0 AS listed FROM urlhaus_rows WHERE url <> '' GROUP BY url""")
def _(t):
    raw = _stream(t, "urlhaus_rows").withColumn("tags", F.split("tags_text", ",")).drop("tags_text")
    rows = norm.norm_urlhaus(raw, AS_OF).select("url", "source", "first_seen", "last_seen", "confidence")
    path = scratch_path(t.spark, "merged")
    upsert.stream_into(rows, path, scratch_path(t.spark, "merged-checkpoint"), ["url", "source"], writers.snk_indicators)
    return upsert.read_merged(t.spark, path, rows.schema).select("url", "source", F.lit(True).alias("listed"))


@query("st_verdict_counts", """
SELECT date_trunc('hour', created_at) AS window_start, verdict, count(*) AS scans FROM scan_history
GROUP BY ALL HAVING date_trunc('hour', any_value(created_at)) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM scan_history) - INTERVAL 1 HOUR""")
def _(t):
    return _landed(t, "counts", streams.st_verdict_counts(_stream(t, "scan_history")))


@query("st_verdict_counts_sliding", """
WITH b AS (SELECT time_bucket(INTERVAL 15 MINUTE, created_at) - k * INTERVAL 15 MINUTE AS window_start, verdict
  FROM scan_history, range(0, 4) r(k))
SELECT window_start, verdict, count(*) AS scans FROM b
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM scan_history) - INTERVAL 1 HOUR GROUP BY ALL""")
def _(t):
    return _landed(t, "sliding", streams.st_verdict_counts(_stream(t, "scan_history"), "1 hour", "15 minutes"))


@query("st_critical_alerts", "SELECT scan_id, url, target_brand, created_at FROM scan_history WHERE severity = 'critical'")
def _(t):
    return _landed(t, "alerts", streams.st_critical_alerts(_stream(t, "scan_history")))


@query("st_known_threat", "WITH " + O.feed_hits("url_corpus") + """
 SELECT scan_id, url, verdict FROM scan_history WHERE url IN (SELECT url FROM hit)""")
def _(t):
    known = streams.st_known_threat(_stream(t, "scan_history"), t.threat_indicators_raw)
    return _landed(t, "known", known.select("scan_id", "url", "verdict"))


@query("st_circuit", BREAKER_SQL)
def _(t):
    return _landed(t, "circuit", streams.st_circuit(_stream(t, "feed_attempts"), delay_s=0)).withColumn(
        "attempted_at", F.col("attempted_at").cast("timestamp_ntz"))


@query("st_recheck_ttl", """
WITH RECURSIVE a AS (SELECT scan_id, url, created_at, row_number() OVER (PARTITION BY url ORDER BY created_at, scan_id) AS i FROM scan_history),
 b AS (SELECT scan_id, url, created_at, i, created_at AS last, true AS passed FROM a WHERE i = 1
  UNION ALL
  SELECT a.scan_id, a.url, a.created_at, a.i, CASE WHEN a.created_at >= b.last + INTERVAL 300 SECOND THEN a.created_at ELSE b.last END,
   a.created_at >= b.last + INTERVAL 300 SECOND FROM b JOIN a ON a.url = b.url AND a.i = b.i + 1)
SELECT scan_id, url, created_at FROM b WHERE passed""")
def _(t):
    return _landed(t, "recheck", streams.st_recheck_ttl(_stream(t, "scan_history").select("scan_id", "url", "created_at"), delay_s=0))


def listed_urls(t: Tables) -> DataFrame:
    """What all sources say, stored once: a stream reads it anew with every micro-batch."""
    path = scratch_path(t.spark, "listed")
    checked_everywhere(t).write.parquet(path)
    return t.spark.read.parquet(path)


@query("st_score", f"WITH src AS (SELECT {O.DEFAULT_NETWORK}, event_id AS scan_id FROM (SELECT e.event_id, u.url FROM events e "
       "JOIN url_corpus u ON u.page_id = e.event_id % (SELECT count(*) FROM pages))), " + O.verdicts("src", "scan_id") + ", " + _KNOWN + """
 SELECT j.scan_id, j.url, CASE WHEN f.url IS NOT NULL THEN 'phishing' ELSE j.verdict END AS verdict,
  round(CASE WHEN f.url IS NOT NULL THEN 0.98 ELSE j.confidence END, 9) AS confidence, f.sources FROM judged j LEFT JOIN feed_said f ON f.url = j.url""")
def _(t):
    scored = streams.st_score(_stream(t, "scan_history").select("scan_id", "url"), known=listed_urls(t))
    landed = _landed(t, "score", scored.select("scan_id", "url", "verdict", F.round("confidence", 9).alias("confidence"), "sources"))
    return landed.withColumn("sources", F.array_join("sources", ","))


@query("st_score_model")
def _(t):
    model, (chars, tokens, documents) = best_model(t)
    vectors = text.feat_assemble(_stream(t, "scan_history").select("scan_id", "url"), chars, tokens, CHARS, TOKENS, documents)
    scored = streams.st_score(vectors, model, listed_urls(t))
    return _landed(t, "score-model", scored.select("scan_id", "url", "verdict", "confidence", "prediction_source", "ml_probability"))
