"""The quality network and the factorization machine."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baitline.llm import quality as Q
from baitline.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def held_out(spark, module, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").where("held_out").select(label, "score", "predicted").collect()
    return model, rows


def test_quality_held_out(spark):
    _, rows = held_out(spark, Q, "quality")
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_toxicity_held_out(spark):
    _, rows = held_out(spark, T, "toxic")
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(clean) <= 0.02 * len(clean)
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.5


def network(seed=0):
    rng = np.random.default_rng(seed)
    return Q.Network(rng.normal(0, 1, (Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), rng.normal(0, 1, Q.FILTERS).astype(np.float32), rng.normal(0, 0.1, 2 * Q.FILTERS).astype(np.float32), 0.1)


def plain_score(n, text):
    raw = (text or "").encode() or b"\0"
    b = np.frombuffer(raw + b"\0" * (Q.WIDTH - 1), np.uint8)
    out = sum(n.table[k][b[k : k + len(raw)]] for k in range(Q.WIDTH))
    tops = [out[i : i + Q.STEP].max(0) for i in range(0, len(raw), Q.STEP)]
    chunks = np.array([np.maximum(a, c) for a, c in zip(tops, tops[1:])] or tops) + n.lift
    seen = np.hstack([np.maximum(chunks, 0).mean(0), np.maximum(chunks, 0).max(0)])
    return 1 / (1 + np.exp(-(seen @ n.out + n.bias)))


def test_network_covers_the_whole_text():
    n = network()
    texts = [None, "", "a", "x" * 127, "x" * 128, "x" * 129, "y" * 300 + "!", "é" * 40_000 + "end", "z " * 700_000 + "?"]
    assert np.allclose(Q.scores(n, pa.array(texts)), [plain_score(n, t) for t in texts], atol=1e-4)


def test_network_gradient():
    n = network(4)
    p = {"table": n.table.astype(np.float64), "lift": n.lift.astype(np.float64), "out": n.out.astype(np.float64), "bias": np.array([n.bias])}
    part, y = [b"abc" * 70, b"hello world", b"", b"q" * 300], np.array([1.0, 0.0, 1.0, 0.0])
    def loss():
        s = np.array([plain_score(Q.Network(p["table"], p["lift"], p["out"], p["bias"][0]), t.decode()) for t in part])
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()
    grads = Q._gradients(p, part, y)
    for key, at in (("lift", (3,)), ("out", (5,)), ("out", (20,)), ("bias", (0,)), ("table", (1, ord("b"), 2)), ("table", (0, ord("q"), 7))):
        p[key][at] += 1e-4
        up = loss()
        p[key][at] -= 2e-4
        down = loss()
        p[key][at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[key][at]) < 2e-3


def test_machine_learns_pairs():
    """Two words are harmless alone and toxic together: no sum of weights tells that."""
    rng = np.random.default_rng(6)
    texts, labels = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["alphaword"] * a + ["betaword"] * b + [f"n{k}" for k in rng.integers(0, 50, 5)]))
        labels.append(int(a and b))
    m = T.fit(texts, labels, rounds=400)
    got = T.scores(m, pa.array(["alphaword betaword", "alphaword", "betaword", "", None]))
    assert got[0] > 0.5 and max(got[1:]) < T.CUT


def test_machine_equals_its_formula():
    m = T.Machine(np.sort(np.array([5, 2**63 + 1, 2**64 - 9], np.uint64)), -0.3, np.array([0.5, -1.0, 2.0]), np.array([[1.0, 2], [0.5, -1], [3, 0.1]]))
    T_terms, T.terms = T.terms, lambda data, offsets: iter([(np.array([0, 0, 0, 1, 2]), np.array([5, 5, 2**64 - 9, 7, 2**63 + 1], np.uint64))])
    try:
        got = T.scores(m, pa.array(["a", "b", "c"]))
    finally:
        T.terms = T_terms
    logit = [-0.3 + 0.5 + 2.0 + m.factors[0] @ m.factors[2], -0.3, -0.3 - 1.0]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(logit))))


@pytest.mark.parametrize("module", [Q, T])
def test_odd_rows(spark, module):
    rows = [(i, ("clean words of text " if i % 2 else "BAD*** bad### ") * (i % 7 + 1)) for i in range(60)]
    odd = [(100, None), (101, ""), (None, "no id"), (3, rows[3][1]), (102, "long " * 100_000)]
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows + odd], "doc_id long, text string, id string, score double")
    column = "quality" if module is Q else "toxic"
    some = [(i, i % 2 if module is Q else 1 - i % 2) for i in range(60)] + [(3, None), (None, 1), (7, 1), (999, 0)]
    labels = spark.createDataFrame([(i, l, 1) for i, l in some], f"doc_id long, {column} int, _label int")
    model = module.train(df, labels)
    got = module.score(df, model).collect()
    assert len(got) == len(df.collect()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in got if r.doc_id == 3}.__len__() == 1 and {r.score for r in got if r.doc_id in (100, 101)}.__len__() == 1
    assert module.score(df.where("false"), model).collect() == []
    assert module.train(df, labels.where("false")) is None
    assert {r.score for r in module.score(df, None).collect()} == {0.5}


def test_rows_of_a_hot_id_are_fitted_once(spark, monkeypatch):
    from baitline.llm import language as L

    # an id that none of the three holds out
    free = spark.range(300, 400).where(~Q.fold("id", 5, 0) & ~Q.fold("id", 4, 2)).first()[0]
    docs = spark.range(300).selectExpr(f"IF(id < 100, {free}, id) AS doc_id", "concat('text ', id) AS text", "IF(id % 2 = 0, 'en', 'de') AS lang")
    labels = spark.range(100, 400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 2 AS INT) AS toxic")
    seen = []
    for module in (Q, T, L):
        monkeypatch.setattr(module, "fit", lambda texts, marks: seen.append(list(texts)))
    Q.train(docs, labels), T.train(docs, labels), L.train(docs)
    hot = {f"text {i}" for i in range(100)} | {f"text {i}".encode() for i in range(100)}
    assert [sum(x in hot for x in texts) for texts in seen] == [1, 1, 2]  # op3: one for each language
    assert all(len(texts) > 50 for texts in seen)


def test_machine_of_a_table_equals_that_of_a_list(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(i) * 3 - 200, int(m), " ".join(f"w{k}" for k in rng.integers(0, 60, 12)) + (" Dreadful Oaf" if m else "")) for i, m in enumerate(rng.integers(0, 2, 400))]
    rows += [(5000, 0, None), (5001, 1, ""), (5002, 1, "w1 w1 w1 " * 300), (5003, 0, "é" * 500)]
    kinds = "id long, label int, text string"
    spark.createDataFrame(rows, kinds).repartition(5).write.parquet(f"{tmp_path}/rows")
    sample = T.Sample(spark.read.schema(kinds).parquet(f"{tmp_path}/rows"))
    plain, spread = (T.fit(texts, [r[1] for r in rows], rounds=20) for texts in ([r[2] for r in rows], sample))
    assert len(plain.terms) > 3 and list(sample) == [r[2] for r in rows]
    assert np.array_equal(plain.terms, spread.terms) and plain.bias == spread.bias
    assert np.array_equal(plain.linear, spread.linear) and np.array_equal(plain.factors, spread.factors)
    # labels that no term tells apart
    some = T.Sample(sample.rows.where("id < 0 and text is not null").selectExpr("id", "CAST(0 AS INT) AS label", "'same words' AS text"))
    assert len(T.fit(some, [0] * some.rows.count(), rounds=2).terms) == 0


def test_fitting_keeps_long_texts_off_the_driver(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat(IF(id % 2 = 0, 'dreadful oaf ', 'kind soul '), repeat(concat('word', id, ' '), 2000)) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(1 - id % 2 AS INT) AS toxic")
    collect, seen = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda df: [seen.append(len(str(r))) or r for r in collect(df)])
    machine = T.train(docs, labels)
    assert sum(seen) < 100_000  # the texts have over 4 million characters
    got = T.scores(machine, pa.array(["a dreadful oaf", "a kind soul"]))
    assert got[0] > 0.5 > T.CUT > got[1]
