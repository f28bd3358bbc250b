import numpy as np
import pytest
from pyspark.sql import functions as F

from baitline.llm import language as L

SF = "/root/testdata/sf0.001"


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9):
        code = L.codewords(n)
        far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len(code) == n and min(far) >= max(1, code.shape[1] // 4)


@pytest.fixture(scope="module")
def coder(spark):
    return L.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, coder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = L.identify(docs, coder).join(docs, "doc_id").where("held_out")
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.95


def test_a_wrong_bit_is_corrected(coder):
    code = coder.code * 5.0
    for i in range(len(code)):
        for bit in range(code.shape[1]):
            hurt = code[i].copy()
            hurt[bit] *= -0.2
            assert L.decode(coder, hurt[None])[0][0] == i
    _, _, lead = L.decode(coder, np.zeros((1, code.shape[1])))
    assert lead[0] < L.TIE


def test_odd_rows(spark, coder):
    rows = [(1, None), (2, ""), (3, "12 %% ..."), (4, "the"), (None, "the and of"), (4, "the"), (5, "the thing and that " * 20_000)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = L.identify(df, coder).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.score == 0 for r in got[:3])
    assert got[3].lang_pred == got[5].lang_pred == got[6].lang_pred == "en"
    assert got[4].doc_id is None and not got[4].held_out and 0 <= got[4].score <= 1


def test_empty_and_unlabelled(spark, coder):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.train(none) is None and L.identify(none, None).collect() == []
    assert L.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(30)], "doc_id long, text string, lang string")
    assert L.identify(one, L.train(one)).first().lang_pred == "xx"


def test_keeps_rows_as_they_are(spark, coder):
    df = spark.createDataFrame([(1, "the", 7), (None, "of", 8), (2, "..", 9), (3, None, 9)], "doc_id long, text string, _text int")
    kept = L.keep_identified(df, coder)
    assert kept.schema == df.schema
    assert [tuple(r) for r in kept.collect()] == [(1, "the", 7), (None, "of", 8)]
