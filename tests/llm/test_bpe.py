import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from baitline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text, enc):
    ids = np.array(enc.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_as_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 4000)
    odd = [None, "", " ", "\n\n  x", "it's 12½ ok 日本語 😀!!", "<|endoftext|>", "a" * 5000, "wörd " * 9000, "same", "same", " \t　 \x1c"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (3, "again")], "doc_id long, text string")
    rows = docs.unionByName(extra).withColumn("block", docs["doc_id"] * 0).withColumn("id", docs["doc_id"])
    path = spark.conf.get("spark.sql.warehouse.dir") + "/bpe-test"
    rows.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(rows, PATH, P.PATTERN).collect())
    enc = whole()
    assert got == sorted((r.doc_id is None, r.doc_id or 0, *expected(r.text, enc)) for r in rows.collect())


def test_ids_and_texts(spark):
    df = spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(df, PATH, P.PATTERN, tokens=True, buckets=3).collect()}
    assert got == {1: (whole().encode_ordinary("Hello  world"), "Hello  world"), 2: ([], "")}


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_packs_round_trip():
    numbers = np.array([0, 255, 256, 70_000, 2**31], np.uint32)
    assert (bpe._wide(bpe._unpack(bpe._pack(b"", bpe._narrow(numbers)))[1]) == numbers).all()
    assert bpe._runs(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
