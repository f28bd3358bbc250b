import corpus_pipeline as C
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for _, stage in C.STAGES[:-1]:
        after = C.stored(stage(spark, docs, SF), "t")
        assert after.schema.names == docs.schema.names
        assert after.join(docs, docs.columns, "left_anti").count() == 0
        docs = after
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    assert C.run(spark, SF).count() == seen[-1]


def test_each_stage_decides(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    base = " ".join(f"thing{k} and the of was {k % 7}" for k in range(200))
    texts = [
        (1, base, "en"), (2, base.replace(" ", "  "), "en"), (3, base + " that", "en"), (4, "12 34 ...", "en"), (5, None, "en"),
        (6, "and the thing " + item + " was of that", "en"), (7, "clean words of another text that stay", "en"), (None, "without an id but clean text", "en"),
        (8, "und der die das ist nicht ein schlechter text", "de"),
    ]
    docs = spark.createDataFrame([(i, t, l, "s", 1, "x") for i, t, l in texts], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    kept = []
    for _, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, SF), "t")
        kept.append(sorted((r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect()))
    ids = [[None if none else i for none, i in k] for k in kept]
    assert ids[0] == [1, 2, 3, 6, 7, 8, None]
    assert ids[1] == [2, 3, 6, 7, 8, None]  # more code points
    assert ids[2] == [2, 6, 7, 8, None]
    assert ids[3] == [2, 7, 8, None]
    last = C.STAGES[-1][1](spark, docs, SF)
    assert last.count() == 4 and last.where(F.col("n_tokens") < 1).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")


def left(spark, docs):
    for _, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, SF), "t")
    return docs


def prose(seed, n=120):
    return " ".join(f"word{(seed * 7919 + k * k) % 9973}" for k in range(n))


def test_rows_without_or_with_repeated_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [
        (None, prose(1), "en"), (None, prose(1), "en"), (None, prose(1), "en"),  # copies without ids: one stays
        (None, "some words " + item + " more words", "en"),  # contaminated, without an id
        (5, prose(2), "en"), (5, "the and " + item, "en"),  # one id, a clean and a contaminated text
        (6, prose(3), "en"), (6, prose(3), "en"),  # a repeated row
        (7, prose(4), "en"), (None, prose(4) + " ", "en"),  # the longer copy has no id
    ]
    got = [(r.doc_id, r.text) for r in left(spark, frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(None, prose(1)), (5, prose(2)), (6, prose(3)), (None, prose(4) + " ")], key=str)


def test_without_labels_rows_with_letters_stay(spark):
    docs = frame(spark, [(1, prose(1), None), (2, "12 34", None), (3, None, None), (4, prose(2), None)])
    assert sorted(r.doc_id for r in left(spark, docs).collect()) == [1, 4]


def test_empty_table_and_long_texts(spark):
    empty = left(spark, frame(spark, [(1, "a", "en")]).where("false"))
    assert empty.collect() == [] and C.STAGES[-1][1](spark, empty, SF).collect() == []
    long = prose(9, 60_000)
    docs = frame(spark, [(1, long, "en"), (2, long + " ", "en"), (3, prose(10), "en"), (4, "y" * 300_000, "en")])
    kept = left(spark, docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [2, 3, 4]


def fingerprint(text):
    import xxhash

    words = [w.decode() for w in text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_chain_against_brute_force(spark):
    """Every stage after the model stage, one document at a time."""
    import re

    import public_tokenizers as P
    import tiktoken
    from baitline.llm.bpe import load_ranks

    docs = C.stored(C.language_id(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "t")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i, text))
    rows = sorted((i, text) for _, i, text in (min(g) for g in groups.values()))
    prints = [fingerprint(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [row for k, row in enumerate(rows) if find(k) == k]
    shingles = lambda text, n: {tuple(w[i : i + n]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))] for i in range(len(w) - n + 1)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for i, text in rows:
        found = False
        for item in items:
            n = min(5, len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", item)))
            want = shingles(item, n)
            found |= bool(want) and len(want & shingles(text, n)) >= 0.8 * len(want)
        if not found:
            clean.append((i, text))
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((i, len(coder.encode_ordinary(text))) for i, text in clean)
    assert sorted((r.doc_id, r.n_tokens) for r in C.run(spark, SF).collect()) == want
