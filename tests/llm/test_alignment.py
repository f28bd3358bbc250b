import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from baitline.llm import alignment
from baitline.llm.alignment import align, merge_path, merged, pair_counts, token_links

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def expected(rows):
    """One token pair at a time."""
    tok, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    raw_a = lambda i: bytes(letters[c] for c in tok.id_to_token(i))
    raw_b = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(raw_a, a)) != whole or b"".join(map(raw_b, b)) != whole:
            found.append(([], [], [], ""))
            continue
        spans = []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(raw(i)), i))
                at = out[-1][1]
            spans.append(out)
        links, j = [], 0
        for s, e, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= cut) for side in spans))
            start = cut
        found.append((a, b, links, ";".join(groups)))
    count = Counter(p for _, _, links, _ in found for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, _), (a, b, links, groups) in zip(rows, found):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((
            i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == top[p[0]] for p in links),
            sum(count[p] for p in links), digest,
        ))
    return sorted(out, key=str), count


TEXTS = [
    (1, "Hello  world, it's 12½ ok\n"), (2, None), (3, ""), (4, "same text"), (4, "same text"), (None, "no id"), (5, "antidisestablishmentarianism " * 40),
    (6, "▁ looks like a space"), (7, "a<|endoftext|>b <s> </s> <0x41>"), (8, "日本語 😀 é\x00\x01"), (9, " "), (10, "x" * 3000), (11, "\t\n"), (12, "՘ Ᲊ"),
]


@pytest.mark.parametrize("work,block", [(1 << 16, 8 << 20), (7, 300)])
def test_against_one_by_one(spark, monkeypatch, work, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment.merged, "__defaults__", (work,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = TEXTS + [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, block int, pairs string").repartition(3)
    want, count = expected(rows)
    assert sorted(map(tuple, align(df, A, B).collect()), key=str) == want
    if block > 300:
        got = {(r.a, r.b): r["count"] for r in pair_counts(token_links(df, A, B), 32_000).collect()}
        assert got == count


def test_groups_as_text_and_empty(spark):
    df = spark.createDataFrame([("", "a b")], "doc_id string, text string")
    (row,) = align(df, A, B, groups=True).collect()
    assert row.doc_id == "" and row.n_groups == 2 and hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert align(df.where("false"), A, B).collect() == []
    assert [tuple(r) for r in align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30))), min_size=1, max_size=4), st.integers(1, 9))
def test_pieces_give_what_one_merge_gives(docs, work):
    a_end, b_end, a_doc, base, want = [], [], [], 0, Counter()
    cuts = 0
    for d, (x, y) in enumerate(docs):
        x, y = (sorted({*s, 31}) for s in (x, y))
        for e in {*x, *y}:
            want[d, len(a_end) + sum(v < e for v in x), len(b_end) + sum(v < e for v in y)] += 1
        cuts += len({*x} & {*y})
        a_end += [base + e for e in x]
        b_end += [base + e for e in y]
        a_doc += [d] * len(x)
        base += 31
    a_end, b_end, a_doc = map(np.array, (a_end, b_end, a_doc))
    i, j = merge_path(a_end, b_end, work)
    assert (np.diff(i) + np.diff(j) <= work).all() and (i[-1], j[-1]) == (len(a_end), len(b_end))
    doc, pair, times, cut_a, cut_b = merged(a_end, b_end, a_doc, np.arange(len(a_end)), np.arange(len(b_end)), 1000, work)
    assert dict(zip(zip(doc.tolist(), (pair // 1000).tolist(), (pair % 1000).tolist()), times.tolist())) == want
    assert cut_a.sum() == cut_b.sum() == cuts
