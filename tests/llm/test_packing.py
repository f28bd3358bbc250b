import itertools
import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from baitline.llm.packing import pack, places, plan_bins, sequences
from baitline.llm.wordcodes import coder

PATH = P.path("byte_bpe_50k.json")


def least_bins(items, limit):
    """Fewest bins, by search over all states of sorted fillings."""
    states = {()}
    for x in sorted(items, reverse=True):
        new = set()
        for s in states:
            new.add(tuple(sorted((*s, x))))
            for k, used in enumerate(s):
                if used + x <= limit:
                    new.add(tuple(sorted((*s[:k], used + x, *s[k + 1 :]))))
        states = new
    return min(map(len, states))


def best_fit(counts):
    """Plain best fit of lengths in falling order, for comparison."""
    limit = len(counts) - 1
    open_bins = []  # free tokens, serial, copies, content
    serial = 0
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            at = bisect_left(open_bins, (x,))
            if at == len(open_bins):
                free, copies, content = limit, -(-left // (limit // x)), []
            else:
                free, _, copies, content = open_bins.pop(at)
            each = free // x
            filled, over = divmod(min(left, copies * each), each)
            left -= filled * each + over
            for many, times in ((filled, each), (1 if over else 0, over), (copies - filled - (1 if over else 0), 0)):
                if many:
                    serial += 1
                    insort(open_bins, (free - times * x, serial, many, content + [(x, times)] * (times > 0)))
    return [(content, copies) for _, _, copies, content in open_bins]


def total(bins):
    return sum(copies for _, copies in bins)


def contents(bins):
    out = Counter()
    for content, copies in bins:
        for x, times in content:
            out[x] += times * copies
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_few_more_bins_than_needed(items):
    bins = plan_bins(np.bincount(items, minlength=21))
    assert contents(bins) == Counter(items)
    assert all(sum(x * t for x, t in content) <= 20 for content, _ in bins)
    assert total(bins) <= least_bins(items, 20) + 1


def test_exact_complements():
    """Sets that a perfect packing exists for, by one, two and three complements."""
    for parts in ((13, 7), (11, 6, 3), (9, 5, 4, 2), (10, 10), (20,)):
        counts = np.zeros(21, np.int64)
        for x in parts:
            counts[x] += 7
        assert total(plan_bins(counts)) == 7


def test_many_pieces_close_to_the_bound():
    rng = np.random.default_rng(3)
    for sizes in (rng.lognormal(5.5, 1.2, 200_000).astype(int) % 2048 + 1, rng.integers(1, 2049, 300_000), rng.integers(600, 700, 90_000)):
        counts = np.bincount(sizes, minlength=2049)
        bins = plan_bins(counts)
        assert contents(bins) == Counter({x: int(n) for x, n in enumerate(counts) if n})
        assert total(bins) <= total(best_fit(counts)) and len(bins) < 9000
        if sizes.min() < 600:
            assert total(bins) <= 1.002 * max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum())) + 1


def test_a_hot_length_is_one_range():
    counts = np.zeros(2049, np.int64)
    counts[[700, 648, 1]] = 10**12, 10**12 // 2, 5
    plan, _ = places(plan_bins(counts), 2048)
    assert len(plan) < 20


def expected(rows, limit):
    tok, out = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        ends = list(range(len(ids), 0, -limit))[::-1]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            out.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return sorted(out, key=str)


ROWS = [
    (1, "Hello  world, it's 12½ ok"), (2, None), (3, ""), (4, "same"), (4, "same"), (None, "no id"), (5, "long text " * 900), (6, "x" * 5000),
    (7, "a<|endoftext|>b"), (8, "՘ Ᲊ 日本語 😀"), (9, " \t\n"), (10, "word " * 30),
]


@pytest.mark.parametrize("limit", [16, 2048])
def test_pieces_and_places(spark, limit):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in ROWS * 3], "doc_id long, text string, task int, length string").repartition(4)
    got = pack(df, PATH, limit=limit).collect()
    assert sorted(map(tuple, (r[:5] for r in got)), key=str) == expected(ROWS * 3, limit)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= limit
    assert len(bins) <= -(-sum(r.length for r in got) // limit) + 2


def test_sequences_hold_the_tokens(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(60)], "doc_id long, text string").repartition(3)
    packed = pack(docs, PATH, limit=64, tokens=True)
    whole = {r.sequence_id: list(r.ids) for r in sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_codes_are_the_librarys(spark):
    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text for r in docs if r.text] + [t for _, t in ROWS if t] + ["\x1c \x85 a", "<|endoftext|>", "  <|endoftext|> <|endoftext"]
    for special in (True, False):
        tok.encode_special_tokens = not special
        for text in texts:
            assert np.frombuffer(coder(PATH, special).ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_both_splitters_agree_on_plain_characters():
    mine = coder(PATH)
    cut = mine.library.pre_tokenizer
    for n in itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1)):
        c = chr(n)
        if not mine.odd(c):
            text = f"a{c}1{c}! {c}{c} a {c}\n {c}"
            assert [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)] == mine.split(text), hex(n)
            if not mine.not_latin(c):
                assert mine.split_latin(text) == mine.split(text), hex(n)
