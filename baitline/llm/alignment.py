"""Aligning the tokens of two tokenizers over the same bytes, by merge-path pieces.

1. Both encode every text; a token is a stretch of the text's bytes.  The ends
   of A's and B's tokens are two sorted sequences.  Merging them gives the links
   (tokens whose bytes overlap) and the groups (cut where both end).
2. Merge path.  A step of the merge takes one end; after k steps it stands on
   the k-th diagonal of the grid of A and B ends.  A binary search on evenly
   spaced diagonals divides the merge of a block of texts, or of one long text,
   into independent pieces of equal work.  Each piece emits its overlaps reduced
   to distinct id pairs per document; a group that crosses a border is stitched
   by looking at the end before it.
3. A block keeps its distinct pairs with the number of its documents that hold
   them, and per document numbers into that list.  Only the lists are shuffled
   to be counted over the corpus, so a pair in a third of all documents is one
   row per block.
4. Counts return to their blocks and are summed up per document.

Texts are read once.  A task holds one block of texts, or one text if longer.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .wordcodes import byte_letters, coder
from .words import blocks

#: Bytes of text in a block, and merge steps in a piece.
BLOCK, WORK = 8 << 20, 1 << 16


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as lines:
        form = json.load(lines)
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    out = [b""] * (1 + max([*form["model"]["vocab"].values(), *(t["id"] for t in form.get("added_tokens", ()))]))
    for token, number in form["model"]["vocab"].items():
        out[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    for token in form.get("added_tokens", ()):
        out[token["id"]] = token["content"].encode()
    return out


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str):
    """Both encoders, the bytes and sizes of their ids, and the ids as text before each kind of border; once per worker."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_a = byte_level_tokens(path_a)
    bytes_b = []
    for n in range(pieces.get_piece_size()):
        shown = pieces.id_to_piece(n)
        bytes_b.append(bytes([int(shown[3:5], 16)]) if pieces.is_byte(n) else shown.replace("▁", " ").encode())
    sizes = [np.array([len(x) for x in table], np.int64) for table in (bytes_a, bytes_b)]
    shown = [f"{n}{border}" for n in range(len(bytes_a)) for border in ",|"] + [f"{n}{border}" for n in range(len(bytes_b)) for border in ",;"]
    return coder(path_a, False).ids, pieces.encode, (bytes_a, bytes_b), sizes, shown


def merge_path(a_end: np.ndarray, b_end: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B ends before each piece of ``work`` merge steps (A first where both are equal)."""
    n, m = len(a_end), len(b_end)
    diagonal = np.append(np.arange(0, n + m, work), n + m)
    low, high = np.maximum(diagonal - m, 0), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # The mid-th A end belongs before the diagonal if it is not after the B end it would displace.
        before = open_ & (a_end[np.minimum(mid, n - 1)] <= b_end[np.clip(diagonal - mid - 1, 0, m - 1)])
        low = np.where(before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    return low, diagonal - low


def overlaps(a_end: np.ndarray, b_end: np.ndarray, i: tuple[int, int], j: tuple[int, int]):
    """Links of one piece as positions of A and B tokens, and those A and B tokens that end together."""
    mine, other = a_end[i[0] : i[1]], b_end[j[0] : j[1]]
    at_b = j[0] + np.searchsorted(other, mine)
    tied = b_end[at_b] == mine
    at_a = i[0] + np.searchsorted(mine, other)
    shared = a_end[np.minimum(at_a, len(a_end) - 1)] == other
    if i[0] and len(other):
        shared[0] |= a_end[i[0] - 1] == other[0]
    own = np.arange(i[0], i[1])
    alone = j[0] + np.flatnonzero(~shared)
    return np.concatenate((own, at_a[~shared])), np.concatenate((at_b, alone)), own[tied], at_b[tied]


def merged(a_end: np.ndarray, b_end: np.ndarray, a_doc: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, width: int, work: int = WORK):
    """Over a block: documents, pairs and times of all links, and for A and B which tokens end a group."""
    i, j = merge_path(a_end, b_end, work)
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    doc, pair, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(i) - 1):
        a, b, end_a, end_b = overlaps(a_end, b_end, (i[k], i[k + 1]), (j[k], j[k + 1]))
        cut_a[end_a] = cut_b[end_b] = True
        d, p, t = _counted(a_doc[a], a_ids[a].astype(np.int64) * width + b_ids[b])
        doc.append(d), pair.append(p), times.append(t)
    return *_counted(np.concatenate(doc), np.concatenate(pair), np.concatenate(times)), cut_a, cut_b


def _counted(doc: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None):
    """Distinct (document, pair) with the sum of their times, in order."""
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(doc))) if times is None else np.add.reduceat(times[order], first) if len(first) else first
    return doc[first], pair[first], many


def group_order(cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A's and B's tokens when groups are written one by one, A's tokens before B's."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    until_a = np.append(np.flatnonzero(cut_a) + 1, len(cut_a))
    before_b = np.concatenate(([0], np.flatnonzero(cut_b) + 1))
    return np.arange(len(cut_a)) + before_b[group_a], np.arange(len(cut_b)) + until_a[group_b]


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _block(texts: list[bytes], path_a: str, path_b: str, groups: bool):
    """Per text [n_a, n_b, n_groups, n_links, digest, pack(, groups)], and the block's pairs with their documents."""
    code_a, code_b, (bytes_a, bytes_b), (size_a, size_b), shown = _pair(path_a, path_b)
    ids_a, ids_b, none = [], [], np.zeros(0, np.uint32)
    for raw in texts:
        a = b = none
        if raw:
            text = raw.decode("utf-8", "replace")
            a = np.frombuffer(code_a(" " + text), "<u4")
            coded = code_b(text)
            whole = b" " + raw
            if b"".join(map(bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(bytes_b.__getitem__, coded)):
                b = np.array(coded, np.uint32)
            else:
                a = none
        ids_a.append(a), ids_b.append(b)
    edge_a, edge_b = (np.cumsum([0, *map(len, x)]) for x in (ids_a, ids_b))
    a, b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
    width, n = len(size_b), len(texts)
    a_doc = np.repeat(np.arange(n), np.diff(edge_a))
    if len(a):
        doc, pair, times, cut_a, cut_b = merged(np.cumsum(size_a[a]), np.cumsum(size_b[b]), a_doc, a, b, width)
    else:
        doc = pair = times = np.zeros(0, np.int64)
        cut_a = cut_b = np.zeros(0, bool)
    place_a, place_b = group_order(cut_a, cut_b)
    written = np.empty(len(a) + len(b), np.int64)
    written[place_a] = 2 * a.astype(np.int64) + cut_a
    written[place_b] = 2 * (len(size_a) + b.astype(np.int64)) + cut_b
    distinct, number, many = np.unique(pair, return_inverse=True, return_counts=True)
    # Frequent pairs get small numbers, so that lists of them are short.
    order = np.argsort(-many, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[number]
    order_in_doc = np.lexsort((number, doc))
    number, times = number[order_in_doc], times[order_in_doc]
    ends = np.searchsorted(doc, np.arange(n + 1))
    ends_groups = np.concatenate(([0], np.cumsum(cut_a)))
    out = []
    for d in range(n):
        start, end = ends[d], ends[d + 1]
        text = "".join(map(shown.__getitem__, written[edge_a[d] + edge_b[d] : edge_a[d + 1] + edge_b[d + 1]].tolist()))[:-1]
        pack = pa.compress(_planes(np.diff(number[start:end], prepend=0)) + _planes(times[start:end]), codec="zstd", asbytes=True)
        row = [
            edge_a[d + 1] - edge_a[d], edge_b[d + 1] - edge_b[d], ends_groups[edge_a[d + 1]] - ends_groups[edge_a[d]],
            times[start:end].sum(), hashlib.sha256(text.encode()).hexdigest() if text else "", int(end - start), pack,
        ]
        out.append(row + [text] * groups)
    order = np.argsort(rank)
    return out, distinct[order], many[order]


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Stored table of aligned blocks: a row per text, and a row per block with its pairs (a * width of B + b) and their documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pack"] + ["groups"] * groups
    kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()] + [pa.string()] * groups
    lists = pa.list_(pa.int64())

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, offsets in blocks(batch.column(1), BLOCK):
                raw = data.tobytes()
                rows, pairs, many = _block([raw[x:y] for x, y in zip(offsets, offsets[1:])], path_a, path_b, groups)
                block = task << 32 | serial
                serial += 1
                n = len(rows) + 1
                columns = [pa.array([r[k] for r in rows] + [None], t) for k, t in enumerate(kinds)]
                held = pa.concat_arrays([ids.slice(row, end - row), pa.nulls(1, ids.type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), held, *columns, pa.array([None] * (n - 1) + [pairs], lists), pa.array([None] * (n - 1) + [many], lists)],
                    names=["block", "id", *fields, "pairs", "docs"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    text = ", groups string" if groups else ""
    schema = (
        f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        f" n_pairs long, pack binary{text}, pairs array<long>, docs array<long>"
    )
    return stored(rows.mapInArrow(run, schema), "links")


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """Per linked id pair: pair, a, b, count (documents that hold it linked), best (no pair of this A id is held by more)."""
    each = links.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    split = counts.withColumn("a", F.floor(F.col("pair") / width)).withColumn("b", F.col("pair") % width)
    # A window holds the pairs of one A id: at most as many as B has ids.
    return split.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``groups`` also the groups as text.

    A is a byte-level tokenizer file and encodes a space and the text, B a piece
    model, which adds the space; special tokens' strings are plain text.  A
    group is written ``a1,a2|b1``, groups are joined by ``;``.  ``n_best`` are
    links of a pair that no pair of its A id exceeds in documents, ``count_sum``
    is the sum of the links' document counts; a document is a row.

    Null and empty texts, and texts whose tokens' bytes of A or B are not the
    text's, have no tokens: zeros and an empty ``groups_sha256``; they count for
    no pair.  Repeated ids and rows give a row each, null ids stay null, other
    columns are not read, an empty table gives no row.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    links = token_links(docs, path_a, path_b, id_col, text_col, groups)
    counts = stored(pair_counts(links, width).select("pair", "count", "best"), "pair-counts")
    listed = links.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("number", "pair"))
    known = listed.join(counts, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * groups

    def total(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        number = pairs.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        count[number] = pairs.column("count").to_numpy()
        best[number] = pairs.column("best").to_numpy()
        n_best, count_sum = [], []
        for size, pack in zip(rows.column("n_pairs").to_pylist(), rows.column("pack").to_pylist()):
            raw = pa.decompress(pack, decompressed_size=16 * size, codec="zstd", asbytes=True)
            mine, times = np.cumsum(_from_planes(raw[: 8 * size])), _from_planes(raw[8 * size :])
            n_best.append(int(times[best[mine]].sum()))
            count_sum.append(int((times * count[mine]).sum()))
        kept = [rows.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        kept += [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), rows.column("groups_sha256")]
        return pa.table(kept + ([rows.column("groups")] if groups else []), names=names)

    texts = links.where(F.col("pairs").isNull()).drop("pairs", "docs")
    schema = (
        f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        + (", groups string" if groups else "")
    )
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(total, schema)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
