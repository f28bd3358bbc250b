"""Byte-level BPE by a global shuffle of distinct words, and decoding.

Encoding and decoding never hold more than a block of texts:

1. Explode.  Each block of rows is cut into pre-tokens.  Its distinct words are
   numbered by falling frequency.  The words go out in hash buckets; a second
   reading of the same scan gives each block's word numbers by position.  Only
   these numbers and the block's distinct words are shuffled, never the texts.
2. Encode.  A bucket holds all blocks' words of one hash range; every distinct
   word is encoded once, whatever the number of blocks that use it.
3. Reassemble.  Ids return to their block, meet the word numbers, and are put
   in the order of positions, row by row.
4. Decode.  Ids are joined with the token-byte table, which has one row for
   each token of the vocabulary and so is small enough to be sent along.

A hot word is one entry per block in one bucket; a hot text or source does not
matter.  The rows given must come from a stored table, because they are read
twice; a digest of the words guards against two different readings.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks

#: Bytes of text in a block.
BLOCK = 24 << 20
#: Distinct words a task remembers before it starts anew.
REMEMBERED = 1_000_000
_PACKS = "block long, part int, pack binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str):
    """The library's merge loop and the token-byte table, once per worker."""
    import regex
    import tiktoken

    ranks = load_ranks(path)
    merges = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return regex.compile(pattern), merges._core_bpe.encode_single_piece, table


def _pack(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    sizes = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    whole = sizes + b"".join(raw)
    return np.array([len(whole)], "<i8").tobytes() + pa.compress(whole, codec="zstd", asbytes=True)


def _unpack(pack: bytes) -> list[bytes]:
    whole = pa.decompress(pack[8:], decompressed_size=int(np.frombuffer(pack[:8], "<i8")[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(whole[:8], "<i8")[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(whole[8 : 8 * (n + 1)], "<i8")])
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, which compress well."""
    numbers = numbers.astype("<u4")
    return b"".join((numbers >> np.uint32(shift) & np.uint32(255)).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24))


def _wide(planes: bytes) -> np.ndarray:
    low = np.frombuffer(planes, np.uint8).reshape(4, -1).astype(np.uint32)
    return low[0] | low[1] << np.uint32(8) | low[2] << np.uint32(16) | low[3] << np.uint32(24)


def _numbered(data: np.ndarray, offsets: np.ndarray, split) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words by falling frequency, numbers by position, words per row."""
    first: dict[str, int] = {}
    found, counts = [np.zeros(0, np.int32)], np.zeros(len(offsets) - 1, "<i4")
    number = first.setdefault
    raw = data.tobytes()
    for row in range(len(offsets) - 1):
        words = split(raw[offsets[row] : offsets[row + 1]].decode("utf-8", "replace"))
        counts[row] = len(words)
        found.append(np.fromiter((number(w, len(first)) for w in words), np.int32, len(words)))
    at = np.concatenate(found)
    del found
    order = np.argsort(-np.bincount(at, minlength=len(first)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    names = list(first)
    return [names[i] for i in order], rank[at], counts


def _bucket(word: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little") % buckets


def _read(batches, split, text_col: str, buckets: int):
    """Blocks of a partition: block id, rows of the batch, distinct words, buckets, numbers, counts."""
    task, serial = TaskContext.get(), 0
    for batch in batches:
        for start, end, data, offsets in blocks(batch.column(text_col), BLOCK):
            words, numbers, counts = _numbered(data, offsets, split)
            coded = [w.encode() for w in words]
            place = np.fromiter((_bucket(w, buckets) for w in coded), np.int32, len(coded))
            sign = hashlib.blake2b(b"\0".join(coded) + f"{task.partitionId()}/{serial}".encode(), digest_size=8)
            yield int.from_bytes(sign.digest(), "little", signed=True), batch.slice(start, end - start), coded, place, numbers, counts
            serial += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    block, part, pack = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(pack, pa.binary())], ["block", "part", "pack"]
    )


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs [start, start + size), one run after the other."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - sizes), sizes)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    buckets: int | None = None, tokens: bool = False,
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with ``tokens`` also the ids and the decoded text.

    Every match of ``pattern`` is encoded by itself, without special tokens.  A
    null text counts as empty: no token, digests of no bytes.  Repeated ids and
    rows give a row each, null ids stay null, other columns are not read, and
    an empty table gives no row.  ``path`` must exist on every machine.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(256, 2 * parts)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def words(batches):
        split = _coder(path, pattern)[0].findall
        for block, _, coded, place, _, _ in _read(batches, split, "text", buckets):
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                mine = [coded[i] for i in order[ends[b] : ends[b + 1]]]
                if mine:
                    out.append((block, b, _pack(np.array([len(w) for w in mine], "<u4"), b"".join(mine))))
            yield _batch(out)

    def positions(batches):
        split = _coder(path, pattern)[0].findall
        for block, part, _, place, numbers, counts in _read(batches, split, "text", buckets):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", part.schema.field("id").type)])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([part.column("id")], ["id"]))
            yield _batch([(block, -1, _pack(sink.getvalue().to_pybytes(), counts, place.astype("<i4"), _narrow(numbers)))])

    def ids_of(batches):
        piece, known = _coder(path, pattern)[1], {}
        for batch in batches:
            out = []
            for block, b, pack in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, text = _unpack(pack)
                ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
                found, at = [], 0
                for end in ends:
                    word, at = text[at:end], end
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[word] = np.array(piece(word), "<u4").tobytes()
                    found.append(ids)
                lengths = np.array([len(x) // 4 for x in found], "<u4")
                out.append((block, b, _pack(_narrow(lengths), _narrow(np.frombuffer(b"".join(found), "<u4")))))
            yield _batch(out)

    def rebuild(batches):
        table = _coder(path, pattern)[2]
        byte_of = table.__getitem__
        now, held, packs = None, None, {}

        def finish():
            if held is None:
                raise ValueError("the two readings of the rows differ; give a stored table")
            ids, counts, place, numbers = held
            with pa.ipc.open_stream(ids) as reader:
                ids = reader.read_next_batch().column("id")
            counts, place, numbers = np.frombuffer(counts, "<i4"), np.frombuffer(place, "<i4"), _wide(numbers)
            size = np.zeros(len(place), np.int64)
            start = np.zeros(len(place), np.int64)
            flat, filled = [np.zeros(0, "<u4")], 0
            for b, pack in packs.items():
                lengths, coded = map(_wide, _unpack(pack))
                mine = np.flatnonzero(place == b)
                size[mine] = lengths
                start[mine] = filled + np.cumsum(lengths, dtype=np.int64) - lengths
                filled += len(coded)
                flat.append(coded.astype("<u4"))
            if not (size > 0).all():
                raise ValueError("the two readings of the rows differ; give a stored table")
            flat = np.concatenate(flat)
            out, at = [[] for _ in range(5 if tokens else 3)], 0
            for n in counts.tolist():
                row, at = numbers[at : at + n], at + n
                coded = flat[_runs(start[row], size[row])]
                decoded = b"".join(map(byte_of, coded.tolist()))
                values = [len(coded), hashlib.sha256(coded.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                if tokens:
                    values += [coded.tolist(), decoded.decode("utf-8", "replace")]
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            return pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, k) for c, k in zip(out, kinds))],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * tokens],
            )

        for batch in batches:
            for block, b, pack in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield finish()
                    now, held, packs = block, None, {}
                if b < 0:
                    held = _unpack(pack)
                else:
                    packs[b] = pack
        if now is not None:
            yield finish()

    encoded = rows.mapInArrow(words, _PACKS).repartition(parts, "part").mapInArrow(ids_of, _PACKS)
    placed = rows.mapInArrow(positions, _PACKS)
    together = placed.unionByName(encoded).repartition(parts, "block").sortWithinPartitions("block", "part")
    extra = ", ids array<int>, decoded string" if tokens else ""
    return together.mapInArrow(rebuild, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
