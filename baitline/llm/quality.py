"""Text quality by a byte-level convolutional network in numpy.

A filter of width ``WIDTH`` reads one-hot bytes, so it is a table of a weight
per offset and byte, and its output at a position is a sum of ``WIDTH`` table
rows.  The document is covered by chunks of two blocks of ``STEP`` positions
that overlap by one block, to its very end.  Each chunk is max-pooled; the mean
and the maximum over all chunks make one probability through a linear layer.

Fitting takes a bounded sample (``SAMPLE`` labelled rows of each label).
Scoring reads every whole text in one narrow pass, in slices of bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_sample, fold
from .words import blocks

#: Labelled rows per label that the network is fitted on.
SAMPLE = 700
FILTERS, WIDTH, STEP = 16, 5, 128
#: Positions whose filter outputs are held at once.
_SLICE = 1 << 15
#: A text scores 1 from here on.
CUT = 0.3


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    lift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 FILTERS
    bias: float


def _laid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with WIDTH - 1 zero bytes after each (an empty one has a zero byte), block starts and blocks per row."""
    sizes = np.maximum(np.diff(offsets), 1)
    begin = np.concatenate([[0], np.cumsum(sizes + WIDTH - 1)])
    laid = np.zeros(begin[-1], np.uint8)
    for row in range(len(sizes)):
        part = data[offsets[row] : offsets[row + 1]]
        laid[begin[row] : begin[row] + len(part)] = part
    counts = -(-sizes // STEP)
    first = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(first, counts)
    starts = np.repeat(begin[:-1], counts) + place * STEP
    ends = np.minimum(starts + STEP, np.repeat(begin[:-1] + sizes, counts))
    return laid, np.stack([starts, ends]), counts


def _outputs(table: np.ndarray, laid: np.ndarray, low: int, high: int) -> np.ndarray:
    """Filter outputs at the positions [low, high)."""
    total = table[0][laid[low:high]]
    for k in range(1, WIDTH):
        total += table[k][laid[low + k : high + k]]
    return total


def _blocks_max(table: np.ndarray, laid: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Maximum of every filter in every block."""
    starts, ends = spans
    out = np.empty((len(starts), FILTERS), np.float32)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        low, high = starts[at], ends[to - 1]
        # between two texts lie padding positions: they make segments of their own, which are left out
        cuts = np.stack([starts[at:to], ends[at:to]], axis=1).ravel() - low
        total = _outputs(table, laid, low, high)
        keep = np.append(np.diff(cuts) > 0, False)
        pooled = np.maximum.reduceat(total, cuts[:-1][keep[:-1]], axis=0)
        out[at:to] = pooled[np.cumsum(keep)[::2] - 1]
        at = to
    return out


def _chunks(blocks_max: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima (each block with the next of its text), first chunk and number of chunks of each row."""
    first = np.cumsum(counts) - counts
    last = np.zeros(len(blocks_max), bool)
    last[first + counts - 1] = True
    pooled = blocks_max.copy()
    pooled[:-1] = np.where(last[:-1, None], pooled[:-1], np.maximum(blocks_max[:-1], blocks_max[1:]))
    keep = ~last
    keep[first[counts == 1]] = True  # a text of one block is one chunk
    sizes = np.maximum(counts - 1, 1)
    return np.flatnonzero(keep), np.cumsum(sizes) - sizes, pooled[keep]


def scores(network: Network | None, column: pa.Array) -> np.ndarray:
    """Probability per row of a text column; without a network, one half."""
    if network is None:
        return np.full(len(column), 0.5)
    out = np.empty(len(column))
    for row, end, data, offsets in blocks(column):
        laid, spans, counts = _laid(data, offsets)
        _, first, pooled = _chunks(_blocks_max(network.table, laid, spans), counts)
        active = np.maximum(pooled + network.lift, 0)
        sizes = np.maximum(counts - 1, 1)[:, None]
        seen = np.hstack([np.add.reduceat(active, first, axis=0) / sizes, np.maximum.reduceat(active, first, axis=0)])
        out[row:end] = seen @ network.out + network.bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[str | None], labels: list[int], epochs: int = 8, rate: float = 0.01, group: int = 32) -> Network:
    """Descend on the log loss (Adam), the gradient going back through the maxima alone."""
    rng = np.random.default_rng(11)
    p = {
        "table": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "lift": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32),
    }
    first = {k: np.zeros_like(a) for k, a in p.items()}
    second = {k: np.zeros_like(a) for k, a in p.items()}
    y, step = np.asarray(labels, np.float32), 0
    raw = [(t or "").encode() for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), group):
            mine, step = order[at : at + group], step + 1
            part = [raw[i] for i in mine]
            grads = _gradients(p, part, y[mine])
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Network(p["table"], p["lift"], p["out"], float(p["bias"][0]))


def _gradients(p: dict, part: list[bytes], y: np.ndarray) -> dict:
    data, offsets = np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
    laid, (starts, ends), counts = _laid(data, offsets)
    top, where = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
    for low in range(0, len(starts), 512):
        some = slice(low, low + 512)
        places = np.minimum(starts[some, None] + np.arange(STEP), ends[some, None] - 1)
        total = p["table"][0][laid[places]]
        for k in range(1, WIDTH):
            total += p["table"][k][laid[places + k]]
        arg = total.argmax(axis=1)
        top[some] = np.take_along_axis(total, arg[:, None, :], 1)[:, 0]
        where[some] = places[np.arange(len(arg))[:, None], arg]
    at, begin, pooled = _chunks(top, counts)
    sizes = np.maximum(counts - 1, 1)
    raised = pooled + p["lift"]
    active = np.maximum(raised, 0)
    mean, peak = np.add.reduceat(active, begin, axis=0) / sizes[:, None], np.maximum.reduceat(active, begin, axis=0)
    seen = np.hstack([mean, peak])
    slope = (1 / (1 + np.exp(-np.clip(seen @ p["out"] + p["bias"], -30, 30))) - y) / len(y)
    row = np.repeat(np.arange(len(y)), sizes)
    back = slope[row, None] * (p["out"][:FILTERS] / sizes[row, None] + p["out"][FILTERS:] * (active == peak[row]))
    back = np.where(raised > 0, back, 0).astype(np.float32)
    # a chunk's maximum is that of its first block or of the next one
    winner = np.where(top[at] >= pooled, at[:, None], np.minimum(at + 1, len(top) - 1)[:, None])
    spot = np.take_along_axis(where, winner, 0)
    lanes = np.broadcast_to(np.arange(FILTERS), spot.shape)
    table = np.stack([
        np.bincount((laid[spot + k].astype(np.int64) * FILTERS + lanes).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        for k in range(WIDTH)
    ]).astype(np.float32)
    return {"table": table + 1e-5 * p["table"], "lift": back.sum(0), "out": seen.T @ slope + 1e-4 * p["out"], "bias": slope.sum(keepdims=True)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network | None:
    """Fit on a bounded sample of the labels outside the held-out fold; None if only one label is known.

    Rows that label an id more than once count as one, with the lesser label.
    """
    known = labels.where(~fold(id_col, 5, 0) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    once = known.groupBy(id_col).agg(F.min(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_label"))
    picked = bounded_sample(once, id_col, "_label", sample)
    # the sample has about 2 * sample rows, whatever the tables' sizes
    drawn = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    # rows that repeat an id count as one, with the least text
    rows = drawn.groupBy(id_col, "_label").agg(F.min(text_col).alias(text_col)).select(id_col, text_col, "_label").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    if len({r[2] for r in rows}) < 2:
        return None
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted.

    Null and empty texts score like a single zero byte.  Repeated rows and ids
    are scored alike, a null id stays null and is not held out, and other
    columns are not read.
    """
    asked = docs.select(F.col(id_col).alias("id"), fold(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))

    def work(batches):
        for batch in batches:
            value = scores(network, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(value), pa.array((value >= CUT).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return asked.mapInArrow(work, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
