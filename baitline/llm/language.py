"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit (logistic, over
hashed byte n-grams) predicts that bit.  Decoding compares the classifiers'
margins with each codeword under the logistic loss, weighted by how well each
bit did for that language in training, and takes the nearest codeword.  Two
codewords at nearly the same distance mark the text as ambiguous.

Fitting takes a bounded sample (``SAMPLE`` texts of each language); scoring
reads every whole text, in one narrow pass over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_sample, fold, fresh
from .words import LOWER, blocks

#: Texts per language that the classifiers are fitted on.
SAMPLE = 400
#: Hashed n-gram features; n-gram sizes in bytes.
BUCKETS, SIZES = 1 << 13, (2, 3)
#: Rows whose features are held at once.
_ROWS = 64
#: A lead in score under which the nearest two codewords count as tied.
TIE = 0.1

_CLEAN = LOWER.copy()
_CLEAN[:128][~(((LOWER[:128] >= 97) & (LOWER[:128] <= 122)))] = 32


@dataclass
class Coder:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, far apart in every pair.

    Up to five languages: every split into two sides.  More: the best of a
    fixed number of seeded random codes by its least distance.
    """
    if n <= 2:
        return np.array([[1], [-1]])[:n]
    if n <= 5:
        splits = np.arange(2 ** (n - 1) - 1)
        rest = (splits[None, :] >> np.arange(n - 2, -1, -1)[:, None]) & 1
        return np.vstack([np.ones_like(splits), 2 * rest - 1])
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7)
    def least(code):
        return (bits - (code @ code.T)[np.triu_indices(n, 1)]).min() // 2
    return max((rng.choice([-1, 1], (n, bits)) for _ in range(200)), key=least)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram shares of each row; rows without letters are zero."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS)
    clean = _CLEAN[data].astype(np.uint32)
    where = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    for size in SIZES:
        n = len(clean) - size + 1
        if n <= 0:
            continue
        gram = clean[:n].copy()
        letters = clean[:n] != 32
        for k in range(1, size):
            gram = (gram << np.uint32(8)) | clean[k : k + n]
            letters |= clean[k : k + n] != 32
        gram = (gram * np.uint32(2654435761)) >> np.uint32(19)
        # spaces alone say nothing, and an n-gram lies in one row
        fine = letters & (where[:n] == where[size - 1 :])
        counts += np.bincount(where[:n][fine] * BUCKETS + gram[fine], minlength=len(counts))
    counts = counts.reshape(rows, BUCKETS)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def fit(texts: list[bytes], langs: list[str], rounds: int = 150, rate: float = 4.0, ridge: float = 1e-5) -> Coder:
    """One logistic classifier per bit, all by the same accelerated gradient steps.

    Each text gives two examples: all of it, and a short piece of its middle,
    so that short texts are told apart as well.
    """
    order = np.argsort([str(x) for x in langs], kind="stable")
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    languages = sorted(set(langs))
    code = codewords(len(languages))
    pieces = []
    for i, text in enumerate(texts):
        at = len(text) // 2
        pieces.append(text[at : at + 24 + 8 * (i % 12)])
    rows = []
    for group in (texts, pieces):
        for at in range(0, len(group), _ROWS):
            part = group[at : at + _ROWS]
            rows.append(features(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])))
    x = np.vstack(rows)
    label = np.array([languages.index(l) for l in langs] * 2)
    y = code[label].astype(np.float32)
    share = 1.0 / np.bincount(label, minlength=len(languages))[label] / len(languages)
    share = share.astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    last_w, last_b = w, b
    for step in range(rounds):
        push = step / (step + 3)
        at_w, at_b = w + push * (w - last_w), b + push * (b - last_b)
        slope = -y * share / (1 + np.exp(np.clip(y * (x @ at_w + at_b), -30, 30)))
        last_w, last_b = w, b
        w, b = at_w - rate * (x.T @ slope + ridge * at_w), at_b - rate * slope.sum(axis=0)
    hits = (np.sign(x @ w + b) == y).astype(float)
    right = np.vstack([hits[label == i].mean(axis=0) for i in range(len(languages))])
    return Coder(languages, code, w, b, right / np.maximum(right.sum(axis=1, keepdims=True), 1e-9))


def decode(coder: Coder, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of the certainty, and the lead over the next one."""
    agree = np.clip(margins[:, None, :] * coder.code[None], -30, 30)
    loss = (np.log1p(np.exp(-agree)) * coder.trust[None]).sum(axis=2) * coder.code.shape[1]
    near = np.exp(loss.min(axis=1, keepdims=True) - loss)
    near /= near.sum(axis=1, keepdims=True)
    best = near.argmax(axis=1)
    ranked = np.sort(near, axis=1)
    lead = ranked[:, -1] - (ranked[:, -2] if near.shape[1] > 1 else 0)
    return best, ranked[:, -1], lead


def _margins(coder: Coder, column: pa.Array) -> np.ndarray:
    out = [np.zeros((0, len(coder.bias)), np.float32)]
    for _, _, data, offsets in blocks(column, 1 << 18):
        for at in range(0, len(offsets) - 1, _ROWS):
            cut = offsets[at : at + _ROWS + 1]
            out.append(features(data[cut[0] : cut[-1]], cut - cut[0]) @ coder.weights + coder.bias)
    return np.vstack(out)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Coder | None:
    """Fit on a bounded sample of the rows with a language outside the held-out fold."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~fold(id_col, 4, 2))
    drawn = bounded_sample(usable.select(id_col, text_col, lang_col), id_col, lang_col, sample)
    # rows that repeat an id count as one for each language, with the least text
    picked = drawn.groupBy(id_col, lang_col).agg(F.min(text_col).alias(text_col)).select(id_col, text_col, lang_col).collect()
    rows = sorted((r[0], r[1].encode(), r[2]) for r in picked)
    return fit([r[1] for r in rows], [r[2] for r in rows]) if rows else None


def identify(docs: DataFrame, coder: Coder | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (0 to 1), ambiguous.

    ``und`` with score 0 for a null text, one without any letter, or when no
    language could be learned.  Repeated rows and ids are scored alike; a null
    id stays null and is not held out; other columns are not read.
    """
    asked = docs.select(
        F.col(id_col).alias(id_col), fold(id_col, 4, 2).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("_letters"),
    )

    def score(batches):
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            n = len(letters)
            lang, value, ambiguous = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if coder is not None and n:
                best, top, lead = decode(coder, _margins(coder, batch.column("_text")))
                names = np.array(coder.languages, object)
                lang[letters], value[letters] = names[best][letters], top[letters]
                ambiguous[letters] = lead[letters] < TIE
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(value), pa.array(ambiguous)],
                [id_col, "held_out", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return asked.mapInArrow(score, f"{id_col} {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, coder: Coder | None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, columns unchanged, whose text gets a language; ``und`` goes.

    Where no language could be learned (no labels), rows with a letter stay.
    Decided row by row where the row lies, so nothing is shuffled and rows
    without an id, or repeating one, need no rule of their own.
    """
    letters_col, own_col = fresh("_letters", docs.columns), fresh("_text", docs.columns)
    marked = docs.withColumn(letters_col, F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))
    asked = marked.withColumn(own_col, F.coalesce(F.col(text_col), F.lit("")))

    def choose(batches):
        for batch in batches:
            letters = batch.column(letters_col).to_numpy(zero_copy_only=False)
            lang = np.where(letters, "", "und").astype(object)
            if coder is not None and len(lang):
                best = decode(coder, _margins(coder, batch.column(own_col)))[0]
                lang[letters] = np.array(coder.languages, object)[best][letters]
            yield batch.select(batch.schema.names[:-2]).filter(pa.array(lang != "und"))

    return asked.mapInArrow(choose, docs.schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
