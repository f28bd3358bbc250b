"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of words that repeats with a smallest period ``q``, is at
least ``least`` words and two periods long, and cannot be extended.

1. Basic factors.  Level k names every factor of 2^k words by the pair of names
   of its halves.  Names belong to one document, and only factors that occur
   more than once in their document get one, so ordinary prose is left after a
   few levels.
2. Proposals.  A run of period q, 2^k <= q < 2^(k+1), repeats the factor of
   level k at distance q.  Occurrences of a factor that follow each other within
   half its length lie in arithmetic progression; so the occurrences within
   twice its length are a few progressions, and two of them propose the
   periods between their members.  A progression proposes nothing by itself at
   its level: its own step is a period of a lower level.
3. Extension.  Each proposal is extended to both sides by comparing named
   factors from the highest level down to single words.
4. Deduplication.  Of proposals of one stretch the least period stays.

Documents are independent, so nothing is shuffled.  A task holds one block of
texts, or one text if that is longer: its words and four bytes per word and level.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks

#: Shortest run in words.
LEAST = 12


def _numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents (equal only for equal words of one document), and where documents start."""
    found, base, ends = [np.zeros(0, np.int64)], 0, [0]
    for words in docs:
        first: dict[bytes, int] = {}
        number = first.setdefault
        found.append(np.fromiter((number(w, base + len(first)) for w in words), np.int64, len(words)))
        base += len(first)
        ends.append(ends[-1] + len(words))
    return np.concatenate(found), np.array(ends, np.int64)


def factors(words: np.ndarray) -> list[np.ndarray]:
    """Per level the names of the factors of 2^k words by position; 0 stands for a factor that does not recur."""
    n, out, size = len(words), [], 1
    at, key = np.arange(n), (words,)
    while len(at):
        order = np.lexsort((at, *key[::-1]))
        at, key = at[order], tuple(k[order] for k in key)
        new = np.zeros(len(at) + 1, bool)
        new[[0, -1]] = True
        for k in key:
            new[1:-1] |= k[1:] != k[:-1]
        lone = new[:-1] & new[1:]
        name = np.cumsum(new[:-1], dtype=np.int32)
        at, name = at[~lone], name[~lone]
        if not len(at):
            break
        level = np.zeros(n, np.int32)
        level[at] = name
        out.append(level)
        at = np.sort(at)
        at = at[at < n - size]
        at = at[level[at + size] > 0]
        key = (level[at], level[at + size])
        size *= 2
    return out


def proposals(level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods, from ``size`` to below twice that, at which factors of ``size`` words recur."""
    at = np.flatnonzero(level)
    at = at[np.argsort(level[at], kind="stable")]
    name = level[at]
    gap = np.diff(at)
    joined = (name[1:] == name[:-1]) & (2 * gap <= size)
    head = np.flatnonzero(np.concatenate(([True], ~joined)))
    tail = np.concatenate((head[1:], [len(at)])) - 1
    first, last, count, name = at[head], at[tail], tail - head + 1, name[head]
    step = np.where(count > 1, (last - first) // np.maximum(count - 1, 1), 0)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here, hop = np.arange(len(head)), 1
    while True:
        here = here[here + hop < len(head)]
        there = here + hop
        close = (name[here] == name[there]) & (first[there] - last[here] < 2 * size)
        here, there = here[close], there[close]
        if not len(here):
            break
        # All distances between members are distance(first, first) + t * width, t from 1 - count to next count - 1.
        width = np.maximum(np.maximum(step[here], step[there]), 1)
        base = first[there] - first[here]
        low = np.maximum(1 - count[here], -((base - size) // width))
        high = np.minimum(count[there] - 1, (2 * size - 1 - base) // width)
        many = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(here)), many)
        t = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
        places.append(first[here][row] + np.maximum(-t, 0) * width[row])
        periods.append(base[row] + t * width[row])
        hop += 1
    place, period = np.concatenate(places), np.concatenate(periods)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # Neighbouring proposals of one period overlap in the same stretch: the first stands for all.
    again = np.zeros(len(place), bool)
    again[1:] = (period[1:] == period[:-1]) & (place[1:] - place[:-1] <= size)
    return place[~again], period[~again]


def find_runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs of one array of word numbers, by start and period."""
    levels = factors(words)
    n = len(words)
    found = [proposals(level, 1 << k) for k, level in enumerate(levels)]
    left = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
    period = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
    right = left.copy()
    for k in range(len(levels) - 1, -1, -1):
        level, size = levels[k], 1 << k
        ahead = np.flatnonzero(right + period < n)
        mine = level[right[ahead]]
        same = (mine > 0) & (mine == level[right[ahead] + period[ahead]])
        right[ahead[same]] += size
        back = np.flatnonzero(left >= size)
        mine = level[left[back] - size]
        same = (mine > 0) & (mine == level[left[back] - size + period[back]])
        left[back[same]] -= size
    end = right + period
    good = end - left >= np.maximum(least, 2 * period)
    left, end, period = left[good], end[good], period[good]
    order = np.lexsort((period, end, left))
    left, end, period = left[order], end[order], period[order]
    twice = np.zeros(len(left), bool)
    twice[1:] = (left[1:] == left[:-1]) & (end[1:] == end[:-1])
    left, end, period = left[~twice], end[~twice], period[~twice]
    order = np.lexsort((period, left))
    return left[order], end[order], period[order]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, texts: bool = False,
) -> DataFrame:
    """Per row: id, n_runs, the longest run, digests; with ``texts`` also runs, n_words and collapsed.

    Words are runs of anything but ASCII white space.  ``start``, ``length``,
    ``period`` and ``exponent_milli`` describe the longest run (ties: least
    start, then least period) and are null where there is none.  ``collapsed``
    keeps of every run its first period: words of a run after its first
    ``period`` words are dropped, and the others joined by one space.

    Null, empty and blank texts have no words and no runs; their digests are
    those of no bytes.  Repeated ids and rows give a row each, null ids stay
    null, other columns are not read, an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string" if texts else ""
    schema = (
        f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long,"
        f" runs_sha256 string, collapsed_sha256 string{extra}"
    )
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), run_type, pa.string()]

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                raw = data.tobytes()
                split = [raw[a:b].split() for a, b in zip(offsets, offsets[1:])]
                words, edge = _numbered(split)
                start, stop, period = find_runs(words, least)
                # Words inside a run after its first period, all documents at once.
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, stop, -1)
                gone = np.cumsum(cover[:-1]) > 0
                doc = np.searchsorted(edge, start, "right") - 1
                first = np.searchsorted(doc, np.arange(len(split) + 1))
                out = [[] for _ in range(10 if texts else 7)]
                for d, names in enumerate(split):
                    a, b = first[d], first[d + 1]
                    s, q = (start[a:b] - edge[d]).tolist(), period[a:b].tolist()
                    size = (stop[a:b] - start[a:b]).tolist()
                    best = min(range(b - a), key=lambda i: (-size[i], s[i], q[i]), default=None)
                    kept = [w for w, g in zip(names, gone[edge[d] : edge[d + 1]].tolist()) if not g] if b > a else names
                    text = b" ".join(kept)
                    values = [b - a, *([None] * 4 if best is None else [s[best], size[best], q[best], 1000 * size[best] // q[best]])]
                    values += [_digest("".join(f"{x},{y},{z}\n" for x, y, z in zip(s, size, q)).encode()), _digest(text)]
                    if texts:
                        runs = [{"start": x, "length": y, "period": z} for x, y, z in zip(s, size, q)]
                        values += [len(names), runs, text.decode("utf-8", "replace")]
                    for column, value in zip(out, values):
                        column.append(value)
                arrays = [batch.column(0).slice(row, end - row), *(pa.array(c, k) for c, k in zip(out, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=names_out)

    names_out = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    names_out += ["n_words", "runs", "collapsed"] if texts else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def looped(id_col: Column, text: Column) -> Column:
    """The text, for every tenth hash of an id with the words from a point on replaced by a loop.

    The loop is the ``p`` words from word ``a`` on; a null id has no hash and keeps its text.
    """
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a), F.slice(loop, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))


#: Equal stretches of six words at one distance, in islands of neighbouring positions; CRC-32 bit by bit.
OP12_SQL = r"""
WITH hashed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda u, x: list_reduce(list_prepend(xor(u, x), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h
  FROM documents
), planned AS (
  SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turn, h // 10 AS g FROM hashed
), placed AS (
  SELECT *, CASE WHEN turn THEN g % n ELSE n END AS a FROM planned
), sized AS (
  SELECT *, CASE WHEN turn THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM placed
), words AS (
  SELECT r, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM sized)
), six AS (
  SELECT r, i, list(word) OVER ahead AS key, count(*) OVER ahead AS many FROM words
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.r = y.r AND x.key = y.key AND x.i < y.i
  WHERE x.many = 6 AND y.many = 6
), marked AS (
  SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + 5 + q AS size FROM marked GROUP BY r, q, island
), runs AS (
  SELECT r, s, size, min(q) AS q FROM stretches WHERE size >= greatest(12, 2 * q) GROUP BY r, s, size
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS told,
    first({'s': s, 'l': size, 'q': q} ORDER BY size DESC, s, q) AS best
  FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT w.r, w.i FROM words w JOIN runs u ON w.r = u.r AND w.i >= u.s + u.q AND w.i < u.s + u.size
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
  sha256(coalesce(body, '')) AS collapsed_sha256
FROM hashed LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
