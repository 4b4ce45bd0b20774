"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(LEAST, TIMES * q)`` long, that no
neighbouring word extends. All runs of a text are found as follows, a few tens of thousands of words
at a time (texts side by side, parted by numbers of their own, so that no run crosses them):

1. Suffix array by doubling. The ranks of each step number the stretches of 2, 4, 8 ... words, which
   also answers how far two places agree, forwards and backwards, in a logarithm of steps.
2. A wavelet tree over the suffix array finds, among the suffixes that begin with a given block, the
   one with the least place from a given one on (range successor).
3. The blocks of B = 2, 4, 8 ... words at multiples of B are looked for in the window of B places
   behind them. A run of period q, B <= q < 2B, is at least 4q long, so it holds such a block, and
   its next copy q words on.
4. Copies at most B/2 apart form a progression: the block has that difference as its own period.
   The stretch of that period around the block and the one around the copies end q words apart, so
   the whole progression gives one candidate. Copies further apart are candidates themselves, at
   most a few in a window.
5. A candidate is extended to both sides and kept if it is long enough. Of candidates with the same
   ends the least period counts; the others are its multiples.

A task holds some hundred bytes for each word of the texts it has side by side; a text longer than
``TOGETHER`` words is looked at alone. Nothing is shuffled. Null and empty texts have no words and no
runs. Rows with a null id keep their words as they are. Repeated rows give repeated results; equal
exponents go to the smallest start, then the smallest period. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import CRC_TABLE, crc32_sql

LEAST, TIMES, TOGETHER = 6, 4, 50_000
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
     ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
RESULT_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Suffix array of a sequence and the ranks of its dyadic blocks.

    ``rank[k][i]`` is the first place in the array of the suffixes that share 2**k words with suffix i.
    """

    def __init__(self, values: np.ndarray):
        self.n = n = len(values)
        order = np.argsort(values, kind="stable").astype(np.int64)
        self.rank = [self._groups(order, values[order])]
        k = 1
        while True:
            rank = self.rank[-1]
            open_ = self._shared(order, rank)
            if not len(open_):
                break
            # only suffixes that still share their rank are ordered anew, inside their group
            i = order[open_]
            behind = np.where(i + k < n, rank[np.minimum(i + k, n - 1)] + 1, 0)
            key = rank[i].astype(np.int64) * (n + 1) + behind
            at = np.argsort(key, kind="stable")
            order[open_] = i[at]
            key, new = key[at], rank.copy()
            first = np.empty(len(key), bool)
            first[0] = True
            np.not_equal(key[1:], key[:-1], out=first[1:])
            new[order[open_]] = open_[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            self.rank.append(new)
            k *= 2
        self.order = order

    @staticmethod
    def _groups(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        first = np.empty(len(order), bool)
        first[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        rank = np.empty(len(order), np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return rank

    @staticmethod
    def _shared(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of the array whose suffix shares its rank with another one."""
        r = rank[order]
        same = r[1:] == r[:-1]
        out = np.zeros(len(r), bool)
        out[1:] |= same
        out[:-1] |= same
        return np.flatnonzero(out)

    def ends(self, k: int) -> np.ndarray:
        """For each first place of a group of rank k, the place behind the group."""
        first = np.flatnonzero(self.rank[k][self.order] == np.arange(self.n))
        out = np.zeros(self.n, np.int64)
        out[first] = np.append(first[1:], self.n)
        return out

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree, i < j."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.rank))):
            rank, width = self.rank[k], 1 << k
            inside = j + width <= self.n
            hit = inside & (rank[np.minimum(i, self.n - 1)] == rank[np.where(inside, j, 0)])
            step = width * hit
            i, j, total = i + step, j + step, total + step
        return total

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree, i < j."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.rank))):
            rank, width = self.rank[k], 1 << k
            inside = i >= width
            hit = inside & (rank[np.maximum(i - width, 0)] == rank[np.maximum(j - width, 0)])
            step = width * hit
            i, j, total = i - step, j - step, total + step
        return total


class Wavelet:
    """Wavelet tree over a permutation, level by level: zeros of the bit first, then the ones."""

    def __init__(self, values: np.ndarray):
        self.n, self.zeros = len(values), []
        self.bits = max(1, int(self.n - 1).bit_length())
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.zeros.append(zeros)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places lo..hi are less than x."""
        lo, hi, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            zlo, zhi, total = zeros[lo], zeros[hi], zeros[-1]
            one = ((x >> (self.bits - 1 - level)) & 1).astype(bool)
            count += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, total + lo - zlo, zlo), np.where(one, total + hi - zhi, zhi)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The value of places lo..hi that c others of them are less than."""
        lo, hi, c, value = lo.copy(), hi.copy(), c.copy(), np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            zlo, zhi, total = zeros[lo], zeros[hi], zeros[-1]
            one = c >= zhi - zlo
            c = np.where(one, c - (zhi - zlo), c)
            value = 2 * value + one
            lo, hi = np.where(one, total + lo - zlo, zlo), np.where(one, total + hi - zhi, zhi)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Least value of places lo..hi that is x or more; n where there is none."""
        out = np.full(len(lo), self.n, np.int64)
        inside = np.flatnonzero(x < self.n)
        lo, hi = lo[inside], hi[inside]
        c = self.below(lo, hi, x[inside])
        some = c < hi - lo
        out[inside[some]] = self.smallest(lo[some], hi[some], c[some])
        return out


def candidates(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the periods that copies of them in the window behind speak for."""
    tree, n = Wavelet(suffixes.order), suffixes.n
    blocks, periods = [], []
    for k in range(len(suffixes.rank)):
        width = 1 << k
        b = np.arange(0, n - 2 * width + 1, width, dtype=np.int64)
        lo = suffixes.rank[k][b].astype(np.int64)
        hi = suffixes.ends(k)[lo]
        several = hi - lo > 1
        b, lo, hi = b[several], lo[several], hi[several]
        x, end = tree.successor(lo, hi, b + width), b + 2 * width
        while True:
            within = x < end
            if not within.any():
                break
            b, lo, hi, x, end = b[within], lo[within], hi[within], x[within], end[within]
            after = tree.successor(lo, hi, x + 1)
            blocks.append(b)
            periods.append(x - b)
            near = np.flatnonzero((after < end) & (after - x <= width // 2))
            if len(near):
                d = (after - x)[near]
                own = b[near] + d + suffixes.forwards(b[near], b[near] + d)
                other = x[near] + d + suffixes.forwards(x[near], x[near] + d)
                blocks.append(b[near])
                periods.append(other - own)
                # on to the first copy that begins behind the progression
                after[near] = tree.successor(lo[near], hi[near], other - width + 1)
            x = after
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, q = np.concatenate(blocks), np.concatenate(periods)
    return b[q > 0], q[q > 0]


def find_runs(values: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. ``times`` is 4 at least."""
    if len(values) < least:
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(values)
    b, q = candidates(suffixes)
    start = b - suffixes.backwards(b, b + q)
    length = b + q + suffixes.forwards(b, b + q) - start
    enough = length >= np.maximum(least, times * q)
    found = np.unique(np.stack([start, length, q], axis=1)[enough], axis=0)
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def split_words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words, with a repetition in one of ten documents (by the id's crc32)."""
    n, h = len(words), zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def summarise(words: list[str], runs: np.ndarray) -> tuple:
    """Result columns of a text, its id aside."""
    if not len(runs):
        return (0, None, None, None, None, sha256(b"").hexdigest(), sha256(" ".join(words).encode()).hexdigest())
    rows = runs.tolist()
    best = rows[0]
    for r in rows[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    start, length, period = best
    cut = np.zeros(len(words) + 1, np.int64)
    np.add.at(cut, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cut, runs[:, 0] + runs[:, 1], -1)
    kept = " ".join([words[i] for i in np.flatnonzero(np.cumsum(cut)[:-1] == 0)])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return (len(rows), start, length, period, 1000 * length // period, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def runs_of_texts(texts: list[list[str]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each list of words, all of them looked at together."""
    number: dict[str, int] = {}
    values, starts = [], []
    for k, words in enumerate(texts):
        starts.append(len(values))
        values += [number.setdefault(w, len(number)) for w in words]
        values.append(-1 - k)
    found = find_runs(np.array(values, np.int64), least, times)
    border = np.searchsorted(found[:, 0], [*starts, len(values)])
    return [found[border[k] : border[k + 1]] - [starts[k], 0, 0] for k in range(len(texts))]


def query(docs: DataFrame) -> DataFrame:
    """op13: number of runs, the strongest one, and digests of all runs and of the text without repetitions."""

    def flush(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        rows = [(i, *summarise(w, r)) for i, w, r in zip(ids, texts, runs_of_texts(texts), strict=True)]
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RESULT, strict=True)], schema=RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                for i, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                    words = planted(split_words(text or ""), i)
                    if held and held + len(words) > TOGETHER:
                        yield flush(ids, texts)
                        ids, texts, held = [], [], 0
                    ids.append(i)
                    texts.append(words)
                    held += len(words) + 1
        if ids:
            yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, RESULT_DDL)


ORACLE = rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         coalesce({crc32_sql("doc_id::VARCHAR", "crc.t")}, 1) AS h FROM documents, crc),
cuts AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM texts),
units AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cuts),
w AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS ws FROM units),
tries AS (SELECT r, ws, n, unnest(range(1, n // 4 + 1)) AS q FROM w WHERE n >= 6),
differ AS (  -- places i whose word differs from the one q on, and both ends
  SELECT r, q, unnest(list_concat([-1::BIGINT], list_filter(range(n - q), lambda i: ws[i + 1] <> ws[i + q + 1]), [n - q])) AS i FROM tries),
gaps AS (SELECT r, q, lag(i) OVER (PARTITION BY r, q ORDER BY i) + 1 AS s, i FROM differ),
stretch AS (SELECT r, s, i + q - s AS l, min(q) AS q FROM gaps WHERE i + q - s >= greatest(6, 4 * q) AND i > s GROUP BY ALL),
best AS (SELECT r, s, l, q, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM stretch),
sums AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM stretch GROUP BY r),
gone AS (SELECT r, list_distinct(flatten(list(range(s + q, s + l)))) AS places FROM stretch GROUP BY r)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(CASE WHEN g.r IS NULL THEN array_to_string(ws, ' ') ELSE
    array_to_string(list_transform(list_filter(range(n), lambda i: NOT list_contains(places, i)), lambda i: ws[i + 1]), ' ') END) AS collapsed_sha256
FROM w LEFT JOIN best b ON w.r = b.r AND b.k = 1 LEFT JOIN sums s ON w.r = s.r LEFT JOIN gone g ON w.r = g.r
"""
