"""Benchmark decontamination: shared n-gram seeds, exact bounds, then Smith-Waterman alignment.

1. The test items go to the tasks in blocks of at most ``BLOCK_WORDS`` words, which bounds what is
   collected and sent, however many items there are.
2. One pass over whole texts finds every 3-word run of a block's items. Runs that lie near each
   other form a passage; it keeps the run numbers and the item words around them as numbers. Long
   passages are cut into windows that overlap by more than any alignment that counts can span.
3. Passages with equal words become one, so that a passage copied into many documents is judged
   once, and no count of documents decides anything.
4. A passage meets every item it shares a run with, common or rare. A pair goes on unless a bound
   shows that no alignment can reach the least score: the words the two have in common, and the
   best stretch of the text when each of the item's words counts as a match.
5. A local alignment of words (match 2, mismatch -1, gap -1) between passage and item gives
   score / (2 * words of the item); from ``LEAST_SCORE`` on, the document holds the item.
   Besides, the points must be more than ``LEAST_WORDS - 1`` words can give, so that at least
   ``LEAST_WORDS`` words match. Items of up to ``SHORT_ITEM`` words are held only as a whole, word
   for word: one shared run of three words would be enough of them otherwise.

Words are the runs of letters and digits of the lower-cased text. Null or empty texts hold
nothing. Items of under three words are one run of what they have; items without words are
never found. Repeated documents are found one by one; items with equal text are found under each
item_id. Null ids pass through as null. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import whole
from tidecast.session import materialise

RUN, LEAST_SCORE, LEAST_WORDS, SHORT_ITEM, BLOCK_WORDS = 3, 0.35, 5, 8, 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+")
PASSAGE = "doc_id long, text_hash long, first long, runs array<int>, words array<int>"
SCORED = "runs array<int>, words array<int>, item_id long, score double, start long, end long"


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """The words and runs of a block of items, as sorted numbers."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.items = [(i, [self.words.setdefault(w, len(self.words) + 1) for w in item_words(t)]) for i, t in items]
        self.longest = max((len(w) for _, w in self.items), default=0)
        runs = {r for _, w in self.items for r in self.runs_of(w)}
        self.codes = np.array(sorted(runs), dtype=np.int64)

    def runs_of(self, w: list[int]) -> list[int]:
        base = len(self.words) + 1
        padded = w + [0] * (RUN - len(w)) if w else []
        return [sum(x * base**k for k, x in enumerate(padded[i : i + RUN])) for i in range(len(padded) - RUN + 1)]


def find(text: str | None, known: dict[str, int], codes: np.ndarray, margin: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(first word, runs, words with margins) of each passage of the text."""
    ids = np.fromiter((known.get(w, 0) for w in item_words(text)), dtype=np.int64)
    if not len(ids) or not len(codes):
        return
    base = len(known) + 1
    tail = np.concatenate([ids, np.zeros(RUN - 1, dtype=np.int64)])
    hits: list[np.ndarray] = []
    for used in range(1, RUN + 1):  # items of under RUN words are codes with zeros at the end
        where = np.flatnonzero(np.all([tail[k : k + len(ids)] > 0 for k in range(used)], axis=0))
        code = sum(tail[where + k] * base**k for k in range(used))
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        ok = codes[at] == code
        hits.append(np.stack([where[ok], at[ok]]))
    pos, run = np.concatenate(hits, axis=1)
    order = np.lexsort((run, pos))
    pos, run = pos[order], run[order]
    cuts = np.flatnonzero(np.diff(pos) > margin) + 1
    for p, r in zip(np.split(pos, cuts), np.split(run, cuts), strict=True):
        if not len(p):
            continue
        lo, hi = max(0, int(p[0]) - margin), min(len(ids), int(p[-1]) + RUN + margin)
        # long passages go in windows; an alignment that counts spans under 3 margins, the overlap
        for start in range(lo, max(lo + 1, hi - 3 * margin), 9 * margin):
            end = min(hi, start + 12 * margin)
            inside = np.unique(r[(p >= start) & (p < end)])
            if len(inside):
                yield start, inside.tolist(), ids[start:end].tolist()


def blocks(benchmark: DataFrame) -> int:
    """Number of blocks of about BLOCK_WORDS words, from the items' total length."""
    total = benchmark.agg(F.sum(F.length(whole("text")))).first()[0] or 0
    return 1 + total // (4 * BLOCK_WORDS)


def passages(docs: DataFrame, items: Items) -> DataFrame:
    """The passages of all documents that hold a run of the items."""
    sent = docs.sparkSession.sparkContext.broadcast((items.words, items.codes, items.longest))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows = [
                    (d, h, *found)
                    for d, h, t in zip(part[0].to_pylist(), part[1].to_pylist(), part[2].to_pylist(), strict=True)
                    for found in find(t, *known)
                ]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())], strict=True)],
                    names=["doc_id", "text_hash", "first", "runs", "words"],
                )

    cols = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return cols.mapInArrow(work, PASSAGE)


def least(words: int) -> float:
    """The points an alignment needs with an item of so many words."""
    if words <= SHORT_ITEM:
        return MATCH * words
    return max(LEAST_SCORE * MATCH * words - 1e-9, MATCH * (LEAST_WORDS - 1) + 1)


def candidates(distinct: DataFrame, items: Items) -> DataFrame:
    """(runs, words, k): the passages with each item of a common run that the bounds do not rule out."""
    at = {int(c): i for i, c in enumerate(items.codes)}
    holders: list[list[int]] = [[] for _ in at]
    for k, (_, w) in enumerate(items.items):
        for c in set(items.runs_of(w)):
            holders[at[c]].append(k)
    sent = distinct.sparkSession.sparkContext.broadcast((holders, [w for _, w in items.items]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, wanted = sent.value
        sizes = [np.unique(np.array(w, dtype=np.int64), return_counts=True) for w in wanted]
        for b in batches:
            of, ks = [], []
            for row, (runs, words) in enumerate(zip(b.column("runs").to_pylist(), b.column("words").to_numpy(zero_copy_only=False), strict=True)):
                there, where, counts = np.unique(words, return_inverse=True, return_counts=True)
                for k in sorted({k for r in runs for k in holders[r]}):
                    own, times = sizes[k]
                    at = np.minimum(np.searchsorted(there, own), len(there) - 1)
                    both = there[at] == own
                    if MATCH * np.minimum(times, counts[at])[both].sum() < least(len(wanted[k])):
                        continue
                    # every word of the text that an alignment spans is one of the item's or costs a point
                    points = np.full(len(there), max(MISMATCH, GAP))
                    points[at[both]] = MATCH
                    upto = np.cumsum(points[where])
                    if (upto - np.minimum(np.minimum.accumulate(upto), 0)).max() >= least(len(wanted[k])):
                        of.append(row)
                        ks.append(k)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(of, pa.int64())).columns, pa.array(ks, pa.int32())], names=["runs", "words", "k"])

    return distinct.select("runs", "words").mapInArrow(work, "runs array<int>, words array<int>, k int")


def align(item: list[list[int]], text: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair of word lists: score, first and last word in the text."""
    n, rows, cols = len(item), max(map(len, item)), max(map(len, text))
    a, b = np.full((rows, n), -1), np.full((cols, n), -2)
    for k, (x, y) in enumerate(zip(item, text, strict=True)):
        a[: len(x), k], b[: len(y), k] = x, [w or -2 for w in y]
    above, above_at = np.zeros((cols + 1, n), np.int32), np.tile(np.arange(cols + 1)[:, None], (1, n))
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(rows):
        row, row_at = np.zeros_like(above), above_at * 0
        row_at[0] = 0
        for j in range(1, cols + 1):
            score, at = above[j - 1] + np.where(a[i] == b[j - 1], MATCH, MISMATCH), above_at[j - 1]
            for other, other_at in ((above[j] + GAP, above_at[j]), (row[j - 1] + GAP, row_at[j - 1])):
                more = other > score
                score, at = np.where(more, other, score), np.where(more, other_at, at)
            none = score <= 0
            row[j], row_at[j] = np.where(none, 0, score), np.where(none, j, at)
            more = row[j] > best
            best, first, last = np.where(more, row[j], best), np.where(more, row_at[j], first), np.where(more, j - 1, last)
        above, above_at = row, row_at
        above_at[0] = 0
    return best, first, last


def score(pairs: DataFrame, items: Items) -> DataFrame:
    """Rows (runs, words, k) to alignments with the points they need; places count from the passage's first word."""
    sent = pairs.sparkSession.sparkContext.broadcast(items.items)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for f in frames:
            f = f.assign(size=f["words"].map(len)).sort_values("size", kind="stable")
            for k in range(0, len(f), 256):
                g = f.iloc[k : k + 256]
                texts, wanted = [list(w) for w in g["words"]], [known[i][1] for i in g["k"]]
                best, start, end = align(wanted, texts)
                out = g[["runs", "words"]].assign(
                    item_id=pd.array([known[i][0] for i in g["k"]], dtype="Int64"),
                    score=best / (MATCH * np.array([len(w) for w in wanted])),
                    start=start,
                    end=end,
                )
                yield out[best >= np.array([least(len(w)) for w in wanted])]

    return pairs.mapInPandas(work, SCORED)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, score, start, end): the best passage of each document and item."""
    n = blocks(benchmark)
    out = []
    for k in range(n):
        part = benchmark.select(F.col("item_id").cast("long").alias("i"), "text")
        part = part.where(F.pmod(F.xxhash64("i", "text"), F.lit(n)) == k)
        items = Items(sorted(((r[0], r[1] or "") for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        found = materialise(passages(docs, items), "passages")
        # a passage is aligned once, however many documents hold it
        scored = score(candidates(found.select("runs", "words").distinct(), items), items)
        both = found.withColumn("h", F.xxhash64("words")).join(scored.withColumn("h", F.xxhash64("words")), ["h", "words", "runs"])
        out.append(both.select("doc_id", "text_hash", "item_id", "score", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end")))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    best = every.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("score", -F.col("start"), "end")).alias("x"))
    return best.select("doc_id", "text_hash", "item_id", "x.score", (-F.col("x.col2")).alias("start"), "x.end")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    found = materialise(leaks(docs, benchmark), "leaks").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h"))
    return docs.join(found, on, "left_anti")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op1: the benchmark items that documents hold."""
    return leaks(docs, benchmark).drop("text_hash")
