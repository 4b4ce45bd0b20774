"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (runs of letters, lower-cased) and their prefixes of 4 to 10
letters, hashed to ``BUCKETS`` numbers; a term's value is log(1 + count). The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so that two terms may mean more, or less, together than their weights add up to.

Fitting: labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``TRAIN_ROWS`` of them, the ones
with the least hashes of their id. Two kinds of buckets get weights and factors: those seen in at
least ``LEAST_DOCS`` of these rows and unevenly between the classes (chi-square of ``LEAST_CHI``),
the strongest ``MOST_TERMS`` at most; and those that belong to a pair which tells more than its two
terms do by themselves (chi-square of ``PAIR_CHI``), whatever they tell alone, looked for among the
``PAIR_TERMS`` most frequent buckets of at least ``PAIR_SHARE`` of the rows. The others have no
weight. The sample, the terms tried and the model are bounded by these parameters, whatever the
size of the corpus; the scores cover every whole text.

A text without known terms, also a null or empty one, scores the sigmoid of w0. Null ids are
scored, and are never held out or fitted on. Of several labels of a document the larger counts.
Without labels of both classes the model is the smoothed share of toxic rows. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import whole
from tidecast.session import materialise

BUCKETS, PREFIXES = 1 << 18, range(4, 11)
TRAIN_ROWS, LEAST_DOCS, LEAST_CHI, MOST_TERMS = 20_000, 5, 10.0, 20_000
#: Terms in this share of the fitted rows, the most frequent ones, are tried in pairs.
PAIR_SHARE, PAIR_TERMS, PAIR_CHI, PAIR_ROWS = 0.01, 3_000, 60.0, 1_000
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 12, 128, 0.1, 3e-3, 5


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(text: Column) -> Column:
    """Array of all hashed terms, with repetitions."""
    w = F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")

    def of(x):
        pre = [F.when(F.length(x) > n, F.pmod(F.xxhash64(F.lit(n), F.substring(x, 1, n)), F.lit(BUCKETS))) for n in PREFIXES]
        return F.array(F.pmod(F.xxhash64(x), F.lit(BUCKETS)), *pre)

    return F.transform(F.array_compact(F.flatten(F.transform(w, of))), lambda x: x.cast("int"))


def _by_row(x: np.ndarray, border: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[border[1:]] - total[border[:-1]]


def margin(model: dict, i: np.ndarray, x: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score before the sigmoid, and the factor sums of each row. i numbers the model's terms."""
    vx = model["v"][i] * x[:, None]
    s = _by_row(vx, border)
    return model["w0"] + _by_row(model["w"][i] * x, border) + 0.5 * (s * s - _by_row(vx * vx, border)).sum(axis=1), s


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(i: np.ndarray, x: np.ndarray, border: np.ndarray, labels: np.ndarray, n: int) -> dict:
    """w0, w and v of ``n`` terms. AdaGrad on the logistic loss, in a fixed order.

    Row r has the terms i[border[r]:border[r + 1]] with the values x of the same places.
    """
    y = np.asarray(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(SEED)
    model = {"w0": float(np.log(share / (1 - share))), "w": np.zeros(n), "v": rng.normal(0, 0.01, (n, FACTORS))}
    g0, gw, gv = 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
    for _ in range(EPOCHS if n else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            sizes = border[rows + 1] - border[rows]
            part = np.concatenate([np.arange(border[r], border[r + 1]) for r in rows])
            ii, xx, own = i[part], x[part], np.concatenate([[0], np.cumsum(sizes)])
            z, s = margin(model, ii, xx, own)
            g = sigmoid(z) - y[rows]
            of = np.repeat(np.arange(len(rows)), sizes)
            dw = g[of] * xx
            dv = dw[:, None] * (s[of] - model["v"][ii] * xx[:, None])
            u, at = np.unique(ii, return_inverse=True)
            sw = np.bincount(at, dw, len(u)) + DECAY * model["w"][u]
            sv = np.stack([np.bincount(at, dv[:, f], len(u)) for f in range(FACTORS)], axis=1) + DECAY * model["v"][u]
            g0, gw[u], gv[u] = g0 + g.sum() ** 2, gw[u] + sw**2, gv[u] + sv**2
            model["w0"] -= RATE * g.sum() / np.sqrt(g0)
            model["w"][u] -= RATE * sw / np.sqrt(gw[u])
            model["v"][u] -= 0.3 * RATE * sv / np.sqrt(gv[u])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fits on the bounded sample of labelled rows.

    Terms are counted and chosen by Spark; the driver gets the chosen terms of the sample only.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample is bounded by a parameter, and so is what is broadcast
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    some = materialise(some.select("doc_id", "toxic", terms(whole("text")).alias("t")), "labelled")
    ids = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow()
    y = ids["toxic"].to_numpy()
    model = {"buckets": np.zeros(0, np.int64)}
    empty = np.zeros(0, np.int64)
    if not 0 < y.sum() < len(y):
        return model | fit(empty, empty, np.zeros(len(y) + 1, np.int64), y, 0)
    mean = float(y.mean())
    seen = some.select("toxic", F.explode(F.array_distinct("t")).alias("b")).groupBy("b")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    chi = F.pow(F.col("k") - F.col("n") * mean, F.lit(2.0)) / (F.col("n") * mean * (1 - mean))
    told = (F.col("n") >= LEAST_DOCS) & (chi >= LEAST_CHI)
    strong = seen.where(told).orderBy(chi.desc(), "b").limit(MOST_TERMS).select("b").toArrow()["b"].to_numpy()
    # what tells nothing alone may tell much beside another term, if both are seen often enough
    often = F.col("n") >= max(LEAST_DOCS, PAIR_SHARE * len(y))
    often = np.sort(seen.where(often).orderBy(F.col("n").desc(), "b").limit(PAIR_TERMS).select("b").toArrow()["b"].to_numpy())
    row, i, _ = _entries(some, often, ids["doc_id"].to_numpy())
    paired = often[in_pairs(row, i, y, len(often))]
    model["buckets"] = np.union1d(strong, paired).astype(np.int64)
    row, i, count = _entries(some, model["buckets"], ids["doc_id"].to_numpy())
    border = np.searchsorted(row, np.arange(len(y) + 1))
    return model | fit(i, np.log1p(count), border, y, len(model["buckets"]))


def _entries(some: DataFrame, buckets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number among ``buckets`` and count of each of these terms in the sample, in order."""
    kept = some.sparkSession.createDataFrame([(int(b),) for b in buckets], "b int")
    entries = some.select("doc_id", F.explode("t").alias("b")).join(F.broadcast(kept), "b")
    entries = entries.groupBy("doc_id", "b").agg(F.count(F.lit(1)).cast("int").alias("c")).toArrow()
    row, i = np.searchsorted(ids, entries["doc_id"].to_numpy()), np.searchsorted(buckets, entries["b"].to_numpy())
    order = np.lexsort((i, row))
    return row[order], i[order], entries["c"].to_numpy()[order]


def in_pairs(row: np.ndarray, i: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` terms belong to a pair that tells more than its two terms do one by one.

    A pair's share of label 1 is held against the one its terms would give if they only added up
    (their odds multiplied); ``PAIR_CHI`` allows for the many pairs that are tried.
    """
    y = np.asarray(labels, float)
    both, ones = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for k in range(0, len(y), PAIR_ROWS):
        at = slice(*np.searchsorted(row, [k, k + PAIR_ROWS]))
        x = np.zeros((min(PAIR_ROWS, len(y) - k), n), np.float32)
        x[row[at] - k, i[at]] = 1
        both += x.T @ x
        ones += x[y[k : k + PAIR_ROWS] > 0].T @ x[y[k : k + PAIR_ROWS] > 0]
    out, mean = np.zeros(n, bool), y.mean()
    alone = (np.diag(ones) + mean) / (np.diag(both) + 1)
    odds = alone / (1 - alone)
    for k in range(n):
        joint = odds[k] * odds / (mean / (1 - mean))
        share = joint / (1 + joint)
        spread = both[k] * share * (1 - share)
        chi = (ones[k] - both[k] * share) ** 2 / np.maximum(spread, 1)
        # a term beside another one that is always with it is the same term
        own = both[k] > 0.9 * np.minimum(np.diag(both), both[k, k])
        out[k] = bool((chi[~own] >= PAIR_CHI).any())
    return out


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = np.full(BUCKETS, -1, np.int32)
        number[known["buckets"]] = np.arange(len(known["buckets"]))
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                i = number[part[1].flatten().to_numpy()]
                row = np.repeat(np.arange(part.num_rows), part[1].value_lengths().to_numpy())[i >= 0]
                # one entry per row and term, with its count
                n = len(known["buckets"]) + 1
                each, count = np.unique(row * n + i[i >= 0], return_counts=True)
                border = np.searchsorted(each, np.arange(part.num_rows + 1) * n)
                z, _ = margin(known, each % n, np.log1p(count), border)
                yield pa.RecordBatch.from_arrays([part[0], pa.array(sigmoid(z))], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    cols = docs.select(F.col(doc_id).alias("doc_id"), terms(whole(text)).alias("t"))
    return cols.mapInArrow(work, f"doc_id {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op5: toxicity score and prediction of each document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
