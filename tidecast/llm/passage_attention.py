"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

1. A whole text is cut into passages of about ``PASSAGE`` words, equally long.
2. A passage is described by the rates of each punctuation mark, of capitals, digits and letters
   beyond ASCII, word lengths, distinct and repeated words, word pairs the document had before, and
   its lower-cased words hashed to ``BUCKETS`` numbers.
3. Encoder: h = tanh(W x + b) of the standardised description x.
4. Gated attention: a = u . (tanh(V h) * sigmoid(G h)), softmax over the document's passages.
5. Score: sigmoid(c . sum(a h) + c0). All of W, V, G, u and c are learned together from document
   labels; no passage has a label of its own.

Fitting: labelled rows whose crc32(doc_id) mod 3 is not 1, at most ``TRAIN_ROWS`` of them, those with
the least hashes of their id, and of these the first whose passages are ``TRAIN_PASSAGES`` at most
together (at least one document). The sample and the model are bounded by these parameters, whatever
the size of the corpus; scores cover every whole text.

A null or empty text, or one of white space, is one passage without words and gets a score. Null ids
are scored, and are never held out or fitted on. Of several labels of a document the larger counts;
null labels do not count. Rows that share an id are scored one by one. Without labels of both classes
the score is the smoothed share of good rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.words import whole
from tidecast.session import materialise

PASSAGE, BUCKETS = 64, 128
TRAIN_ROWS, TRAIN_PASSAGES = 4_000, 60_000
ENCODED, GATES, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 30, 32, 0.004, 1e-3, 12
#: Texts are looked at side by side up to this many bytes, and read in pieces of at most as many.
TOGETHER = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Classes of bytes that are counted: each ASCII mark, digits, capitals, first bytes beyond ASCII.
_KIND = np.full(256, -1, np.int64)
_KIND[_MARKS] = np.arange(len(_MARKS))
DIGIT, CAPITAL, BEYOND = len(_MARKS), len(_MARKS) + 1, len(_MARKS) + 2
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("A") : ord("Z") + 1] = CAPITAL
_KIND[0xC0:] = BEYOND
KINDS = len(_MARKS) + 3
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
SIZES = 10
FEATURES = KINDS + SIZES + BUCKETS


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """The bytes in pieces that end at white space, a word longer than a piece being kept whole."""
    x = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(x):
        end = min(at + TOGETHER, len(x))
        while end < len(x):
            spaces = np.flatnonzero(_SPACE[x[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            end = min(end + TOGETHER, len(x))
        yield x[at:end]
        at = end


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length in bytes of each word, and (word, kind) of each counted byte."""
    hashes, lengths, events, before = [], [], [], 0
    for x in _pieces(data):
        space = _SPACE[x]
        begins = ~space
        begins[1:] &= space[:-1]
        first = np.flatnonzero(begins)
        if not len(first):
            continue
        own = np.cumsum(begins) - 1
        place = (np.arange(len(x)) - first[np.maximum(own, 0)]) & 255
        value = (_LOWER[x] + np.uint64(1)) * _POWERS[place]
        value[space] = 0
        hashes.append(_mix(np.add.reduceat(value, first)))
        lengths.append(np.add.reduceat((~space).astype(np.int64), first))
        kind = _KIND[x]
        seen = np.flatnonzero(kind >= 0)
        events.append((own[seen] + before) * KINDS + kind[seen])
        before += len(first)
    none = np.zeros(0, np.int64)
    if not hashes:
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(lengths), np.concatenate(events)


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages of the texts, and the border of each text's passages."""
    parts = [_words(t) for t in texts]
    counts = np.array([len(p[0]) for p in parts], np.int64)
    offset = np.cumsum(counts) - counts
    n_passages = np.maximum(1, (counts + PASSAGE // 2) // PASSAGE)
    border = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(border[-1])
    h, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    event = np.concatenate([p[2] + o * KINDS for p, o in zip(parts, offset, strict=True)])
    doc = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(h)) - offset[doc]
    own = border[doc] + within * n_passages[doc] // np.maximum(counts[doc], 1)

    words = np.bincount(own, minlength=total).astype(float)
    per_word = np.maximum(words, 1)
    out = np.zeros((total, FEATURES), np.float32)
    kinds = np.bincount(own[event // KINDS] * KINDS + event % KINDS, minlength=total * KINDS).reshape(total, KINDS)
    out[:, :KINDS] = np.log1p(kinds / per_word[:, None])
    sums = lambda x: np.bincount(own, x, minlength=total) / per_word
    mean = sums(length)
    again, had = np.zeros(len(h)), np.zeros(len(h))
    if len(h):
        follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        again[follows] = h[follows] == h[follows - 1]
        salt = (np.arange(max(total, len(texts)) + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
        pair = _mix(h[follows - 1] * np.uint64(31) + h[follows]) ^ _mix(salt[doc[follows]])
        _, new = np.unique(pair, return_index=True)
        had[follows] = 1
        had[follows[new]] = 0
        _, new = np.unique(h ^ _mix(salt[own]), return_index=True)
        distinct = np.bincount(own[new], minlength=total) / per_word
    else:
        distinct = np.zeros(total)
    sizes = [words == 0, np.log1p(words), np.log1p(mean), np.sqrt(np.maximum(sums(length * length) - mean * mean, 0)) / (1 + mean)]
    sizes += [sums(length == 1), sums(length > 20), distinct, sums(again), sums(had), kinds[:, CAPITAL] > 0.5 * np.maximum(words * mean, 1)]
    out[:, KINDS : KINDS + SIZES] = np.stack(sizes, axis=1)
    bucket = (h >> np.uint64(57)).astype(np.int64)
    out[:, KINDS + SIZES :] = np.bincount(own * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.sqrt(per_word)[:, None]
    return out, border


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(model: dict, x: np.ndarray, border: np.ndarray) -> dict:
    """All layers for standardised passages; each text's passages lie between its borders, one at least."""
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["G"])
    a = (t * g) @ model["u"]
    bag = np.repeat(np.arange(len(border) - 1), np.diff(border))
    e = np.exp(a - np.maximum.reduceat(a, border[:-1])[bag])
    alpha = e / np.add.reduceat(e, border[:-1])[bag]
    r = np.add.reduceat(alpha[:, None] * h, border[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "bag": bag, "alpha": alpha, "r": r, "p": _sigmoid(r @ model["c"] + model["c0"])}


def gradients(model: dict, x: np.ndarray, border: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss over the texts."""
    f = forward(model, x, border)
    h, t, g, bag, alpha = f["h"], f["t"], f["g"], f["bag"], f["alpha"]
    dz = (f["p"] - y) / len(y)
    dr = dz[:, None] * model["c"]
    dalpha = (h * dr[bag]).sum(axis=1)
    da = alpha * (dalpha - np.add.reduceat(alpha * dalpha, border[:-1])[bag])
    gated = da[:, None] * model["u"]
    dt, dg = gated * g * (1 - t * t), gated * t * g * (1 - g)
    dh = (alpha[:, None] * dr[bag] + dt @ model["V"].T + dg @ model["G"].T) * (1 - h * h)
    return {
        "W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "G": h.T @ dg,
        "u": (t * g).T @ da, "c": f["r"].T @ dz, "c0": dz.sum(),
    }


def start(features: int) -> dict:
    rng = np.random.default_rng(SEED)
    near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {
        "W": near(features, ENCODED), "b": np.zeros(ENCODED), "V": near(ENCODED, GATES), "G": near(ENCODED, GATES),
        "u": near(GATES), "c": near(ENCODED), "c0": np.zeros(()),
    }


def fit(x: np.ndarray, border: np.ndarray, labels: np.ndarray) -> dict:
    """Adam on batches of documents, in a fixed order."""
    y = np.asarray(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return {"share": share}
    scale = {"mean": x.mean(axis=0), "std": np.maximum(x.std(axis=0), 1e-3)}
    x = standardised(scale, x)
    model = start(x.shape[1])
    model["c0"] = np.array(np.log(share / (1 - share)))
    first, second, steps = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            own = np.concatenate([np.arange(border[r], border[r + 1]) for r in rows])
            edges = np.concatenate([[0], np.cumsum(border[rows + 1] - border[rows])])
            steps += 1
            for name, d in gradients(model, x[own], edges, y[rows]).items():
                if name in ("W", "V", "G", "c"):
                    d = d + DECAY * model[name]
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.999 * second[name] + 0.001 * d * d
                move = first[name] / (1 - 0.9**steps) / (np.sqrt(second[name] / (1 - 0.999**steps)) + 1e-8)
                model[name] = model[name] - RATE * move
    return model | scale | {"share": share}


def standardised(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["std"], -8, 8)


def probability(model: dict, x: np.ndarray, border: np.ndarray) -> np.ndarray:
    if "W" not in model:
        return np.full(len(border) - 1, model["share"])
    return forward(model, standardised(model, x), border)["p"]


def _side_by_side(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in lots of about ``TOGETHER`` bytes of text, with their passages."""
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b[column]).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = sizes[at - 1] if at else 0
            end = min(b.num_rows, max(at + 1, int(np.searchsorted(sizes, base + TOGETHER, side="right"))))
            lot = b.slice(at, end - at)
            yield (lot, *describe(lot[column].cast(pa.binary()).to_pylist()))
            at = end


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> dict:
    """Fits on the bounded sample of labelled rows; their passages are described in tasks."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample is bounded by a parameter, and so is what is broadcast
    some = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(known), "doc_id")
    some = some.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "y", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, x, border in _side_by_side(batches, 3):
            packed = [x[border[k] : border[k + 1]].tobytes() for k in range(lot.num_rows)]
            cols = [lot[0], lot[1], lot[2], pa.array(np.diff(border)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "t", "y", "n", "x"])

    some = materialise(some.mapInArrow(work, "h long, t long, y int, n long, x binary"), "passages")
    first = some.orderBy("h", "t").limit(rows)  # one window over the bounded sample
    first = first.withColumn("upto", F.sum("n").over(W.orderBy("h", "t").rowsBetween(W.unboundedPreceding, W.currentRow)))
    sample = first.where((F.col("upto") <= passages) | (F.col("upto") == F.col("n"))).orderBy("upto").select("y", "n", "x").toArrow()
    border = np.concatenate([[0], np.cumsum(sample["n"].to_numpy().astype(np.int64))])
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return fit(x, border, sample["y"].to_numpy())


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, x, border in _side_by_side(batches, 1):
            yield pa.RecordBatch.from_arrays([lot[0], pa.array(probability(sent.value, x, border))], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInArrow(work, f"doc_id {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op12: quality score and prediction of each document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
