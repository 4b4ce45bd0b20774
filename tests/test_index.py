"""Vector index, split of examples, ledger gate."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import knowledge as B
from tidecast.operators import ledger as L
from tidecast.operators import text as T
from tidecast.session import fresh_path

VEC = "id long, label long, embedding array<float>"


def vectors(n, dim=16, groups=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, i % 2, (centres[rng.integers(groups)] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_of_the_index(spark):
    rows = vectors(4000)
    docs = spark.createDataFrame(rows, VEC)
    queries = docs.where("id % 100 = 0").select(F.col("id").alias("query"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    centres = B.cell_centres(docs, 40, sample=1000)
    index = B.build_index(docs, centres, fresh_path(spark, "cells"))
    assert index.count() == 4000
    exact = {(r.query, r.id) for r in B.probe(index, queries, 10, centres).collect()}
    # brute force
    e = np.array([r[2] for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = set()
    for q in range(0, 4000, 100):
        score = np.where(np.arange(4000) % 2 == q % 2, e @ e[q], -2)
        want |= {(q, int(i)) for i in np.argsort(-score, kind="stable")[:10]}
    assert len(exact & want) >= 0.999 * len(want)
    near = {(r.query, r.id) for r in B.probe(index, queries, 10, centres, 8).collect()}
    assert len(near & want) >= 0.95 * len(want)


def test_index_of_odd_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [1.0]), (4, 0, [0.0, 0.0]), (5, 0, [1.0, 0.1])]
    docs = spark.createDataFrame(rows, VEC)
    centres = B.cell_centres(docs.where("size(embedding) = 2"), 3)
    index = B.build_index(docs, centres, fresh_path(spark, "cells"))
    assert index.count() == 5
    one = B.cell_centres(docs.limit(0), 3)
    assert len(one) == 0 and B.with_cells(docs, "embedding", one).count() == 5


@pytest.mark.parametrize("names", [lambda k: f"store-{k:05d}", lambda k: "R" + str(k), lambda k: "same", lambda k: "é" * (k % 4) + str(k)])
def test_split_as_in_one_sort(spark, names):
    rows = [(names(k), dt.date(2024, 1, 1 + (k % 3 == 0) + (k % 11 == 0)), f"text {k}") for k in range(400)]
    got = T.split_pairs(spark.createDataFrame(rows, "entity string, forecast_start date, text string"), 0.6).collect()
    order = sorted(rows, key=lambda r: (r[1], r[0].encode()))
    train = {(r[0], r[1]) for r in order[: int(len(order) * 0.6)]}
    assert len(got) == 400 and sum(r.part == "train" for r in got) == 240
    assert {(r.entity, r.forecast_start) for r in got if r.part == "train"} == train


def test_ledger_gate_counts_in_the_load_itself(spark):
    rows = [("1.0", "2024-01-01" if k % 3 else None, str(k)) for k in range(30)]
    raw = spark.createDataFrame(rows, "entity string, date string, pred string")
    path = fresh_path(spark, "load")
    out, usable = L.load_checked(raw, {"pred": "double"}, path)
    assert usable and out.count() == 20
    bad = raw.withColumns({"pred": F.lit(None).cast("string"), "entity": F.lit(None).cast("string")})
    with pytest.raises(L.UnusableLedger):
        L.load_checked(bad, {"pred": "double"}, fresh_path(spark, "load"))
    assert L.load_checked(bad, {"pred": "double"}, fresh_path(spark, "load"), strict=False)[1] is False
    assert L.load_checked(raw.limit(0), {}, fresh_path(spark, "load"), strict=False)[1] is False
