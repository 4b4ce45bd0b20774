"""Knowledge documents (id, text, metadata) and retrieval over given embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doc_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def _doc(df: DataFrame, kind: str, ident: Column, text: Column, **meta: Column) -> DataFrame:
    m = {"type": F.lit(kind), **meta}
    return df.select(
        ident.alias("id"), text.alias("text"),
        F.create_map(*[x for k, c in m.items() for x in (F.lit(k), c.cast("string"))]).alias("metadata"),
    )


def _signed(c: Column) -> Column:
    r = F.bround(c, 0).cast("int")
    return F.concat(F.when(r >= 0, "+").otherwise(""), r.cast("string"))


def docs_state(state: DataFrame, issues: DataFrame, keep_issues: int = 10) -> DataFrame:
    """A bias document per entity and one per recent issue."""
    text = F.concat(
        F.lit("Entity "), F.col("entity"), F.lit(": bias "), _signed(F.col("overall_bias")), F.lit(" guests, strategy "),
        F.coalesce("best_strategy", F.lit("ENSEMBLE_EQUAL")),
    )
    a = _doc(state, "restaurant_bias", doc_id(F.lit("bias"), F.col("entity")), text, restaurant=F.col("entity"))
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date"), "type"))
    i = issues.withColumn("rn", rn).where(F.col("rn") <= keep_issues)
    it = F.concat(F.lit("Entity "), F.col("entity"), F.lit(" on "), F.col("date").cast("string"), F.lit(": "), F.col("type"))
    b = _doc(i, "issue", doc_id(F.lit("issue"), F.col("entity"), F.col("date").cast("string"), F.col("type")), it, restaurant=F.col("entity"))
    return a.unionByName(b)


def feedback_days(ledger: DataFrame) -> DataFrame:
    d = ledger.where("pred is not null and actual >= 0").groupBy("entity", "date").agg(F.sum("pred").alias("pred"), F.sum("actual").alias("actual"))
    return d.withColumn("abs_error", F.abs(F.col("pred") - F.col("actual")))


def top_feedback(days: DataFrame, max_records: int) -> DataFrame:
    """Largest errors when there are more than ``max_records``; ties by entity and date."""
    return days.orderBy(F.desc("abs_error"), "entity", "date").limit(max_records)


def docs_feedback(days: DataFrame) -> DataFrame:
    e = F.col("pred") - F.col("actual")
    verdict = F.when(F.abs(e) <= F.col("actual") * 0.1, "accurate").when(e > 0, "too high").otherwise("too low")
    text = F.concat(
        F.lit("Entity "), F.col("entity"), F.lit(" "), F.col("date").cast("string"), F.lit(" "), F.date_format("date", "EEEE"), F.lit(": forecast "),
        F.bround("pred", 0).cast("int").cast("string"), F.lit(", actual "), F.bround("actual", 0).cast("int").cast("string"), F.lit(", "), verdict,
    )
    return _doc(days, "feedback", doc_id(F.lit("fb"), F.col("entity"), F.col("date").cast("string")), text,
                restaurant=F.col("entity"), weekday=F.date_format("date", "EEEE"))


def docs_pattern(weekday_stats: DataFrame) -> DataFrame:
    """A baseline document per entity and weekday."""
    n = lambda c: F.bround(c, 0).cast("int").cast("string")
    text = F.concat(F.lit("Entity "), F.col("entity"), F.lit(" on "), F.col("weekday"), F.lit(": mean "), n("avg"), F.lit(", from "), n("min"), F.lit(" to "), n("max"))
    return _doc(weekday_stats, "pattern", doc_id(F.lit("wd"), F.col("entity"), F.col("weekday")), text, restaurant=F.col("entity"), weekday=F.col("weekday"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents replace old ones of the same id; one document per id."""
    one = new.groupBy("id").agg(F.max_by(F.struct("text", "metadata"), "text").alias("d")).select("id", "d.*")
    return old.join(one.select("id"), "id", "left_anti").unionByName(one)


def learn(ledger: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Feedback of the last days on the raw AI value."""
    t = F.date_sub(F.lit(today).cast("date"), days)
    r = ledger.where("ai_raw is not null and actual >= 0 and coalesce(ai_available, false)").where(F.col("date") >= t)
    first = F.min_by("ai_raw", F.struct(F.coalesce("shift", F.lit("")), F.coalesce("hour", F.lit(-1)), "run_date"))
    d = r.groupBy("entity", "date").agg(first.alias("pred"), F.sum("actual").alias("actual"))
    return docs_feedback(d)


def retrieve(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top ``k`` documents per query among those with the query's metadata value.

    docs: id, label, embedding; queries: query, label, vector. The join is on the label, whose
    side to send Spark chooses by size; a partial top-k runs before the shuffle of the scores, so
    a hot label sends k rows per task."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    q = queries.withColumn("qn", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    e = F.col("embedding")
    scored = docs.join(q, "label").withColumn("score", dot(e, F.col("vector")) / F.nullif(F.sqrt(dot(e, F.transform(e, lambda x: x.cast("double")))) * F.col("qn"), F.lit(0.0)))
    rn = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rn).where(F.col("rank") <= k).select("query", "id", "rank", "score")


# -- inverted-file index --------------------------------------------------------------------


def cell_centres(docs: DataFrame, cells: int, sample: int = 100_000, seed: int = 5) -> np.ndarray:
    """Unit vectors of ``cells`` cells at most: k-means on the ``sample`` documents with the least
    hashes of their id. The sample bounds the fit only; every document is put into a cell."""
    some = docs.select("id", "embedding").where(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    e = F.col("embedding")
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    some = some.select(array_to_vector(F.transform(e, lambda x: x / F.nullif(length, F.lit(0.0)))).alias("features")).where(length > 0)
    kinds = some.distinct().limit(cells).count()
    if kinds < 2:
        return np.array([v["features"].toArray() for v in some.limit(1).collect()])
    centres = np.array(KMeans(k=kinds, seed=seed, maxIter=10).fit(some).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def with_cells(df: DataFrame, vector: str, centres: np.ndarray, nearest: int = 1) -> DataFrame:
    """Adds ``cells``: numbers of the nearest cells by cosine, nearest first, in Arrow batches. Rows
    whose vector is null or of another length go to cell 0."""
    n, place = min(nearest, max(1, len(centres))), df.columns.index(vector)
    out = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(place)
            near = np.zeros((b.num_rows, n), np.int32)
            fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), centres.shape[1] if len(centres) else -1), False)
            good = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            if len(good):
                rows = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), -1)
                near[good] = np.argsort(-(np.nan_to_num(rows) @ centres.T), axis=1, kind="stable")[:, :n]
            cells = pa.array(near.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, "cells"])

    return df.mapInArrow(work, out)


def build_index(docs: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """Writes id, label, embedding and cell, in folders by cell, so that a probe reads its cells only."""
    spread = F.pmod(F.xxhash64("id"), F.lit(16))  # a crowded cell is written by several tasks
    index = with_cells(docs.select("id", "label", "embedding"), "embedding", centres).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    index.repartition("cell", spread).write.partitionBy("cell").parquet(path)
    return docs.sparkSession.read.parquet(path)


def probe(index: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, cells: int | None = None) -> DataFrame:
    """Top ``k`` documents per query from the ``cells`` cells nearest to it, ranked by their exact
    scores; all cells (None) give the exact result of :func:`retrieve`."""
    if cells is None:
        return retrieve(index, queries, k)
    q = with_cells(queries, "vector", centres, cells)
    q = q.withColumn("cell", F.explode("cells"))
    place = lambda df: df.withColumn("label", F.struct("label", F.col("cell").cast("int").alias("cell"))).drop("cell")
    return retrieve(place(index), place(q.drop("cells")), k)


def mean_vectors(docs: DataFrame) -> DataFrame:
    """Mean embedding per label: as many rows as there are labels."""
    p = docs.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return p.groupBy("label").agg(v.alias("vector")).withColumn("query", F.col("label"))
