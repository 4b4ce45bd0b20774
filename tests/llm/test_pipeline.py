"""The pipeline and the registered queries against plain versions on the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import TABLES, norm
from tests.llm import plain
from tidecast.llm import align_leaks, flow_mix, queries

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(rows)
    good = plain.quality([(rows[i].source, rows[i].text) for i in ids])
    ids = [i for i, k in zip(ids, good, strict=True) if k]
    assert 100 < len(ids) < len(rows)
    comp = plain.components({i: rows[i].text for i in ids})
    ids = [i for i in ids if comp[i] == i]
    items = [align_leaks.item_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {
        i for i in ids for w in items
        if plain.local_alignment(w, align_leaks.item_words(rows[i].text)) >= align_leaks.LEAST_SCORE * 2 * len(w)
    }
    ids = [i for i in ids if i not in leaked]
    left = spark.createDataFrame([(i, rows[i].source, rows[i].text) for i in ids], "doc_id long, source string, text string")
    times = {r.doc_id: r.taken // r.size if r.size else 1 for r in flow_mix.query(left).collect()}
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i in ids:
        one = np.array([*tok.encode(rows[i].text, add_special_tokens=False).ids, 0], dtype="<u4")
        for _ in range(times[i]):
            want.append((i, start, len(one), zlib.crc32(one.tobytes())))
            start += len(one)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_columns_and_take_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_registered():
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0]))[0].startswith("op1_")
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted(repr(tuple(norm(r[c]) for c in order)) for r in df.collect())
    b = sorted(repr(tuple(norm(r[names.index(c)]) for c in order)) for r in cur.fetchall())
    assert a == b
