import random

from tests.llm import plain
from tidecast.llm import align_leaks as A

ITEM = "item_id long, text string"
DOC = "doc_id long, text string"


def _vocabulary(rng, n=300):
    return ["the", "of", "and"] * 20 + ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_scores_equal_plain_alignment(spark):
    rng = random.Random(4)
    words = _vocabulary(rng)
    items = {k: [rng.choice(words) for _ in range(rng.randint(12, 50))] for k in range(12)}
    docs, planted = {}, set()
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        if d % 2:
            k = d % 12
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.1, 0.25]) else w for w in items[k]]
            at = rng.randint(0, len(text))
            text[at:at] = copy
            planted.add((d, k))
        docs[d] = text
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], DOC)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], ITEM)
    got = {(r.doc_id, r.item_id): r for r in A.query(df, bench).collect()}
    exact = {(d, k): plain.local_alignment(w, t) / (2 * len(w)) for d, t in docs.items() for k, w in items.items()}
    assert {k for k, s in exact.items() if s >= A.LEAST_SCORE} == set(got)
    assert all(abs(got[k].score - exact[k]) < 1e-9 for k in got)
    assert planted <= set(got)
    assert all(docs[d][r.start] in items[k] and docs[d][r.end] in items[k] for (d, k), r in got.items())


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [(k, f"item number{k} has its very own words{k} and a tail{k} of more{k} words") for k in range(9)]
    docs = spark.createDataFrame([(k, f"x{k} y z " + t + " q r") for k, t in rows], DOC)
    bench = spark.createDataFrame(rows, ITEM)
    one = sorted(map(tuple, A.query(docs, bench).collect()))
    monkeypatch.setattr(A, "BLOCK_WORDS", 40)
    assert A.blocks(bench) > 1
    assert sorted(map(tuple, A.query(docs, bench).collect())) == one


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "one two"), (4, "alpha beta gamma delta epsilon zeta")], ITEM)
    rows = [(None, "say alpha beta gamma delta epsilon zeta now"), (7, "ALPHA, beta; gamma delta epsilon zeta!"), (8, None), (9, ""), (10, "one two"), (11, "clean words only " * 30_000), (7, "ALPHA, beta; gamma delta epsilon zeta!")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as item_id", "2 as text_hash", "'x' as words")
    got = {(r.doc_id, r.item_id) for r in A.query(docs, bench).collect()}
    assert got == {(None, 1), (None, 4), (7, 1), (7, 4), (10, None)}
    kept = A.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [8, 9, 11]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d")], DOC), spark.createDataFrame([(1, "a b c d")], ITEM)
    assert A.query(docs, bench.limit(0)).count() == 0
    assert A.query(docs.limit(0), bench).count() == 0
    assert A.decontaminate(docs, bench.limit(0)).count() == 1


def test_an_item_deep_in_a_text_of_item_words(spark):
    """Runs all over a long text are one passage, which is aligned in windows."""
    rng = random.Random(9)
    items = {k: [f"w{rng.randint(0, 40)}" for _ in range(20)] for k in range(4)}
    runs = [w for t in items.values() for i in range(0, 18, 3) for w in t[i : i + 3]]
    text = [w for _ in range(60) for w in rng.sample(runs, 12) + items[rng.randint(0, 3)][3:6]]
    at = [250, 500, 777]
    for k, p in enumerate(at):
        text[p:p] = items[k]
    got = {r.item_id: r for r in A.query(spark.createDataFrame([(1, " ".join(text))], DOC), spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], ITEM)).collect()}
    for k, w in items.items():
        exact = plain.local_alignment(w, text) / (2 * len(w))
        assert (k in got) == (exact >= A.LEAST_SCORE) and (k not in got or abs(got[k].score - exact) < 1e-9)
    assert all(got[k].score == 1.0 for k in range(3))


def test_partial_copies_in_many_documents(spark):
    """Runs that only repeated partial copies hold are as good as any, however many documents hold them."""
    cut, worded = [f"w{i}" for i in range(37)], [f"v{i}" for i in range(37)]
    edited = [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(worded)]
    rows = [(d, f"text {d} before " + " ".join(cut[:16]) + " after") for d in range(30)] + [(100 + d, f"text {d} " + " ".join(edited)) for d in range(25)]
    docs, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, " ".join(cut)), (2, " ".join(worded))], ITEM)
    got = {r.doc_id: r for r in A.query(docs, bench).collect()}
    assert set(got) == {d for d, _ in rows}
    assert all(got[d].item_id == 1 and got[d].score == 16 / 37 and (got[d].start, got[d].end) == (3, 18) for d in range(30))
    assert all(got[100 + d].item_id == 2 and abs(got[100 + d].score - plain.local_alignment(worded, edited) / 74) < 1e-9 for d in range(25))
    assert A.decontaminate(docs, bench).count() == 0


def test_a_shared_run_is_no_short_item(spark):
    """Short items count as a whole only, longer ones from five matching words on."""
    items = {1: "what is the capital of old france", 2: "a b c d e f g h i j", 3: "k l m n o p q r s"}
    texts = {1: "he said what is the capital and left", 2: "so what is the capital of old france then", 3: "x a b c d y", 4: "x a b c d e y", 5: "k l m n x o p q r s", 6: "k l m x n y"}
    docs, bench = spark.createDataFrame(list(texts.items()), DOC), spark.createDataFrame(list(items.items()), ITEM)
    assert {(r.doc_id, r.item_id) for r in A.query(docs, bench).collect()} == {(2, 1), (4, 2), (5, 3)}
    assert sorted(r.doc_id for r in A.decontaminate(docs, bench).collect()) == [1, 3, 6]
