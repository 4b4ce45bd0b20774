import random

from tests.llm import plain
from tidecast.llm import bottom_k, components


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def _edited(rng, w, rate):
    return [rng.choice("xyz") * 4 + str(rng.random())[2:6] if rng.random() < rate else x for x in w]


def _corpus():
    """Exact copies, small and large groups of near copies, one passage that most documents share."""
    rng = random.Random(1)
    passage, base = _words(rng, 50), _words(rng, 120)
    docs = [" ".join(_words(rng, rng.randint(20, 200))) for _ in range(60)]
    docs += [" ".join(_words(rng, rng.randint(10, 90)) + passage + _words(rng, 9)) for _ in range(90)]
    docs += [" ".join(passage + _words(rng, rng.randint(0, 14))) for _ in range(50)]
    docs += [" ".join(_edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04, 0.08]))) for _ in range(150)]
    docs += docs[:20] * 2 + [d.upper() for d in docs[:5]]
    for d in docs[20:40]:
        w = d.split()
        docs += [" ".join(_edited(rng, w, 0.02)) for _ in range(rng.randint(1, 4))]
    docs += ["", None, " \n ", "one", "One two three four", "one two three four", "one two three four five"]
    rng.shuffle(docs)
    return dict(enumerate(docs))


def test_same_as_comparing_all_pairs(spark):
    texts = _corpus()
    got = {r.doc_id: r for r in bottom_k.query(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = plain.components(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(plain.shingles(t)) for i, t in texts.items()}
    assert {i for i, r in got.items() if r.kept} == {i for i, c in want.items() if i == c}
    assert max(sum(c == x for c in want.values()) for x in set(want.values())) > bottom_k.SHORT


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (None, "alone here it is now", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 2), (6, "", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").selectExpr("*", "1 as id", "2 as n", "3 as s")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in bottom_k.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (6, 6, True)]
    kept = bottom_k.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "alone here it is now"), (5, "a b c d e f"), (6, "")]


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bottom_k.query(none).count() == 0
    long = " ".join(str(k) for k in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x " * 60_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in bottom_k.query(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def _all_pairs_of_rows(rows):
    """Component of each row, rows of one id being one document."""
    comp = plain.components(dict(enumerate(t for _, t in rows)))
    parent = {k: k for k in comp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for k, (i, t) in enumerate(rows):
        if plain.shingles(t):
            for j in (comp[k], first.setdefault(i, k)):
                a, b = find(k), find(j)
                parent[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(rows))]


def test_two_texts_of_one_id_link_both_their_copies(spark):
    rng = random.Random(4)
    one, two = _words(rng, 60), _words(rng, 60)
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, " ".join(one[:-1])), (7, " ".join(two[1:])), (8, " ".join(_words(rng, 60)))]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = bottom_k.query(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (6, 5), (7, 5), (8, 8)}


def test_repeated_ids_as_comparing_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i if rng.random() < 0.8 else rng.randrange(300), t) for i, t in _corpus().items() if t and len(t.split()) > 5]
    got = bottom_k.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(zip([i for i, _ in rows], _all_pairs_of_rows(rows), strict=True))


def test_long_lists_of_unlinked_members(spark, monkeypatch):
    """Texts made of passages that hundreds of them share, a few of them copies of each other."""
    rng = random.Random(7)
    passages = [_words(rng, 25) for _ in range(24)]
    docs = [sum(rng.sample(passages, 5), []) for _ in range(500)]
    docs += [_edited(rng, rng.choice(docs), 0.01) for _ in range(40)]
    texts = dict(enumerate(" ".join(d) for d in docs))
    monkeypatch.setattr(bottom_k, "TOGETHER", 20)
    got = {r.doc_id: r.component_id for r in bottom_k.query(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = plain.components(texts)
    assert got == want
    assert len(set(want.values())) < len(want) - 20
