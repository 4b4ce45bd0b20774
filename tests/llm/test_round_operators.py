"""Merkle manifest, passage attention and periodic runs."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm import plain
from tidecast.llm import merkle_blocks, passage_attention, period_runs

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["1 as pos", "2 as n", "3 as digest", "'x' as grp", "4 as leaf", "5 as score", "6 as h", "7 as y", "8 as start", "9 as quality"]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOC).selectExpr("*", *CLASH)


ODD = [
    (None, None, None, None, None),
    (None, "one two", "en", None, 3),
    (1, "", "en", "a", 0),
    (2, None, "en", None, None),
    (3, " \t\n ", None, "a", 3),
    (4, "word " * 30_000, "de", "b", 2**63 - 1),
    (5, "the same row twice", "en", "a", 18),
    (5, "the same row twice", "en", "a", 18),
    (5, "another text of that id", "en", "a", 23),
    (-8, "é:ñ,-", "\x00", "é", 5),
]


# -- Merkle manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    return [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def way(levels, i):
    """(left, sibling or None) from node i to the one node of the last level."""
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append((j < i, nodes[j] if j < len(nodes) else None))
        i //= 2
    return out


def plain_manifest(rows):
    code = lambda *v: H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in v])
    by = {}
    for i, text, lang, source, n in rows:
        own = code(i, source, lang, n, text)
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        by.setdefault(lang, []).append((i, own, code(i, source, lang, n + 1, text) if bad else own))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = [[x[1] for x in by[lang]]]
        while len(trees[lang][-1]) > 1:
            trees[lang].append(up(trees[lang][-1]))
    crown = [[trees[x][-1][0] for x in order]]
    while len(crown[-1]) > 1:
        crown.append(up(crown[-1]))
    out = []
    for g, lang in enumerate(order):
        for k, (i, own, claim) in enumerate(by[lang]):
            path = way(trees[lang], k) + way(crown, g)
            folded = claim
            for left, other in path:
                folded = H(folded) if other is None else H(other, folded) if left else H(folded, other)
            root = crown[-1][0]
            out.append((i, own, trees[lang][-1][0], root, H(*[o for _, o in path if o]), folded, folded == root))
    return out


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_manifest_of_odd_rows(spark):
    assert key(merkle_blocks.query(docs_of(spark, ODD)).collect()) == key(plain_manifest(ODD))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_manifest_with_small_blocks(spark, monkeypatch, n):
    """Blocks of four: several rounds in the trees of the groups and in the one above them."""
    monkeypatch.setattr(merkle_blocks.manifest, "__defaults__", (2,))
    rng = random.Random(n)
    rows = [(i * 7 - 20, f"text {i}", rng.choice(["a", "a", "a", "b", None]), "s", i) for i in range(n)]
    rows += [(1000 + k, "t", f"lang{k}", None, k) for k in range(n if n > 8 else 0)]
    assert key(merkle_blocks.query(docs_of(spark, rows)).collect()) == key(plain_manifest(rows))


def test_manifest_of_documents_and_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = merkle_blocks.query(docs).collect()
    assert key(got) == key(plain_manifest(rows))
    assert 0 < sum(not r.verified for r in got) < len(got) / 3
    assert merkle_blocks.query(docs.limit(0)).collect() == []


# -- periodic runs


def plain_runs(w, least=6, times=4):
    """Each period in turn: stretches whose words equal those the period further on."""
    found, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    w = []
    alphabet = rng.choice(["ab", "abc", "abcdefgh", "a"])
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.5:
            w += [rng.choice(alphabet) for _ in range(rng.randint(0, 15))]
        else:
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 12))]
            unit = unit * rng.randint(1, 3) + [rng.choice(alphabet)] if rng.random() < 0.4 else unit
            w += (unit * 9)[: rng.randint(1, 60)]
    return w


def test_runs_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        for w, got in zip(texts, period_runs.runs_of_texts(texts), strict=True):
            assert [tuple(r) for r in got.tolist()] == plain_runs(w), w


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        values = rng.permutation(n)
        tree = period_runs.Wavelet(values)
        lo = rng.integers(0, n, 50)
        hi = rng.integers(lo, n + 1)
        x = rng.integers(0, n + 1, 50)
        want = [min((v for v in values[a:b] if v >= c), default=n) for a, b, c in zip(lo, hi, x, strict=True)]
        assert tree.successor(lo, hi, x).tolist() == want


def plain_row(i, text):
    w = plain.WORD.findall(text or "")
    if i is not None and w and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(),
    )


def test_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 6000]
    odd = [(i, t) for i, t, *_ in ODD if not t or len(t) < 6000] + [(10, "a b " * 40 + "\x0bc d\x85e " * 7), (None, "x " * 9)]
    rows += odd
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).selectExpr("*", *CLASH)
    got = period_runs.query(frame).collect()
    assert key(got) == key([plain_row(*r) for r in rows])
    assert any(r.n_runs for r in got)
    assert period_runs.query(frame.limit(0)).collect() == []


def test_a_very_long_text_of_one_word(spark):
    (r,) = period_runs.query(docs_of(spark, [(3, "w " * 300_000, None, None, None)])).collect()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 300_000, 1)


# -- passage attention


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, border, y = rng.normal(size=(9, 5)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    model = passage_attention.start(5)
    loss = lambda m: -np.mean(y * np.log(p := passage_attention.forward(m, x, border)["p"]) + (1 - y) * np.log(1 - p))
    for name, d in passage_attention.gradients(model, x, border, y).items():
        flat = np.atleast_1d(d).ravel()
        for k in range(0, flat.size, 7):
            sides = []
            for step in (1e-6, -1e-6):
                other = model | {name: model[name].copy()}
                other[name].reshape(-1)[k] += step
                sides.append(loss(other))
            assert abs((sides[0] - sides[1]) / 2e-6 - flat[k]) < 1e-6, name


def test_attention_finds_the_passage_that_decides(spark):
    """One passage in eight makes a text bad; the learned weight is on that passage."""
    rng = random.Random(2)
    plain_words = [f"{a}{b}" for a in "klmnprst" for b in ("an", "en", "or", "is", "tu", "be")]
    rows, labels = [], []
    for i in range(900):
        passages = [" ".join(rng.choice(plain_words) for _ in range(64)) for _ in range(8)]
        if i % 2:
            passages[rng.randrange(8)] = " ".join(rng.choice(["kan##", "len##", "mor##"]) for _ in range(64))
        rows.append((i, "\n".join(passages), "en", "s", 1))
        labels.append((i, 1 - i % 2, 0))
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in passage_attention.query(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 200
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.97
    model = passage_attention.train(docs, labels)
    weights = []
    for i in range(1, 60, 2):
        x, border = passage_attention.describe([rows[i][1].encode()])
        f = passage_attention.forward(model, passage_attention.standardised(model, x), border)
        weights.append(f["alpha"][["##" in p for p in rows[i][1].split("\n")].index(True)])
    assert np.mean(weights) > 2 / 8


def test_quality_on_held_out_rows_and_odd_ones(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in passage_attention.query(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    truth = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in truth]) > 0.9
    odd = passage_attention.query(docs_of(spark, ODD), labels.selectExpr("*", "1 as text", "2 as score"))
    rows = odd.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    nothing = passage_attention.query(docs_of(spark, ODD), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert passage_attention.query(docs.limit(0), labels).collect() == []


def test_description_does_not_depend_on_the_pieces(monkeypatch):
    text = ("Some Words, and  more;\tof them\n" * 50 + "x" * 700 + " é ñ 12 ## ").encode()
    want, border = passage_attention.describe([b"", text, b"a b"])
    assert border.tolist() == [0, 1, 1 + (len(text.split()) + 32) // 64, 2 + (len(text.split()) + 32) // 64]
    monkeypatch.setattr(passage_attention, "TOGETHER", 64)
    again, _ = passage_attention.describe([b"", text, b"a b"])
    assert np.allclose(want, again)
