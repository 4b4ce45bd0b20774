import itertools
import random

from pyspark.sql import functions as F

from tidecast.llm import flow_mix as M

DOC = "doc_id long, source string, text string"


def _docs(spark, seed=2, n=900):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z", None, "tiny"]
    rows = []
    for i in range(n):
        s = "tiny" if i < 4 else rng.choice(names[:5] + ["a"] * 6)
        rows.append((i, s, "w " * int(rng.lognormvariate(4, 1.2))))
    return spark.createDataFrame(rows, DOC)


def test_targets_and_taken_words(spark):
    docs = _docs(spark)
    rows = M.query(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    # plain sharing: hand out what is left until no source is over three times its size
    goal, free, left = {}, set(sizes), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3 * sizes[s]
            left -= goal[s]
            free.remove(s)
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in sizes}
    assert goal["tiny"] == 3 * sizes["tiny"] == taken["tiny"]
    for r in rows:
        assert abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(3, 0.002 * goal[s]), (s, taken[s], goal[s])
    again = {r.doc_id: r.taken for r in M.query(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert {r.doc_id: r.taken for r in M.query(docs, seed=8).collect()} != again


def test_flow_of_overlapping_sources_is_cheapest():
    rng = random.Random(3)
    for _ in range(20):
        patterns = {("a",): rng.randint(0, 4), ("b",): rng.randint(0, 4), ("a", "b"): rng.randint(0, 4)}
        quota = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}
        got = M._flow(patterns, quota)

        def cost(words, size):
            return sum(max(0, min(size, words - k * size)) * c for k, c in enumerate(M.REPEAT_COSTS))

        best = None
        for a, b, x in itertools.product(*(range(3 * patterns[p] + 1) for p in (("a",), ("b",), ("a", "b")))):
            need = max(0, a - quota["a"]) + max(0, b - quota["b"])
            if need or x > quota["a"] - a + quota["b"] - b:
                continue
            total = cost(a, patterns["a",]) + cost(b, patterns["b",]) + cost(x, patterns["a", "b"])
            best = max(best or (-1, 0), (a + b + x, -total))
        assert (sum(got.values()), -sum(cost(got[p], n) for p, n in patterns.items())) == best


def test_flow_of_many_patterns():
    """Fed as far as the sources ask, and repeated no more than the words that are short of it."""
    import time

    rng = random.Random(5)
    patterns = {}
    while len(patterns) < 20_000:
        p = tuple(sorted({f"s{int(400 * rng.random() ** 2)}" for _ in range(rng.choice([1, 1, 2, 3]))}))
        patterns[p] = rng.randint(1, 1000)
    sizes = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = {s: rng.randint(0, n) for s, n in sizes.items()}
    begun = time.time()
    got = M._flow(patterns, quota)
    assert time.time() - begun < 30
    assert all(0 <= got[p] <= 3 * n for p, n in patterns.items())
    # no way is left from a pattern with unused words, through flows that may move, to a source that asks
    net = M._Network(patterns, quota)
    net.supply = [x + n for x, n in zip(net.supply, net.sizes, strict=True)]
    while found := net.levels():
        net.push(*found)
    once = sum(net.sizes) - sum(net.supply)
    assert sum(min(got[p], n) for p, n in patterns.items()) == once


def test_overlap_in_documents(spark):
    docs = spark.createDataFrame([(i, "x" if i % 3 else "y", "w " * 10) for i in range(60)], DOC)
    both = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array("source"))
    marked = M.mark(docs, both, 1)
    cuts, sources, goal = M.plan(marked)
    taken = M.apply(marked, cuts).select(F.sum(F.col("__copies") * F.col("__size"))).first()[0]
    assert abs(taken - sum(goal.values())) <= 20
    assert {r.source for r in sources.collect()} == {"x", "y"}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "a", ""), (3, "a", "one two three"), (3, "a", "one two three"), (None, "b", "w " * 50_000), (None, "b", None)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as size", "2 as __copies_", "3 as taken", "4 as target")
    got = M.query(docs).collect()
    assert len(got) == 6 and all((r.size > 0) or r.taken == 0 for r in got)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("text is null or text = ''").count() == 3
    assert M.query(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0
