"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources. Documents are summed by membership pattern (the sorted
set of their sources), which leaves a small flow network: each pattern offers its words once at
cost 0, and again for repetitions at the growing (convex) costs ``REPEAT_COSTS``; each source asks
for its quota and takes it from the patterns that contain it. The flow of least cost repeats as
little as possible and says how many words each pattern gives: largest flows by layers, one for each round
of repetitions, which takes seconds for 100,000 patterns. Patterns of one source go through it like
the others. Only pattern sums (checked against ``MAX_PATTERNS``) reach the driver.

A pattern's flow is whole rounds of its documents plus a rest. The rest is drawn in seeded order:
per size class (powers of two) the documents with the least hashes that fit the class's share,
found by a histogram of hashes, so that no task sees more than one of its bars; what is then
missing is filled from the next documents of each class, largest first.

Sources by code point, null last, weigh 1, 2, 3, repeating; targets share the words of all
documents, and stop at 3 times their source's words, the excess going to the others by weight.
Null or empty texts have size 0 and are never missed: their taken words are 0. Rows that are equal
in id and text are drawn together. Clashing columns of the input are replaced by the results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.words import whole, words
from tidecast.session import materialise

MAX_REPEAT, REPEAT_COSTS, MAX_PATTERNS, NEXT = 3, (0, 1, 3), 100_000, 16
BROADCAST_PATTERNS = 1000


def weights(sources: list[str | None]) -> dict[str | None, int]:
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + k % 3 for k, s in enumerate(order)}


def targets(sizes: dict[str | None, int], total: int, weight: dict) -> dict[str | None, float]:
    """Shares of ``total`` by weight, none above MAX_REPEAT times its size."""
    out, left, open_ = {}, float(total), set(sizes)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > MAX_REPEAT * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: float(MAX_REPEAT * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


class _Network:
    """Patterns, their sources, and the words that go from one to the other."""

    def __init__(self, patterns: dict[tuple, int], quota: dict):
        self.names, self.sizes = list(patterns), list(patterns.values())
        number = {s: j for j, s in enumerate(quota)}
        self.left = list(quota.values())
        self.supply = [0] * len(self.names)
        self.head = [number[s] for p in self.names for s in p]
        self.tail = [i for i, p in enumerate(self.names) for _ in p]
        self.flow = [0] * len(self.head)
        self.out: list[list[int]] = [[] for _ in self.names]
        self.into: list[list[int]] = [[] for _ in self.left]
        for e, (i, j) in enumerate(zip(self.tail, self.head, strict=True)):
            self.out[i].append(e)
            self.into[j].append(e)

    def levels(self) -> tuple[list[int], list[int]] | None:
        """Distance of patterns and sources from the patterns with words to give; None where no
        source that still asks can be reached."""
        far_p, far_s = [-1] * len(self.names), [-1] * len(self.left)
        front, found, d = [i for i, x in enumerate(self.supply) if x], False, 0
        for i in front:
            far_p[i] = 0
        while front and not found:
            d, reached = d + 1, []
            for i in front:
                for e in self.out[i]:
                    j = self.head[e]
                    if far_s[j] < 0:
                        far_s[j] = d
                        reached.append(j)
                        found = found or self.left[j] > 0
            front = []
            for j in reached:
                for e in self.into[j]:
                    i = self.tail[e]
                    if self.flow[e] and far_p[i] < 0:
                        far_p[i] = d
                        front.append(i)
        return (far_p, far_s) if found else None

    def push(self, far_p: list[int], far_s: list[int]) -> None:
        """Sends words along shortest ways until none of them is left open."""
        at_p, at_s = [0] * len(self.names), [0] * len(self.left)
        for first in range(len(self.names)):
            path: list[int] = []  # arcs, forwards and backwards in turn
            i = first
            while self.supply[first]:
                # on to a source, or back where the pattern has no way left
                if at_p[i] < len(self.out[i]):
                    e = self.out[i][at_p[i]]
                    j = self.head[e]
                    if far_s[j] != far_p[i] + 1:
                        at_p[i] += 1
                        continue
                    path.append(e)
                    if self.left[j]:
                        n = min([self.supply[first], self.left[j], *[self.flow[x] for x in path[1::2]]])
                        for k, x in enumerate(path):
                            self.flow[x] += n if k % 2 == 0 else -n
                        self.supply[first] -= n
                        self.left[j] -= n
                        path, i = [], first
                        continue
                    while at_s[j] < len(self.into[j]):
                        x = self.into[j][at_s[j]]
                        if self.flow[x] and far_p[self.tail[x]] == far_s[j]:
                            break
                        at_s[j] += 1
                    else:
                        path.pop()
                        at_p[i] += 1
                        continue
                    path.append(x)
                    i = self.tail[x]
                elif path:
                    at_s[self.head[path.pop()]] += 1
                    i = self.tail[path.pop()]
                else:
                    break


def _flow(patterns: dict[tuple, int], quota: dict) -> dict[tuple, int]:
    """Words each pattern gives, at the least cost of repetitions.

    Only the rounds of a pattern cost anything, and no way from the start comes back to it. So the
    cheapest flow is one largest flow for each round, cheapest round first, on what the last one left.
    """
    net = _Network(patterns, quota)
    for _ in sorted(REPEAT_COSTS):
        net.supply = [x + n for x, n in zip(net.supply, net.sizes, strict=True)]
        while found := net.levels():
            net.push(*found)
    given = [0] * len(net.names)
    for e, i in enumerate(net.tail):
        given[i] += net.flow[e]
    return dict(zip(net.names, given, strict=True))


def route(patterns: dict[tuple, int], goal: dict) -> dict[tuple, int]:
    """Words to take from each pattern so that the sources come to their (rounded) targets."""
    return _flow(patterns, {s: round(t) for s, t in goal.items()})


def mark(docs: DataFrame, sources: Column, seed: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds __size, __pattern (JSON of the sorted sources), __h (seeded order) and __class of the size."""
    size = F.size(words(whole(text))).cast("long")
    return docs.withColumns(
        {
            "__size": size,
            "__pattern": F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"}),
            "__h": F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(F.col(text))),
        }
    ).withColumn("__class", F.when(F.col("__size") > 0, F.floor(F.log2(F.col("__size"))).cast("int")).otherwise(0))


def plan(marked: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Per pattern and size class: rounds, cut and filling hashes; per source: size and target; targets."""
    spark = marked.sparkSession
    marked = marked.withColumnRenamed("__size", "size")
    sums = marked.groupBy("__pattern").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = sums.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    patterns = {tuple(json.loads(r[0])): r["s"] for r in rows}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, sum(patterns.values()), weights(list(sizes))) if sizes else {}
    flow = route(patterns, goal)
    key = {tuple(json.loads(r[0])): r[0] for r in rows}
    todo = [(key[p], n, *divmod(flow[p], n)) for p, n in patterns.items() if n]
    quota = spark.createDataFrame(todo, "__pattern string, s long, rounds long, rest long")
    of_source = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], "source string, source_size long, target double")

    small = len(rows) <= BROADCAST_PATTERNS
    hint = F.broadcast if small else (lambda df: df)
    bits = max(8, sum(r["n"] for r in rows).bit_length() // 2 + 2)
    bar = F.shiftright(F.col("__h"), 64 - bits)
    each = marked.where("size > 0").select("__pattern", "__class", "__h", "size").withColumn("bar", bar)
    bars = each.groupBy("__pattern", "__class", "bar").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("__pattern", "__class")
    before = group.orderBy("bar").rowsBetween(W.unboundedPreceding, -1)
    bars = bars.join(hint(quota), "__pattern").withColumns(
        {
            "share": F.floor(F.sum("b").over(group).cast("decimal(38,0)") * F.col("rest") / F.col("s")).cast("long"),
            "words0": F.coalesce(F.sum("b").over(before), F.lit(0)),
            "n0": F.coalesce(F.sum("n").over(before), F.lit(0)),
        }
    )
    # the first bar that goes over the share, and how many documents lie before it
    bars = bars.withColumn("over", F.col("words0") + F.col("b") > F.col("share"))
    bars = bars.withColumn("edge", F.min(F.when(F.col("over"), F.col("n0"))).over(group))
    fringe = bars.where(F.col("over") & (F.col("n0") - F.col("edge") < NEXT)).select("__pattern", "__class", "bar", "share", "edge", "words0")
    start = fringe.groupBy("__pattern", "__class").agg(F.first("share").alias("share"), F.min("words0").alias("words0"))
    fringe = each.join(hint(fringe.select("__pattern", "__class", "bar")), ["__pattern", "__class", "bar"])
    fringe = fringe.groupBy("__pattern", "__class", "__h").agg(F.sum("size").alias("size"))
    order = group.orderBy("__h")
    fringe = fringe.join(start, ["__pattern", "__class"]).withColumn("words", F.col("words0") + F.sum("size").over(order))
    fringe = fringe.withColumn("in", F.col("words") <= F.col("share"))
    fringe = fringe.withColumn("k", F.row_number().over(W.partitionBy("__pattern", "__class", "in").orderBy("__h")))
    fringe = materialise(fringe, "fringe")

    got = bars.groupBy("__pattern", "__class").agg(
        F.sum(F.when(~F.col("over"), F.col("b")).otherwise(0)).alias("whole"),
        F.max(F.when(~F.col("over"), F.col("bar"))).alias("last"),
    )
    part = fringe.where("in").groupBy("__pattern", "__class").agg(F.sum("size").alias("part"), F.max("__h").alias("cut"))
    classes = got.join(part, ["__pattern", "__class"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    # a bar's largest hash is one less than the next bar's least
    edge = F.shiftleft(F.col("last"), 64 - bits) + F.lit((1 << (64 - bits)) - 1)
    classes = classes.withColumn("cut", F.coalesce(F.greatest("cut", edge), F.lit(-(1 << 63))))
    taken = classes.groupBy("__pattern").agg(F.sum(F.col("whole") + F.col("part")).alias("taken"))
    nexts = fringe.where(~F.col("in") & (F.col("k") <= NEXT)).groupBy("__pattern").agg(
        F.sort_array(F.collect_list(F.struct("size", "__h")), asc=False).alias("nexts")
    )
    fill = quota.join(taken, "__pattern").join(nexts, "__pattern", "left")
    begin = F.struct((F.col("rest") - F.col("taken")).alias("d"), F.array().cast("array<bigint>").alias("hs"))
    step = lambda a, x: F.when(
        x["size"] <= a["d"],
        F.struct((a["d"] - x["size"]).alias("d"), F.concat(a["hs"], F.array(x["__h"])).alias("hs")),
    ).otherwise(a)
    none = F.array().cast("array<struct<size:bigint,__h:bigint>>")
    fill = fill.select("__pattern", "rounds", F.aggregate(F.coalesce("nexts", none), begin, step, lambda a: a["hs"]).alias("fill"))
    cuts = classes.select("__pattern", "__class", "cut").join(fill, "__pattern")
    cuts = materialise(cuts, "cuts")
    return (hint(cuts), hint(of_source), goal)


def apply(marked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``__copies``: how often the mix takes the document."""
    df = marked.join(cuts, ["__pattern", "__class"], "left")
    extra = (F.col("__h") <= F.col("cut")) | F.array_contains("fill", F.col("__h"))
    copies = F.when(F.col("__size") > 0, F.coalesce(F.col("rounds") + extra.cast("long"), F.lit(0))).otherwise(F.lit(0))
    return df.withColumn("__copies", copies)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents as the mix takes them: each one as many times as it has copies.

    Documents without words carry no weight and stay once.
    """
    marked = mark(docs, F.array(F.col("source")), seed)
    cuts, _, _ = plan(materialise(marked.select("__pattern", "__class", "__h", "__size"), "sizes"))
    times = F.when(F.col("__size") > 0, F.col("__copies")).otherwise(F.lit(1)).cast("int")
    taken = apply(marked, cuts).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times)))
    return taken.select(*docs.columns)


def query(docs: DataFrame, seed: int = 7) -> DataFrame:
    """op3: size, source size, target and taken words of each document."""
    marked = mark(docs.select("doc_id", "source", "text"), F.array(F.col("source")), seed).drop("text")
    marked = materialise(marked, "sizes")
    cuts, sources, _ = plan(marked)
    df = apply(marked, cuts)
    df = df.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    taken = (F.col("__copies") * F.col("__size")).alias("taken")
    return df.select("doc_id", F.col("__size").alias("size"), "source_size", "target", taken)
