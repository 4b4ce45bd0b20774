"""Merkle manifest of a data set by exchange of subtrees.

Leaves are numbered within their group and cut into superblocks of ``2 ** BITS`` consecutive ones.

1. Up: each superblock is reduced to its top node; the top nodes of a group are leaves of the next
   round, until each group has one node, its subroot. The subroots form one last tree, the root.
2. Down: from the top round to the first one, the nodes of a superblock are cogrouped with the outer
   nodes it needs, which are the siblings of its top node on the way to the root (a row per level).
   The same function finishes the local reduction, joins inner and outer siblings into the proof of
   each node, and, among the leaves, folds the leaf to be checked through them. What it gives for the
   nodes of one round are the outer nodes of the superblocks of the round below.

A group of any size is spread over as many superblocks; a task holds one of them and some tens of
outer nodes. Rounds grow with the logarithm of the largest group. Numbers come from a range
partitioned, written table, so no group is ordered in one task.

``H`` is the lowercase hex sha256 of the concatenated inputs, digests as hex text. Every two
consecutive nodes become their H; a last one without a neighbour becomes its own H. A lone leaf is
the subroot itself. Groups are ordered null first, then by UTF-8 bytes.

Rows of a group that share an id are ordered by leaf digest; null ids come first, and are never
tampered with. Equal rows are leaves of their own, with proofs of their own. Nulls in any column are
leaves like others. The proof of a lone row is the H of nothing. An empty table gives no rows and has
no root. Columns that are not hashed are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.words import CRC_TABLE, crc32_sql
from tidecast.session import materialise

BITS = 9
HASHED = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "grp long, pos long, n long, digest string"
OUTER = "grp long, block long, step int, upper boolean, left boolean, digest string"
PROVED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """H of the values: ``-`` for a null, else UTF-8 byte count, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, from 0 within the group by ``order``, and ``n``, the group's rows.

    Rows are dealt out by ranges and written in order; only the counts of each group in each
    partition are added up.
    """
    keys = [*group, *order]
    placed = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(*group, part.alias("__part")).agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    over = W.partitionBy(*(group or [F.lit(0)]))  # a row per partition of the table that holds the group
    before = F.sum("__c").over(over.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__c")
    counts = counts.select(
        *[F.col(c).alias(f"__g_{c}") for c in group],
        F.col("__part"),
        (before - F.col("__first")).alias("__shift"),
        F.sum("__c").over(over).alias("n"),
    )
    same = part == F.col("__part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    out = placed.join(counts, same)
    return out.select(*nodes.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n")


def reduce_block(digests: list[str], levels: int) -> list[list[str]]:
    """The block's nodes, level by level."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def levels_of(n: int, bits: int) -> int:
    """Levels that a superblock spans when its group has n nodes: all, or up to the group's one node."""
    return min(bits, (int(n) - 1).bit_length())


def climb(nodes: DataFrame, bits: int) -> DataFrame:
    """Top node of each superblock, as nodes of the next round."""

    def top(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        grp, block, n = (int(k) for k in key)
        digests = df.sort_values("pos")["digest"].tolist()
        last = reduce_block(digests, levels_of(n, bits))[-1]
        return pd.DataFrame({"grp": [grp], "pos": [block], "n": [-(-n >> bits)], "digest": last})

    blocks = nodes.select("grp", "pos", "n", "digest", F.shiftright("pos", bits).alias("block"))
    return blocks.groupBy("grp", "block", "n").applyInPandas(top, NODE)


def inner_path(tree: list[list[str]], i: int) -> Iterator[tuple[bool, str | None]]:
    """Siblings of node i inside its block: whether they stand left, and their digest (None: no sibling)."""
    for level in tree[:-1]:
        other = i ^ 1
        yield other < i, level[other] if other < len(level) else None
        i >>= 1


def fold(digest: str, path: list[tuple[bool, str | None]]) -> str:
    for left, other in path:
        digest = H(digest) if other is None else H(other, digest) if left else H(digest, other)
    return digest


def _local(nodes: pd.DataFrame, outer: pd.DataFrame, bits: int):
    """The block's rows by position, its tree and the path of its top node."""
    nodes, outer = nodes.sort_values("pos"), outer.sort_values("step")
    tree = reduce_block(nodes["digest"].tolist(), levels_of(nodes["n"].iloc[0], bits))
    siblings = [None if d is None or d != d else d for d in outer["digest"].tolist()]
    return nodes, tree, list(zip(map(bool, outer["upper"]), map(bool, outer["left"]), siblings, strict=True))


def exchange(nodes: DataFrame, outer: DataFrame, bits: int, upper: bool) -> DataFrame:
    """Path of each node to the root: the outer nodes of the block below it.

    ``upper``: nodes of the tree over subroots, whose position is the group below.
    """

    def paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, tree, above = _local(nodes, outer, bits)
        rows = []
        for i, (grp, pos) in enumerate(zip(nodes["grp"].tolist(), nodes["pos"].tolist(), strict=True)):
            path = [(upper, *x) for x in inner_path(tree, i)] + above
            place = (pos, 0) if upper and nodes["lowest"].iloc[0] else (grp, pos)
            rows += [(*place, k, *x) for k, x in enumerate(path)]
        cols = ["grp", "block", "step", "upper", "left", "digest"]
        return pd.DataFrame(rows, columns=cols).astype({"digest": object})

    return _cogroup(nodes, outer, bits).applyInPandas(paths, OUTER)


def _cogroup(nodes: DataFrame, outer: DataFrame, bits: int):
    blocks = nodes.withColumn("block", F.shiftright("pos", bits))
    return blocks.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block"))


def prove(leaves: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """Proofs of the leaves, and the roots that the leaves to be checked (``claim``) fold to."""

    def proofs(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves, tree, above = _local(leaves, outer, bits)
        subroot = fold(tree[-1][0], [(left, d) for up, left, d in above if not up])
        root = fold(subroot, [(left, d) for up, left, d in above if up])
        outside = [(left, d) for _, left, d in above]
        end, rows = "".join(d for _, d in outside if d), []
        for i, (key, own, claim) in enumerate(zip(leaves["id"], leaves["digest"], leaves["claim"], strict=True)):
            inside = list(inner_path(tree, i))
            folded = fold(claim, inside + outside)
            rows.append((key, own, subroot, root, H(*[d for _, d in inside if d], end), folded, folded == root))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PROVED.split(", ")])

    return _cogroup(leaves, outer, bits).applyInPandas(proofs, PROVED)


def _rounds(nodes: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """The nodes of each round, the last one with one node for each group."""
    out = [nodes]
    while most > 1:
        out.append(materialise(climb(out[-1], bits), "tops"))
        most = -(-most >> bits)
    return out


def manifest(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """Proof and check of every leaf.

    ``leaves``: grp_key (the group), id (string), ``order`` (long), digest, claim (the digest to be folded).
    """
    spark = leaves.sparkSession
    placed = numbered(leaves, ["grp_key"], ["order", "digest"])
    keys = placed.groupBy("grp_key").agg(F.max("n").alias("size"))
    keys = materialise(numbered(materialise(keys, "groups"), [], ["grp_key"]).withColumnRenamed("pos", "grp"), "groups")
    most, groups = keys.agg(F.max("size"), F.max("n")).first()
    if most is None:
        return spark.createDataFrame([], PROVED)
    own = keys.select(F.col("grp_key").alias("__key"), "grp")
    placed = placed.join(own, F.col("grp_key").eqNullSafe(F.col("__key"))).select("grp", "pos", "n", "id", "digest", "claim")
    placed = materialise(placed, "leaves")

    lower = _rounds(placed.select("grp", "pos", "n", "digest"), most, bits)
    subroots = lower[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(groups).cast("long").alias("n"), "digest")
    outer = spark.createDataFrame([], OUTER)
    # From the root down. Where a round has one node for each group there is nothing to exchange.
    upper = _rounds(subroots, groups, bits)[:-1]
    for k in reversed(range(len(upper))):
        outer = materialise(exchange(upper[k].withColumn("lowest", F.lit(k == 0)), outer, bits, True), "outer")
    for nodes in reversed(lower[1:-1]):
        outer = materialise(exchange(nodes, outer, bits, False), "outer")
    return prove(placed, outer, bits)


def _leaf_sql(n_chars: str) -> str:
    text = [f"({n_chars})::VARCHAR" if c == "n_chars" else f"{c}::VARCHAR" for c in HASHED]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({t})::VARCHAR || ':' || {t}, '-')" for t in text) + "))"


def query(docs: DataFrame) -> DataFrame:
    """op11: leaf, roots, proof digest and tamper check of each document."""
    col = {c: F.col(c) for c in HASHED}
    tampered = F.coalesce(F.crc32(col["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False)) & col["n_chars"].isNotNull()
    other = col | {"n_chars": col["n_chars"].cast("decimal(20,0)") + 1}
    leaves = docs.select(
        col["lang"].alias("grp_key"),
        col["doc_id"].cast("string").alias("id"),  # a string, as pandas has no long with nulls
        col["doc_id"].cast("long").alias("order"),
        leaf([col[c] for c in HASHED]).alias("digest"),
        F.when(tampered, leaf([other[c] for c in HASHED])).alias("claim"),
    )
    leaves = materialise(leaves, "digests").withColumn("claim", F.coalesce("claim", "digest"))
    out = manifest(leaves)
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS r, *, coalesce({crc32_sql("doc_id::VARCHAR", "crc.t")} % 7 = 0, false) AS bad FROM documents, crc),
hashed AS (
  SELECT r, doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN bad THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS claim FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM hashed),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM tree WHERE len(nodes) > 1),
ends AS (SELECT lang, nodes[1] AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM tree WHERE len(nodes) = 1),
crown AS (
  SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM ends
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM crown WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root, level AS depth FROM crown WHERE len(nodes) = 1),
steps AS (
  SELECT p.r, t.level, (p.pos >> t.level) & 1 AS odd, t.nodes[xor(p.pos >> t.level, 1) + 1] AS other
  FROM placed p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT p.r, e.depth + c.level, (e.g >> c.level) & 1, c.nodes[xor(e.g >> c.level, 1) + 1]
  FROM placed p JOIN ends e ON p.lang IS NOT DISTINCT FROM e.lang JOIN crown c ON len(c.nodes) > 1),
proofs AS (SELECT r, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY r),
folded AS (
  SELECT r, 0 AS level, claim AS digest FROM placed
  UNION ALL
  SELECT f.r, f.level + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(s.other, '') || f.digest ELSE f.digest || coalesce(s.other, '') END)
  FROM folded f JOIN steps s ON f.r = s.r AND f.level = s.level)
SELECT p.doc_id, p.leaf, e.subroot, x.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = x.root AS verified
FROM placed p JOIN ends e ON p.lang IS NOT DISTINCT FROM e.lang CROSS JOIN root x
JOIN folded f ON f.r = p.r AND f.level = e.depth + x.depth LEFT JOIN proofs q ON q.r = p.r
"""
