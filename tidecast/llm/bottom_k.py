"""Near duplicates by bottom-k sketches of one hash function.

1. A document's set is its distinct 5-word shingles as 64-bit hashes; its sketch is the 64 least
   of them. Documents of equal sets (count and 128-bit fingerprint) are one class, and the least
   doc_id stands for it.
2. Inverted lists of the 16 least values. Lists of up to ``SHORT`` members give all their pairs.
   Two sets at the threshold share none of the 16 least values with probability 0.25 ** 16.
3. Long lists never give all pairs. A pair that shares values of long lists only has at least 4
   of them (all but 4e-6 of pairs just at the threshold), so only documents with 4 such values go
   on. For these, the inverted lists are built anew from the full sets, with the rarest values
   first: a linked pair must share one of the rarest quarter, without exception. Again short lists
   give their pairs.
4. What is left are documents of which three quarters or more are values of long lists, that is
   large groups of near copies. Each such list compares its members with its least edited one and
   links are contracted to components; the members outside that one's component do the same among
   themselves, as long as that links many of them. Then only members outside the first one's component are
   compared with members of other components, and only if the counts of shared values allow a link;
   a list is dealt out over as many tasks as its length asks for.
5. Pairs are filtered by the Jaccard estimate of the union's sketch and confirmed on full sets.
6. Components by alternating stars, on classes.

A document without words has an empty set, links with nothing and is its own component. A null
text is an empty one. Rows that share a doc_id are one document, all of whose texts are linked with
each other; rows without one follow their
class, or stay alone with a null component (and are kept) when no row of the class has one.
Extra columns are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.components import components
from tidecast.llm.words import ascii_lower, whole, window_hashes, words
from tidecast.session import materialise

WIDTH, SKETCH, INDEXED, SHORT, HOT_LEAST, HOT_KEYS = 5, 64, 16, 32, 4, 12
PERCENT, ESTIMATE_PERCENT = 75, 45
#: Up to so many ids, some tens of MB, go to all tasks to pick their texts; more meet them in a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a long list that one task compares with the ones outside its hub's component.
TOGETHER = 64
#: Share of the members outside that a further round of hubs has to link to be followed by another.
WORTH = 0.25


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, s): hash of the text, and the sorted distinct shingle hashes."""
    text = F.col(text)
    df = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), words(ascii_lower(whole(text))).alias("w"))
    df = df.withColumn("h", window_hashes("w", WIDTH))
    n = F.size("w")
    s = F.when(n >= WIDTH, F.sort_array(F.array_distinct("h"))).when(n > 0, F.array(F.xxhash64("w")))
    return df.select("id", "t", F.coalesce(s, F.array().cast("array<bigint>")).alias("s"))


def _size_fits(a: str, b: str):
    """Two sets whose sizes allow the threshold."""
    a, b = F.col(a), F.col(b)
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _list_pairs(lists: DataFrame) -> DataFrame:
    """(v, id, n), short lists, to distinct (a, b)."""
    a = lists.select("v", F.col("id").alias("a"), F.col("n").alias("na"))
    b = lists.select("v", F.col("id").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "v").where((F.col("a") < F.col("b")) & _size_fits("na", "nb")).select("a", "b").distinct()


def _likely(a: str, b: str):
    """Whether the sketch of the union lets the threshold seem possible."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return 100 * shared >= ESTIMATE_PERCENT * F.size(union)


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the arrays sa and sb of the column s of ``sets``."""
    a = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(a, "a").join(b, "b")


def confirm(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as links (u, v)."""
    df = _with_both(pairs, full)
    df = df.where(_likely(F.slice("sa", 1, SKETCH), F.slice("sb", 1, SKETCH)))
    df = df.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("both")
    return df.where(100 * F.col("both") >= PERCENT * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def rarest_first(full: DataFrame) -> DataFrame:
    """(id, s) to (id, n, hot, prefix, keys): the rarest quarter, and the values of long lists.

    ``hot`` counts the set's values in long lists. ``prefix`` holds those of the rarest quarter
    that are in short lists; ``keys`` the ``HOT_KEYS`` least values of long lists, for sets of
    which three quarters are such values.
    """
    each = full.select("id", F.explode("s").alias("v"))
    seen = each.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    sets = each.join(seen, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("o"))
    sets = sets.withColumn("n", F.size("o"))
    quarter = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + 1
    rare = F.filter(F.slice("o", F.lit(1), quarter), lambda x: (x["c"] >= 2) & (x["c"] <= SHORT))
    hot = F.transform(F.filter("o", lambda x: x["c"] > SHORT), lambda x: x["v"])
    sets = sets.select("id", "n", F.transform(rare, lambda x: x["v"]).alias("prefix"), F.sort_array(hot).alias("hots"))
    keys = F.when(100 * F.size("hots") >= PERCENT * F.col("n"), F.slice("hots", 1, HOT_KEYS))
    return sets.select("id", "n", "prefix", F.size("hots").alias("hot"), keys.alias("keys"))


def _may_link(a: str, b: str):
    """Sets that share values of long lists only: whether their counts allow the threshold."""
    most = F.least(F.col(f"hot{a}"), F.col(f"hot{b}"))
    return (100 + PERCENT) * most >= PERCENT * (F.col(f"n{a}") + F.col(f"n{b}"))


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Each long list's members against its least edited one."""
    hub = lists.groupBy("v").agg(F.min(F.struct(F.col("n") - F.col("hot"), "id", "n", "hot")).alias("h"))
    hub = hub.select("v", F.col("h.id").alias("a"), F.col("h.n").alias("na"), F.col("h.hot").alias("hota"))
    b = lists.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hot").alias("hotb"))
    df = b.join(hub, "v").where((F.col("a") != F.col("b")) & _size_fits("na", "nb") & _may_link("a", "b"))
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_main(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds each member's component, that of its list's least edited member, and the list's length."""
    df = lists.join(comps, lists["id"] == comps["node"], "left").drop("node")
    df = df.withColumn("component", F.coalesce("component", "id"))
    hub = df.groupBy("v").agg(F.min(F.struct(F.col("n") - F.col("hot"), "id", "component")).alias("h"), F.count(F.lit(1)).alias("c"))
    return df.join(hub.select("v", F.col("h.component").alias("main"), "c"), "v")


def _hub_links(long: DataFrame, links: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found through hubs, and the components they make.

    The members outside the component of their list's hub get a hub of their own, and so on, as
    long as a round links ``WORTH`` of the members it looks at. The rest is for the pairs outside.
    """
    comps = materialise(components(links), "components")
    lists = long
    while True:
        outside = _with_main(lists, comps).where("component <> main")
        lists = materialise(outside.select(*long.columns), "outside")
        new = materialise(confirm(_hub_pairs(lists), full), "hub-links")
        found, members = new.count(), lists.select("id").distinct().count()
        if found:
            links = links.union(new)
            comps = materialise(components(links), "components")
        if found <= WORTH * members:
            return links, comps


def _outside_pairs(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Members outside the component of a list's hub against the members of other components.

    A pair is given at its first common list; a list is dealt out over as many tasks as it has lots
    of ``TOGETHER`` members.
    """
    df = _with_main(lists, comps).withColumn("lots", F.ceil(F.col("c") / TOGETHER).cast("int"))
    names = ["id", "n", "hot", "keys", "component"]
    a = df.where("component <> main").select("v", "lots", *[F.col(c).alias(f"{c}a") for c in names])
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    b = df.select("v", "lots", *[F.col(c).alias(f"{c}b") for c in names], (F.col("component") != F.col("main")).alias("out"))
    b = b.withColumn("salt", F.pmod(F.xxhash64("idb"), F.col("lots")).cast("int")).drop("lots")
    on = (
        (a["v"] == b["v"])
        & (a["salt"] == b["salt"])
        & (a["componenta"] != b["componentb"])
        & (~b["out"] | (a["ida"] < b["idb"]))
        & _size_fits("na", "nb")
        & _may_link("a", "b")
        & (F.array_min(F.array_intersect("keysa", "keysb")) == a["v"])
    )
    return a.join(b, on).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of rows that share an id: each with the least of them."""
    several = (F.min("f1") != F.max("f1")) | (F.min("f2") != F.max("f2"))
    ids = rows.where("n > 0").groupBy("id").agg(several.alias("several")).where("several").select("id")
    of = rows.select("id", "f1", "f2", "n").join(ids, "id", "left_semi").join(classes, ["f1", "f2", "n"]).select("id", "cid")
    of = materialise(of.distinct(), "repeated")
    return of.join(of.groupBy("id").agg(F.min("cid").alias("u")), "id").where("u <> cid").select("u", F.col("cid").alias("v"))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, n, component) for every row; t is the hash of its text."""
    rows = shingle_sets(docs, doc_id, text).select(
        "id",
        "t",
        F.size("s").alias("n"),
        F.xxhash64("s").alias("f1"),
        F.xxhash64(F.lit(1), "s").alias("f2"),
        F.slice("s", 1, SKETCH).alias("s"),
    )
    rows = materialise(rows, "sketches")
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # From here to the end ``id`` is the number of a class, whose text is one of its document ``doc``.
    one = rows.where("n > 0").select("id", "t", "n", "f1", "f2", "s").dropDuplicates(["id", "f1", "f2"])
    of_class = classes.select(F.col("rep").alias("id"), "f1", "f2", "cid")
    sketches = one.join(of_class, ["id", "f1", "f2"]).select(F.col("cid").alias("id"), F.col("id").alias("doc"), "t", "n", "s")
    sketches = materialise(sketches, "class-sketches")

    lists = sketches.select("id", "n", F.explode(F.slice("s", 1, INDEXED)).alias("v"))
    seen = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = materialise(lists.join(seen, "v"), "lists")
    pairs = _list_pairs(lists.where(F.col("c") <= SHORT))
    pairs = materialise(_with_both(pairs, sketches).where(_likely("sa", "sb")).select("a", "b"), "pairs")
    need = F.least(F.lit(HOT_LEAST), F.ceil(F.least(F.first("n"), F.lit(INDEXED)) * PERCENT / 100))
    crowded = lists.where(F.col("c") > SHORT).groupBy("id").agg(F.count(F.lit(1)).alias("k"), need.alias("need"))
    crowded = materialise(crowded.where("k >= need").select("id"), "crowded")

    wanted = crowded.union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = materialise(wanted.join(sketches.select("id", "doc", "t"), "id"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["doc", "t"]).dropDuplicates(["id"])
    full = materialise(shingle_sets(texts, "id", "text").select("id", "s"), "sets")

    sets = materialise(rarest_first(full.join(crowded, "id", "left_semi")), "rarest")
    more = _list_pairs(sets.select("id", "n", F.explode("prefix").alias("v")))
    long = materialise(sets.where("keys is not null").select("id", "n", "hot", "keys", F.explode("keys").alias("v")), "long")
    links = confirm(pairs.union(more).union(_hub_pairs(long)).distinct(), full).union(_of_one_id(rows, classes))
    links, comps = _hub_links(long, materialise(links, "links"), full)
    rest = materialise(confirm(_outside_pairs(long, comps), full), "rest")

    # the later links join whole components
    of = lambda k: F.coalesce(F.col(f"c{k}.component"), F.col(k))
    rest = rest.join(comps.alias("cu"), F.col("u") == F.col("cu.node"), "left")
    rest = rest.join(comps.alias("cv"), F.col("v") == F.col("cv.node"), "left")
    upper = components(rest.select(of("u").alias("u"), of("v").alias("v")))
    of_class = (
        classes.join(comps, F.col("cid") == F.col("node"), "left")
        .select("f1", "f2", "n", "rep", F.coalesce("component", "cid").alias("c1"))
        .join(upper, F.col("c1") == F.col("node"), "left")
        .select("f1", "f2", "n", "rep", F.coalesce("component", "c1").alias("c2"))
    )
    of_class = materialise(of_class, "class-components")
    least = of_class.groupBy("c2").agg(F.min("rep").alias("component"))
    of_class = of_class.join(least, "c2").drop("c2", "rep")
    out = rows.select("id", "t", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    return out.select("id", "t", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def _kept():
    return F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    return classify(docs, doc_id, text).select(
        F.col("id").alias(doc_id),
        F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
        _kept().alias("kept"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the least id. Of rows that share its id, one stays."""
    out = classify(docs, doc_id, text).where(_kept())
    out = materialise(out.groupBy(F.col("id").alias("__id"), F.col("t").alias("__t")).agg(F.count(F.lit(1)).alias("__n")), "kept")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__t"))
    kept = docs.join(out.select("__id", "__t"), same, "left_semi")
    repeated = out.where("__id is not null").groupBy("__id").agg(F.sum("__n").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).union(kept.where(F.col(doc_id).isNull()))


def query(docs: DataFrame) -> DataFrame:
    """op4: class of near duplicates of each document."""
    return near_duplicates(docs.select("doc_id", "text"))
