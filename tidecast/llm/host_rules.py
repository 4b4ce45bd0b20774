"""Quality rules judged per host: failures by domain, shrunk with an empirical beta prior.

Every document is measured by native functions only. Rule failures are summed per host
(partial sums before the shuffle, so a host with a third of all rows is no hot task), each
rule's failure rate over the hosts gives a beta prior by the method of moments, and the
shrunk rates decide what a host's documents have to stand:

* a host whose shrunk rate of any rule is above ``reject_rate`` is rejected with all its documents;
* a rule whose shrunk rate is above ``enforce_rate`` is enforced on the host's documents:
  the ones that fail it go;
* below that, a failure is taken as chance and forgiven. Failures of the base rules
  (too few words, too much repetition) are never forgiven.

Null text is an empty text, and so fails ``short``. A null host is a host of its own. Repeated
rows are judged one by one and stay. Empty tables give empty results. Result columns replace
input columns of the same names; other columns pass through.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import whole, window_hashes, words
from tidecast.session import materialise

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Limits of the rules: words at least, percent of repeated words, symbols per 100 words,
#: percent of lines that repeat, characters of the mean word.
LIMITS = {"short": 10, "repeats": 20, "symbols": 10, "dup_lines": 30, "mean_word": (2, 14)}
#: Verdicts of this many hosts, some bytes each, are sent to all tasks; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
RULES = ["short", "repeats", "symbols", "dup_lines", "mean_word"]
BASE = ["short", "repeats"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures and ``n_lines`` (lines that hold a word).

    ``n_repeat_words`` counts the words inside 5-word windows that occur twice or more,
    windows being compared by a 64-bit hash.
    """
    df = docs.withColumn("__text", whole(text))
    df = df.withColumn("__words", words(F.col("__text")))
    df = df.withColumn("__h", window_hashes("__words", 5))
    df = df.withColumn("__some", F.size("__h") > F.size(F.array_distinct("__h")))
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("__placed", F.when(F.col("__some"), placed))
    k = F.greatest(F.size("__placed") - 1, F.lit(0))
    twins = F.zip_with(
        F.slice("__placed", F.lit(1), k),
        F.slice("__placed", F.lit(2), k),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate(
        starts,
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    df = df.withColumn("__lines", lines)
    return df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("__some"), covered).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("__text", "__words", "__h", "__some", "__placed", "__lines")


def failures(limits: dict = LIMITS) -> dict[str, Column]:
    """One Boolean per rule, in whole-number arithmetic."""
    c = F.col
    low, high = limits["mean_word"]
    return {
        "short": c("n_words") < limits["short"],
        "repeats": 100 * c("n_repeat_words") > limits["repeats"] * c("n_words"),
        "symbols": 100 * c("n_symbols") > limits["symbols"] * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > limits["dup_lines"] * c("n_lines"),
        "mean_word": (c("word_chars") < low * c("n_words")) | (c("word_chars") > high * c("n_words")),
    }


def host_rates(measured: DataFrame, host: str = "source", limits: dict = LIMITS) -> DataFrame:
    """Per host and rule: documents ``n``, failures ``f``, prior ``a`` and ``b``, ``shrunk`` rate."""
    flags = failures(limits)
    sums = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(flags[r].cast("long")).alias(r) for r in RULES]
    )
    long = sums.select(
        "host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("f")) for r in RULES])).alias("x")
    ).select("host", "n", "x.rule", "x.f")
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    moments = long.groupBy("rule").agg(F.sum(n).alias("N"), F.sum(f).alias("S"), F.sum(f * f / n).alias("Q"))
    mean = F.col("S") / F.col("N")
    spread = F.greatest(F.col("Q") / F.col("N") - mean * mean, F.lit(1e-9))
    weight = F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(1e6))
    prior = moments.select("rule", (mean * weight).alias("a"), ((1 - mean) * weight).alias("b"))
    # One row per rule: the broadcast is bounded by the list of rules.
    return long.join(F.broadcast(prior), "rule").withColumn(
        "shrunk", (F.col("f") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))
    )


def verdicts(rates: DataFrame, reject_rate: float = 0.6, enforce_rate: float = 0.02) -> DataFrame:
    """One row per host: ``host_rejected`` and one ``enforce_<rule>`` each."""
    top = lambda r: F.max(F.when(F.col("rule") == r, F.col("shrunk")))
    return rates.groupBy("host").agg(
        (F.max("shrunk") > reject_rate).alias("host_rejected"),
        *[(top(r) > enforce_rate).alias(f"enforce_{r}") for r in RULES],
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    keep_text: bool = True,
    reject_rate: float = 0.6,
    enforce_rate: float = 0.02,
    limits: dict = LIMITS,
) -> DataFrame:
    """The documents with their measures, ``base_failed``, ``host_rejected`` and ``kept``."""
    out = [*MEASURES, "base_failed", "host_rejected", "kept"]
    measured = measure(docs, text)
    if not keep_text:
        measured = measured.drop(text)
    measured = materialise(measured, "measured")  # read twice: for the hosts and for the documents
    hosts = verdicts(host_rates(measured, host, limits), reject_rate, enforce_rate)
    hosts = materialise(hosts.select(*[F.col(c).alias(f"__v_{c}") for c in hosts.columns]), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)  # else both sides are dealt out by host
    flags = failures(limits)
    df = measured.join(hosts, F.col(host).eqNullSafe(F.col("__v_host")), "left")
    base = functools.reduce(operator.or_, [flags[r] for r in BASE])
    own = functools.reduce(operator.or_, [flags[r] & F.col(f"__v_enforce_{r}") for r in RULES])
    df = df.withColumns({"base_failed": base, "host_rejected": F.col("__v_host_rejected")})
    df = df.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected") | own))
    rest = [c for c in docs.columns if c not in out and (keep_text or c != text)]
    return df.select(*rest, *out)


def query(docs: DataFrame) -> DataFrame:
    """op10: measures and verdict of each document."""
    out = judge(docs.select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", *MEASURES, "base_failed", "kept")


_RULE_SQL = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "mean_word": "(word_chars < 2 * n_words OR word_chars > 14 * n_words)",
}
ORACLE = (
    r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT row, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT row, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS c FROM win) WHERE c > 1)
  GROUP BY row),
m AS (
  SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (row)),
h AS (
  SELECT source, count(*) AS n, """
    + ", ".join(f"sum(CASE WHEN {q} THEN 1 ELSE 0 END) AS {r}" for r, q in _RULE_SQL.items())
    + """ FROM m GROUP BY source),
l AS ("""
    + " UNION ALL ".join(f"SELECT source, n::double AS n, '{r}' AS rule, {r}::double AS f FROM h" for r in RULES)
    + """),
p AS (SELECT rule, mean * weight AS a, (1 - mean) * weight AS b FROM (
  SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(q - mean * mean, 1e-9) - 1, 1.0), 1e6) AS weight FROM (
    SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS q FROM l GROUP BY rule))),
v AS (
  SELECT source, max((f + a) / (n + a + b)) > 0.6 AS rejected, """
    + ", ".join(f"max(CASE WHEN rule = '{r}' THEN (f + a) / (n + a + b) END) > 0.02 AS e_{r}" for r in RULES)
    + """ FROM l JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, """
    + " OR ".join(f"({_RULE_SQL[r]})" for r in BASE)
    + " AS base_failed, NOT ("
    + " OR ".join([f"({_RULE_SQL[r]})" for r in BASE] + ["rejected"] + [f"(({q}) AND e_{r})" for r, q in _RULE_SQL.items()])
    + """) AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""
)
