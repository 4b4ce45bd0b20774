"""Secret scans with a trigram inverted index.

Each rule is a regular expression. From its syntax tree comes a Boolean query of trigrams that
every match must contain. A task indexes each block of texts: the postings of the rules' trigrams
(lower-cased ASCII bytes) as one row set per trigram. A rule's query intersects and unites these
sets, and only the texts that remain are searched with the expression. A rule without a mandatory
trigram searches all texts. Blocks are built, used and dropped within a task, so nothing is
shuffled and memory is bounded by a block.

Spans count code points, the end excluded. Matches of a rule are leftmost and do not overlap, and a
match whose value is too short is dropped with the text it has used up. Rules do not look at each
other: the base rules find the same with or without the others.

A null text is an empty one and has no spans. Null ids and repeated rows pass through. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as syntax
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import whole


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules, then the shapes of well-known keys.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("privatekey", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
BLOCK_ROWS, MOST_STRINGS = 500, 64
SPANS = "array<struct<kind:string,start:long,end:long>>"


def trigram_query(pattern: str):
    """True (no condition), a trigram, or ("and" | "or", parts)."""

    def every(parts):
        parts = list(dict.fromkeys(p for p in parts if p is not True))
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))

    def some(parts):
        parts = list(dict.fromkeys(parts))
        return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))

    def of(strings):
        return some([every(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])

    def walk(nodes):
        """(strings the nodes match if these are all they match, else None; query)"""
        exact, parts, whole_known = {""}, [], True

        def add(strings):
            nonlocal exact, whole_known
            more = {a + b for a in exact for b in strings}
            if len(more) > MOST_STRINGS:
                parts.append(of(exact))
                whole_known, more = False, strings
            exact = more

        def cut(query=True):
            nonlocal exact, whole_known
            parts.extend((of(exact), query))
            exact, whole_known = {""}, False

        for op, arg in nodes:
            if op is sre.LITERAL and arg < 128:
                add({chr(arg).lower()})
            elif op is sre.IN and all(o is sre.LITERAL and x < 128 for o, x in arg) and len(arg) <= 8:
                add({chr(x).lower() for _, x in arg})
            elif op is sre.SUBPATTERN:
                strings, query = walk(arg[-1])
                add(strings) if strings is not None else cut(query)
            elif op is sre.BRANCH:
                found = [walk(x) for x in arg[1]]
                if all(s is not None for s, _ in found):
                    add(set().union(*(s for s, _ in found)))
                else:
                    cut(some([q if s is None else of(s) for s, q in found]))
            elif op is sre.MAX_REPEAT:
                low, high, inner = arg
                strings, query = walk(inner)
                if strings is not None and (low, high) == (0, 1):
                    add(strings | {""})
                elif strings is not None and low == high <= 8:
                    for _ in range(low):
                        add(strings)
                else:
                    cut(True if low == 0 else of(strings) if strings is not None else query)
            else:
                cut()
        if whole_known:
            return exact, of(exact)
        return None, every([*parts, of(exact)])

    return walk(syntax.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Index:
    """The trigrams of all rules and their queries."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.number = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.trigrams):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = k + 1

    def postings(self, texts: pa.Array) -> np.ndarray:
        """Row set of each trigram, as one row of Booleans."""
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        out = np.zeros((len(self.trigrams), len(texts)), bool)
        if len(b) < 3:
            return out
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.int32)
        found = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        where = np.flatnonzero(found)
        row = np.searchsorted(at - at[0], where, "right") - 1
        inside = where + 2 < (at - at[0])[row + 1]
        out[found[where[inside]].astype(int) - 1, row[inside]] = True
        return out

    def rows(self, query, postings: np.ndarray) -> np.ndarray:
        """The rows that may match."""
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.trigrams.index(query)]
        parts = [self.rows(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def search(self, texts: pa.Array) -> list[list[dict]]:
        """Spans of each text, by start and then by the order of the rules."""
        postings, out = self.postings(texts), [[] for _ in range(len(texts))]
        for k, (rule, regex, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.rows(query, postings)):
                for m in regex.finditer(texts[int(i)].as_py()):
                    if len(m[rule.group]) >= rule.least:
                        out[i].append((m.start(), k, m.end(), rule.kind))
        return [[{"kind": kind, "start": s, "end": e} for s, _, e, kind in sorted(x)] for x in out]


def find(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of every document."""
    plain = [tuple(r) for r in rules]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([Rule(*r) for r in plain])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(k, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([part[0], pa.array(index.search(part[1]), kind)], names=[doc_id, "spans"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, whole(text).alias("text")).mapInArrow(work, f"`{doc_id}` {id_type}, spans {SPANS}")


def _joined(spans):
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def query(docs: DataFrame) -> DataFrame:
    """op9: counts and spans of the secrets in each document."""
    found = find(docs.select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(_joined(of(*base)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _joined("spans").alias("spans"))
