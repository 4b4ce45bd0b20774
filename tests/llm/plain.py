"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(texts: dict) -> dict:
    """Least reachable id of each id, every pair being compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


def quality(rows) -> list[bool]:
    """rows of (source, text) to kept."""
    rules = {
        "short": lambda m: m["n_words"] < 10,
        "repeats": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": lambda m: 100 * m["n_symbols"] > 10 * m["n_words"],
        "dup_lines": lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "mean_word": lambda m: not 2 * m["n_words"] <= m["word_chars"] <= 14 * m["n_words"],
    }
    found = [(s, {r: f(measures(t)) for r, f in rules.items()}) for s, t in rows]
    n, fails = Counter(s for s, _ in found), defaultdict(Counter)
    for s, f in found:
        fails[s].update(r for r in rules if f[r])
    rate = defaultdict(dict)
    for r in rules:
        total = sum(n.values())
        mean = sum(fails[s][r] for s in n) / total
        spread = max(sum(fails[s][r] ** 2 / n[s] for s in n) / total - mean * mean, 1e-9)
        weight = min(max(mean * (1 - mean) / spread - 1, 1), 1e6)
        for s in n:
            rate[s][r] = (fails[s][r] + mean * weight) / (n[s] + weight)
    return [
        not (f["short"] or f["repeats"] or max(rate[s].values()) > 0.6 or any(f[r] and rate[s][r] > 0.02 for r in rules))
        for s, f in found
    ]


def local_alignment(a: list, b: list) -> int:
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best
