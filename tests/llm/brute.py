"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows ``(doc_id, text, lang, source)``; what is missing is filled in."""
    full = [(*r, *(None, "en", "s0")[len(r) - 1:])[:4] for r in rows]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DDL)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in often for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def fingerprint(text, shingle=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """Node -> smallest node reachable, by comparing all pairs."""
    nodes = sorted(nodes)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def lines_left(rows, min_sites, min_words):
    """The texts after cross-site line removal, rows ``(doc_id, text, source)`` with distinct ids."""
    strip = " \t\n\x0b\f\r"
    sites = defaultdict(set)
    keeper = {}
    for doc, text, source in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            k = line.strip(strip)
            if len(words(k)) >= min_words:
                sites[k].add(source)
                keeper.setdefault(k, (doc, i))
    out = {}
    for doc, text, _ in rows:
        stay = [x for i, x in enumerate((text or "").split("\n"))
                if len(sites.get(x.strip(strip), ())) < min_sites or keeper[x.strip(strip)] == (doc, i)]
        out[doc] = None if text is None else "\n".join(stay)
    return out
