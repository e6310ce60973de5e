"""Brute-force versions: plain Python over whole texts, slow and short."""

import re
from collections import Counter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def lower_ascii(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def benchmark_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))


def contamination(rows, items):
    """{doc_id: (n_words, hit word places, items)}"""
    owners = {}
    for i, t in items:
        w = benchmark_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for i, t in rows:
        w = benchmark_words(t)
        hit, found = set(), set()
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                if o := owners.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= o
        out[i] = (len(w), hit, found)
    return out


def cut(text, hit):
    """The text without each run of hit words, from the first word's start to the last one's end."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))]
    out, at = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += text[at : spans[k][0]]
        if k + 1 not in hit:
            at = spans[k][1]
    return out + text[at:]


def line_dedup(rows, long_line=None):
    """{doc_id: (text, lines removed)} of rows with distinct doc_ids. long_line: windows of one line, or of two, of more words count as well."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (None, 0)
            continue
        lines = t.split("\n")
        n = min(3, len(lines))
        spans = [(k, n) for k in range(len(lines) - n + 1)]
        if long_line is not None:
            size = [len(x.encode().split()) for x in lines]
            long = [k for k in range(len(lines)) if size[k] > long_line] if n > 1 else []
            spans += [(k, 1) for k in long]
            spans += [(k, 2) for k in range(len(lines) - 1) if n > 2 and k not in long and k + 1 not in long and size[k] + size[k + 1] > long_line]
        gone = set()
        for k, m in sorted(spans):
            key = tuple(lines[k : k + m])
            if not any(x.encode().split() for x in key):
                continue
            if key in seen:
                gone |= set(range(k, k + m))
            seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)) if gone else (t, 0)
    return out


def shingles(t):
    w = [x for x in re.split("[ \t-\r]+", lower_ascii(t)) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    """{doc_id: (set size, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}
