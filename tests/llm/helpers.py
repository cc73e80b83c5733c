"""Plain restatements of the contracts, and rows that every operator must bear."""

import re

ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "x"),
    (1, "the quick brown fox jumps over the lazy dog", "x"),
    (2, None, None),
    (3, "", "y"),
    (4, "  \t\n ", "y"),
    (None, "no id here", "z"),
    (5, "😀 Größe ÉTÉ a@b.co 1.2.3.4 +1 (743) 555-3824", "z"),
    (6, "word " * 30_000, "long"),
    (7, "x" * 200_000, "long"),
]


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names may clash."""
    names = "doc_id long, text string, source string, hits string, quality_score string, t1 string, node string, component string, edits string, row string"
    return spark.createDataFrame([(i, t, s, *["clash"] * 7) for i, t, s in ODD], names)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def components(rows, n, percent=80):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out
