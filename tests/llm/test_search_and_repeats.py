"""Lexical search, hard negatives and repeated passages, against plain restatements."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import hard_negatives, induced, lexical, suffix_dedup
from tests.llm.helpers import odd


# Lexical search.


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10, multiplicity=False):
    held = [(d, terms(t)) for d, t in docs]
    n_all, l_all = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        own = terms(text)
        scores = []
        for d, t in held:
            if d is None or not t:
                continue
            m, total = 100 - 90 + (90 * len(t) * n_all) // l_all, 0
            for term in set(own):
                df, tf = sum(term in x for _, x in held), t.count(term)
                w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
                total += (own.count(term) if multiplicity else 1) * w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if total > 0:
                scores.append((-total, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("multiplicity", [False, True])
def test_search(spark, multiplicity, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_TERMS", 8)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "γάμμα", "x1", "d-e", "é"]) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "!?"), (62, "alpha " * 3000)]
    items = [(1, "alpha alpha beta"), (2, "nothing known"), (3, None), (4, "É é γάμμα x1"), (5, "d e x1")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), multiplicity=multiplicity)
    assert sorted(map(tuple, found.collect())) == ranked(docs, items, multiplicity=multiplicity)


def test_search_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick fox word", "c"), (1, "lazy", "c"), (None, "dog", "c")], "item_id long, text string, term string")
    found = lexical.search(odd(spark), items).collect()
    assert [(r["item_id"], r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (1, 1), (1, 6)]
    assert lexical.search(odd(spark).limit(0), items).count() == 0
    assert lexical.search(odd(spark), items.limit(0)).count() == 0


# Hard negatives.


def mined(rows):
    """rows: (vec_id, label, whole components)."""
    out = []
    for a, la, va in rows:
        if a % 50:
            continue
        score = {b: sum(x * y for x, y in zip(va, vb)) for b, _, vb in rows}
        best = sorted((-score[b], b) for b, lb, _ in rows if lb == la and b != a)[:5]
        for s, p in best:
            window = sorted((-score[b], b) for b, lb, _ in rows if lb != la and 50 * -s <= 100 * score[b] <= 95 * -s)[:3]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "hot", "large"])
def test_negatives(spark, kind, monkeypatch):
    for name, value in {"BLOCK": 64, "LEAF": 8, "QUERIES": 4, "HELD": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (900, 6)) + rng.normal(0, 1, (10, 6))[rng.integers(0, 10, 900)]
    if kind == "hot":
        v[rng.random(900) < 0.4] = v[0]
    v = np.floor(v * 40).astype(int)
    if kind == "large":
        v = v * 100_000
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in r]) for i, r in enumerate(v)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label long, v array<int>"))
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_negatives_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (50, None, 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5], 2), (3, [float("nan"), 1.0], 2), (4, [None, 1.0], 2), (5, [1.0], 2), (6, [0.6, 0.1], None), (None, [1.0, 1.0], 2), (7, [], 3), (8, [float("inf"), 0.0], 2)]
    made = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, label int, cell string, v string")
    used = hard_negatives.quantised(made)
    assert sorted(r["vec_id"] for r in used.collect()) == [0, 1, 2, 5, 7]
    # 0 and 1: 256 * 256 + 128 * 64; 2 has 49152 of it and 5, filled up with 0, 65536.
    assert sorted(map(tuple, hard_negatives.mine(used).collect())) == [(0, 1, 1, 5, 73728, 65536), (0, 1, 2, 2, 73728, 49152)]
    assert hard_negatives.mine(used.limit(0)).count() == 0


# Repeated passages.


@pytest.mark.parametrize("limit", [1 << 26, 64])
def test_suffix_order(limit, monkeypatch):
    rng = random.Random(7)
    for turn in range(150):
        monkeypatch.setattr(induced, "LONG", 3 if turn % 2 else 512)
        monkeypatch.setattr(induced, "SHORT", (0, 9, 1 << 19)[turn % 3])
        text = bytes(rng.randrange(1 + turn % 4) for _ in range(rng.randint(1, 90)))
        if turn % 3 == 0:
            text = text[: rng.randint(1, 9)] * 12
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0] + [next((k for k in range(9) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 9) for a, b in zip(order[:-1], order[1:])]
        got = induced.suffix_order(np.frombuffer(text, np.uint8), 9, limit)
        assert (got[0].tolist(), got[1].tolist()) == (order, common)


def kept(rows, width):
    """rows in order: what stays of each, bytes gone and spans gone."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def removed(df):
    return [(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in df.collect()]


@pytest.mark.parametrize("case", ["plain", "spilled", "crowded", "pieces"])
def test_repeats(spark, case, monkeypatch):
    for name, value in {"plain": {}, "spilled": {"HELD": 50, "SORTED": 2000}, "crowded": {"CROWD": 1}, "pieces": {"PIECE": 64, "BLOCK": 500, "SHARD": 300}}[case].items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)] + ["ab" * 150, "z" * 400]
    rows = [(i, " ".join(rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.4 else " ".join(word() for _ in range(10)) for _ in range(rng.randint(0, 8)))) for i in range(70)]
    rows += [(70, rows[3][1]), (71, None), (72, rows[5][1] + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(removed(suffix_dedup.without_repeats(df))) == sorted(kept(rows, 100))


def test_repeats_in_documents(spark, small):
    table = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pydict()
    want = kept(list(zip(table["doc_id"], table["text"], strict=True)), 100)
    got = suffix_dedup.op13_suffix_dedup(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted((d, n, r, s, hashlib.sha256(b).hexdigest()) for d, n, r, s, b in want)


def test_repeats_odd_rows(spark):
    got = removed(suffix_dedup.without_repeats(odd(spark)))
    # Rows of one doc_id and one text: none is long enough. The long texts repeat themselves.
    assert sorted((d or 99, n, g) for d, n, g, _, _ in got) == [(1, 43, 0), (1, 43, 0), (2, 0, 0), (3, 0, 0), (4, 5, 0), (5, 51, 0), (6, 150_000, 149_995), (7, 200_000, 199_999), (99, 10, 0)]
    twice = spark.createDataFrame([(1, "q" * 50 + "r" * 80), (1, "q" * 50 + "r" * 80), (None, "q" * 50 + "r" * 80), (None, None)], "doc_id long, text string")
    assert sorted((d or 99, g) for d, _, g, _, _ in removed(suffix_dedup.without_repeats(twice))) == [(1, 0), (1, 130), (99, 0), (99, 130)]
    assert suffix_dedup.without_repeats(twice.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(odd(spark).select("text", "doc_id", F.lit(1).alias("key"), F.lit(2).alias("tie"))).count() == 9
