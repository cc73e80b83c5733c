"""Words, tokens, packing, edit-aware counts, fingerprints and personal data, against plain restatements."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm import bytetext, codec, packing, pii, simhash, token_tree
from tests.llm.helpers import ODD, base_spans, odd, words


def test_words_and_shingles():
    texts = ["Hello  World\tfoo", "", "x", "a b c d e a b c d e", " lead trail ", "Ünï Code", "next"]
    w = bytetext.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = w.hash[w.doc[i] : w.doc[i + 1]]
        assert len(own) == len(words(t))
        for word, h in zip(words(t), own, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    values, bounds = bytetext.shingles(w, 4)
    assert [len(set(values[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [1, 0, 1, 5, 1, 1, 1]


def test_codec_is_the_tokenizer():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(codec.default_path())
    encoder = codec.load(codec.default_path())
    every = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}!\t{chr(c)} x" for c in range(1, 0x3000)]
    for text in [t or "" for _, t, _ in ODD if len(t or "") < 1000] + ["<|endoftext|> hi", "a <|endoftext|> b<|endoftext|><|endoftext|>c <|endo", "  a\n\n b\r\n", "it's's", "a" * 3000, *every]:
        assert codec.ids(encoder, text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rows = packing.pack(odd(spark)).collect()
    encoder = codec.load(codec.default_path())
    by_doc = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["length"] <= 1024 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text, _ in ODD:
        whole = [*codec.ids(encoder, text or "").tolist(), 0]
        pieces = sorted(by_doc[i], key=lambda r: (r["sequence_id"]))
        copies = 2 if i == 1 else 1
        assert sum(r["length"] for r in pieces) == copies * len(whole)
        assert [x for r in pieces for x in r["ids"]] == whole * copies
    assert packing.pack(odd(spark).where("false")).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(odd(spark), capacity=1000)


def test_token_tree_is_the_whole_count():
    encoder, rng = codec.load(codec.default_path()), random.Random(3)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'s", "'re", "1", "23", "é", "😀", ".", "!!", "\t", " x", "'"]
    text_of = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    total = again = 0
    for k in range(600):
        text = text_of(rng.choice([0, 1, 5, 40, 800]) if k < 60 else rng.randint(0, 30))
        tree = token_tree.TokenTree(encoder, text)
        for _ in range(rng.randint(1, 6)):
            a, new = rng.randint(0, len(text) + 2), text_of(rng.choice([0, 1, 4, 200 if k < 20 else 3]))
            b, done = a + rng.choice([0, 0, 1, 3, 50]), tree.encoded
            tree.edit(a, b, new)
            at = min(a, len(text))
            text = text[:at] + new + text[min(max(b, at), len(text)) :]
            pieces = token_tree.PRETOKEN.findall(text)
            assert tree.text == text and tree.tokens == len(encoder.encode_ordinary(text))
            assert [n for block in tree.blocks for n in block[0]] == [len(p) for p in pieces]
            total, again = total + len(pieces), again + tree.encoded - done
    assert again < total / 4


def test_kept_trees(spark):
    """A second batch of edits goes on from the table of trees and encodes only what it touches."""
    encoder = codec.load(codec.default_path())
    docs = [(i, f"{i} words it's " * (i * 40)) for i in range(6)] + [(9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", token_tree.sample_edits(F.coalesce("text", F.lit(""))))
    first = token_tree.edit_trees(token_tree.trees(df), df.select("doc_id", "edits"))
    second = token_tree.edit_trees(first, first.select("doc_id", F.expr("array(struct(3L as start, 5L as stop, ' new' as text))").alias("edits")))
    for r in second.collect():
        assert sum(r["tokens"]) == len(encoder.encode_ordinary(r["text"])) and sum(r["lengths"]) == len(r["text"])
        assert r["reencoded"] < 12 and r["text"][3:7] == " new"
    assert token_tree.edit_trees(first, first.select("doc_id", F.lit(None).cast(token_tree.EDITS).alias("edits"))).where("reencoded > 0").count() == 0


def test_token_counts(spark):
    edits = spark.createDataFrame([(1, 1, 0, 3, "a"), (1, 0, 4, 9, "slow"), (6, 0, 100, 105, None)], "doc_id long, seq int, start int, stop int, text string")
    plain = odd(spark).select("doc_id", "text")
    got = {(r["doc_id"], r["n_tokens"]): r for r in token_tree.count_tokens(token_tree.with_edits(plain, edits)).collect()}
    encoder = codec.load(codec.default_path())
    count = lambda t: len(encoder.encode_ordinary(t))
    one = next(t for i, t, _ in ODD if i == 1)
    assert got[1, count(one)]["edited_tokens"] == count("a slow brown fox jumps over the lazy dog")
    assert got[6, count(ODD[7][1])]["edited_chars"] == 149_995
    assert got[2, 0]["edited_tokens"] == got[3, 0]["reencoded"] == 0
    assert token_tree.count_tokens(plain.where("false").withColumn("edits", F.lit(None).cast(token_tree.EDITS))).count() == 0


def brute_fingerprint(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower().strip(" \t\n\x0b\x0c\r")) if w]
    votes = [0] * 64
    for i, a in enumerate(own):
        h = xxhash.xxh64_intdigest(a.encode(), seed=42)
        if i + 1 < len(own):
            h = xxhash.xxh64_intdigest(own[i + 1].encode(), seed=h)
        weight = simhash.HEAVY if len(a) > simhash.SHORT else 1
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return f"{sum((v > 0) << b for b, v in enumerate(votes)):016x}"


def test_fingerprints(spark, tmp_path):
    rows = [(i, t) for i, t, _ in ODD] + [(8, "the quick brown fox jumps over the lazy dog"), (9, "one two three four five six seven eight nine ten eleven twelve")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op5_simhash(spark, str(tmp_path)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0] if r[0] is not None else 1 << 60)
    want = []
    for k, (i, t) in enumerate(order):
        half, following = len(t) // 2, order[(k + 1) % len(order)][1]
        edited = t[: len(t) - half] + following[:half]
        a, b, c = (brute_fingerprint(x) for x in (t, edited, following))
        like = lambda x, y: 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 64
        within = sum((int(a, 16) ^ int(brute_fingerprint(x), 16)).bit_count() <= simhash.RADIUS for _, x in order)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c), within))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_neighbour_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    monkeypatch.setattr(simhash, "BUCKETS_SIDE", 3)
    ids = random.Random(1).sample(range(-500, 10_000), 200)
    df = spark.createDataFrame([(i, f"t{i}") for i in [*ids, None]], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in simhash.with_next(df, ["text"]).collect()}
    order = [*sorted(ids, reverse=True), None]
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_radius_search(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(3)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    df = spark.createDataFrame([(x,) for x in [*signed, *signed[:3], None]], "fp long")
    got = {tuple(r) for r in simhash.within_radius(df, 3).collect()}
    mask = (1 << 64) - 1
    rows = [*signed, *signed[:3]]
    assert {tuple(r) for r in simhash.neighbours(df, 3).collect()} == {(a, sum(((a ^ b) & mask).bit_count() <= 3 for b in rows)) for a in signed}
    assert got == {(a, b, ((a ^ b) & mask).bit_count()) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}


def test_base_spans(spark):
    rng = random.Random(1)
    parts = [*"aB1.@-_+ %()9\n", "é", "😀", "4111 1111 1111 1111", "192.168.0.1", "a@b.co", "+1 (743) 555-3824", "256", "00"]
    texts = ["a@b-c.d_x@y.z", "1.2.3.4.5.6.7.8", "😀 x@y.zz 1.2.3.4", "999.1.1.1 0255.1.1.01", None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += ["a" * 50_000 + "@b.c", "1." * 5_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [f"{pii.KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in r["spans"] if s["kind"] < 4] for r in pii.spans(df).collect()}
    for i, text in enumerate(texts[:-4]):
        assert got[i] == base_spans(text), text
    assert [len(got[i]) for i in range(len(texts) - 4, len(texts))] == [1, 1_250, 1, 0]


def test_disclosing_terms(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(40))
    rows = [(i, f"{filler()} call Zorblax at z@x.org or {filler()}") for i in range(6)] + [(100 + i, filler() + " call me or at home") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(r["text"][s["start"] : s["stop"]], s["remove"]) for s in r["spans"] if s["kind"] == 4] for r in pii.spans(df).join(df, "doc_id").collect()}
    assert all(found[i] == [("Zorblax", True)] for i in range(6))
    assert not any(found[100 + i] for i in range(300))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[100] == dict(rows)[100] and "call  at [EMAIL] or" in clean[0]


def brute_disclosures(rows):
    """(doc_id, start, stop) of the terms that the estimate finds, from sets of documents."""
    texts = [(i, t or "") for i, t in rows]
    entities, terms, places = {}, {}, {}
    for n, (_, text) in enumerate(texts):
        spans = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in base_spans(text))]
        spans += [("secret", m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}", text) if len(re.findall("[0-9]+", m[0])) >= 4 and re.search("[A-Za-z]", m[0])]
        for k, a, z in spans:
            entities.setdefault((k, text[a:z].lower()), set()).add(n)
        for m in re.finditer(r"[^\W\d_]+", text):
            if len(m[0]) >= 3:
                terms.setdefault(m[0].lower(), set()).add(n)
                if not any(a < m.end() and m.start() < z for _, a, z in spans):
                    places.setdefault((n, m[0].lower()), []).append((m.start(), m.end()))
    out = set()
    for c in entities.values():
        ic = math.log2(len(texts) / len(c))
        for t, held in terms.items():
            both = [n for n in c & held if (n, t) in places]
            if len(both) >= 2 and ic >= 4:
                pmi = ic + math.log2(len(both) / len(held))
                if pmi >= 0.9 * ic - 1e-9 and pmi >= 4:
                    out |= {(texts[n][0], a, z) for n in both for a, z in places[n, t]}
    return out


def test_disclosing_terms_by_brute_force(spark, small):
    """All occurrences in the document count, far from the value too, and so do words of texts that are there twice."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdeiklmnorst") for _ in range(rng.randint(2, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(5, 80))) for i in range(300)]
    for k in range(12):
        value = rng.choice([f"user{k}@x.org", f"10.0.{k}.7", f"+1 (743) 555-38{k:02d}", f"a1b2c3d4e5f6a7b8c9d0e{k}"])
        for i in rng.sample(range(300), rng.randint(1, 4)):
            rows[i] = (i, f"Name{chr(97 + k)}s {rows[i][1]} {value} {text(10)} name{chr(97 + k)}s, Éa@b.c")
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], s["start"], s["stop"]) for r in pii.spans(df).collect() for s in r["spans"] if s["kind"] == pii.TERM}
    assert got == brute_disclosures(rows) and len(got) > 30
    far = spark.createDataFrame([(i, f"Zorblax {'word ' * 700} z@x.org {'word ' * 3000} and zorblax") for i in range(3)] + [(10 + i, "word and more") for i in range(200)], "doc_id long, text string")
    assert all("orblax" not in r["text"] for r in pii.redact(far).collect())
    found = {(r["doc_id"], s["start"], s["stop"]) for r in pii.spans(spark.read.parquet(f"{small}/documents.parquet")).collect() for s in r["spans"] if s["kind"] == pii.TERM}
    assert found == brute_disclosures([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_odd_rows(spark):
    df = odd(spark)
    for out in (pii.spans(df), pii.redact(df), simhash.fingerprint_documents(df)):
        assert out.count() == len(ODD)
    assert pii.redact(df).columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert texts[2] is None and texts[5] == "😀 Größe ÉTÉ [EMAIL] [IP] [PHONE]"
    assert pii.spans(df.where("false")).count() == simhash.fingerprint_documents(df.where("false")).count() == simhash.with_next(df.where("false").select("doc_id", "text"), ["text"]).count() == 0
