"""Pages, quality, licences, near-duplicates, benchmarks, the language model and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import components, decontaminate, html_extract, licenses, minhash, pitman_yor, quality
from ledgerlark.llm.registry import ORACLES, QUERIES
from tests.llm import helpers
from tests.llm.helpers import ODD, odd


def test_pages(spark, small):
    import html

    got = {r["page_id"]: r["text"] for r in html_extract.op1_html(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        assert got[r["page_id"]] == " ".join(html.unescape(text).split())


def test_pages_without_an_article(spark):
    box = "<body><div class='box'>Welcome here</div><div class=text><p>Story {0} is told once {1}</p></div><div class='tail'>Same end</div></body>"
    rows = [(i, f"http://a.b/{i}", box.format(i, i * 7)) for i in range(20)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://c.d", "<p>a<p>b &amp; c&nbsp;d<br>e <!-- x --> <script>no</script><ul><li>1<li>2</ul><div class='comments'>bad</div><form>f</form>")]
    rows += [(103, "http://c.d", "<article><header><h1>T</h1></header><p>x</p><aside>no</aside><div class='comment-list'>no</div></article><p>outside</p>"), (104, "http://c.d", "plain & text < 3 <b>bold</b>x"), (104, "http://c.d", "plain & text < 3 <b>bold</b>x"), (105, "u", "<div " * 20_000 + "a" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, page string, low string")
    got = collections.defaultdict(list)
    for r in html_extract.extract(df).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    assert all(got[i] == [(t := f"Story {i} is told once {i * 7}", len(t))] for i in range(20))
    assert got[100] == got[101] == [("", 0)]
    assert got[102] == [("a b & c d e 1 2", 15)] and got[103] == [("T x", 3)]
    assert got[104] == [("plain & text < 3 boldx", 22)] * 2
    assert html_extract.extract(df.where("false")).count() == 0


def test_pages_by_the_tree(spark):
    """The same page, with an article: only the other pages of its host decide what of it is its own."""
    page = "<body><nav>Menu</nav><article class='tag-social comments-open'><h1>A title</h1><p class='lead'>Read us daily</p><p class='notice'>On fog</p><p>Body text of the story</p><div class='comments'><p>First!</p></div></article></body>"
    other = lambda i, lead, notice: page.replace("A title", f"T{i}").replace("Body text", f"Story {i}").replace("Read us daily", lead).replace("On fog", notice).replace("First!", f"No {i}!")
    rows = [(i, f"http://same.org/{i}", other(i, "Read us daily", f"Fog {i}")) for i in range(1, 12)] + [(0, "http://same.org/0", page)]
    rows += [(100 + i, f"http://own.org/{i}", other(i, f"Lead {i}", "On fog")) for i in range(1, 12)] + [(100, "http://own.org/0", page)]
    rows += [(200 + i, "http://copies.org/x", page) for i in range(40)] + [(300, "http://few.org/x", page)]
    rows += [(400, "http://form.org", "<body class='comments-open'><form><article><h1>T</h1><p>x y</p></article></form><div class=comments><article>no</article></div></body>")]
    rows += [(401, "http://parts.org", f"<div class='article-title'><h1>T</h1></div><div class='story'><p>{'body ' * 40}</p></div>"), (402, "http://parts.org", f"<article>T</article><div><p>{'body ' * 40}</p></div>")]
    got = {r["page_id"]: (r["text"], r["by_tree"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("A title On fog Body text of the story", True)
    assert got[100] == ("A title Read us daily Body text of the story", False)
    assert {got[200 + i] for i in range(40)} | {got[300]} == {("A title Read us daily Body text of the story", False)}
    assert got[400][0] == "T x y" and got[401][0] == got[402][0] == "T " + ("body " * 40).strip()


def test_importance_by_brute_force(spark):
    rng = random.Random(2)
    pages = [[(node, kind, rng.randint(0, 3 if node else 0)) for node in range(4) for kind in (0, 1) if rng.random() < 0.8] for _ in range(30)]
    rows = [(p, "h", node, 0, kind, feature) for p, own in enumerate(pages) for node, kind, feature in own]
    got = {r["node"]: r["importance"] for r in html_extract.importance(spark.createDataFrame(rows, "page long, host string, node long, parent long, kind int, feature long")).collect()}
    for node in range(4):
        m, values = sum((node, 0) == x[:2] for own in pages for x in own), []
        for kind in (0, 1):
            n = collections.Counter(x[2] for own in pages for x in own if x[:2] == (node, kind)).values()
            values.append(1 - sum(k * math.log(k) for k in n) / (sum(n) * math.log(m)))
        assert got[node] == pytest.approx(max(values))


def test_quality_on_the_held_out_fold(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.op4_quality(spark, folder).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_quality_model():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction that single features do not show
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).tolist() == [1.0, 1.0]
    assert (quality.fit(x[:10], np.ones(10)).score(x) > 0.9).all()


def test_quality_of_odd_rows(spark):
    df = odd(spark)
    model = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.score(df, model, out_col="s")
    assert out.columns == [*df.columns, "s"] and {r["s"] for r in out.collect()} == {1.0}
    assert quality.score(df.where("false"), model).count() == 0


def test_licences(spark):
    notices = {1: ("MIT", "Released under the MIT License."), 2: ("GPL", "This work is licensed under the GNU General Public License, version 2."), 3: ("CC", "Licensed under CC BY-NC 4.0."), 4: ("Apache", "Licensed under the Apache License, Version 2.0.")}
    rows = [(i, f"Some words.\n\nof the permission of the day\n \n{t}\n\nMore.") for i, (_, t) in notices.items()] + [(10, "He lost his driving license and walked home."), (11, "The terms of the peace were made public."), *[(i, t) for i, t, _ in ODD]]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "line": F.lit("clash")}))
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got.collect() if r["doc_id"] < 5) == [(i, 2, f) for i, (f, _) in notices.items()]
    assert {r["doc_id"] for r in got.collect()} == set(notices)
    assert licenses.scan(odd(spark).where("false")).count() == 0


def test_licences_in_long_and_wrapped_paragraphs(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice("the of river house with over a stone was very by green people walked for".split()) for _ in range(n))
    bsd = "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that the following\n * conditions are met:"
    rows = [(1, f"{filler(400)} Licensed under CC BY-NC 4.0. {filler(400)}"), (2, f"{filler(30)}\n{bsd}\n{filler(30)}"), (3, filler(2000)), (4, f"{filler(100)} Released under the MIT License. {filler(50)} Licensed under the Apache License, Version 2.0. {filler(20)}")]
    got = sorted((r["doc_id"], r["family"], r["paragraph"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "CC", 0), (2, "BSD", 0), (4, "Apache", 0), (4, "MIT", 0)]


def test_every_confirming_window_is_scored():
    """Of any share of a template's pairs that confirms it, one has a word that is looked for."""
    rng, looked = random.Random(3), re.compile(licenses.telling_pattern().replace("(?i)", ""))
    for _, _, own in licenses.templates():
        for _ in range(30):
            some = rng.sample(sorted(own), math.ceil(licenses.CONFIRM * len(own) - 1e-9))
            assert looked.search(" ".join(some).replace("#", "7")) and set(" ".join(some).split()) & set(licenses.telling_words())


def test_licence_probabilities_are_calibrated():
    names, _, temperature, held = licenses.model()
    found = [(max(p), p.index(max(p)) == label) for z, label in held for p in [licenses._softmax([x / temperature for x in z])]]
    assert abs(np.mean([p for p, _ in found]) - np.mean([ok for _, ok in found])) < 0.15
    sure = [ok for p, ok in found if p >= licenses.CONFIDENT]
    assert len(sure) > 20 and np.mean(sure) > 0.8
    unknown = [p.index(max(p)) == len(names) - 1 or max(p) < licenses.CONFIDENT for z, label in held if label == len(names) - 1 for p in [licenses._softmax([x / temperature for x in z])]]
    assert np.mean(unknown) > 0.9


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*edges, (5, None)], "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if top(x) != x}


def near_rows():
    """Groups of edited copies, some far from the first text, with exact copies among them."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(40):
            text = base[:]
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                text[rng.randrange(90)] = rng.choice(vocabulary)
            rows.append((at, " ".join(text)))
            at += 1
    return rows + [(at + k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 60])))) for k in range(60)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()}
    assert got == helpers.components(rows, size)


def test_near_duplicates_of_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op7_minhash(spark, small).collect()}
    assert got == helpers.components(rows, 4)


def test_near_duplicates_of_odd_rows(spark):
    rows = [*[(i, t) for i, t, _ in ODD], (9, "The quick brown fox jumps over the LAZY dog"), (9, "something else entirely"), (10, "something else entirely")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "bands": F.lit("x")})
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, size=4).collect()), key=repr)
    keep = lambda d: [(k, c) for i, _, c, k in got if i == d]
    assert keep(1) == [(True, 1)] * 2 and keep(9) == [(False, 1)] * 2 and keep(10) == [(False, 1)]  # the two texts of 9 join 1 and 10
    assert keep(2) == [(True, 2)] and keep(3) == [(True, 3)] and keep(4) == [(True, 4)] and keep(0) == [(True, None)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_benchmark_items(spark):
    rng = random.Random(9)
    # Thousands of words, as a corpus has; those of a few hundred would be in nearly all documents and tell nothing.
    vocabulary = [f"{a}{b}{c}{d}{e}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst" for d in "aeiou" for e in "knpt"] + ["the", "of", "and"] * 200
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{sentence(rng.choice([14, 30, 60]))}. {sentence(6)}.") for i in range(30)]
    docs = [(i, sentence(300)) for i in range(200)]
    planted = {}
    for i, (item, text) in enumerate(items):
        words = text.split()
        for k in range(0, len(words), 9):  # a paraphrase: every ninth word is another
            words[k] = words[k] if i % 3 else rng.choice(vocabulary)
        planted[i] = item
        docs[i] = (i, f"{sentence(100)} {text.upper() if i % 3 == 1 else ' '.join(words)} {sentence(100)}")
    benchmark = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], h["item_id"]) for r in decontaminate.matches(df, benchmark).collect() for h in r["hits"]}
    assert got == set(planted.items())
    out = decontaminate.matches(odd(spark), benchmark, out_col="m")
    assert out.columns == [*odd(spark).columns, "m"] and all(not r["m"] for r in out.collect())
    assert all(not r["hits"] for r in decontaminate.matches(df, benchmark.where("false")).collect())
    assert decontaminate.matches(df.where("false"), benchmark).count() == 0


def test_benchmark_search_skips_no_window(spark):
    """Paraphrases of every degree: what the bounds leave is what projecting every window of six words' step finds."""
    import pyarrow as pa

    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}{d}{e}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst" for d in "aeiou" for e in "knpt"] + ["the", "of", "and"] * 200
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{sentence(rng.choice([14, 30, 60]))}. {sentence(6)}.") for i in range(60)]
    docs = []
    for i in range(300):
        text = [x for w in items[i % 60][1].split() for x in ([rng.choice(vocabulary)] if rng.random() < i / 600 else [rng.choice(vocabulary)] * (rng.random() < i / 400) + [w])]
        docs.append(f"{sentence(rng.randrange(60, 90))} {' '.join(text)} {sentence(60)}")
    docs += [sentence(200) for _ in range(200)]
    df, n = decontaminate.document_frequencies(spark.createDataFrame([(t,) for t in docs], "text string"))
    index = decontaminate.build(spark, items, decontaminate.weights(df, n))
    words = decontaminate._words(pa.array(docs))
    got = {(d, x["item_id"]) for d, hits in enumerate(decontaminate._search(index, words)) for x in hits}
    want = set()
    for d, (a, z) in enumerate(zip(words.doc[:-1], words.doc[1:], strict=True)):
        own = words.hash[a:z]
        for at in sorted({*range(0, len(own) - 24, 6), len(own) - 24}):
            window = own[at : at + 24]
            weight, place = index.idf[decontaminate.buckets(window)].astype(float) ** 2, decontaminate._places(index.own, index.slot, window)
            vector = np.sqrt(np.bincount(place[place >= 0], weight[place >= 0], len(index.own)))
            cosine = vector @ index.basis @ index.latent.T / np.sqrt(weight.sum())
            for item in {int(index.item[j]) for j in np.flatnonzero(cosine >= 0.4)}:
                lcs, answer = decontaminate._confirm(index, own, item, at)
                if lcs >= 0.7 or (lcs >= 0.5 and answer >= 0.8):
                    want.add((d, index.ids[item]))
    assert len(want) > 150 and got == want


def test_groups_of_items():
    items = [(i, "a b c d e f g h " * 30) for i in range(200)]
    groups = decontaminate.spaces(items)
    assert len(groups) > 1 and [i for g in groups for i, *_ in g] == list(range(200))
    long = decontaminate.spaces([(1, " ".join(f"w{k}" for k in range(30_000)) + ". the answer")])
    assert len(long) == 3 and {(i, a, cut) for g in long for i, _, a, cut in g} == {(1, "the answer", True)}
    words = [w for g in long for _, t, *_ in g for w in t.replace(".", "").split()]
    assert set(words) >= {f"w{k}" for k in range(30_000)} | {"answer"}


def test_short_and_long_items(spark, monkeypatch):
    """Items of three words, and one of more passages than a group holds, each found once, in groups that share a pass."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    monkeypatch.setattr(decontaminate, "SPACE", 64)
    book = sentence(900)
    items = [(1, "zebra quartz violin"), (2, "Who wrote Kalevala"), (3, book), (4, sentence(20))]
    docs = [(i, sentence(100)) for i in range(60)]
    docs[3] = (3, sentence(50) + " zebra, quartz VIOLIN " + sentence(50))
    docs[5] = (5, sentence(50) + " who wrote kalevala? " + sentence(40) + " " + items[3][1])
    docs[7] = (7, " ".join(book.split()[300:380]) + " " + " ".join(book.split()[820:880]))
    got = [(r["doc_id"], h["item_id"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() for h in r["hits"]]
    assert sorted(got) == [(3, 1), (5, 2), (5, 4), (7, 3)]


def test_weighted_lcs():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 3, 2, 4, 4])
    assert decontaminate.weighted_lcs(a, b, np.array([1.0, 5.0, 1.0, 1.0])) == 7.0


def model_tokens(text):
    return [*helpers.words(text), None]


def check_scores(rows, docs):
    tokens = [(i, model_tokens(t)) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


def test_language_model(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = pitman_yor.op10_pitman_yor(spark, small).collect()
    check_scores(rows, docs)
    held = [r for r in rows if r["held_out"]]
    per_token = lambda rs, k: sum(r[k] for r in rs) / sum(r["n_tokens"] for r in rs)
    assert per_token(held, "score") > per_token(held, "base_score")


def test_language_model_of_odd_rows(spark):
    # The repeated word of a long text makes hot words; several shards make them meet.
    check_scores(pitman_yor.score(odd(spark), shards=5).collect(), [(i, t) for i, t, _ in ODD])
    assert pitman_yor.score(odd(spark).where("false")).count() == 0


def test_language_model_adds_up_to_one():
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(100)]
    word, context, row = pitman_yor._tokens(pa.array(texts))
    hot = np.zeros(0, np.uint64)
    head = b"T" + np.uint32(len(texts)).tobytes()
    shard = pitman_yor.Shard(0, [(0, head + b) for _, b in pitman_yor._pack(word, context, row.astype(np.uint16), hot, 1)])
    counts = pitman_yor._count(shard, hot)
    counts["vocabulary"] = int(counts["words"][0])
    sums = pitman_yor._sums(shard, counts, hot)
    share = 1 / (counts["vocabulary"] + 1)
    for s, (tables, above) in enumerate(pitman_yor.chain(shard, counts, hot)):
        assert np.all((tables >= (shard.count > 0)) & (tables <= shard.count))
        customers, (c, t) = np.bincount(shard.word, tables, len(shard.words)), sums["parent"][s]
        room = (pitman_yor.PARENT_STRENGTH + pitman_yor.PARENT_DISCOUNT * t) * share
        parent = (customers - pitman_yor.PARENT_DISCOUNT * above + room) / (pitman_yor.PARENT_STRENGTH + c)
        unknown = room / (pitman_yor.PARENT_STRENGTH + c)
        assert parent.sum() + unknown == pytest.approx(1)
        for b in np.unique(shard.context):
            of = shard.context == b
            held = (shard.count[of] - pitman_yor.DISCOUNT * tables[of]).sum()
            assert (held + (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * sums["contexts"][s][b]) * (parent.sum() + unknown)) / (pitman_yor.STRENGTH + counts["contexts"][b]) == pytest.approx(1)


def test_language_model_seats_all_customers():
    """A pair of 3,000 tokens, seated again in every round: its tables follow their conditional distribution."""
    import pyarrow as pa

    def mean(c, strength, discount):
        log = np.full(c + 2, -np.inf)
        log[1], t = 0.0, np.arange(1, c + 1)
        for n in range(1, c):
            log[1:-1] = np.logaddexp(np.log(np.maximum(n - discount * t, 1e-300)) + log[1:-1], log[:-2])
        chance = np.exp(log[1:-1] + t * np.log(strength) - (log[1:-1] + t * np.log(strength)).max())
        return (t * chance).sum() / chance.sum()

    word, context, row = pitman_yor._tokens(pa.array([" ".join(["a"] * 3001 + ["b"])]))
    hot, head = np.zeros(0, np.uint64), b"T" + np.uint32(1).tobytes()
    blobs = [(0, head + b) for _, b in pitman_yor._pack(word, context, row.astype(np.uint16), hot, 1)]
    states = []
    for number in range(60):
        shard = pitman_yor.Shard(number, blobs)
        counts = pitman_yor._count(shard, hot)
        counts["vocabulary"] = int(counts["words"][0])
        states += [tables[shard.count.argmax()] for tables, _ in pitman_yor.chain(shard, counts, hot)]
    assert shard.count.max() == 3000
    # The pair's restaurant has two types, and its dish has a probability of 1 at most.
    assert np.mean(states) < mean(3000, pitman_yor.STRENGTH + 2 * pitman_yor.DISCOUNT, pitman_yor.DISCOUNT)
    rng = np.random.default_rng(3)
    for c, strength, discount in ((2, 0.3, 0.75), (40, 5.0, 0.75), (3000, 0.6, 0.6), (3000, 40.0, 0.75), (3000, 4000.0, 0.75)):
        got = pitman_yor.draw_tables(np.full(400, c), np.full(400, strength), discount, rng)
        assert abs(got.mean() - mean(c, strength, discount)) < 5 * got.std() / 20


def test_table_numbers_are_those_of_a_sampler():
    """Customers that leave and sit down again one by one, as the restaurant's rule says, have as many tables."""
    rng = np.random.default_rng(5)
    for c, strength, discount in ((5, 0.7, 0.75), (9, 3.0, 0.4)):
        seats, seen = [c], []
        for step in range(6000):
            i = rng.choice(len(seats), p=np.array(seats) / c)
            seats[i] -= 1
            seats = [x for x in seats if x]
            # A new table: the dish's own part of the strength; strength here is already that of the seated restaurant.
            weight = np.array([*(x - discount for x in seats), strength])
            i = rng.choice(len(weight), p=weight / weight.sum())
            seats = [*seats, 1] if i == len(seats) else [x + (k == i) for k, x in enumerate(seats)]
            seen.append(len(seats)) if step > 500 else None
        got = pitman_yor.draw_tables(np.full(4000, c), np.full(4000, strength), discount, rng)
        assert abs(got.mean() - np.mean(seen)) < 0.12
        assert np.abs(np.bincount(got, minlength=c + 1) / 4000 - np.bincount(seen, minlength=c + 1) / len(seen)).max() < 0.06


def test_discounts_follow_the_corpus():
    assert pitman_yor.estimate(np.array([600.0, 100.0, 0.0, 5.0])) == (0.75, pitman_yor.PARENT_DISCOUNT)
    assert pitman_yor.estimate(np.array([1.0, 1000.0, 1e9, 1.0])) == (0.05, 0.95)


def test_pipeline_of_odd_rows(spark, small):
    """Nulls, empty and long texts, repeats, clashing names and empty tables, in every stage."""
    import corpus_pipeline

    docs = odd(spark).withColumns({"_mark": F.lit("clash"), "n_chars": F.lit(7).cast("long")}).union(odd(spark).where("doc_id = 3").selectExpr("doc_id", "'another text of this id' as text", *odd(spark).columns[2:], "'clash'", "7L"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, small)
            got = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert len(got) <= len(ODD) + 1 or name == "packing"
            if name == "near-duplicates" and rows is docs:
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got if (r["doc_id"] or 0) < 4) == [(0, "no id here"), (1, ODD[0][1]), (2, ""), (3, ""), (3, "another text of this id")]
    assert stage(spark, docs.where("false"), small).count() == 0


def test_quality_by_brute_force():
    """A tree is the best of all cuts, one after the other, and a score the logistic of a sum of table look-ups."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        g, h, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(0, 9, 9)
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality.RIDGE)
        borders = [0, 9]
        for _ in range(2):
            options = [(value(a, k) + value(k, b) - value(a, b), k) for a, b in zip(borders, borders[1:], strict=False) for k in range(a + 1, b) if min(n[a:k].sum(), n[k:b].sum()) >= quality.MIN_LEAF]
            if not options or max(options)[0] <= 0:
                break
            borders = sorted([*borders, max(options)[1]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + quality.RIDGE)) for a, b in zip(borders, borders[1:], strict=False)])
        assert np.allclose(quality._tree(g, h, n), want)
    x = rng.random((500, 3))
    model = quality.fit(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float))
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        z = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_pipeline(spark, small):
    """Stages against a plain restatement on each one's own input."""
    import corpus_pipeline
    from ledgerlark.llm import codec, pii
    from ledgerlark.llm.common import settle

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, docs, small))
        assert after.columns == columns
        kept.append(({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in after.collect()}))
        docs = after
    (before, good), (_, unique), (_, clean), (_, safe) = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert sum((i in good) == bool(q) for i, q in labels.items()) / len(labels) > 0.9 and good.items() <= before.items()
    assert set(unique) == {i for i, (_, c) in helpers.components(list(good.items()), 5).items() if i == c}
    items = [" ".join(helpers.words(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert set(unique) - set(clean) >= {i for i, t in unique.items() if any(x in " ".join(helpers.words(t)) for x in items)}
    assert len(set(unique) - set(clean)) < 0.1 * len(unique)
    secret = re.compile("[A-Za-z0-9_]{20}")
    assert set(safe) == set(clean) and not any(helpers.base_spans(t) for t in safe.values())
    assert all(safe[i] == t for i, t in clean.items() if not helpers.base_spans(t) and not secret.search(t))
    encoder = codec.load(codec.default_path())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sum(r["length"] for r in packed) == sum(len(codec.ids(encoder, t)) + 1 for t in safe.values())
    assert pii.KINDS[:4] == list(helpers.BASE)
    piece = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(piece, QUERIES["pipeline"](spark, small).collect())) == sorted(map(piece, packed))


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q))) == list(range(1, 14)) and "pipeline" in QUERIES
