"""Main text of web pages by a site style tree.

The DOMs of a host are merged: elements with the same path of tags and style names are one style node. For each
node the pages' features are counted: the sequences of child elements (presentation) and the text blocks (content).
With n_a pages having feature a, N = sum n_a and m pages having the node, the node's importance is

    1 - sum(n_a log n_a) / (N log m)

which is the normalised entropy of the presentations and 1 minus the mean normalised entropy of the contents: 0 if
every page has the same, 1 if no two pages do. A node takes the larger of the two. A branch's importance is that of
its text, and with a small weight the node's own: the best of its nodes, or, where a name speaks against the branch,
their mean by length.

Whether a branch of a page stays is one sum: what HTML's tags and style names say (a prior, for or against), whether
it stands in what the page marks as its article, and the importance of the branch, if enough pages have its nodes.
Marks are believed only where they hold a fair share of the page's distinctive text, and a name on something that
holds nearly all of it, or the first of the marks, is no verdict on it. Markup that is never prose (scripts, styles, controls) is no part of the tree.
Equal pages of a host are one page of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import settle, table
from ledgerlark.llm.html_tree import Node, read

#: Elements without prose; tags, and style names (class, id and role, split at non-letters), against a branch.
NEVER = frozenset("head button select script style noscript template iframe svg canvas object video audio dialog textarea title datalist math map".split())
AGAINST = frozenset("nav footer aside form menu".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar comment comments commentlist respond disqus reply replies discussion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup share sharing related recommended recommendations pagination pager login searchbox contentinfo complementary".split()
)
DOUBTFUL = frozenset("notice notices alert legal social promo promotion copyright disclaimer search skip header".split())
#: What marks an article: tags, and whole style names.
MAIN_TAGS, MAIN_NAMES = frozenset(["article", "main"]), frozenset("main article content article-body articlebody article-content main-content maincontent post-content entry-content post-body story-body".split())
#: Weights of the sum: a name or tag against a branch, a doubtful one, an article's mark, to be in an article or outside
#: of the page's, and the importance (of which a half tells nothing).
STRONG, WEAK, MARK, INSIDE, OUTSIDE, TREE = 4.0, 2.0, 2.0, 1.0, 2.0, 1.5
#: Pages that a node needs before its importance counts, the weight of its own one in a branch, the share of the page's
#: distinctive text that makes an article's mark credible, and the one from which a name is no verdict.
LEAST_PAGES, OWN_WEIGHT, CREDIBLE, NEARLY_ALL = 8, 0.1, 0.2, 0.8
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_nodes(nodes: list[Node]) -> list[int]:
    """The style node of each element, a hash of its path; 0 for the root and for what never holds prose."""
    out = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        if not (n.hidden or n.tag in NEVER) and (n.parent == 0 or out[n.parent]):
            out[i] = _hash(f"{out[n.parent]}/{n.tag}.{n.style}")
    return out


def prior(node: Node) -> tuple[float, bool]:
    """What tag and names say for or against the element, and whether they mark an article."""
    if node.tag in ("html", "body"):
        return 0.0, False
    main = node.tag in MAIN_TAGS or bool(MAIN_NAMES & set(node.style.lower().split()))
    against = STRONG if node.tag in AGAINST or node.marks & NAMES else WEAK if node.tag == "header" or node.marks & DOUBTFUL else 0.0
    return MARK * main - against, main


class Branch:
    """A style node on one page: parent (a place in the list, -1 for none), prior, main, header and its text's length."""

    __slots__ = ("style", "parent", "prior", "main", "header", "size")

    def __init__(self, style: int, parent: int, prior: float, main: bool, header: bool, size: int = 0):
        self.style, self.parent, self.prior, self.main, self.header, self.size = style, parent, prior, main, header, size


def branches(nodes: list[Node], style: list[int], blocks: list[tuple[int, str]]) -> list[Branch]:
    """The style nodes of a page that have text in them, parents first."""
    place: dict[int, int] = {}
    out: list[Branch] = []
    for i, n in enumerate(nodes[1:], 1):
        if style[i] and style[i] not in place:
            place[style[i]] = len(out)
            out.append(Branch(style[i], place.get(style[n.parent], -1), *prior(n), n.tag == "header"))
    if any(i == 0 for i, _ in blocks):
        place[0] = len(out)
        out.append(Branch(0, -1, 0.0, False, False))
    for i, text in blocks:
        if i == 0 or style[i]:
            out[place[style[i]]].size += len(text)
    return out


def kept(page: list[Branch], known: dict[int, float]) -> set[int]:
    """The style nodes whose own text stays. known: importances of the style nodes that enough pages have."""
    n = len(page)
    size, seen, mass = (np.zeros(n) for _ in range(3))
    for i, b in enumerate(page):
        size[i], seen[i], mass[i] = b.size, b.size * (b.style in known), b.size * known.get(b.style, 1.0)
    mine = size.copy()
    best = np.array([known.get(b.style, 1.0) if b.size else 0.0 for b in page])
    for i in range(n - 1, -1, -1):
        if (up := page[i].parent) >= 0:
            size[up], seen[up], mass[up], best[up] = size[up] + size[i], seen[up] + seen[i], mass[up] + mass[i], max(best[up], best[i])
    above: list[set[int]] = []
    for b in page:
        above.append(above[b.parent] | {b.parent} if b.parent >= 0 else set())
    everything = sum(mass[i] for i, b in enumerate(page) if b.parent < 0)
    mains = [i for i, b in enumerate(page) if b.main and b.prior > 0] or [i for i, b in enumerate(page) if b.main]
    wrapper = [b.prior < 0 and (i in above[mains[0]] if mains else mass[i] >= NEARLY_ALL * everything) for i, b in enumerate(page)]
    against = [b.prior < 0 and not wrapper[i] and not b.main and not (b.header and any(page[k].main for k in above[i])) for i, b in enumerate(page)]
    doomed = [against[i] or any(against[k] for k in above[i]) for i in range(n)]
    tops = [m for m in mains if not doomed[m] and not any(k in mains for k in above[m])]
    open_mass = sum(mine[i] * known.get(page[i].style, 1.0) for i in range(n) if not doomed[i])
    credible = bool(tops) and sum(mass[m] for m in tops) >= CREDIBLE * open_mass and sum(size[m] for m in tops) > 0
    holders = set().union(*(above[m] for m in tops)) if tops else set()
    cut, stays = [False] * n, set()
    for i, b in enumerate(page):
        inside = any(m == i or m in above[i] for m in tops)
        value = max(b.prior, 0.0) if wrapper[i] or i in tops or (b.header and inside and b.prior == -WEAK) else b.prior
        value += INSIDE * (inside and i not in tops)
        outside = credible and not inside
        if outside and i not in holders:
            value -= OUTSIDE
        if size[i] > 0 and i not in holders and b.style:
            branch = mass[i] / size[i] if b.prior < 0 else best[i]
            value += TREE * (2 * (OWN_WEIGHT * known.get(b.style, 1.0) + (1 - OWN_WEIGHT) * branch) - 1) * seen[i] / size[i]
        cut[i] = (b.parent >= 0 and cut[b.parent]) or value < 0
        if not cut[i] and not outside:
            stays.add(b.style)
    return stays


def _features(pages: DataFrame) -> DataFrame:
    """page, host, node, parent, kind and feature, once for each page. Kind 0 is a child sequence, 1 a text block; 2 is the
    page's own branch: its place in `at`, and what kept() needs to know of it in `size` and `about`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in types]
                for page, host, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    nodes, blocks = read(html)
                    style = style_nodes(nodes)
                    rows = {(style[i], style[n.parent], 0, _hash(" ".join(dict.fromkeys(nodes[c].tag + "." + nodes[c].style for c in n.children))), 0, 0, 0.0) for i, n in enumerate(nodes[1:], 1) if style[i]}
                    rows |= {(style[i], style[nodes[i].parent] if i else 0, 1, _hash(text), 0, 0, 0.0) for i, text in blocks if i == 0 or style[i]}
                    rows |= {(b.style, b.parent, 2, int(b.main) | 2 * b.header, k, b.size, b.prior) for k, b in enumerate(branches(nodes, style, blocks))}
                    for row in rows:
                        for column, value in zip(out, (page, host, *row), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["page", "host", "node", "parent", "kind", "feature", "at", "size", "about"])

    return pages.select("page", "host", "html").mapInArrow(run, "page long, host string, node long, parent long, kind int, feature long, at int, size int, about double")


def importance(features: DataFrame) -> DataFrame:
    """host, node, parent, pages and importance of each style node by itself."""
    counts = features.where("kind < 2").groupBy("host", "node", "parent", "kind", "feature").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("host", "node", "parent", "kind").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log(F.col("n"))).alias("spread"))
    pages = F.max(F.when(F.col("kind") == 0, F.col("total")))
    nodes = kinds.groupBy("host", "node", "parent").agg(pages.alias("pages"), F.collect_list(F.struct("total", "spread")).alias("k"))
    value = F.when(F.col("pages") > 1, F.array_max(F.transform("k", lambda k: 1 - k["spread"] / (k["total"] * F.log("pages"))))).otherwise(F.lit(1.0))
    return nodes.select("host", "node", "parent", "pages", value.alias("importance"))


def _decisions(features: DataFrame, known: DataFrame) -> DataFrame:
    """page and stay: the style nodes whose text stays, of the pages where the tree decides otherwise than the prior."""
    rows = features.where("kind = 2").select("page", "host", "node", F.col("parent").cast("int").alias("parent"), F.col("feature").cast("int").alias("flags"), "at", "size", "about")
    told = rows.join(known, ["host", "node"], "left").groupBy("page").agg(F.collect_list(F.struct("at", "node", "parent", "flags", "size", "about", "importance")).alias("b"), F.count("importance").alias("k")).where("k > 0").select("page", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, stays = [], []
            for page, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.sort(key=lambda x: x["at"])
                own = [Branch(x["node"], x["parent"], x["about"], bool(x["flags"] & 1), bool(x["flags"] & 2), x["size"]) for x in found]
                stay = kept(own, {x["node"]: x["importance"] for x in found if x["importance"] is not None})
                if stay != kept(own, {}):
                    pages.append(page)
                    stays.append(sorted(stay))
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(stays, pa.list_(pa.int64()))], names=["page", "stay"])

    return told.mapInArrow(run, "page long, stay array<long>")


def _text(html: str, stay: list[int] | None) -> str:
    """stay: what the tree decided for this page; without it, the prior decides."""
    nodes, blocks = read(html)
    style = style_nodes(nodes)
    mine = kept(branches(nodes, style, blocks), {}) if stay is None else set(stay)
    return " ".join(text for i, text in blocks if (i == 0 or style[i]) and style[i] in mine)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and by_tree (whether the tree decided otherwise than tags and names) of each row.

    A null or empty html has the text ''; pages without a host in their url are one site. Repeated rows are extracted
    each; other columns are not read; an empty table gives no rows.
    """
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = plain.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))).withColumn("page", F.xxhash64("host", "html"))
    # Of equal pages of a host one is in the tree: the one with the smallest id. Mostly there are few such groups.
    groups = settle(keyed.groupBy("page").agg(F.count("*").alias("n"), F.min("page_id").alias("one")).where("n > 1").select("page", "one"))
    alone = keyed.join(groups.select(F.col("page").alias("p"), "one"), F.col("page") == F.col("p"), "left").where(F.col("p").isNull() | F.coalesce(F.col("page_id") == F.col("one"), F.col("one").isNull()))
    features = settle(_features(alone))
    known = settle(importance(features).where(F.col("pages") >= LEAST_PAGES).select("host", "node", "importance"))
    # Written first, so that the join below is planned by its true size.
    decided = settle(_decisions(features, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [_text(html, stay) for html, stay in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64)), part.column(3).is_valid()], names=["page_id", "url", "text", "n_chars", "by_tree"])

    joined = keyed.join(decided, "page", "left").select("page_id", "url", "html", "stay")
    kind = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_tree boolean")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
