"""Rows from the lines of laid-out pages: clustering, sections, carried headings and wrapped rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.text import plain_punctuation, reservation, without_reservation
from ledgerlark.sources.tables import written

TOLERANCE = 2.0
#: Where the column of extents begins between the left edges of names and extents.
BOUNDARY = 0.62


def cluster_lines(fragments: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """page, y and frags of each line: fragments (page, x, y, text) whose y is within the tolerance of the line's first,
    in the order in which they come (place). Lines go down the page, fragments to the right. A page is one group; with a
    column doc, a page of a document is, and doc stays."""
    keys_of = [c for c in ("doc", "page") if c in fragments.columns]

    def lines(page: pd.DataFrame) -> pd.DataFrame:
        keys: list[float] = []
        held: list[list[tuple[float, str]]] = []
        for x, y, text in page.sort_values("place")[["x", "y", "text"]].itertuples(index=False):
            k = next((i for i, key in enumerate(keys) if abs(key - y) <= tolerance), None)
            if k is None:
                keys.append(y)
                held.append([])
                k = len(keys) - 1
            held[k].append((x, text))
        order = sorted(range(len(keys)), key=lambda i: -keys[i])
        return pd.DataFrame({**{k: [page[k].iloc[0]] * len(order) for k in keys_of}, "line": range(len(order)), "y": [keys[i] for i in order], "frags": [[{"x": x, "text": t} for x, t in sorted(held[i], key=lambda f: f[0])] for i in order]})

    kinds = dict(fragments.dtypes)
    return fragments.groupBy(*keys_of).applyInPandas(lines, "".join(f"{k} {kinds[k]}, " for k in keys_of) + "line long, y double, frags array<struct<x:double,text:string>>")


def section_ranges(marks: DataFrame, group: list[str], at: str) -> DataFrame:
    """Each mark with `last`, the place before the next mark of its group; null for the last one."""
    return marks.withColumn("last", F.lead(at).over(Window.partitionBy(*group).orderBy(at)) - 1)


def carry_forward(lines: DataFrame, heading: str, group: list[str], order: list[str]) -> DataFrame:
    """The heading, where it is null, of the nearest line before that has one."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(heading, F.last(heading, ignorenulls=True).over(before))


def boundary(name_left: float, extent_left: float) -> float:
    return name_left + BOUNDARY * (extent_left - name_left)


#: How the lines of an order of delimitation read.
_DASH = "[-\u2013\u2014]"
SECTION = rf"(?i)^\s*SCHEDULE\s*{_DASH}?\s*[IVX]+\s*$"
ANNEXURE, ANNEXURE_NAME = rf"(?i)^\s*ANNEXURE\s*{_DASH}?\s*I\s*$", "JAMMU AND KASHMIR"
PART_A = rf"(?i)(?:PART|TABLE)\s*{_DASH}?\s*A\s*{_DASH}?\s*ASSEMBLY\s+CONSTITUENC"
PART_A_OF_ANNEXURE = r"(?i)^\s*ASSEMBLY\s+CONSTITUENCIES\s*&\s*THEIR\s+EXTENT\s*$"
PART_B = rf"(?i)(?:PART|TABLE)\s*{_DASH}?\s*B\s*{_DASH}?\s*PARLIAMENTARY|^\s*(?:ANNEXURE\s*{_DASH}?\s*A|APPENDIX)\s*$"
STOP = r"(?i)^\s*(?:NOTE\s*\.|Abbreviations?\s*[:-]|The above Order)"
SKIPPED = r"(?i)Sl\.?\s*No\.?\s*&\s*Name|^\s*NOTE\s*[:-]|^\d{1,4}$"
DISTRICT = rf"(?i)^\s*(?:\d+\s*{_DASH}?\s*)?DISTRICT\s*[:\u2013\u2014-]\s*([^,;]{{2,60}}?)\s*$"
NUMBERED = "^\\s*(\\d{1,3})\\s*(?:[-\u2010-\u2015:.]\\s*)?(.*)$"
#: Lines of a page that can be a section's heading, and the least distance between the two columns.
HEAD_LINES, COLUMN_GAP = 8, 40


def with_text(lines: DataFrame) -> DataFrame:
    """lines with `text`: its fragments as one text in plain punctuation."""
    return lines.withColumn("text", plain_punctuation(F.array_join(F.transform("frags", lambda f: f["text"]), " ")))


def in_sections(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, line, frags, text) with section (the page where it starts), name and annexure.

    A heading among the first lines of a page begins a section there; its name is the next line of the page that is not
    empty, if that is no heading of a part. A section goes on to the page before the next one's; lines before the first
    are left out. Of two headings on a page the later counts. Windows over a page and over a document's pages: the lines
    are sorted, not joined with what was found in them.
    """
    page, pages = Window.partitionBy("doc", "page"), Window.partitionBy("doc").orderBy("page").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.when(F.col("text").rlike(SECTION), F.lit("schedule")).when(F.col("text").rlike(ANNEXURE), F.lit("annexure"))
    own = F.when((F.col("line") < HEAD_LINES) & kind.isNotNull(), F.struct(F.col("line").alias("at"), kind.alias("kind")))
    marked = lines.withColumn("_mark", F.max(own).over(page))
    after = (F.col("line") > F.col("_mark.at")) & (F.col("text") != "")
    marked = marked.withColumn("_following", F.min(F.when(after, F.struct("line", "text"))).over(page)["text"])
    named = F.when(F.col("_mark.kind") == "annexure", F.lit(ANNEXURE_NAME)).when(~F.col("_following").rlike(PART_A) & ~F.contains(F.upper("_following"), F.lit("PARLIAMENT")), F.upper("_following"))
    start = F.when(F.col("_mark").isNotNull(), F.struct(F.col("page").alias("section"), named.alias("name"), (F.col("_mark.kind") == "annexure").alias("annexure")))
    placed = marked.withColumn("_start", F.last(start, ignorenulls=True).over(pages)).where(F.col("_start").isNotNull())
    return placed.select(*lines.columns, "_start.*")


def in_part_a(lines: DataFrame) -> DataFrame:
    """The lines of in_sections() from the page of part A's heading up to the line of part B's, or to the section's end."""
    section, page = Window.partitionBy("doc", "section"), Window.partitionBy("doc", "section", "page")
    place = F.struct("page", "line")
    opens = F.col("text").rlike(PART_A) | (F.col("annexure") & F.col("text").rlike(PART_A_OF_ANNEXURE))
    found = lines.withColumn("_first", F.min(F.when(opens, place)).over(section)).where(F.col("_first").isNotNull())
    found = found.withColumn("_last", F.min(F.when((place > F.col("_first")) & F.col("text").rlike(PART_B), place)).over(section))
    kept = found.where((F.col("page") >= F.col("_first.page")) & (F.col("_last").isNull() | (place < F.col("_last"))))
    stop = kept.withColumn("_stop", F.min(F.when(F.col("text").rlike(STOP), F.col("line"))).over(page))
    return stop.where("_stop is null or line < _stop").select(*lines.columns)


def column_edge(lines: DataFrame) -> DataFrame:
    """doc, section, name_left, extent_left and edge, from the numbered lines whose second fragment stands apart: the least
    x of the first fragments, the most common x of the second ones (of several the first to come), and the place between."""
    f = [F.get("frags", F.lit(i)) for i in (0, 1)]
    begin = plain_punctuation(f[0]["text"])
    own = lines.where((F.size("frags") > 1) & begin.rlike(NUMBERED) & ~begin.rlike(DISTRICT) & (F.length(begin) < 60))
    apart = own.select("doc", "section", "page", "line", f[0]["x"].alias("x0"), f[1]["x"].alias("x1")).where(F.col("x1") - F.col("x0") > COLUMN_GAP)
    each = apart.groupBy("doc", "section", "x1").agg(F.min("x0").alias("x0"), F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line")).alias("at"))
    found = each.groupBy("doc", "section").agg(F.min("x0").alias("name_left"), F.min(F.struct((-F.col("n")).alias("n"), "at", "x1"))["x1"].alias("common"), F.sort_array(F.collect_set("x1")).alias("all"))
    beyond = F.get(F.filter("all", lambda x: x > F.col("name_left") + COLUMN_GAP), F.lit(0))
    found = found.withColumn("extent_left", F.when(F.col("common") > F.col("name_left") + COLUMN_GAP, F.col("common")).otherwise(beyond))
    return found.select("doc", "section", "name_left", "extent_left", (F.col("name_left") + BOUNDARY * (F.col("extent_left") - F.col("name_left"))).alias("edge"))


def with_district(lines: DataFrame) -> DataFrame:
    """The lines that belong to rows, with the heading (district) that they stand under: '' before the first."""
    own = F.when(F.col("text").rlike(DISTRICT) & (F.length("text") < 90), F.regexp_extract("text", DISTRICT, 1))
    own = F.when(own.rlike("[A-Za-z]{2}"), F.rtrim(F.regexp_replace(F.regexp_replace(plain_punctuation(own), r"\.+$", ""), r"(?i)\s*\(.*?contd.*?\)\s*$", "")))
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    other = (F.col("text") == "") | F.col("text").rlike(SKIPPED) | F.col("text").rlike(PART_A) | F.col("text").rlike(SECTION) | F.col("text").rlike(ANNEXURE) | F.coalesce(squeezed(F.col("text")) == squeezed(F.col("name")), F.lit(False))
    marked = lines.where(~other).withColumn("own", own)
    carried = carry_forward(marked.withColumn("heading", F.col("own")), "heading", ["doc", "section"], ["page", "line"])
    return carried.where("own is null").drop("own").withColumn("heading", F.coalesce("heading", F.lit("")))


_ROW = re.compile(NUMBERED, re.S)
ROWS = "section string, number int, name string, extent string, heading string, page long"
#: Characters and words that a wrapped part of a name has at most.
WRAPPED_CHARS, WRAPPED_WORDS = 30, 4


def _is_name(text: str) -> bool:
    """Whether text left of the edge goes on with a name: short, without digits, not beginning with a small letter."""
    return len(text) <= WRAPPED_CHARS and len(text.split()) <= WRAPPED_WORDS and not any(c.isdigit() for c in text) and (text[0].isupper() or not text[0].isalpha())


def assemble_rows(lines: DataFrame, edge: float | None = None) -> DataFrame:
    """Numbered rows of each section from (section, page, line, heading, frags and, if no edge is given, edge).

    A number with a name begins a row, whatever the number; a bare number does if it is the next one, its name being on
    the next line. Other lines go on with the row before: left of the edge with its name if they look like one, else
    with its extent. Lines before the first row are left out. A section is read in its order by one task, for a row can go
    on over a page's end, but not held: a row leaves as soon as the next one begins.
    """
    keys = [c for c in ("doc", "section") if c in lines.columns]
    columns = ["section", "number", "name", "extent", "heading", "page"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        within, row = None, None
        for batch in batches:
            out: list[dict] = []
            for line in batch.itertuples(index=False):
                at = tuple(None if pd.isna(k) else k for k in (getattr(line, c) for c in keys))
                if at != within:
                    out += [row] if row else []
                    within, row = at, None
                border = line.edge if edge is None else edge
                left, right = (" ".join(" ".join(f["text"] for f in line.frags if (f["x"] < border) == side).split()) for side in (True, False))
                m = _ROW.match(left) if left else None
                if m and (m[2].strip() or int(m[1]) == (row["number"] if row else 0) + 1):
                    out += [row] if row else []
                    row = {"section": str(line.section), "number": int(m[1]), "name": [m[2]], "extent": [right], "heading": line.heading, "page": line.page}
                elif row:
                    if left:
                        row["name" if _is_name(left) else "extent"].append(left)
                    row["extent"].append(right)
            yield frame(out)
        yield frame([row] if row else [])

    def frame(out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{**r, **{k: " ".join(" ".join(r[k]).split()) for k in ("name", "extent")}} for r in out], columns=columns)

    return lines.repartition(*keys).sortWithinPartitions(*keys, "page", "line").mapInPandas(rows, ROWS)


def delimitation(lines: DataFrame) -> DataFrame:
    """Constituencies of an order from its lines (doc, page, line, frags): state_name, district, ac_number, constituency,
    reservation, extent and page. Sections without a name, a part A or two columns give no rows."""
    part = written(in_part_a(in_sections(with_text(lines)).where(F.col("name").isNotNull() & ~F.contains("name", F.lit("PARLIAMENT")))))
    rows = with_district(part.join(column_edge(part), ["doc", "section"]))
    found = assemble_rows(rows.withColumn("section", F.col("name")))
    return found.select(F.col("section").alias("state_name"), F.col("heading").alias("district"), F.col("number").alias("ac_number"), without_reservation(F.col("name")).alias("constituency"), F.coalesce(reservation(F.col("name")), F.lit("")).alias("reservation"), F.col("extent"), (F.col("page") + 1).alias("page"))


def each_page(pages: DataFrame, read, schema: str) -> DataFrame:
    """read(content) -> rows for each binary file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            found = [(path, *row) for path, content in zip(batch["path"], batch["content"], strict=True) for row in read(bytes(content))]
            yield pd.DataFrame(found, columns=names)

    return pages.select("path", "content").mapInPandas(run, schema)
