"""Edit-aware token counts.

A document's pre-tokens are kept in blocks, and a segment tree holds the sums of characters, pre-tokens and tokens
below each node. Trees are kept as a table, so that later edits go on from it (`trees`, `edit_trees`). Byte-level BPE merges nothing across pre-tokens, and where a pre-token ends depends on the text from
its start to two characters beyond its end, so an edit can change only the pre-tokens from the last one that ends at
least two characters before it up to the first place behind it where the old and the new borders agree. Only those
are encoded again; the sums above their blocks are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import codec
from ledgerlark.llm.common import keyed_text, table

PRETOKEN = regex.compile(codec.PATTERN)
#: Pre-tokens of a block; a block that grows to four times as many makes the tree be built anew.
BLOCK = 32
#: Characters beyond its end that can decide where a pre-token ends.
LOOKAHEAD = 2
#: Pre-tokens whose counts a worker remembers, and the longest that it does.
CACHE, CACHE_CHARS = 200_000, 40
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"

_counts: dict[str, int] = {}


def token_count(encoder, piece: str) -> int:
    n = _counts.get(piece)
    if n is None:
        n = len(encoder.encode_ordinary(piece))
        if len(piece) <= CACHE_CHARS:
            if len(_counts) >= CACHE:
                _counts.clear()
            _counts[piece] = n
    return n


class TokenTree:
    """The token count of a text that is edited."""

    def __init__(self, encoder, text: str, kept: tuple[list[int], list[int]] | None = None):
        """kept: lengths and tokens of the text's pre-tokens, if they are known already."""
        self.encoder, self.text, self.encoded = encoder, text, 0
        if kept is None:
            pieces = [len(p) for p in self._split(PRETOKEN.findall(text))]
            kept = pieces, self._last
        self._build(*kept)

    def leaf_values(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.blocks for x in a], [x for _, b in self.blocks for x in b]

    def _split(self, pieces: list[str]) -> list[str]:
        encoder = self.encoder
        self._last = [token_count(encoder, p) for p in pieces]
        self.encoded += len(pieces)
        return pieces

    def _build(self, lengths: list[int], tokens: list[int]) -> None:
        n = max(1, -(-len(lengths) // BLOCK))
        self.leaves = 1 << (n - 1).bit_length()
        self.blocks = [(lengths[i * BLOCK : (i + 1) * BLOCK], tokens[i * BLOCK : (i + 1) * BLOCK]) for i in range(n)] + [([], [])] * (self.leaves - n)
        chars, toks = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (a, b) in enumerate(self.blocks):
            chars[self.leaves + i], toks[self.leaves + i] = sum(a), sum(b)
        for i in range(self.leaves - 1, 0, -1):
            chars[i], toks[i] = chars[2 * i] + chars[2 * i + 1], toks[2 * i] + toks[2 * i + 1]
        self.chars, self.toks = chars, toks

    @property
    def tokens(self) -> int:
        return self.toks[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at` (the last one with characters, for the end), and where it starts."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.leaves, before

    def _set(self, block: int, lengths: list[int], tokens: list[int]) -> None:
        self.blocks[block] = (lengths, tokens)
        node = self.leaves + block
        self.chars[node], self.toks[node] = sum(lengths), sum(tokens)
        while node > 1:
            node //= 2
            self.chars[node], self.toks[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.toks[2 * node] + self.toks[2 * node + 1]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replaces text[start:stop]; positions beyond the text are its end."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        shift = len(replacement) - (stop - start)
        self.text = self.text[:start] + replacement + self.text[stop:]
        # The first pre-token to be redone: the first that ends later than LOOKAHEAD characters before the edit.
        first, at = self._find(max(start - LOOKAHEAD, 0))
        lengths, tokens = self.blocks[first]
        keep = 0
        while keep < len(lengths) and at + lengths[keep] <= start - LOOKAHEAD:
            at += lengths[keep]
            keep += 1
        # Old borders behind the edit, as new positions, until one of them is a new border too.
        block, k, old = first, keep, at
        new_lengths, new_tokens, new = [], [], at
        matches = PRETOKEN.finditer(self.text, at)

        def advance() -> bool:
            nonlocal block, k, old
            while k >= len(self.blocks[block][0]):
                if block + 1 >= self.leaves:
                    return False
                block, k = block + 1, 0
            old += self.blocks[block][0][k]
            k += 1
            return True

        agreed = False
        for m in matches:
            piece = m[0]
            new_lengths.append(len(piece))
            new_tokens.append(token_count(self.encoder, piece))
            self.encoded += 1
            new += len(piece)
            while old < stop or old + shift < new:
                if not advance():
                    break
            if old >= stop and old + shift == new:
                agreed = True
                break
        if not agreed:  # the edit reaches the end of the text
            block, k = self.leaves - 1, len(self.blocks[-1][0])
        tail_lengths, tail_tokens = self.blocks[block][0][k:], self.blocks[block][1][k:]
        merged = lengths[:keep] + new_lengths + tail_lengths, tokens[:keep] + new_tokens + tail_tokens
        for b in range(first + 1, block + 1):
            if self.blocks[b][0]:
                self._set(b, [], [])
        self._set(first, *merged)
        if len(merged[0]) > 4 * BLOCK:
            self._build([x for b in self.blocks for x in b[0]], [x for b in self.blocks for x in b[1]])


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the column `edits`: those of (id, seq, start, stop, text) with its id, in the order of seq. A
    document's edits follow each other and so stay together; rows with a null id have none."""
    own = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text"))).alias("_log"))
    log = F.transform("_log", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["text"].alias("text")))
    return docs.join(own, id_col, "left").withColumn("edits", log.cast(EDITS)).drop("_log")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Per row: tokens of the text and, after its edits one after the other, of the edited text; the pre-tokens of the
    text; and how many pre-tokens the edits made to be encoded again.

    An edit replaces the code points from start to stop (exclusive) of the text as it is then; positions beyond the
    end are the end, nulls are 0 and ''. Null and empty texts have no tokens, null edits are none; repeated rows are
    counted each, an empty table gives no rows, other columns are not read.
    """
    path = tokenizer or codec.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list[int]] = [[], [], [], [], []]
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = TokenTree(encoder, text)
                    before, pieces = tree.tokens, tree.encoded
                    for e in edits or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    for column, value in zip(out, (before, pieces, len(tree.text), tree.tokens, tree.encoded - pieces), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_tokens", "n_pretokens", "edited_chars", "edited_tokens", "reencoded"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, edited_chars long, edited_tokens long, reencoded long")


TREES = "doc_id long, text string, lengths array<int>, tokens array<int>, reencoded long"


def _trees(rows: DataFrame, tokenizer: str | None) -> DataFrame:
    """rows: doc_id, text, lengths, tokens (null: to be built) and edits."""
    path = tokenizer or codec.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, lengths, tokens, done = [], [], [], []
                for text, a, b, edits in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    tree = TokenTree(encoder, text, None if a is None else (a, b))
                    before = tree.encoded
                    for e in edits or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    a, b = tree.leaf_values()
                    texts.append(tree.text)
                    lengths.append(a)
                    tokens.append(b)
                    done.append(tree.encoded - before)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lengths, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(done, pa.int64())], names=["doc_id", "text", "lengths", "tokens", "reencoded"])

    return rows.select("doc_id", "text", "lengths", "tokens", F.col("edits").cast(EDITS)).mapInArrow(run, TREES)


def trees(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and the lengths and token counts of its pre-tokens, the leaves of its tree."""
    none = F.lit(None)
    return _trees(keyed_text(docs, id_col, text_col).withColumns({"lengths": none.cast("array<int>"), "tokens": none.cast("array<int>"), "edits": none.cast(EDITS)}), tokenizer)


def edit_trees(kept: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The trees after the edits of (doc_id, edits), a row for each doc_id at most; `reencoded` tells how many pre-tokens
    were encoded. Trees without edits stay as they are; nothing else is encoded again."""
    return _trees(kept.select("doc_id", "text", "lengths", "tokens").join(edits.select("doc_id", "edits"), "doc_id", "left"), tokenizer)


def sample_edits(text: Column) -> Column:
    """Three edits of any text: the second quarter loses up to 40 characters at its start, a line is put in the middle,
    and up to 12 characters before the last quarter are replaced."""
    n = F.length(text).cast("long")
    edit = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(new).alias("text"))
    first, middle, last = F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4)
    return F.array(edit(first, F.least(first + 40, n), ""), edit(middle, middle, "\nOne more line, put in later.\n"), edit(last - F.least(last, F.lit(12)), last, "2025's edit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    docs = keyed_text(table(spark, sf_dir, "documents"))
    return count_tokens(docs.withColumn("edits", sample_edits(F.col("text"))))
