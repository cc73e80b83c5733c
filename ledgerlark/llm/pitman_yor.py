"""A hierarchical Pitman-Yor language model of word pairs.

Restaurants: one for each context, which is the word before, hashed into 2^CONTEXT_BITS restaurants; they all share
the unigram restaurant as parent, whose base is uniform over the vocabulary and one unknown word. A customer is a
training token; a table of a context restaurant is a customer of the parent.

How it is distributed. Tokens are dealt out by the word they are (the dish), as packed arrays, so that all tables of a
dish, in every context and in the parent, are in one place. Words that make up a thousandth of some partition are dealt
out by word and context instead, and their parts meet in sums over at most HOT of them. What restaurants share, the
numbers of their customers and tables, are arrays of fixed size, added up over the shards in chunks. So there are
four passes over one shuffle: counts; Gibbs sampling twice, which gives the shared sums of each sample, the second time
from those of the first; and scoring, where each shard repeats its chain from the same seed and adds up its tokens'
log probabilities for each document.

The discounts are estimated from the corpus, by how many pairs have one and how many two tokens, and likewise words
among the pairs: n1 / (n1 + 2 n2).

Sampling: in each round all customers of every dish are seated again at once, by a draw of the dish's number of tables
from its distribution given the number of its customers, first in the contexts and then in the parent. Of what other
shards hold, the numbers of tables of each context, of the parent, and of frequent words are those that the pass before
left. The predictive probabilities of SAMPLES states of the chain are averaged before the logarithm is taken.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bytetext
from ledgerlark.llm.common import held_out, table

CONTEXT_BITS = 16
#: Discount and strength of the context restaurants and of the parent; discounts hold where the corpus gives no estimate.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 2.0, 0.6, 20.0
#: Rounds before the first sample and between samples, samples.
BURN_IN, THIN, SAMPLES = 2, 1, 3
#: Passes of sampling; each begins with what the shards share as the one before left it.
SWEEPS = 2
#: Customers of a dish up to which the weights of table numbers are listed; points of the integrals beyond.
LISTED, NODES = 1024, 192
#: Words dealt out by context too, at most, and the share of a piece that makes one such.
HOT, HOT_SHARE = 4096, 1000
#: Tokens of a shard and of one packed piece, about, and shards that one task takes one after the other.
SHARD_TOKENS, PIECE_TOKENS, GROUP = 1_000_000, 1_000_000, 4
#: Values of a chunk of the shared sums.
CHUNK = 512
PIECE_DOCS = 60_000

END = np.uint64(0x1F83D9ABFB41BD6B)
_CONTEXT_SHIFT = np.uint64(64 - CONTEXT_BITS)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with an end after each text, their contexts (before the first: the end) and the row of each."""
    w = bytetext.words(column)
    counts = np.diff(w.doc)
    total = int(counts.sum() + len(counts))
    word = np.full(total, END, dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), counts + 1)
    inner = np.ones(total, bool)
    inner[np.cumsum(counts + 1) - 1] = False
    word[inner] = w.hash
    before = np.concatenate([[END], word[:-1]]) if total else word
    return word, (bytetext.mix(before) >> _CONTEXT_SHIFT).astype(np.uint16), row


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about PIECE_TOKENS tokens; a single text may have more."""
    for batch in batches:
        _, offsets = bytetext.buffers(batch.column(1))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + 6 * PIECE_TOKENS))
            stop = min(max(stop, at + 1), at + PIECE_DOCS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def _in_slices(batch: pa.RecordBatch, step: int = 192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for at in range(0, batch.num_rows, step):
        word, context, row = _tokens(batch.slice(at, step).column(1))
        parts.append((word, context, (row + at).astype(np.uint16)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _survey(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of all tokens, and the words that are frequent enough somewhere to be dealt out by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for piece in _pieces(batches):
            codes, own = pd.factorize(_in_slices(piece)[0])
            n = np.bincount(codes, minlength=len(own))
            often = n * HOT_SHARE >= n.sum()
            words += [own[often].view(np.int64), [-1]]
            counts += [n[often], [-n.sum()]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words).astype(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=["word", "n"])

    found = rows.mapInArrow(run, "word long, n long").groupBy((F.col("n") < 0).alias("all"), "word").agg(F.sum("n").alias("n"))
    total = found.where("all").agg(F.sum("n").alias("n")).first()["n"]
    hot = found.where("not all").orderBy(F.desc("n"), "word").limit(HOT).select("word").toArrow()["word"].to_numpy()
    return -(total or 0), np.sort(hot.view(np.uint64))


def _shard_of(word: np.ndarray, context: np.ndarray | None, shards: int) -> np.ndarray:
    key = word if context is None else bytetext.mix(word + (context.astype(np.uint64) << np.uint64(20)))
    return ((bytetext.mix(key + np.uint64(11)) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _blob(own: np.ndarray, key: np.ndarray) -> bytes:
    """The distinct words, the pairs of each, the tokens of each pair and the row of each token; key: sorted places
    in own (above bit 32), contexts and rows of the tokens."""
    pair = key >> np.uint64(16)
    new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
    pairs = np.flatnonzero(new_pair)
    word = (pair[pairs] >> np.uint64(16)).astype(np.int64)
    words = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    per_pair, per_word = np.diff(np.append(pairs, len(key))).astype(np.uint32), np.diff(np.append(words, len(pairs))).astype(np.uint32)
    head = np.array([len(words), len(pairs), len(key)], np.uint32)
    return b"".join(x.tobytes() for x in (head, own[word[words]], per_word, pair[pairs].astype(np.uint16), per_pair, key.astype(np.uint16)))


def _pack(word: np.ndarray, context: np.ndarray, doc: np.ndarray, hot: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """A blob for each shard. Hot words are told apart by context, all others are whole in one shard."""
    if not len(word):
        return
    low = context.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64)
    codes, own = pd.factorize(word)
    shard, is_hot = _shard_of(own, None, shards), np.isin(own, hot)
    order = np.lexsort((own, shard, is_hot))
    place = np.empty(len(own), np.uint64)
    place[order] = np.arange(len(own), dtype=np.uint64)
    own, shard, cold = own[order], shard[order], int((~is_hot).sum())
    at = place[codes]
    in_cold = at < cold
    key = np.sort(at[in_cold] << np.uint64(32) | low[in_cold])
    of = shard[(key >> np.uint64(32)).astype(np.int64)]
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    for a, z in zip(edges, np.append(edges[1:], len(of))[: len(edges)], strict=True):
        yield int(of[a]), _blob(own, key[a:z])
    if not in_cold.all():
        at, low, context = at[~in_cold], low[~in_cold], context[~in_cold]
        of = _shard_of(own[at.astype(np.int64)], context, shards)
        for number in np.unique(of):
            some = of == number
            yield int(number), _blob(own, np.sort(at[some] << np.uint64(32) | low[some]))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Word and context of each pair, tokens of each pair, and the row of each token."""
    n_words, n_pairs, n = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    at, out = 12, []
    for kind, count in ((np.uint64, n_words), (np.uint32, n_words), (np.uint16, n_pairs), (np.uint32, n_pairs), (np.uint16, n)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * np.dtype(kind).itemsize
    word, per_word, context, per_pair, doc = out
    return np.repeat(word, per_word), context, per_pair, doc


def _deal(rows: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """shard, piece and blob, dealt out by groups of shards; a blob that begins with D has the piece's rows: doc_ids,
    held-out flags and token numbers. A piece's held-out rows are its last ones, so that one number in each of its other
    blobs, which begin with T, tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_id = TaskContext.get().partitionId() << 24
        for piece in _pieces(batches):
            held = piece.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            order = np.argsort(held, kind="stable")
            piece, held = piece.take(pa.array(order)), held[order]
            word, context, row = _in_slices(piece)
            ids = piece.column(0)
            n = np.bincount(row, minlength=piece.num_rows)
            about = b"".join([np.uint32(piece.num_rows).tobytes(), ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes(), held.tobytes(), n.astype(np.int64).tobytes()])
            head = b"T" + np.uint32(len(held) - held.sum()).tobytes()
            place = int(bytetext.mix(np.array([piece_id], np.uint64))[0]) % shards
            out = [(place, b"D" + about)] + [(s, head + blob) for s, blob in _pack(word, context, row, hot, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([piece_id] * len(out), pa.int64()), pa.array([b for _, b in out], pa.large_binary())], names=["shard", "piece", "blob"])
            piece_id += 1

    return rows.mapInArrow(run, "shard long, piece long, blob binary").repartitionById(-(-shards // GROUP), F.floor(F.col("shard") / GROUP).cast("int"))


class Shard:
    """The pairs of one shard with their training counts, and every token as (piece, row, pair)."""

    def __init__(self, number: int, blobs: list[tuple[int, bytes]]):
        self.number = number
        words, contexts, trained, tokens, self.where = [], [], [], [], []
        for piece, blob in blobs:
            train_rows = int(np.frombuffer(blob, np.uint32, 1, 1)[0])
            word, context, per_pair, doc = _unpack(blob[5:])
            pair = np.repeat(np.arange(len(word)), per_pair)
            words.append(word)
            contexts.append(context)
            trained.append(np.bincount(pair[doc < train_rows], minlength=len(word)))
            tokens.append(per_pair)
            self.where.append((piece, doc))
        word, context, trained = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((words, np.uint64), (contexts, np.uint16), (trained, np.int64)))
        self.words, w = np.unique(word, return_inverse=True)
        key, pair = np.unique(w.astype(np.int64) << CONTEXT_BITS | context, return_inverse=True)
        self.word, self.context = key >> CONTEXT_BITS, key & ((1 << CONTEXT_BITS) - 1)
        self.count = np.bincount(pair, trained, len(key)).astype(np.int64)
        self.c_word = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)
        self.pair_of, at = [], 0
        for per_pair in tokens:
            self.pair_of.append(np.repeat(pair[at : at + len(per_pair)].astype(np.int32), per_pair))
            at += len(per_pair)


@functools.cache
def _log_ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of c customers at t tables, in row c and column t."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, LISTED):
        t = np.arange(1, c + 2)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - discount * t, 1e-300)) + out[c, t])
    return out


def _saddle(c: np.ndarray, strength: np.ndarray, discount: float) -> np.ndarray:
    """w for which strength x (1 - x)^(discount - 1) = c, where x = exp(-w)."""
    low, high = np.full(len(c), -700.0), np.full(len(c), 700.0)
    aim = np.log(c / strength)
    for _ in range(64):
        mid = (low + high) / 2
        w = np.exp(np.minimum(mid, 300))
        above = -w + (discount - 1) * np.log(-np.expm1(-w)) > aim
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.exp((low + high) / 2)


def _chances(c: int, strength: float, w: float, discount: float) -> tuple[int, np.ndarray]:
    """The least number of tables that c customers can be thought to have, and the chances of it and those after it.

    The weight of t tables is strength^t / t! times the coefficient of z^c in ((1 - (1 - z)^discount) / discount)^t. The
    coefficient is a contour integral, here in p = -c log z: along a line through the saddle point c w, or, where that is
    near the branch point 0, along a parabola around it. Sums over NODES points of it are exact but for rounding.
    """
    x, rest = math.exp(-w), -math.expm1(-w)
    phi = 1 - rest**discount
    mean = strength * phi / discount
    around = 9 * math.sqrt(mean)
    low, high = max(1, int(mean - around) - 9), min(c, int(mean + around) + 20)
    t = np.arange(low, high + 1)
    step = np.arange(NODES) + 0.5
    if c * w > 20:
        cross = c * w
        first, second = discount * x * rest ** (discount - 1) / phi, discount * (1 - discount) * x * x * rest ** (discount - 2) / phi
        spread = max(mean, 1.0) * max(second + first - first**2, 1e-12)
        p = cross + 1j * c * step * min(math.pi, 30 / math.sqrt(spread)) / NODES
        turn = np.ones(NODES)
    else:
        cross = max(c * w, 4.0)
        way = 1 + 1j * step * (3 + 8 / cross) / NODES
        p, turn = cross * way**2, way
    at_cross = math.log1p(-((-math.expm1(-cross / c)) ** discount))
    ratio = np.log1p(-((-np.expm1(-p / c)) ** discount)) - at_cross
    held = (np.exp(p - cross + t[:, None] * ratio) * turn).real.sum(axis=1)
    log = t * (math.log(strength / discount) + at_cross) - np.cumsum(np.log(t))
    chance = np.exp(log - log.max()) * np.maximum(held, 0)
    return low, chance / chance.sum()


def draw_tables(count: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The tables at which all customers of each dish sit, drawn from their conditional distribution.

    strength: (theta + d T) P(dish) of each. t tables of c customers have the weight strength^t S(c, t), with the
    generalised Stirling numbers S of the discount: what moves of single customers by the Chinese restaurant rule come
    to in the end. Up to LISTED customers S is listed; beyond, the weights are integrals.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    ways = _log_ways(discount)
    some = np.flatnonzero((count > 1) & (count <= LISTED))
    some = some[np.argsort(count[some], kind="stable")]
    sizes, begin = np.unique(count[some], return_index=True)
    for c, a, z in zip(sizes, begin, np.append(begin[1:], len(some))[: len(sizes)], strict=True):
        t = np.arange(1, c + 1)
        for at in range(a, z, max(1, (1 << 20) // int(c))):
            own = some[at : min(z, at + max(1, (1 << 20) // int(c)))]
            log = np.log(strength[own])[:, None] * t + ways[c, 1 : c + 1]
            sums = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            tables[own] = np.minimum(1 + (sums <= (rng.random(len(own)) * sums[:, -1])[:, None]).sum(axis=1), c)
    many = np.flatnonzero(count > LISTED)
    for i, w in zip(many, _saddle(count[many], strength[many], discount), strict=True):
        low, chance = _chances(int(count[i]), float(strength[i]), float(w), discount)
        tables[i] = low + min(int(np.searchsorted(np.cumsum(chance), rng.random(), side="right")), len(chance) - 1)
    return tables


def _seat_parent(customers: np.ndarray, share: float, total: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish of the parent, given its customers; share: the base probability."""
    strength = np.full(len(customers), (PARENT_STRENGTH + discount * total) * share)
    return draw_tables(customers, strength, discount, rng)


def estimate(ones: np.ndarray) -> tuple[float, float]:
    """Discounts of the contexts and of the parent, in hundredths, from the numbers of pairs with one and two tokens and
    of words with one and two pairs."""
    n1, n2, m1, m2 = (float(x) for x in ones)
    return tuple(round(min(max(a / (a + 2 * b), 0.05), 0.95), 2) if a and b else default for a, b, default in ((n1, n2, DISCOUNT), (m1, m2, PARENT_DISCOUNT)))


def _discounts(counts: dict) -> tuple[float, float]:
    return counts.get("discounts", (DISCOUNT, PARENT_DISCOUNT))


def first_state(counts: dict) -> dict:
    """What the shards share before any sampling: a table for each pair in its context and for each word in the parent."""
    return {"tables": counts["contexts_types"], "customers": max(float(counts["contexts_types"].sum()), 1.0), "seats": float(counts["vocabulary"]), "hot_customers": counts["hot_types"], "hot_seats": np.minimum(counts["hot_types"], 1)}


def chain(shard: Shard, counts: dict, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """SAMPLES states of the chain: tables of each pair, and of each word of the shard in the parent.

    counts: what the first pass found (see _count), and the state of what other shards share, as the last pass left it.
    Words of hot have their parent seats on the driver; here their probability is that of this state.
    """
    rng = np.random.default_rng(shard.number + 1)
    share = 1 / (counts["vocabulary"] + 1)
    discount, upper = _discounts(counts)
    state = counts.get("state") or first_state(counts)
    busy, parent_total = PARENT_STRENGTH + state["customers"], state["seats"]
    is_hot = np.isin(shard.words, hot)
    at = np.searchsorted(hot, shard.words[is_hot])
    several = np.flatnonzero(shard.count > 1)
    # At first, every pair has one table.
    types = np.bincount(shard.word, shard.count > 0, len(shard.words)).astype(np.float64)
    seats = np.minimum(types, 1)
    types[is_hot], seats[is_hot] = state["hot_customers"][at], state["hot_seats"][at]

    def predictive(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (np.maximum(customers - upper * tables, 0) + (PARENT_STRENGTH + upper * parent_total) * share) / busy

    p = predictive(types, seats)
    room = STRENGTH + discount * state["tables"][shard.context[several]]
    rounds = BURN_IN + 1 + THIN * (SAMPLES - 1)
    for r in range(rounds):
        tables = (shard.count > 0).astype(np.int64)
        tables[several] = draw_tables(shard.count[several], room * p[shard.word[several]], discount, rng)
        customers = np.bincount(shard.word, tables, len(shard.words)).astype(np.int64)
        parent = _seat_parent(customers, share, parent_total, upper, rng)
        p = predictive(np.where(is_hot, types, customers), np.where(is_hot, seats, parent))
        if r >= BURN_IN and (r - BURN_IN) % THIN == 0:
            yield tables, parent


def _shards(part) -> Iterator[tuple[Shard, list[tuple[int, bytes]]]]:
    """The shards of a partition, one after the other, and with the first the descriptions of pieces."""
    about: list[tuple[int, bytes]] = []
    held: dict[int, list[tuple[int, bytes]]] = {}
    for row in part:
        blob = bytes(row["blob"])
        if blob[:1] == b"D":
            about.append((row["piece"], blob[1:]))
        else:
            held.setdefault(row["shard"], []).append((row["piece"], blob))
    for number in sorted(held):
        yield Shard(number, sorted(held.pop(number), key=lambda x: x[0])), about
        about = []
    if about:
        yield Shard(-1, []), about


def _added(rdd, make) -> dict[str, np.ndarray]:
    """The sum over all shards of make(shard), arrays of fixed size, added up in chunks of their last axis."""

    def local(part):
        total = None
        for shard, _ in _shards(part):
            one = make(shard)
            total = one if total is None else {k: total[k] + v for k, v in one.items()}
        for name, values in (total or {}).items():
            for at in range(0, max(values.shape[-1], 1), CHUNK):
                yield (name, at), values[..., at : at + CHUNK]

    found: dict[str, list] = {}
    for (name, at), values in rdd.mapPartitions(local).reduceByKey(lambda a, b: a + b).collect():  # arrays of fixed size
        found.setdefault(name, []).append((at, values))
    return {name: np.concatenate([v for _, v in sorted(parts, key=lambda x: x[0])], axis=-1) for name, parts in found.items()}


def _by_hot(shard: Shard, hot: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hot))
    is_hot = np.isin(shard.words, hot)
    out[np.searchsorted(hot, shard.words[is_hot])] = values[is_hot]
    return out


def _count(shard: Shard, hot: np.ndarray) -> dict[str, np.ndarray]:
    known = (shard.c_word > 0) & ~np.isin(shard.words, hot)
    some = shard.count > 0
    types = np.bincount(shard.word, some, len(shard.words))
    return {
        "ones": np.array([(shard.count == 1).sum(), (shard.count == 2).sum(), (types[known] == 1).sum(), (types[known] == 2).sum()], np.float64),
        "contexts": np.bincount(shard.context, shard.count, 1 << CONTEXT_BITS),
        "contexts_types": np.bincount(shard.context, some, 1 << CONTEXT_BITS),
        "words": np.array([known.sum()], np.float64),
        "hot": _by_hot(shard, hot, shard.c_word),
        "hot_types": _by_hot(shard, hot, types),
    }


def _sums(shard: Shard, counts: dict, hot: np.ndarray) -> dict[str, np.ndarray]:
    """For each sample: tables of each context, customers and tables of the parent without hot words, and theirs."""
    contexts, parent, hots = [], [], []
    cold = ~np.isin(shard.words, hot)
    for tables, above in chain(shard, counts, hot):
        customers = np.bincount(shard.word, tables, len(shard.words))
        contexts.append(np.bincount(shard.context, tables, 1 << CONTEXT_BITS))
        parent.append([customers[cold].sum(), above[cold].sum()])
        hots.append(_by_hot(shard, hot, customers))
    return {"contexts": np.array(contexts, np.float64), "parent": np.array(parent, np.float64), "hot": np.array(hots)}


def _score(shard: Shard, counts: dict, sums: dict, hot: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """piece, and for its rows the sums of log10(c + 1), of log10 of the model's probability, and of known tokens."""
    share = 1 / (counts["vocabulary"] + 1)
    discount, upper = _discounts(counts)
    is_hot = np.isin(shard.words, hot)
    at = np.searchsorted(hot, shard.words[is_hot])
    chance = np.zeros(len(shard.word))
    inside = STRENGTH + counts["contexts"][shard.context]
    for s, (tables, above) in enumerate(chain(shard, counts, hot)):
        customers = np.bincount(shard.word, tables, len(shard.words)).astype(np.float64)
        seats = above.astype(np.float64)
        customers[is_hot], seats[is_hot] = sums["hot"][s][at], sums["hot_tables"][s][at]
        all_customers, all_tables = sums["parent"][s]
        p = (customers - upper * seats + (PARENT_STRENGTH + upper * all_tables) * share) / (PARENT_STRENGTH + all_customers)
        chance += (shard.count - discount * tables + (STRENGTH + discount * sums["contexts"][s][shard.context]) * p[shard.word]) / inside
    model = np.log10(chance / SAMPLES)
    c = shard.c_word.astype(np.float64)
    c[is_hot] = counts["hot"][at]
    base, known = np.log10(c + 1)[shard.word], (c > 0)[shard.word]
    for (piece, doc), pair in zip(shard.where, shard.pair_of, strict=True):
        rows = np.flatnonzero(np.bincount(doc))
        yield piece, (rows.astype(np.uint16), *(np.bincount(doc, x[pair])[rows] for x in (base, model, known)))


def score(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows of the held-out fold are scored, not learned from. A null or empty text is its end token alone. Repeated
    rows are learned from and scored as often as they are there; a row with a null doc_id is learned from. Without
    training tokens each token has the uniform probability over the unknown word, 1. Other columns are not read.
    """
    spark = docs.sparkSession
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(key, folds, fold).alias("held"))
    total, hot = _survey(rows)
    n_shards = shards or max(1, math.ceil(total / SHARD_TOKENS))
    dealt = _deal(rows, hot, n_shards).rdd  # one shuffle, whose files all passes read
    counts = _added(dealt, lambda shard: _count(shard, hot)) if total else {}
    if total:
        counts["vocabulary"] = int(counts.pop("words")[0] + (counts["hot"] > 0).sum())
        train_tokens = int(counts["contexts"].sum())
        counts["discounts"] = estimate(counts.pop("ones"))
        rng = np.random.default_rng(0)
        for _ in range(SWEEPS):
            known = spark.sparkContext.broadcast(counts)
            sums = _added(dealt, lambda shard, known=known: _sums(shard, known.value, hot))
            seats = (counts.get("state") or first_state(counts))["seats"]
            sums["hot_tables"] = np.array([_seat_parent(h.astype(np.int64), 1 / (counts["vocabulary"] + 1), seats, counts["discounts"][1], rng) for h in sums["hot"]])
            sums["parent"] += np.column_stack([sums["hot"].sum(axis=1), sums["hot_tables"].sum(axis=1)])
            used, counts = known, counts | {"state": {"tables": sums["contexts"][-1], "customers": sums["parent"][-1, 0], "seats": sums["parent"][-1, 1], "hot_customers": sums["hot"][-1], "hot_seats": sums["hot_tables"][-1]}}
        shared = spark.sparkContext.broadcast(sums)
        below = math.log10(train_tokens + counts["vocabulary"] + 1)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not total:
        return spark.createDataFrame([], schema)

    def parts(part):
        """One packed sum for each piece that has tokens in this partition."""
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for shard, about in _shards(part):
            for piece, blob in about:
                yield piece, b"D" + blob
            for piece, sums_of in _score(shard, used.value, shared.value, hot) if len(shard.word) else ():
                held.setdefault(piece, []).append(sums_of)
        for piece, found in held.items():
            doc, *values = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = np.flatnonzero(np.bincount(doc))
            base, model, seen = (np.bincount(doc, v)[rows] for v in values)
            yield piece, b"S" + np.uint32(len(rows)).tobytes() + rows.astype(np.uint16).tobytes() + base.tobytes() + model.tobytes() + seen.astype(np.uint32).tobytes()

    def documents(part):
        held: dict[int, list] = {}
        for piece, blob in part:
            held.setdefault(piece, []).append(blob)
        for piece in sorted(held):
            blobs = held.pop(piece)
            about = next(b for b in blobs if b[:1] == b"D")[1:]
            n = int(np.frombuffer(about, np.uint32, 1)[0])
            ids, null = np.frombuffer(about, np.int64, n, 4), np.frombuffer(about, np.uint8, n, 4 + 8 * n)
            out, tokens = np.frombuffer(about, np.uint8, n, 4 + 9 * n), np.frombuffer(about, np.int64, n, 4 + 10 * n)
            base, model, seen = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for blob in sorted(b for b in blobs if b[:1] == b"S"):
                m = int(np.frombuffer(blob, np.uint32, 1, 1)[0])
                row = np.frombuffer(blob, np.uint16, m, 5)
                base[row] += np.frombuffer(blob, np.float64, m, 5 + 2 * m)
                model[row] += np.frombuffer(blob, np.float64, m, 5 + 10 * m)
                seen[row] += np.frombuffer(blob, np.uint32, m, 5 + 18 * m)
            base -= tokens * below
            for i in range(n):
                yield None if null[i] else int(ids[i]), bool(out[i]), int(tokens[i]), int(seen[i]), train_tokens, float(base[i]), float(model[i])

    pieces = dealt.mapPartitions(parts).partitionBy(max(-(-n_shards // GROUP), 8), lambda piece: (piece >> 24) * 31 + (piece & 0xFFFFFF)).mapPartitions(documents)
    return spark.createDataFrame(pieces, schema, verifySchema=False)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(table(spark, sf_dir, "documents"))
