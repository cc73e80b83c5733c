"""Suffix sorting by external induced sorting, with common-prefix values.

A text is taken as runs of one symbol. A suffix is L if what follows its first run is smaller than that run's symbol, S
if greater. The S suffixes that follow an L one (the stars) are sorted first: their stretches up to the next star are
sorted and named, and if two have one name the string of names is sorted by recursion, unless it is short. From the stars one
sweep by rising symbols induces all L suffixes, and a second one by falling symbols induces all S suffixes from these.

A sweep drains a priority queue of suffix tuples (symbol, symbols left of its run, order of the suffix behind the run,
run). What has been drained enters the tuples of the runs before it. Symbols whose tuples depend on none of their own
batch are drained together. The length of the prefix that a suffix has in common with the one before goes with it: of
two tuples it is what is left of their runs, and where that is equal, that and the least value between the orders of the
suffixes behind. Queues and sequences over a limit are kept in unlinked files, sorted runs of them in the queue's case,
so that memory follows the limit and the largest batch.
"""

from __future__ import annotations

import tempfile

import numpy as np

from ledgerlark.llm.bytetext import BASE, BASE_INV, mix

#: The longest stretches, in symbols, that are sorted directly; longer ones are sorted by two sweeps.
LONG = 512
#: Strings of names that are short enough to be sorted in memory, by doubling, instead of by another recursion.
SHORT = 1 << 19
#: Bytes beyond which a queue's run, or a sequence, is kept on disk; sorted runs of a queue before some are merged,
#: with few batches and with many.
LIMIT, FAN = 64 << 20, (64, 16)


def _store(n: int, dtype, limit: int) -> np.ndarray:
    """An array in memory, or in a file that goes with it."""
    if n * np.dtype(dtype).itemsize <= limit:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


class Queue:
    """A priority queue of tuples whose first field is the priority. Priorities only rise from pop to pop; tuples of one
    priority come out as they came in."""

    def __init__(self, limit: int, fan: int):
        self.runs: list[list] = []
        self.limit, self.fan = limit, fan

    def push(self, *fields: np.ndarray) -> None:
        if not len(fields[0]):
            return
        order = np.argsort(fields[0], kind="stable")
        kept = []
        for f in fields:
            held = _store(len(f), f.dtype, self.limit // 4)
            np.take(f, order, out=held)
            kept.append(held)
        self.runs.append([0, kept])
        if len(self.runs) > self.fan:  # the last ones, so that runs stay in the order in which they came
            some, self.runs = self.runs[-self.fan // 2 :], self.runs[: -self.fan // 2]
            self.push(*[np.concatenate([r[1][i][r[0] :] for r in some]) for i in range(len(kept))])

    def pop(self, upto) -> list[np.ndarray]:
        """All tuples of a priority of at most upto, by priority."""
        parts = []
        for run in self.runs:
            at, fields = run
            if fields[0][at] <= upto:
                end = at + int(fields[0][at:].searchsorted(upto, "right"))
                parts.append([f[at:end] for f in fields])
                run[0] = end
        if not parts:
            return [np.zeros(0, np.int32)] * 4
        self.runs = [r for r in self.runs if r[0] < len(r[1][0])]
        out = [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
        # By symbol, then what is left; orders behind rise already.
        key = out[0] if out[1].max() == 1 else out[0].astype(np.int64) << 32 | out[1]
        if key.min() != key.max():
            order = np.argsort(key, kind="stable")
            out = [x[order] for x in out]
        return out


def _batches(s: np.ndarray, kind: np.ndarray, n_symbols: int) -> list[int]:
    """Last symbols of batches: no run of a batch is followed by a run of the same batch."""
    behind = np.full(n_symbols, -1, s.dtype)
    r = np.flatnonzero(kind[:-1])
    np.maximum.at(behind, s[r], s[r + 1])
    ends, first = [], 0
    for c, b in enumerate(behind.tolist()):
        if b >= first and c > first:
            ends.append(c - 1)
            first = c
    return [*ends, n_symbols - 1] if n_symbols else []


def _sweep(s: np.ndarray, length: np.ndarray, kind: np.ndarray, fixed: tuple[np.ndarray, ...], n_symbols: int, seed: int | None, cap: int, limit: int) -> tuple[np.ndarray, ...]:
    """run, left and common of all suffixes in order: the fixed ones (run, left, common), which are in order, and those
    of the runs of the kind, which are induced and come before the fixed ones of their symbol. Element 0 is the text's end."""
    total = 1 + len(fixed[0]) + int(length[kind].sum())
    run, left = _store(total, length.dtype, limit), _store(total, length.dtype, limit)
    common = _store(total if cap else 0, np.uint8, limit)
    run[0], left[0] = -1, 0
    common[:1] = 0
    batches = _batches(s, kind, n_symbols)
    queue, done, taken = Queue(limit, FAN[len(batches) > FAN[0]]), 1, 0
    fixed_symbol = s[fixed[0]]

    def induce(order: np.ndarray, of: np.ndarray) -> None:
        n = length[of]
        if len(n) and n.max() > 1:
            each = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
            queue.push(np.repeat(s[of], n), each.astype(length.dtype), np.repeat(order, n), np.repeat(of, n))
        else:
            queue.push(s[of], n, order, of)

    if seed is not None:
        induce(np.zeros(1, length.dtype), np.array([seed], length.dtype))
    for last in np.array(batches, s.dtype):
        symbol, rest, behind, own = queue.pop(last)
        to = int(fixed_symbol.searchsorted(last, "right"))
        n = len(own) + to - taken
        if not n:
            continue
        f_run, f_left = fixed[0][taken:to], fixed[1][taken:to]
        here_run, here_left, here_symbol = np.concatenate([own, f_run]), np.concatenate([rest, f_left]), np.concatenate([symbol, fixed_symbol[taken:to]])
        induced = np.arange(n) < len(own)
        if len(own) and to > taken and symbol[-1] > fixed_symbol[taken]:  # of one symbol, the induced ones come first already
            order = np.argsort(here_symbol, kind="stable")
            here_run, here_left, here_symbol, induced = here_run[order], here_left[order], here_symbol[order], induced[order]
        run[done : done + n], left[done : done + n] = here_run, here_left
        if cap:
            value = np.zeros(n, np.int64)
            if len(own):
                # The least value between the orders of the suffixes behind two neighbours, both of one symbol and length.
                pair = np.flatnonzero((symbol[1:] == symbol[:-1]) & (rest[1:] == rest[:-1]))
                if len(pair):
                    same = np.zeros(len(own), np.int64)
                    same[pair + 1] = _least_between(common[:done], behind[pair].astype(np.int64) + 1, behind[pair + 1].astype(np.int64) + 1)
                    of_own = np.zeros(len(own), np.int64)
                    of_own[pair + 1] = rest[pair + 1] + same[pair + 1]
                else:
                    of_own = np.zeros(len(own), np.int64)
                other = np.flatnonzero((symbol[1:] == symbol[:-1]) & (rest[1:] != rest[:-1])) + 1
                of_own[other] = np.minimum(rest[other], rest[other - 1])
                value[induced] = of_own
            value[~induced] = fixed[2][taken:to]
            turn = np.flatnonzero(induced[:-1] & ~induced[1:]) + 1
            value[turn] = np.minimum(here_left[turn], here_left[turn - 1])
            value[1:][here_symbol[1:] != here_symbol[:-1]] = 0
            value[0] = 0
            common[done : done + n] = np.minimum(value, cap)
        start = np.flatnonzero((here_left == length[here_run]) & (here_run > 0))
        start = start[kind[here_run[start] - 1]]
        induce((start + done).astype(length.dtype), here_run[start] - 1)
        done, taken = done + n, to
    return run, left, common


def _least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[begin:end] of each pair; pairs that follow each other share their ends."""
    out = np.empty(len(begin), np.int64)
    # Pairs of one symbol and length have rising orders, so one reduction gives all of a stretch.
    cut = np.flatnonzero(begin[1:] != end[:-1]) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(begin)), strict=True):
        out[a:b] = np.minimum.reduceat(values[: end[b - 1]], begin[a:b])
    return out


def _common_of(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many bytes the suffixes at a and at b have in common, up to cap."""
    padded = np.concatenate([text, np.zeros(cap + 8, np.uint8)])
    words = np.ndarray((len(text) + cap + 1,), "<u8", padded, strides=(1,))
    out, open_ = np.full(len(a), cap, np.int64), np.arange(len(a))
    for k in range(0, cap, 8):
        differ = words[a[open_] + k] ^ words[b[open_] + k]
        low = differ & (~differ + np.uint64(1))
        ends = np.flatnonzero(differ)
        out[open_[ends]] = k + (np.log2(low[ends].astype(np.float64)).astype(np.int64) >> 3)
        open_ = np.delete(open_, ends)
        if not len(open_):
            break
    return np.minimum(out, np.minimum(cap, len(text) - np.maximum(a, b)))


def _hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of the text."""
    n = len(text) + 1
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INV, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _sorted_stretches(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches in order, and whether each differs from the one before. Symbols are packed into words, and only
    stretches that are equal so far are looked at in the next word. The text's end is smaller than any symbol; what another
    stretch has behind its end is greater: of two of which one begins with the other, the longer one goes on with a falling run."""
    top = int(text.max()) + 2
    bits = next(b for b in (8, 10, 12, 16, 21, 32) if top < 1 << b)
    per, n = 64 // bits, len(begin)
    order, fresh = np.arange(n), np.zeros(n, bool)
    fresh[:1] = True
    open_ = np.arange(n)  # places in order that are not told apart yet
    at = 0
    while len(open_):
        who = order[open_]
        word = np.zeros(len(who), np.uint64)
        from_, to = begin[who] + at, end[who]
        for k in range(per):
            where = from_ + k
            symbol = np.where(where < to, text[np.minimum(where, len(text) - 1)].astype(np.int64) + 1, np.where(to < len(text), top, 0))
            word = (word << np.uint64(bits)) | symbol.astype(np.uint64)
        group = np.cumsum(fresh[open_])
        by = np.argsort(word, kind="stable") if at == 0 else np.lexsort((word, group))
        order[open_] = who[by]
        word, group, done = word[by], group[by], (from_ + per > to)[by]
        fresh[open_[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        at += per
        alone = fresh[open_] & np.append(fresh[open_[1:]], True)
        open_ = open_[~(done | alone)]
    return order, fresh


def _doubled(names: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a short string in order: ranks by 1, 2, 4, ... symbols, until all differ."""
    rank, step = names.astype(np.uint64), 1
    while True:
        key = rank << np.uint64(32)
        key[:-step] |= rank[step:] + np.uint64(1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.append(True, key[1:] != key[:-1])
        if fresh.all():
            return order
        rank = np.empty(len(names), np.uint64)
        rank[order] = np.cumsum(fresh) - 1
        step *= 2


def suffix_order(text: np.ndarray, cap: int = 0, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in order, and how many symbols each has in common with the one before, up to cap (at most
    255; 0: none are given). Symbols are whole numbers from 0; the end of the text is smaller than all. For a text of bytes."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    if n == 0:
        return np.zeros(0, kind), np.zeros(0, np.uint8)
    if text.dtype == np.uint8:
        present = np.zeros(256, np.int64)
        present[np.unique(text)] = 1
        symbols = (np.cumsum(present) - 1).astype(np.int32)
        n_symbols = int(present.sum())
    else:
        symbols, n_symbols = None, int(text.max()) + 1
    at = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1]).astype(kind)
    length = np.diff(np.append(at, n)).astype(kind)
    s = text[at].astype(np.int32) if symbols is None else symbols[text[at]]
    rises = np.append(s[:-1] < s[1:], False)
    star = np.concatenate([[False], rises[1:] & ~rises[:-1]])
    stars = np.flatnonzero(star).astype(kind)

    def sweeps(sorted_stars: np.ndarray, star_common: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
        run, left, common = _sweep(s, length, ~rises, (sorted_stars, length[sorted_stars], star_common), n_symbols, len(s) - 1, cap, limit)
        falling = np.flatnonzero(~rises[run[1:]]) + 1
        before = np.append(common[falling[1:]], 0).astype(np.uint8)[::-1] if cap else np.zeros(0, np.uint8)
        fixed = (run[falling[::-1]], left[falling[::-1]], before)
        run, left, common = _sweep(n_symbols - 1 - s, length, rises, fixed, n_symbols, None, cap, limit)
        return run[:0:-1], left[:0:-1], np.append(0, common[:1:-1]).astype(np.uint8) if cap else common

    order = stars
    if len(stars) > 1:
        ends = np.append(at[stars[1:]] + 1, n).astype(np.int64)  # with the next star's first symbol; the last one is like no other
        begin = at[stars].astype(np.int64)
        if (ends - begin).max() <= LONG:
            place, fresh = _sorted_stretches(text if symbols is None else symbols[text], begin, ends)
            order = stars[place]
        else:
            run, left, _ = sweeps(stars[np.argsort(s[stars], kind="stable")], np.zeros(0, np.uint8), 0)
            order = run[(left == length[run]) & star[run]]
            place = np.searchsorted(stars, order)
            begin, ends = begin[place], ends[place]
            h = _hashes(text, begin, ends)
            fresh = np.append(True, (h[1:] != h[:-1]) | (np.diff(ends - begin) != 0))
        fresh[1:] |= (place[1:] == len(stars) - 1) | (place[:-1] == len(stars) - 1)
        names = np.cumsum(fresh) - 1
        if names[-1] + 1 < len(stars):
            named = np.empty(len(stars), np.int32)
            named[place] = names
            order = stars[_doubled(named) if len(named) <= SHORT else suffix_order(named, 0, limit)[0]]
    star_common = np.zeros(0, np.uint8)
    if cap:
        star_common = np.append(0, _common_of(text, at[order[:-1]].astype(np.int64), at[order[1:]].astype(np.int64), cap))[: len(order)]
    run, left, common = sweeps(order, star_common, cap)
    return at[run] + length[run] - left, common
