"""External induced suffix sorting with common-prefix values, for one shard.

Suffixes are classed as in induced sorting: S-type (smaller than the next suffix) or L-type; the
leftmost S-type positions (LMS) are the seeds. Seeds are ordered by a first induction over their
substrings, names, and recursion on the string of names; from sorted seeds, one scan upwards
induces all L-type suffixes and one scan downwards all S-type ones.

A scan takes suffix tuples (position, common prefix with the tuple before) from a priority queue
keyed by first symbol. Induced tuples always belong to the current symbol or a later one and
arrive in sorted order within it, so the queue is a set of first-in-first-out runs, written to
disk beyond a memory budget. Common-prefix values ride along: a tuple induced from position p has
one more than the minimum over the tuples scanned since the last one of its symbol, a range
minimum per batch plus one running minimum per symbol between batches. Values are capped, as only
"at least ``cap``" matters. Text, types and marks are disk-backed arrays; memory holds the queue's
budget and one batch.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import defaultdict, deque

import numpy as np

BATCH = 1 << 18  # tuples scanned at a time
QUEUE = 1 << 18  # tuples a queue holds in memory; a shard's queues get several times as many
BASE = 1 << 22  # names sorted in memory (8 bytes each); longer strings of names recurse


class Scratch:
    """Disk-backed arrays in a folder of the task's own, removed at the end."""

    def __enter__(self):
        self.dir, self.n = tempfile.mkdtemp(prefix="suffix-"), 0
        return self

    def __exit__(self, *_):
        shutil.rmtree(self.dir, ignore_errors=True)

    def path(self) -> str:
        self.n += 1
        return os.path.join(self.dir, str(self.n))

    def array(self, n: int, dtype) -> np.ndarray:
        return np.memmap(self.path(), dtype, "w+", shape=(max(n, 1),))


class Queue:
    """First-in-first-out runs of (position, common prefix) by symbol, on disk beyond a budget."""

    def __init__(self, scratch: Scratch, limit: int):
        self.scratch, self.limit = scratch, limit
        self.runs: dict[int, deque] = defaultdict(deque)
        self.held, self.file = 0, None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.scratch.path(), "w+b")
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for i, run in enumerate(runs):
                if isinstance(run[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(run[0].astype(np.int64).tobytes() + run[1].tobytes())
                    runs[i] = (at, len(run[0]))
        self.held = 0

    def _load(self, run):
        if isinstance(run[0], np.ndarray):
            return run
        at, n = run
        self.file.seek(at)
        raw = self.file.read(9 * n)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)

    def pop(self, symbol: int):
        """The next run of the symbol, or None."""
        runs = self.runs.get(symbol)
        if not runs:
            self.runs.pop(symbol, None)
            return None
        run = runs.popleft()
        if isinstance(run[0], np.ndarray):
            self.held -= len(run[0])
        return self._load(run)

    def batches(self, symbol: int):
        """Runs of the symbol, joined to about BATCH tuples, while more may arrive."""
        while True:
            got, n = [], 0
            while n < BATCH and (run := self.pop(symbol)) is not None:
                got.append(run)
                n += len(run[0])
            if not got:
                return
            yield np.concatenate([p for p, _ in got]), np.concatenate([v for _, v in got])

    def backwards(self, symbol: int):
        runs = self.runs.pop(symbol, ())
        for run in reversed(runs):
            yield self._load(run)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, at most cap."""
    out = np.zeros(len(a), np.int64)
    n = len(text)
    if text.dtype == np.uint16 and n >= 4:  # four symbols at a time, as one 64-bit word
        words = np.ndarray((n - 3,), np.uint64, buffer=text, strides=(2,))
        live, o = np.arange(len(a)), 0
        far = np.maximum(a, b)
        slow = np.zeros(len(a), bool)
        while len(live) and o < cap:
            end = far[live] + o > n - 4
            if end.any():
                slow[live[end]] = True
                live = live[~end]
            diff = words[a[live] + o] ^ words[b[live] + o]
            low = diff & (~diff + np.uint64(1))  # lowest differing bit; 0 if equal
            bits = np.bitwise_count(low - np.uint64(1)) >> 4  # equal symbols, 4 if diff is 0
            out[live] += bits
            live = live[diff == 0]
            o += 4
        rest = np.flatnonzero(slow)
    else:
        rest = np.arange(len(a))
    live, step = rest, np.arange(16)
    for o in range(0, cap, 16):
        if not len(live):
            break
        if o == 0:
            out[live] = 0
        ia, ib = a[live, None] + o + step, b[live, None] + o + step
        same = (text[np.minimum(ia, n - 1)] == text[np.minimum(ib, n - 1)]) & (np.maximum(ia, ib) < n)
        run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        out[live] += run
        live = live[run == 16]
    return np.minimum(out, cap)


class _Minima:
    """Range minima of a batch (sparse table)."""

    def __init__(self, a: np.ndarray):
        self.rows = [a]
        w = 1
        while 2 * w <= len(a):
            r = self.rows[-1]
            self.rows.append(np.minimum(r[:-w], r[w:]))
            w *= 2

    def get(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over lo..hi, both included."""
        k = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for j in np.unique(k):
            at = k == j
            r = self.rows[j]
            out[at] = np.minimum(r[lo[at]], r[hi[at] - (1 << int(j)) + 1])
        return out


class Inducer:
    """Pushes the predecessors of scanned tuples and carries the common-prefix minima."""

    def __init__(self, code, queue: Queue, alphabet: int, want: int, cap: int):
        self.code, self.queue, self.want, self.cap = code, queue, want, cap
        self.low = np.full(alphabet, cap, np.uint8)  # minimum since the symbol's last tuple
        self.seen = np.zeros(alphabet, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """lcp: with the tuple scanned before; the first value refers to the previous batch."""
        prev = np.maximum(pos - 1, 0)
        code = self.code[prev]
        at = np.flatnonzero((code & 1 == self.want) & (pos > 0))
        if not len(at):
            if self.cap:
                np.minimum(self.low, lcp.min(), out=self.low)
            return
        symbol = (code[at] >> 1).astype(np.int64)
        order = np.argsort(symbol.astype(np.uint16) if len(self.low) <= 65536 else symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.empty(len(at), bool)
        first[0] = True
        first[1:] = symbol[1:] != symbol[:-1]
        if not self.cap:  # only the order is asked for
            heads = np.flatnonzero(first)
            back, none = prev[at], np.zeros(len(at), np.uint8)
            for s, a, b in zip(symbol[heads].tolist(), heads.tolist(), np.append(heads[1:], len(at)).tolist()):
                self.queue.push(s, back[a:b], none[a:b])
            return
        lo = np.empty(len(at), np.int64)
        lo[1:] = at[:-1] + 1
        lo[first] = 0
        table = _Minima(lcp)
        m = table.get(lo, at)
        heads = np.flatnonzero(first)
        hs = symbol[heads]
        m[heads] = np.minimum(m[heads], self.low[hs])
        value = np.minimum(m.astype(np.int64) + 1, self.cap).astype(np.uint8)
        value[heads[~self.seen[hs]]] = 0  # nothing of its symbol before it
        self.seen[hs] = True
        # what follows the symbol's last tuple in this batch
        ends = np.append(heads[1:], len(at)) - 1
        np.minimum(self.low, lcp.min(), out=self.low)
        tail = at[ends] + 1
        rest = np.full(len(ends), self.cap, np.uint8)
        more = tail < len(lcp)
        if more.any():
            rest[more] = table.get(tail[more], np.full(int(more.sum()), len(lcp) - 1))
        self.low[hs] = rest
        back = prev[at]
        for s, a, b in zip(hs.tolist(), heads.tolist(), (ends + 1).tolist()):
            self.queue.push(s, back[a:b], value[a:b])


def classify(text: np.ndarray, scratch: Scratch, dtype) -> np.ndarray:
    """symbol * 2 + (1 if S-type), right to left in stretches."""
    n = len(text)
    code = scratch.array(n, dtype)
    after, after_type = -1, 1  # past the end; the last symbol is the unique smallest: S-type
    for hi in range(n, 0, -(BATCH * 4)):
        lo = max(0, hi - BATCH * 4)
        x = np.asarray(text[lo:hi]).astype(np.int64)
        nxt = np.append(x[1:], after)
        kind = np.where(x < nxt, 1, np.where(x > nxt, 0, 2))
        if hi == n:
            kind[-1] = 1
        elif x[-1] == after:
            kind[-1] = after_type
        known = np.flatnonzero(kind < 2)
        fill = np.searchsorted(known, np.arange(hi - lo))
        kind = kind[known[np.minimum(fill, len(known) - 1)]]
        code[lo:hi] = x * 2 + kind
        after, after_type = int(x[0]), int(kind[0])
    return code


def _up(text, code, seeds, seed_lcp, alphabet, cap, scratch, limit):
    """Scan upwards from sorted seeds; returns the L-type tuples by symbol."""
    queue, out = Queue(scratch, limit), Queue(scratch, limit)
    ind = Inducer(code, queue, alphabet, 0, cap)
    sym = text[seeds].astype(np.int64)
    cuts = np.searchsorted(sym, np.arange(alphabet + 1))
    for c in range(alphabet):
        lo, hi = cuts[c], cuts[c + 1]
        if c not in queue.runs and lo == hi:
            continue
        last = None
        for pos, lcp in queue.batches(c):
            out.push(c, pos, lcp)
            ind.scan(pos, lcp)
            last = pos[-1]
        for a in range(lo, hi, BATCH):
            pos, lcp = seeds[a:min(hi, a + BATCH)], seed_lcp[a:min(hi, a + BATCH)].copy()
            if a == lo:
                lcp[0] = 0 if last is None else common(text, np.array([last]), pos[:1], cap)[0]
            ind.scan(pos, lcp)
    queue.close()
    return out


def _down(text, code, ups, alphabet, cap, scratch, limit, visit):
    """Scan downwards; ``visit(pos, lcp)`` gets every suffix from the largest to the smallest,
    lcp being the common prefix with the one before it in this order."""
    queue = Queue(scratch, limit)
    ind = Inducer(code, queue, alphabet, 1, cap)
    n = len(text)
    for c in range(alphabet - 1, -1, -1):
        last = None
        if c == 0:  # the unique last symbol is induced by nothing
            queue.push(0, np.array([n - 1]), np.zeros(1, np.uint8))
        for pos, lcp in queue.batches(c):
            visit(pos, lcp)
            ind.scan(pos, lcp)
            last = pos[-1]
        carry = None  # an L-type tuple's value refers to the smaller one, scanned after it
        for pos, lcp in ups.backwards(c):
            p, v = pos[::-1], np.empty(len(pos), np.uint8)
            v[1:] = lcp[:0:-1]
            v[0] = carry if carry is not None else (
                0 if last is None else common(text, np.array([last]), p[:1], cap)[0])
            carry = lcp[0]
            for a in range(0, len(p), BATCH):
                visit(p[a:a + BATCH], v[a:a + BATCH])
                ind.scan(p[a:a + BATCH], v[a:a + BATCH])
    queue.close()


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, in memory, by their first ``depth`` names."""
    rank, h = names.astype(np.int64), 1
    n = len(rank)
    while True:
        nxt = np.full(n, -1, np.int64)
        if h < n:
            nxt[:-h] = rank[h:]
        key = rank * (int(rank.max()) + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        k = key[order]
        new[order] = np.cumsum(np.append(0, (k[1:] != k[:-1]).astype(np.int64)))
        rank, h = new, 2 * h
        if h >= depth or int(rank.max()) == n - 1:
            return order


def sort(text: np.ndarray, alphabet: int, cap: int, visit, scratch: Scratch, base: int = BASE,
         limit: int = QUEUE) -> None:
    """Visits all suffixes of ``text`` (its last symbol 0, once) in descending order, with the
    capped common prefix of each with the one visited before."""
    n = len(text)
    dtype = np.uint16 if alphabet <= 32768 else np.int64
    code = classify(text, scratch, dtype)
    found = []
    for lo in range(0, n, BATCH * 4):
        c = np.asarray(code[max(lo - 1, 0):lo + BATCH * 4]) & 1
        at = np.flatnonzero((c[1:] == 1) & (c[:-1] == 0)) + 1 + max(lo - 1, 0)
        found.append(at)
    lms = np.concatenate(found) if found else np.zeros(0, np.int64)
    if n == 1:
        visit(np.array([0]), np.zeros(1, np.uint8))
        return
    # order of the LMS substrings: induce from seeds sorted by first symbol only
    sym = text[lms].astype(np.int64)
    rough = lms[np.argsort(sym, kind="stable")]
    ups = _up(text, code, rough, np.zeros(len(rough), np.uint8), alphabet, 0, scratch, limit)
    is_lms = scratch.array(n, np.bool_)
    is_lms[lms] = True
    parts = []
    _down(text, code, ups, alphabet, 0, scratch, limit, lambda pos, _: parts.append(pos[is_lms[pos]]))
    ups.close()
    order = np.concatenate(parts)[::-1]
    # names: equal neighbours share one
    nth = np.searchsorted(lms, order)
    size = np.diff(np.append(lms, n - 1)) + 1
    size[-1] = 1
    same = np.zeros(len(order), bool)
    cand = np.flatnonzero(size[nth[1:]] == size[nth[:-1]]) + 1
    if len(cand):
        want = size[nth[cand]]
        got = common(text, order[cand - 1], order[cand], int(want.max()))
        kinds = code[order[cand - 1]] == code[order[cand]]
        same[cand] = (got >= want) & kinds
    names = np.empty(len(order), np.int64)
    names[nth] = np.cumsum(~same) - 1
    distinct = int(names.max()) + 1
    if distinct < len(names):
        if len(names) <= base:
            sorted_nth = _doubled(names, cap)  # an LMS substring has two symbols or more
        else:
            down = []
            with Scratch() as inner:
                sort(names, distinct, 1, lambda pos, _: down.append(pos.copy()), inner, base, limit)
            sorted_nth = np.concatenate(down)[::-1]
        seeds = lms[sorted_nth]
    else:
        seeds = order
    # common prefixes of neighbouring seeds, from which all others are induced
    lcp = np.zeros(len(seeds), np.uint8)
    for a in range(1, len(seeds), BATCH):
        b = min(len(seeds), a + BATCH)
        lcp[a:b] = common(text, seeds[a - 1:b - 1], seeds[a:b], cap)
    ups = _up(text, code, seeds, lcp, alphabet, cap, scratch, limit)
    _down(text, code, ups, alphabet, cap, scratch, limit, visit)
    ups.close()
