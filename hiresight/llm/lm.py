"""Document log-likelihood under a gated recurrent language model, trained and applied in numpy.

*Vocabulary.* Word counts over all training documents come from one aggregation. The ``DIRECT``
most frequent words are modelled one by one, in frequency classes of about equal mass; all other
words fall into eight shape classes (non-ASCII, final punctuation, digits or symbols) and within
their class follow add-one unigram counts, unknown words included, so probabilities sum to one.

*Model.* A gated recurrent unit reads the embedding of the token before; the output softmax is
factored: class given state, then word given class and state. Documents run in parallel lanes;
the state starts at zero with each document and is carried across windows to its end, so every
token of a whole text is scored in its full context.

*Training.* Every task runs truncated back-propagation (windows of ``WINDOW`` steps, Adagrad) over
its own training documents, starting from the shared parameters; the tasks' parameters are
averaged by their tokens, in slices, so no task holds all of them. Round r of ``ROUNDS`` takes the
documents whose hash falls to r, so each training document is used exactly once.

*Scoring.* Tasks hold the counts of the ``HEAD`` most frequent words (a fixed bound). The other
words of a document are looked up by a join with the whole count table.

Defined cases: a null or empty text is the end token alone; a null id counts as the empty string
for the split; repeated rows are scored separately (and counted separately in training); an empty
training set gives a uniform model; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_bytes

HEAD = 65_536  # words whose counts every task holds
HEAD_BYTES = 256  # longer words are always joined
DIRECT = 4_096  # words modelled one by one
CLASSES = 64
SHAPES = 8
BUCKETS = 64  # input embeddings shared by all other words
STATE = 16
WINDOW = 32
LANES = 128  # documents trained side by side: with WINDOW, the tokens of one update
WIDE = 512  # documents scored side by side
BUFFER = 1 << 22  # tokens laid out at a time
PIECE = 4 << 20  # bytes of texts taken from an Arrow batch at a time
KNOWN = 400_000  # words a task has looked up
ROUNDS = 2
RATE = 0.15
SLICES = 16
END = b""  # the end token; no word is empty


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


_SIGNS = b"0123456789#*$%&|<>@+=/"


def shape(word: bytes) -> int:
    return 4 * (not word.isascii()) + 2 * (word[-1:] in b".,;:!?") + (len(word.translate(None, _SIGNS)) < len(word))


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split() + [END]


class Vocabulary:
    """What every task knows: head counts, classes, and the totals of the shape classes."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int,
                 rest: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.base_norm = math.log10(total + distinct + 1)
        words = [w for w, _ in head]
        if END not in words[:DIRECT]:  # the end token is always modelled
            head = [(END, dict(head).get(END, 0))] + [x for x in head if x[0] != END]
        self.counts = dict(head)
        direct = head[:DIRECT]
        self.index = {w: i for i, (w, _) in enumerate(direct)}
        n = np.array([c + 1 for _, c in direct], float)
        mass = np.cumsum(n) / n.sum()
        # classes of about equal mass, in order of frequency
        cls = np.minimum((mass - n / n.sum() / 2) * CLASSES, CLASSES - 1).astype(int)
        _, cls = np.unique(cls, return_inverse=True)
        self.cls = cls
        self.first = np.searchsorted(cls, np.arange(cls.max() + 2))
        self.n_cls = int(cls.max()) + 1
        self.counts_direct = n
        self.rest_n = np.zeros(SHAPES)
        self.rest_v = np.zeros(SHAPES)
        for s, (c, v) in rest.items():
            self.rest_n[s], self.rest_v[s] = c, v
        self.rest_norm = np.log10(self.rest_n + self.rest_v + 1)

    def lookup(self) -> "Lookup":
        if "_lookup" not in self.__dict__:
            self._lookup = Lookup(self)
        return self._lookup

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "_lookup"}


class Lookup(dict):
    """Word -> number of what is known of it: arrays with input, class, word, and scores. Words
    outside the head differ only by shape and input bucket."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        d, words = len(v.index), list(v.counts)
        self.tail = len(words)
        self.update(zip(words, range(self.tail)))
        n = self.tail + SHAPES * BUCKETS
        self.ins, self.cls, self.out = (np.zeros(n, np.int16) for _ in range(3))
        self.known, self.base, self.inside = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        for i, w in enumerate(words):
            c = v.counts[w]
            self.known[i], self.base[i] = c > 0, math.log10(c + 1) - v.base_norm
            j = v.index.get(w, -1)
            self.out[i] = j
            if j >= 0:
                self.ins[i], self.cls[i] = j, v.cls[j]
            else:
                s = shape(w)
                self.ins[i], self.cls[i] = d + zlib.crc32(w) % BUCKETS, v.n_cls + s
                self.inside[i] = math.log10(c + 1) - v.rest_norm[s]
        for s in range(SHAPES):
            at = slice(self.tail + s * BUCKETS, self.tail + (s + 1) * BUCKETS)
            self.ins[at], self.cls[at], self.out[at] = d + np.arange(BUCKETS), v.n_cls + s, -1
            self.base[at], self.inside[at] = -v.base_norm, -v.rest_norm[s]

    def __missing__(self, w: bytes) -> int:
        i = self.tail + shape(w) * BUCKETS + zlib.crc32(w) % BUCKETS
        if len(self) < KNOWN and len(w) < 48:
            self[w] = i
        return i

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def initial(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; the output biases start at the unigram model."""
    r = np.random.default_rng(seed)
    h, d, c = STATE, len(v.index), v.n_cls + SHAPES
    mass = np.concatenate([np.bincount(v.cls, v.counts_direct, v.n_cls), v.rest_n + v.rest_v + 1])
    inside = v.counts_direct / np.bincount(v.cls, v.counts_direct, v.n_cls)[v.cls]
    p = {"E": r.normal(0, 0.3, (d + BUCKETS, h)), "Wx": r.normal(0, 0.3, (h, 3 * h)),
         "U": r.normal(0, 0.3, (h, 3 * h)), "b": np.zeros(3 * h),
         "C": r.normal(0, 0.05, (h, c)), "cb": np.log(mass / mass.sum()),
         "W": r.normal(0, 0.05, (d, h)), "wb": np.log(inside)}
    p["b"][:h] = 1.0  # keep the state at first
    return {k: x.astype(np.float32) for k, x in p.items()}


def lanes(known: Lookup, docs: list, width: int):
    """Documents (word numbers) dealt to parallel lanes, longest first to the shortest lane.
    Returns steps x lanes arrays: input, class, word, document (-1: padding), start flags."""
    width = max(1, min(width, len(docs)))
    heap, lists = [(0, i) for i in range(width)], [[] for _ in range(width)]
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        n, i = heapq.heappop(heap)
        lists[i].append(k)
        heapq.heappush(heap, (n + len(docs[k]), i))
    steps = max(n for n, _ in heap)
    x, c, w = (np.zeros((steps, width), np.int16) for _ in range(3))  # all below DIRECT + BUCKETS
    doc, start = np.full((steps, width), -1, np.int32), np.zeros((steps, width), bool)
    for i, ks in enumerate(lists):
        ids = np.concatenate([docs[k] for k in ks])
        sizes = np.array([len(docs[k]) for k in ks])
        n = len(ids)
        # each token follows the one before; a document follows the end token of another
        x[1:n, i], x[0, i] = known.ins[ids[:-1]], known.ins[known[END]]
        c[:n, i], w[:n, i], doc[:n, i] = known.cls[ids], known.out[ids], np.repeat(ks, sizes)
        start[np.cumsum(sizes) - sizes, i] = True
    return x, c, w, doc, start


def _sigmoid(a):
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def forward(p, x, start, h, keep=False, into=None):
    """States after each step; ``h`` is carried in and out. With keep, also what backward needs:
    per step the state before, both gates, the candidate and its recurrent part. ``into``: the
    gates' input for each token, where the parameters stay the same."""
    t, b = x.shape
    n = STATE
    a = p["E"][x.ravel()] @ p["Wx"] + p["b"] if into is None else into[x.ravel()]
    a = a.reshape(t, b, 3 * n)
    hs = np.empty((t, b, n), np.float32)
    held = [np.empty((t, b, k), np.float32) for k in (n, 2 * n, n, n)] if keep else None
    fresh, u_mat = start.any(axis=1), p["U"]
    for i in range(t):
        if fresh[i]:
            h = h * ~start[i][:, None]
        u = h @ u_mat
        g = a[i, :, :2 * n]
        g += u[:, :2 * n]
        g = _sigmoid(g)
        un = u[:, 2 * n:]
        m = g[:, n:] * un
        m += a[i, :, 2 * n:]
        np.tanh(m, out=m)
        if keep:
            held[0][i], held[1][i], held[2][i], held[3][i] = h, g, m, un
        new = h - m
        new *= g[:, :n]
        new += m
        hs[i] = h = new
    return hs, h, held


def _picked(s, at):
    """Log-softmax of the rows at the picked columns, and the unscaled softmax with its sums;
    ``s`` is overwritten."""
    s -= s.max(axis=1, keepdims=True)
    rows = (np.arange(len(s)), at)
    logs = s[rows]
    np.exp(s, out=s)
    total = s.sum(axis=1, keepdims=True)
    return logs - np.log(total[:, 0]), s, total, rows


def _by_class(v, cls):
    """(class, rows) of the directly modelled targets; ``cls`` is sorted."""
    ends = np.searchsorted(cls, np.arange(v.n_cls + 1))
    for c in range(v.n_cls):
        if ends[c + 1] > ends[c]:
            yield c, slice(ends[c], ends[c + 1])


def log_probs(p, v, hs, cls, out):
    """Natural log-probability of each target; of shape-class targets only the class's."""
    order = np.argsort(cls, kind="stable")
    hs, cls, out = hs[order], cls[order], out[order]
    res = _picked(hs @ p["C"] + p["cb"], cls)[0].astype(np.float64)
    for c, rows in _by_class(v, cls):
        lo, hi = v.first[c], v.first[c + 1]
        if hi - lo > 1:
            res[rows] += _picked(hs[rows] @ p["W"][lo:hi].T + p["wb"][lo:hi], out[rows] - lo)[0]
    back = np.empty_like(res)
    back[order] = res
    return back


def gradients(p, v, x, cls, out, ok, start, h):
    """Gradients of the mean negative log-likelihood over one window, and the state after it."""
    t, b = x.shape
    n = STATE
    hs, h_out, held = forward(p, x, start, h, keep=True)
    flat = hs.reshape(t * b, n)
    rows = np.flatnonzero(ok.ravel())
    rows = rows[np.argsort(cls.ravel()[rows], kind="stable")]
    hr, cr, wr = flat[rows], cls.ravel()[rows], out.ravel()[rows]
    g = {k: np.zeros_like(a) for k, a in p.items()}
    logs, soft, total, at = _picked(hr @ p["C"] + p["cb"], cr)
    loss = -logs.sum()
    soft /= total
    soft[at] -= 1
    g["C"], g["cb"] = hr.T @ soft, soft.sum(axis=0)
    dh = soft @ p["C"].T
    for c, k in _by_class(v, cr):
        lo, hi = v.first[c], v.first[c + 1]
        if hi - lo < 2:
            continue
        hk = hr[k]
        logs, e, total, at = _picked(hk @ p["W"][lo:hi].T + p["wb"][lo:hi], wr[k] - lo)
        loss -= logs.sum()
        e /= total
        e[at] -= 1
        g["W"][lo:hi], g["wb"][lo:hi] = e.T @ hk, e.sum(axis=0)
        dh[k] += e @ p["W"][lo:hi]
    dout = np.zeros((t * b, n), np.float32)
    dout[rows] = dh
    dout = dout.reshape(t, b, n)
    before, gates, cand, rec = held
    z, r = gates[:, :, :n], gates[:, :, n:]
    by_cand = (1 - z) * (1 - cand * cand)  # of the output by the candidate's argument
    by_keep = (before - cand) * z * (1 - z)
    by_reset = rec * r * (1 - r)
    da = np.empty((t, b, 3 * n), np.float32)  # by the input's part of the gates
    du = np.empty((t, b, 3 * n), np.float32)  # by the state's part
    back, fresh, ut = np.zeros((b, n), np.float32), start.any(axis=1), np.ascontiguousarray(p["U"].T)
    for i in range(t - 1, -1, -1):
        d = dout[i]
        d += back
        dm = d * by_cand[i]
        v_ = du[i]
        np.multiply(d, by_keep[i], out=v_[:, :n])
        np.multiply(dm, by_reset[i], out=v_[:, n:2 * n])
        np.multiply(dm, r[i], out=v_[:, 2 * n:])
        da[i, :, 2 * n:] = dm
        d *= z[i]
        back = v_ @ ut
        back += d
        if fresh[i]:
            back *= ~start[i][:, None]
    da[:, :, :2 * n] = du[:, :, :2 * n]
    g["U"] = before.reshape(t * b, n).T @ du.reshape(t * b, 3 * n)
    da = da.reshape(t * b, 3 * n)
    e = p["E"][x.ravel()]
    g["Wx"], g["b"] = e.T @ da, da.sum(axis=0)
    dx = da @ p["Wx"].T
    order = np.argsort(x.ravel(), kind="stable")
    ids = x.ravel()[order]
    firsts = np.flatnonzero(np.diff(ids, prepend=-1))
    g["E"][ids[firsts]] = np.add.reduceat(dx[order], firsts, axis=0)
    scale = 1.0 / max(len(rows), 1)
    return {k: a * scale for k, a in g.items()}, h_out, float(loss), len(rows)


def train(p, v, docs, memory):
    """One pass over the documents; p and the Adagrad sums are updated in place."""
    x, c, w, doc, start = lanes(v.lookup(), docs, LANES)
    h, loss, n = np.zeros((x.shape[1], STATE), np.float32), 0.0, 0
    for i in range(0, len(x), WINDOW):
        j = slice(i, i + WINDOW)
        ok = doc[j] >= 0
        live = ok.any(axis=0)  # lanes that have ended drop out
        g, h2, add, m = gradients(p, v, x[j][:, live], c[j][:, live], w[j][:, live], ok[:, live],
                                  start[j][:, live], h[live])
        h[live] = h2
        loss, n = loss + add, n + m
        norm = math.sqrt(sum(float((a * a).sum()) for a in g.values()))
        cut = min(1.0, 1.0 / (norm + 1e-9))
        for k, a in g.items():
            if cut < 1:
                a *= cut
            memory[k] += a * a
            p[k] -= RATE * a / np.sqrt(memory[k])
    return loss, n


def score(p, v, docs) -> np.ndarray:
    """Natural log-likelihood per document; shape-class words contribute their class only."""
    x, c, w, doc, start = lanes(v.lookup(), docs, WIDE)
    into = p["E"] @ p["Wx"] + p["b"]
    total, h = np.zeros(len(docs)), np.zeros((x.shape[1], STATE), np.float32)
    for i in range(0, len(x), WINDOW):
        j = slice(i, i + WINDOW)
        live = (doc[j] >= 0).any(axis=0)
        hs, h2, _ = forward(p, x[j][:, live], start[j][:, live], h[live], into=into)
        h[live] = h2
        d = doc[j][:, live].ravel()
        ok = np.flatnonzero(d >= 0)
        lp = log_probs(p, v, hs.reshape(-1, STATE)[ok], c[j][:, live].ravel()[ok], w[j][:, live].ravel()[ok])
        total += np.bincount(d[ok], lp, len(docs))
    return total


# ---- Spark

def _count(batches):
    """(word, shape, n) of the training documents, pre-aggregated in the task."""
    names = ["word", "shape", "n"]

    def out(seen):
        words = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([shape(w) for w in words], pa.int32()),
             pa.array(list(seen.values()), pa.int64())], names)

    seen: Counter = Counter()
    for b in (s for whole in batches for s in slices(whole, PIECE)):
        for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not held_out(doc_id):
                seen.update(tokens(raw))
                if len(seen) > 600_000:
                    yield out(seen)
                    seen = Counter()
    yield out(seen)


def _buffers(batches, known: Lookup, keep, tails: bool):
    """Lists of (doc_id, word numbers, words outside the head if asked for) of about BUFFER tokens."""
    held, n = [], 0
    for b in (s for whole in batches for s in slices(whole, PIECE)):
        for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if keep(doc_id):
                words = tokens(raw)
                ids = known.encode(words)
                rest = np.flatnonzero(ids >= known.tail).tolist() if tails else ()
                held.append((doc_id, ids, [words[i] for i in rest]))
                n += len(ids)
                if n >= BUFFER:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _pack(p) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(flat: np.ndarray, like) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at:at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def _train_task(shared, turn: int):
    def run(batches):
        v, p = shared.value
        p = {k: a.copy() for k, a in p.items()}
        memory = {k: np.full_like(a, 1e-3) for k, a in p.items()}
        n = 0
        for held in _buffers(batches, v.lookup(),
                             lambda d: not held_out(d) and zlib.crc32(f"r{d}".encode()) % ROUNDS == turn,
                             tails=False):
            _, m = train(p, v, [ids for _, ids, _ in held], memory)
            n += m
        if n:
            flat = _pack(p)
            cuts = np.array_split(flat, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * SLICES, pa.int32()),
                 pa.array([float(n)] * SLICES, pa.float64()),
                 pa.array([c.astype("<f4").tobytes() for c in cuts], pa.binary())], ["slice", "part", "n", "w"])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total = pdf["n"].sum()
    w = sum(np.frombuffer(x, "<f4").astype(float) * n for x, n in zip(pdf["w"], pdf["n"])) / total
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [total],
                         "w": [w.astype("<f4").tobytes()]})


def vocabulary(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The whole count table (word, shape, n), and the bounded part that tasks hold."""
    table = stage(docs.mapInArrow(_count, "word binary, shape int, n long")
                  .groupBy("word", "shape").agg(F.sum("n").alias("n")), "lm-counts")
    # the head: words from a frequency band up, so that at most HEAD rows leave the executors
    short = table.where(F.length("word") <= HEAD_BYTES).withColumn("band", F.floor(F.log2("n") * 64))
    bands = sorted(((r["band"], r["v"]) for r in short.groupBy("band").agg(  # some 4,000 at most
        F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    kept, least = 0, None
    for band, n in bands:
        kept += n
        if kept > HEAD:
            break
        least = band
    rows = short.where(F.col("band") >= least).select("word", "n").collect() if least is not None else []
    head = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    direct = {w for w, _ in head[:DIRECT]}
    sums = {r["shape"]: [r["n"], r["v"]] for r in table.groupBy("shape").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, distinct = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    for w, n in head:
        if w in direct or w == END:  # what is modelled directly leaves its shape class
            sums[shape(w)][0] -= n
            sums[shape(w)][1] -= 1
    return table, Vocabulary(head, total, distinct, {s: tuple(x) for s, x in sums.items()})


def fit(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters trained on every training document."""
    sc = docs.sparkSession.sparkContext
    p = initial(v)
    for turn in range(ROUNDS):
        shared = sc.broadcast((v, p))  # bounded by HEAD, DIRECT and STATE
        kind = "slice int, part int, n double, w binary"
        own = docs.mapInArrow(_train_task(shared, turn), kind)
        mean = own.groupBy("slice", "part").applyInPandas(_average, kind) \
            .groupBy("slice").applyInPandas(_average, kind)
        got = {r["slice"]: np.frombuffer(r["w"], "<f4") for r in mean.collect()}  # one model
        if got:
            p = _unpack(np.concatenate([got[k] for k in sorted(got)]), p)
    return p


SCORED = "task int, nth long, doc_id long, held_out boolean, n_tokens long, known long, base double, lm double, " \
         "tail array<binary>"


def _score_task(shared):
    def run(batches):
        v, p = shared.value
        known, task, nth = v.lookup(), TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(),
                 pa.float64(), pa.list_(pa.binary())]
        for held in _buffers(batches, known, lambda d: True, tails=True):
            lm = score(p, v, [ids for _, ids, _ in held]) / math.log(10)
            rows = []
            for (doc_id, ids, tail), s in zip(held, lm):
                rows.append((task, nth, doc_id, held_out(doc_id), len(ids), int(known.known[ids].sum()),
                             float(known.base[ids].sum()), float(s + known.inside[ids].sum()), tail))
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def evaluate(docs: DataFrame) -> DataFrame:
    """One row per document: token counts, add-one unigram score and the model's score (log10)."""
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    table, v = vocabulary(own)
    p = fit(own, v)
    scored = stage(own.mapInArrow(_score_task(sc.broadcast((v, p))), SCORED), "lm-scored")
    tail = scored.select("task", "nth", F.explode("tail").alias("w")) \
        .groupBy("task", "nth", "w").agg(F.count(F.lit(1)).alias("k"))
    found = tail.join(table.select("word", "n"), F.col("w") == F.col("word")) \
        .groupBy("task", "nth").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"),
                                    F.sum("k").alias("more"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("tail").join(found, ["task", "nth"], "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("lm") + logs).alias("score"))


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return evaluate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
