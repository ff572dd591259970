"""Exact removal of repeated byte strings with external suffix arrays.

Every byte covered by a ``length``-byte string that also starts elsewhere is removed. The suffixes
of the corpus are dealt to shards by content, so that equal strings meet, and each shard is sorted
by external induced suffix sorting (``suffix.py``):

1. *Anchors.* Each ``length``-byte window has an anchor, its ``ANCHOR``-byte substring of least
   hash (the leftmost on ties). Equal windows have equal anchors at equal places. Consecutive
   windows with the same anchor occurrence form a segment. A window whose anchor hash occurs in
   only one segment of the corpus is not repeated; its segment goes no further. This is exact:
   an anchor shared by chance only costs work.
2. *Hot anchors.* Equal segments are one row with its uses counted, so thousands of copies cost
   one. An anchor that more than ``SPLIT`` different segments share is extended: each segment is
   cut into the windows that reach far to the anchor's left and those that reach far to its
   right, with a correspondingly longer anchor, until groups are small or anchors are whole windows.
3. *Shards.* Segments are partitioned by anchor, concatenated on the task's disk and suffix-sorted
   with common-prefix values; neighbouring suffixes that share ``length`` bytes are marked. A
   window is repeated if it is marked or its segment has several uses; an anchor all of whose
   segments have several uses has nothing left to find and is not sorted.
4. Marked windows become byte ranges per text; texts occurring twice or more are ranges as a whole
   if they have a window at all. Texts cross the shuffle compressed and once per distinct text.

Texts are judged as UTF-8 bytes on the input. Defined cases: a null text is empty; texts shorter
than ``length`` keep everything; repeated rows are copies like any other, each judged to repeat;
ids are not looked at, so null or repeated ids change nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffix
from .common import slices, stage, text_bytes

LENGTH = 200
ANCHOR = 64
SPLIT = 1024  # different segments of one anchor
SHARD = 1 << 20  # bytes of segments in a shard, about
SHARDS = 20_000  # tasks at most; beyond, shards grow and their sorting moves to disk
CHUNK = 1 << 20  # windows whose anchors are found at a time
PIECE = 4 << 20  # bytes of Arrow data turned into Python objects at a time

_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(out)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def anchor_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every k-byte substring."""
    n = len(x)
    up, down = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[x] * up, out=c[1:])
    h = (c[k:] - c[:-k]) * down[:n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def segments(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR):
    """(hash, first window, windows, anchor offset from the first window) of the text's segments."""
    out = [[], [], [], []]
    total = len(raw) - length + 1
    w = length - anchor + 1  # anchors of a window
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, total, CHUNK):
        n = min(CHUNK, total - at)  # windows here
        h = anchor_hashes(data[at:at + n + length - 1], anchor)
        m = len(h)  # n + w - 1
        # the place breaks ties to the left
        key = (h & ~np.uint64(CHUNK * 2 - 1)) | np.arange(m, dtype=np.uint64)
        blocks = -(-m // w)
        pad = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        pad[:m] = key
        grid = pad.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[w - 1:w - 1 + n])
        place = (least & np.uint64(CHUNK * 2 - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out[0].append(h[place[first]])
        out[1].append(first + at)
        out[2].append(np.diff(np.append(first, n)))
        out[3].append(place[first] - first)
    if not out[0]:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(x) for x in out]


# ---- per text

def _anchors(batches):
    """Segments of each text. Of copies within a task only the first carries them: a copied text is
    removed as a whole, and for what it shares with other texts one occurrence is enough."""
    seen = set()  # digests of the task's texts
    for b in (s for whole in batches for s in slices(whole, PIECE)):
        rows = []
        for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            k = hashlib.md5(raw).digest()
            h, first, n, off = segments(b"" if k in seen else raw)
            seen.add(k)
            rows.append((doc_id, k, len(raw), hashlib.sha256(raw).hexdigest(), h.view(np.int64), first, n, off))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                 pa.list_(pa.int16()), pa.list_(pa.int16())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         ["doc_id", "k", "n_bytes", "sha", "h", "first", "n", "off"])


def _digest(key: int, content: bytes) -> bytes:
    return hashlib.md5(key.to_bytes(8, "little", signed=True) + content).digest()


SEGMENT = "key long, digest binary, content binary, off int, alen int, n int"
_SEG = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]


def _cut(batches):
    """Compressed texts with their candidate segments -> segment rows with their use (k, at)."""
    names = ["key", "digest", "content", "off", "alen", "n", "k", "at"]
    unpack = zstandard.ZstdDecompressor()
    for b in (s for whole in batches for s in slices(whole, PIECE // 4)):
        rows = []
        for k, z, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = unpack.decompress(z)
            for s in segs:
                content = raw[s["first"]:s["first"] + s["n"] - 1 + LENGTH]
                rows.append((s["h"], _digest(s["h"], content), content, s["off"], ANCHOR, s["n"], k, s["first"]))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [*_SEG, pa.binary(), pa.int64()])], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [*_SEG, pa.binary(), pa.int64()])], names)


def _extend(batches):
    """Segments of hot anchors -> their two halves with longer anchors, and the shift of each."""
    names = ["key", "digest", "content", "off", "alen", "n", "parent", "shift"]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            slack = LENGTH - r["alen"]
            half = -(-slack // 2)
            # window w has off - w bytes left of the anchor
            left = min(max(r["off"] - half + 1, 0), r["n"])
            for lo, hi, a, size in ((0, left, r["off"] - half, r["alen"] + half),
                                    (left, r["n"], r["off"], r["alen"] + slack - half + 1)):
                if hi <= lo:
                    continue
                size = min(size, LENGTH)
                content = r["content"][lo:hi - 1 + LENGTH]
                key = int.from_bytes(hashlib.md5(bytes([lo == 0 and left > 0]) + r["content"][a:a + size])
                                     .digest()[:8], "little", signed=True)
                rows.append((key, _digest(key, content), content, a - lo, size, hi - lo, r["digest"], lo))
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [*_SEG, pa.binary(), pa.int64()])], names)


def marked_windows(contents, counts, length: int = LENGTH) -> list[np.ndarray]:
    """Per segment the flags of its windows that occur elsewhere in the shard. Contents stream to
    disk; what memory holds is one number per segment and the sorter's budget."""
    with suffix.Scratch() as scratch:
        path, starts, total = scratch.path(), [], 0
        with open(path, "wb") as f:
            for c in contents:
                starts.append(total)
                x = np.frombuffer(c, np.uint8).astype(np.uint16) + 2
                f.write(x.tobytes() + b"\x01\x00")
                total += len(c) + 1
            f.write(b"\x00\x00")
        text = np.memmap(path, np.uint16, "r", shape=(total + 1,))
        mark = scratch.array(total + 1, np.bool_)
        before = [-1]

        def visit(pos, lcp):
            hit = np.flatnonzero(lcp >= length)
            if len(hit):
                mark[pos[hit]] = True
                prev = np.append(before[0], pos[:-1])
                mark[prev[hit]] = True
            before[0] = int(pos[-1])

        suffix.sort(text, 258, length, visit, scratch)
        return [np.array(mark[s:s + n]) for s, n in zip(starts, counts)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _shard(batches):
    """Segment rows of one shard -> (digest, repeated windows as from, to)."""
    digests, counts, solid = [], [], []

    def contents():
        for b in batches:
            digests.extend(b.column(0).to_pylist())
            counts.extend(b.column(2).to_pylist())
            solid.extend(b.column(3).to_pylist())
            yield from b.column(1).to_pylist()

    # the flags are asked for after all contents are read
    flags = marked_windows(contents(), counts)
    rows = []
    for d, f, known in zip(digests, flags, solid):
        if not known:  # all windows of the others are repeated anyway
            rows.extend((d, a, b) for a, b in _ranges(f))
    for i in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows[i:i + 50_000]), [pa.binary(), pa.int32(), pa.int32()])], ["digest", "lo", "hi"])


def _remove(with_text: bool):
    """Compressed texts with ranges of repeated windows -> what is left of them."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in (s for whole in batches for s in slices(whole, PIECE // 4)):
            rows, marks = [], b.column(2)
            cuts, ranges = marks.offsets.to_numpy(), marks.values
            los, his = (ranges.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k, z, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), cuts[:-1], cuts[1:]):
                raw = unpack.decompress(z)
                covered = np.zeros(len(raw) + 1, np.int32)
                np.add.at(covered, los[i:j], 1)
                np.add.at(covered, his[i:j] - 1 + LENGTH, -1)
                gone = np.cumsum(covered[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((k, int(gone.sum()), len(_ranges(gone)), hashlib.sha256(kept).hexdigest(),
                             kept if with_text else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()])],
                ["k", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


@F.arrow_udf(T.BinaryType())
def _compress(texts: pa.Array) -> pa.Array:
    z = zstandard.ZstdCompressor(level=5)
    return pa.array([z.compress(t or b"") for t in texts.to_pylist()], pa.binary())


# ---- the operator

def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    the remaining bytes (``kept``)."""
    own = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).mapInArrow(
        _anchors, "doc_id long, k binary, n_bytes long, sha string, h array<long>, first array<int>, "
                  "n array<short>, off array<short>"), "sa-anchors")
    one = own.select("k", F.explode(F.arrays_zip("h", "first", "n", "off")).alias("s"))
    several = own.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")) \
        .where("c > 1").select(F.col("h").alias("shared"))
    wanted = one.join(several, F.col("s.h") == F.col("shared"), "left_semi") \
        .groupBy("k").agg(F.collect_set("s").alias("segs"))  # at most a text's segments
    texts = docs.select(text_bytes().alias("raw")).select(
        F.unhex(F.md5("raw")).alias("k"), _compress("raw").alias("z")).dropDuplicates(["k"])
    cut = stage(texts.join(wanted, "k").mapInArrow(_cut, SEGMENT + ", k binary, at long"), "sa-segments")

    uses, segs = cut.select("digest", "k", "at"), cut.select("key", "digest", "content", "off", "alen", "n")
    parts, used = [], []
    while True:
        segs = stage(segs.dropDuplicates(["key", "digest"]), "sa-distinct")
        hot = stage(segs.where(F.col("alen") < LENGTH).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
                    .where(F.col("c") > SPLIT).select(F.col("key").alias("hot")), "sa-hot")
        if not hot.limit(1).count():
            parts.append(segs)
            used.append(uses)
            break
        parts.append(segs.join(hot, F.col("key") == F.col("hot"), "left_anti"))
        split = stage(segs.join(hot, F.col("key") == F.col("hot"), "left_semi")
                      .mapInArrow(_extend, SEGMENT + ", parent binary, shift long"), "sa-extended")
        links = split.select("parent", "shift", F.col("digest").alias("child"))
        used.append(uses.join(links, F.col("digest") == F.col("parent"), "left_anti"))
        uses = stage(uses.join(links, F.col("digest") == F.col("parent"))
                     .select(F.col("child").alias("digest"), "k", (F.col("at") + F.col("shift")).alias("at")), "sa-uses")
        segs = split.drop("parent", "shift")
    leaves, places = parts[0], used[0]
    for p, u in zip(parts[1:], used[1:]):
        leaves, places = leaves.union(p), places.union(u)
    places = stage(places, "sa-places")
    twice = places.groupBy(F.col("digest").alias("d")).agg((F.count(F.lit(1)) > 1).alias("solid"))
    flags = stage(leaves.select("key", "digest", "n").join(twice, F.col("digest") == F.col("d")).drop("d"), "sa-flags")
    open_ = flags.groupBy("key").agg(F.bool_and("solid").alias("done"), F.sum(F.col("n") + LENGTH).alias("bytes")) \
        .where("not done")
    open_ = stage(open_.select(F.col("key").alias("open"), "bytes"), "sa-open")
    shards = min(SHARDS, max(1, int((open_.agg(F.sum("bytes")).first()[0] or 0) // SHARD)))
    rows = leaves.join(open_, F.col("key") == F.col("open"), "left_semi") \
        .join(flags.select(F.col("digest").alias("d"), "solid"), F.col("digest") == F.col("d")) \
        .select("digest", "content", "n", "solid", "key")
    sorted_ = rows.repartition(shards, "key").drop("key").mapInArrow(_shard, "digest binary, lo int, hi int")
    found = stage(sorted_.union(flags.where("solid").select("digest", F.lit(0).alias("lo"), F.col("n").alias("hi"))),
                  "sa-found")
    marks = places.join(found, "digest").groupBy("k").agg(F.collect_list(F.struct(
        (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))).alias("marks"))
    rest = stage(texts.join(marks, "k").mapInArrow(
        _remove(with_text), "k binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
        .select("k", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])), "sa-rest")
    copies = own.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    by_text = copies.join(rest, "k", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    out = own.select("doc_id", F.col("k").alias("own"), "n_bytes", "sha").join(by_text, F.col("own") == F.col("k")).select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        # null: nothing was removed, the text is kept as it is
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []))
    return out


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
