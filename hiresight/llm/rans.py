"""Token ids as a binary format: static range asymmetric numeral system (rANS).

One frequency table, counted over all documents and scaled to 2**18, serves every block. A block
holds whole documents in ascending doc_id order and is independent of all others. Its ids are
dealt over interleaved lanes (id i to lane i mod lanes), each an own 64-bit rANS state, so a numpy
step codes all lanes at once; states shrink and grow by 32-bit words in one shared stream. Every
``EVERY`` steps the block keeps a checkpoint (lane states, stream position) from which decoding
can start, so parts of a block decode in parallel; a crc32 covers the block, another its ids.

Blocks are rows of Parquet files (Spark's commit protocol makes a lost executor harmless, and any
store Spark writes to will do); the table and the part sizes lie beside them.

Payload, little endian: magic "RNS1", ids n (u64), lanes (u32), checkpoints k (u32), words m (u64),
crc32 of the ids (u32); k rows of (stream position u64, lanes x state u64); m words (u32).

Defined cases: a null or empty text is only the end id; repeated documents and ids are kept as
separate rows, a null id sorts first; ties in doc_id are ordered by length and checksum; an empty
table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices, stage
from .tokens import encoder

BITS = 18  # frequencies sum to 2**BITS
LANES = 1024
EVERY = 256  # steps between checkpoints
BLOCK = 1 << 20  # a block is closed at this many ids
PART = 1 << 23  # ids of a file, about
PIECE = 4 << 20  # bytes of texts taken from an Arrow batch at a time
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sQIIQI")


def scale(counts: np.ndarray) -> np.ndarray:
    """Frequencies summing to 2**BITS, at least 1 for every id that occurs."""
    total, room = int(counts.sum()), 1 << BITS
    if total == 0:
        return np.zeros(len(counts), np.uint64)
    if int((counts > 0).sum()) > room:
        raise ValueError("more distinct ids than the table has slots")
    f = np.where(counts > 0, np.maximum(counts * (room / total), 1).astype(np.int64), 0)
    over = int(f.sum()) - room
    if over < 0:
        f[np.argmax(f)] -= over
    while over > 0:  # taken from the largest, in proportion
        cut = np.minimum(f - 1, (f * (over / f.sum())).astype(np.int64) + 1) * (f > 1)
        order = np.argsort(-f, kind="stable")
        take = np.minimum(np.cumsum(cut[order]), over)
        f[order] -= np.diff(take, prepend=0)
        over = int(f.sum()) - room
    return f.astype(np.uint64)


class Table:
    """The shared frequency table with the lookups of coder and decoder."""

    def __init__(self, freqs: np.ndarray):
        self.f = freqs.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs.astype(np.int64))
        self.slot_f = self.f[self.symbol]
        self.slot_b = np.arange(len(self.symbol), dtype=np.uint64) - self.c[self.symbol]


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = min(LANES, max(1, n // 64))
    steps = -(-n // lanes)
    f, c = table.f[ids], table.c[ids]
    x = np.full(lanes, _LOW, np.uint64)
    words, marks, at = [], [], 0  # at: words emitted so far, from the stream's end
    for t in range(steps - 1, -1, -1):
        ft, ct = f[t * lanes:(t + 1) * lanes], c[t * lanes:(t + 1) * lanes]
        y = x[:len(ft)]  # the last step may be short; a view
        big = y >= ft << np.uint64(63 - BITS)
        if big.any():
            out = y[big]
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
            at += len(out)
            y[big] = out >> np.uint64(32)
        q, r = np.divmod(y, ft)
        y[:] = (q << np.uint64(BITS)) + r + ct
        if t % EVERY == 0:
            marks.append((at, x.copy()))
    body = b"".join(w.tobytes() for w in reversed(words))
    points = b"".join(struct.pack("<Q", at - a) + s.astype("<u8").tobytes() for a, s in reversed(marks))
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEAD.pack(b"RNS1", n, lanes, len(marks), at, crc) + points + body


def decode_block(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids between checkpoints ``first`` and ``last`` (all by default)."""
    magic, n, lanes, k, m, crc = _HEAD.unpack_from(payload)
    if magic != b"RNS1":
        raise ValueError("not a block")
    size = 8 + 8 * lanes
    last = k if last is None else last
    words = np.frombuffer(payload, "<u4", m, _HEAD.size + k * size).astype(np.uint64)
    if first >= last:
        return np.zeros(0, np.uint32)
    off = _HEAD.size + first * size
    pos = struct.unpack_from("<Q", payload, off)[0]
    x = np.frombuffer(payload, "<u8", lanes, off + 8).astype(np.uint64)
    begin, end = first * EVERY * lanes, min(n, last * EVERY * lanes)
    slots = np.empty(end - begin, np.uint32)
    mask, bits, half = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for at in range(0, end - begin, lanes):
        own = slots[at:at + lanes]
        y = x[:len(own)]
        s = y & mask
        own[:] = s
        y >>= bits
        y *= table.slot_f[s]
        y += table.slot_b[s]
        low = np.flatnonzero(y < _LOW)
        if len(low):
            y[low] = (y[low] << half) | words[pos:pos + len(low)]
            pos += len(low)
    ids = table.symbol[slots]
    if first == 0 and last == k and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of the ids differs")
    return ids


TOKENS = "doc_id long, n_tokens long, crc long, ids binary"


def _tokenize(path: str, end_id: int):
    """A row per document, and one with n_tokens -1 that holds the task's counts of all ids."""
    tail = end_id.to_bytes(4, "little")
    names = ["doc_id", "n_tokens", "crc", "ids"]

    def run(batches):
        enc, counts = encoder(path), np.zeros(1, np.int64)
        for b in (s for whole in batches for s in slices(whole, PIECE)):
            raws = [enc.ids(text or "") + tail for text in b.column(1).to_pylist()]
            if not raws:
                continue
            ids = np.frombuffer(b"".join(raws), "<u4")
            sizes = np.array([len(r) // 4 for r in raws])
            c = np.bincount(ids, minlength=len(counts))
            c[:len(counts)] += counts
            counts, width = c, 2 if ids.max() < 1 << 16 else 4
            ends = np.concatenate([[0], np.cumsum(sizes * width)]).astype("<i4")
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(sizes, pa.int64()), pa.array(map(zlib.crc32, raws), pa.int64()),
                pa.Array.from_buffers(pa.binary(), len(raws), [None, pa.py_buffer(ends), pa.py_buffer(
                    ids.astype(f"<u{width}"))])], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
             pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    return run


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _histogram(batches):
    for b in batches:
        for raw in b.column(0).to_pylist():
            counts = np.frombuffer(raw, "<i8")
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                                             ["id", "n"])


def _encode(freqs: np.ndarray):
    names = ["part", "block", "n_ids", "crc", "doc_ids", "lengths", "payload"]

    def run(batches):
        table, part, block = Table(freqs), TaskContext.get().partitionId(), 0
        docs, sizes, held, total = [], [], [], 0

        def close():
            payload = encode_block(np.concatenate(held), table)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([total], pa.int64()),
                 pa.array([zlib.crc32(payload)], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names)

        for b in batches:
            for doc, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                docs.append(doc)
                sizes.append(n)
                held.append(_wide(raw, n))
                total += n
                if total >= BLOCK:
                    yield close()
                    docs, sizes, held, total, block = [], [], [], 0, block + 1
        if docs:
            yield close()

    return run


BLOCKS = "part int, block int, n_ids long, crc long, doc_ids array<long>, lengths array<long>, payload binary"


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encodes every whole text into block files below ``path``/blocks, with ``path``/table."""
    spark = docs.sparkSession
    every = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
                  .mapInArrow(_tokenize(tokenizer, end_id), TOKENS), "rans-ids")
    ids = every.where("n_tokens >= 0")
    table = every.where("n_tokens < 0").select("ids").mapInArrow(_histogram, "id long, n long") \
        .groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row per vocabulary entry
    counts = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64)
    for r in table:
        counts[r["id"]] = r["n"]
    freqs = scale(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freqs)], "id int, freq int") \
        .coalesce(1).write.parquet(f"{path}/table")
    parts = max(1, int(counts.sum()) // PART)
    order = ["doc_id", "n_tokens", "crc"]
    ids.repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .mapInArrow(_encode(freqs), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _decode(freqs: np.ndarray, with_ids: bool):
    names = ["part", "block", "nth", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][:8 if with_ids else 7]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        table = Table(freqs)
        for b in batches:
            for r in b.to_pylist():
                if zlib.crc32(r["payload"]) != r["crc"]:
                    raise ValueError(f"block {r['part']}/{r['block']}: checksum differs")
                raw = memoryview(decode_block(r["payload"], table).astype("<u4").tobytes())
                rows, at = [], 0
                for k, (doc, n) in enumerate(zip(r["doc_ids"], r["lengths"])):
                    own = raw[4 * at:4 * (at + n)]
                    row = (r["part"], r["block"], k, doc, at, n, zlib.crc32(own))
                    rows.append((*row, bytes(own)) if with_ids else row)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    table = spark.read.parquet(f"{path}/table").orderBy("id").collect()  # vocabulary-sized
    freqs = np.array([r["freq"] for r in table], np.uint64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = blocks.select("part", "block", "n_ids")
    # parts are numbered in doc_id order; one row per part, then one per block of a part
    per_part = size.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = (Window.unboundedPreceding, -1)
    base = per_part.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    first = size.join(base, "part").select("part", "block", (F.col("base") + F.coalesce(
        F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*before)),
        F.lit(0))).alias("first"))
    rows = "part int, block int, nth int, doc_id long, within long, n_tokens long, ids_crc32 long"
    out = blocks.mapInArrow(_decode(freqs, with_ids), rows + ", ids binary" * with_ids)
    return out.join(first, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def op7_rans_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, f"rans-{uuid.uuid4().hex[:12]}")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"),
          public_tokenizers.path("byte_bpe_50k.json"), 0, path)
    return read(spark, path, with_ids=False)
