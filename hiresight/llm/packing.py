"""Best-fit decreasing packing of tokenized documents into fixed-length sequences.

Documents longer than a sequence are cut into full pieces and a rest. Best-fit decreasing puts
each piece, longest first, into the open sequence with the least room that still takes it. As
lengths are integers up to ``capacity``, pieces of one length are interchangeable, so the packing
is decided on the histogram of lengths (at most ``capacity`` rows, whatever the data): a segment
tree over the remaining capacities finds the tightest open sequences in logarithmic time, and all
equal pieces that go to equal sequences are placed at once. The result is a plan of runs
(length, first rank, first sequence, pieces per sequence, offset); each piece finds its run by
its rank among the pieces of its length. Ranks need no sort: tasks number their own pieces, and
per-task counts give the offsets.

Defined cases: a null or empty text is one piece holding only the end id; repeated documents,
null ids and ties are packed as separate rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import encoder

CAPACITY = 4096
BROADCAST_ROWS = 100_000  # a larger plan is joined by shuffling
SLICE = 4 << 20  # bytes of ids handed on at a time

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


class Tree:
    """Segment tree over capacities 0..n: counts of open sequences, first non-empty one >= c."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.sum = [0] * (2 * self.size)

    def add(self, c: int, by: int) -> None:
        c += self.size
        while c:
            self.sum[c] += by
            c >>= 1

    def first(self, c: int) -> int:
        """Smallest capacity >= c that has an open sequence, or -1."""
        c += self.size
        if self.sum[c]:
            return c - self.size
        while c > 1:
            if c % 2 == 0 and self.sum[c + 1]:  # the right sibling holds larger capacities
                c += 1
                while c < self.size:
                    c = 2 * c if self.sum[2 * c] else 2 * c + 1
                return c - self.size
            c >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, last, sequence, per, offset): the pieces of this length with ranks
    first..last go to sequences from ``sequence`` on, ``per`` to each, starting at ``offset``."""
    tree, open_, used, runs = Tree(capacity), defaultdict(list), 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        at, total = 0, counts[length]
        while at < total:
            room = tree.first(length)
            if room < 0:
                room, first = capacity, used
                n = -(-(total - at) // (capacity // length))
                used += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            per = room // length
            take = min(total - at, n * per)
            runs.append((length, at, at + take - 1, first, per, capacity - room))
            full, rest = divmod(take, per)
            put(room - per * length, first, full)
            put(room - rest * length, first + full, 1 if rest else 0)
            done = full + (rest > 0)
            put(room, first + done, n - done)
            at += take
    return runs


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc, seen = encoder(path), defaultdict(int)
        task = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
        k = 8 if with_ids else 7

        def out(rows):
            cols = list(zip(*rows)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds)], names[:k])

        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids = enc.ids(text.as_py() or "") + tail
                doc_id = doc_id.as_py()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), task, seen[n], own if with_ids else None))
                    seen[n] += 1
                held += len(ids)
                if held > SLICE:  # a task holds one slice of ids, not a whole batch
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: where it comes from (doc_id, piece, start, length, ids_crc32), where it
    goes (sequence_id, offset) and, if asked for, its ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    pieces = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cut(tokenizer, end_id, capacity, with_ids), PIECES + (", ids binary" if with_ids else "")),
        "pack-pieces")
    cells = stage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in  # at most `capacity` rows
              cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    table = spark.createDataFrame(
        runs or [(0, 0, -1, 0, 1, 0)],
        "run_length int, first long, last long, sequence long, per long, room_at long")
    if len(runs) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    placed = ranked.join(table, (F.col("length") == F.col("run_length"))
                         & F.col("rank").between(F.col("first"), F.col("last")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("room_at") + (nth % F.col("per")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, CAPACITY, with_ids=False)
