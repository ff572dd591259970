"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is the bitwise majority of its shingles' 64-bit hashes. Two fingerprints within
``max_bits`` differing bits are linked. To find the links, a fingerprint is embedded as the bit
counts of its 32 two-bit segments: flipping one bit moves one count by one, so the Manhattan
distance of two embeddings is a lower bound of the differing bits. The range join under that
distance runs on a grid: the segments are dealt to ``max_bits // 2 + 1`` blocks, so in some block
the embeddings of linked fingerprints are at Manhattan distance 0 or 1. Every fingerprint owns the
grid cell of its counts in each block and also probes the cells one step up; of two fingerprints
one step apart the lower probes the cell of the upper, so each near pair meets exactly there. All
pairs that meet are verified exactly on their bits. A task keeps only a spanning forest of the
links it verifies, so a group of n copies gives fewer than n links; cells owned by more than
``TILE`` fingerprints are split into tiles whose pairs go to different tasks. Components come from
label propagation with pointer jumping over links of distinct fingerprints.

Defined cases: a null or empty text, or one without words, has fingerprint zero, linked like any
other; repeated rows and equal texts share a fingerprint; null ids are never a component's id
unless it has no other; an empty table gives an empty result; other columns are ignored by
``components`` and passed through by ``dedupe``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PRE, stage, text_bytes

TILE = 4096  # fingerprints that own one cell and are compared in one task
PAIRS = 1 << 21  # candidate pairs verified at a time
_EVEN = np.uint64(0x5555555555555555)
_CHUNK = 1 << 16


def fingerprint(raw: bytes, shingle: int) -> int:
    words = raw.lower().split()
    n = len(words)
    if n == 0:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = max(n - shingle + 1, 1)
    starts, ends = starts[:k].tolist(), (ends[shingle - 1:] if n >= shingle else ends[-1:]).tolist()
    h64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, k, _CHUNK):
        h = np.array([h64(text[s:e], 42) for s, e in zip(starts[i:i + _CHUNK], ends[i:i + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
            .sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > k).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(shingle: int):
    """Arrow function: whole text as bytes -> fingerprint as a signed 64-bit integer."""
    def f(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or b"", shingle) for t in texts.to_pylist()], pa.int64())

    f.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, T.LongType()).asNondeterministic()


def _blocks(max_bits: int) -> list[list[int]]:
    return [list(map(int, b)) for b in np.array_split(np.arange(32), min(max_bits // 2 + 1, 32))]


def _cells(max_bits: int, probes: bool):
    """fp -> rows (block, cell, probe, fp): owned cells, or the probed ones."""
    blocks = _blocks(max_bits)
    names = ["block", "cell", "probe", "fp"]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = fp.view(np.uint64)
            counts = (x & _EVEN) + ((x >> np.uint64(1)) & _EVEN)  # 32 counts, packed by two bits
            for k, segments in enumerate(blocks):
                mask = np.uint64(sum(3 << (2 * s) for s in segments))
                cell = counts & mask
                steps = [np.uint64(1 << (2 * s)) for s in segments] if probes else [np.uint64(0)]
                for s in steps:
                    ok = ((cell // s) & np.uint64(3)) < 2 if probes else np.ones(len(fp), bool)
                    own = (cell[ok] + s).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), k, np.int32)), pa.array(own),
                         pa.array(np.full(len(own), probes)), pa.array(fp[ok])], names)

    return run


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, its component's smallest node) of the links u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            keep = lab != np.arange(len(nodes))
            return nodes[keep], nodes[lab[keep]]
        lab = new


def _links(fp: np.ndarray, ends: np.ndarray, owner: np.ndarray, max_bits: int):
    """Verified links as a forest. Rows are sorted by group, owners first; row i is compared with
    the rows after it up to ends[i] if it owns the cell."""
    rows = np.flatnonzero(owner)
    n = ends[rows] - rows - 1
    rows, n = rows[n > 0], n[n > 0]
    upto = np.cumsum(n)
    x = fp.view(np.uint64)
    # slices of rows with about PAIRS pairs; a row longer than that is cut as well
    lo = 0
    while lo < len(rows):
        base = upto[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        r, m = rows[lo:hi], n[lo:hi]
        if len(r) == 1 and m[0] > PAIRS:
            spans = [(np.full(min(PAIRS, int(m[0]) - s), r[0]),
                      r[0] + 1 + np.arange(s, min(s + PAIRS, int(m[0])))) for s in range(0, int(m[0]), PAIRS)]
        else:
            left = np.repeat(r, m)
            right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + left + 1
            spans = [(left, right)]
        for left, right in spans:
            near = np.bitwise_count(x[left] ^ x[right]) <= max_bits
            a, b = fp[left[near]], fp[right[near]]
            a, b = a[a != b], b[a != b]
            if len(a):
                yield forest(a, b)
        lo = hi


def _verify(max_bits: int):
    keys = ["block", "cell", "i", "j"]

    def done(cols):
        size = len(cols["fp"])
        if size < 2:
            return
        new = np.ones(size, bool)
        new[1:] = np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], size), np.diff(np.append(starts, size)))
        for a, b in _links(cols["fp"], ends, ~cols["probe"], max_bits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            cols = {k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                    for k in [*keys, "probe", "fp"]}
            if held is not None:
                cols = {k: np.concatenate([held[k], cols[k]]) for k in cols}
            same = np.logical_and.reduce([cols[k] == cols[k][-1] for k in keys]) if len(cols["fp"]) else []
            last = len(cols["fp"]) - int(np.argmin(same[::-1])) if len(same) and not all(same) else 0
            yield from done({k: v[:last] for k, v in cols.items()})
            held = {k: v[last:] for k, v in cols.items()}
        if held is not None:
            yield from done(held)

    return run


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints (column fp) within max_bits."""
    schema = "block int, cell long, probe boolean, fp long"
    owned = fps.mapInArrow(_cells(max_bits, False), schema)
    hot = stage(owned.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
                .select(F.col("block").alias("hb"), F.col("cell").alias("hc"),
                        F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "simhash-hot")
    rows = owned.union(fps.mapInArrow(_cells(max_bits, True), schema))
    rows = rows.join(hot, (F.col("block") == F.col("hb")) & (F.col("cell") == F.col("hc")), "left")
    tile = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    rows = rows.withColumn("t", tile).withColumn("o", other) \
        .select("block", "cell", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "probe", "fp")
    return rows.repartition("block", "cell", "i", "j") \
        .sortWithinPartitions("block", "cell", "i", "j", "probe") \
        .mapInArrow(_verify(max_bits), "u long, v long")


def label(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: its component's smallest node."""
    both = stage(edges.union(edges.select("v", "u")).distinct(), "simhash-links")
    lab = stage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")), "simhash-labels")
    while True:
        # the smallest label around, then the label of that label
        near = both.join(lab, both["v"] == lab["node"]).groupBy("u").agg(F.min("root").alias("low"))
        new = lab.join(near, lab["node"] == near["u"]) \
            .select("node", F.col("root").alias("was"), F.least("root", "low").alias("low"))
        jump = lab.select(F.col("node").alias("jn"), F.col("root").alias("jr"))
        new = stage(new.join(jump, new["low"] == jump["jn"])
                    .select("node", "was", F.least("low", "jr").alias("root")), "simhash-labels")
        changed = new.where("root <> was").limit(1).count()
        lab = new.select("node", "root")
        if not changed:
            return lab


def _roots(owned: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``owned``."""
    fps = stage(owned.select("fp").distinct(), "simhash-distinct")
    lab = label(stage(links(fps, max_bits), "simhash-forest"))
    return fps.join(lab, fps["fp"] == lab["node"], "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    own = stage(docs.select("doc_id", fingerprints(shingle)(text_bytes()).alias("fp")), "simhash-fp")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = stage(least.join(_roots(own, max_bits), "fp"), "simhash-roots")
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stage(roots.join(ids, "root").select(F.col("fp").alias("f"), "component_id"), "simhash-ids")
    return own.join(by_fp, own["fp"] == by_fp["f"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedupe(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each component (the smallest doc_id), columns unchanged."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"),
                         F.lit(":").cast("binary"), text_bytes()))
    own = stage(docs.select("doc_id", key.alias("k"), fingerprints(shingle)(text_bytes()).alias("fp")),
                "simhash-fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k")
    least = own.groupBy("fp").agg(F.min(order).alias("o"))
    roots = least.join(_roots(own, max_bits), "fp")
    kept = stage(roots.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.k").alias(f"{PRE}kept")),
                 "simhash-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{PRE}row"),
                       key.alias(f"{PRE}k"))
    return rows.join(kept, F.col(f"{PRE}k") == F.col(f"{PRE}kept"), "left_semi") \
        .dropDuplicates([f"{PRE}k"]).select(f"{PRE}row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, max_bits=4)
