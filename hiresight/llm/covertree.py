"""Hard-negative mining with cover trees over norm-augmented candidates.

Each vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm of its tree, so all
candidates lie on one sphere and a large inner product with a query (whose extra component is 0)
is a small distance. Rows are dealt by hash into blocks of bounded size; in a block every label
with enough rows has a tree of its own and the other labels share one. A tree comes from a
farthest-first traversal: the points of a level (chosen while the farthest point was more than 2^l
away) are more than 2^l apart, every point lies within 2^(l+1) of the level above, and its parent
is its nearest point there. The traversal is stored as an index table and used by both searches.

A node is a point together with its children from one level downwards; its covering radius r is
the largest distance to a point below it. As |q.x - q.c| <= |q| |x - c|, all inner products below a
node lie within |q| r of its centre's. Search descends best-first, the nodes of highest upper bound
first (``STEP`` at a time), and skips nodes whose interval lies outside every window still open: a
window [low, high] closes below the score of its k-th result. Every point reached is scored exactly.

Queries are worked off in batches of at most ``QUERY_BYTES``, which bounds what is broadcast; the
blocks' winners are merged by ranked windows (at most k rows a block and window).

Defined cases: rows with a null id, label or vector or any null or non-finite component take no
part; rows repeating an id are rows of their own (each is an anchor of its own, and a candidate for
the others); shorter vectors count as zero beyond their end; zero or negative positive scores leave
the window [0, 0] or none; anchors without positives or negatives have no rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ROWS = 4_096  # rows of a block
BLOCK_BYTES = 32 << 20  # at most so much of vectors in a block
QUERY_BYTES = 16 << 20  # vectors of one batch of queries
OWN_TREE = 32  # rows that a label needs for a tree of its own in a block
STEP = 64  # nodes opened at a time


def augment(x: np.ndarray) -> np.ndarray:
    """One more component, so that all rows have the norm of the longest."""
    sq = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(sq.max(initial=0.0) - sq, 0.0))])


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, level) of each point of the cover tree; the root is its own parent.

    Copies of a point hang below it on the lowest level.
    """
    n = len(x)
    parent, level = np.zeros(n, np.int32), np.zeros(n, np.int32)
    sq = (x * x).sum(axis=1)
    tiny = 1e-6 * math.sqrt(float(sq.max(initial=0.0))) + 1e-300

    def away(j):
        return np.sqrt(np.maximum(sq + sq[j] - 2 * (x @ x[j]), 0.0))

    root = int(sq.argmax()) if n else 0
    near, dist = np.full(n, root, np.int32), away(root) if n else np.zeros(0)
    left = np.ones(n, bool)
    left[root] = False
    now, above = None, near.copy()
    for _ in range(n - 1):
        j = int(np.where(left, dist, -1.0).argmax())
        if dist[j] <= tiny:
            break
        at = math.ceil(math.log2(dist[j])) - 1
        if at != now:  # the points so far are the level above
            now, above = at, near.copy()
        parent[j], level[j], left[j] = above[j], at, False
        d = away(j)
        closer = d < dist
        dist[closer], near[closer] = d[closer], j
    parent[left], level[left] = near[left], -2000
    parent[root] = root
    level[root] = 2000
    return parent, level


class Forest:
    """The trees of one block, laid out for search. Nodes are (point, level) with a centre, a
    covering radius, the children's points and, among these and itself, the nodes below."""

    def __init__(self, vectors: np.ndarray, tree: np.ndarray, parent: np.ndarray, level: np.ndarray):
        n = len(vectors)
        self.roots, center, radius, points, below = [], [], [], [], []
        for t in np.unique(tree):
            rows = np.flatnonzero(tree == t)
            x = augment(vectors[rows].astype(np.float64))
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            up, lev = place[parent[rows]], level[rows]
            reach: dict = {}  # (point, level of the child) -> largest distance below
            child, walker = np.arange(len(rows)), np.arange(len(rows))
            while len(walker):
                on = up[child] != child
                child, walker = child[on], walker[on]
                if not len(walker):
                    break
                d = np.sqrt(((x[walker] - x[up[child]]) ** 2).sum(axis=1))
                keys = up[child].astype(np.int64) * 8192 + (lev[child] + 4096)
                o = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(keys[o]) != 0])
                for key, far in zip(keys[o][first], np.maximum.reduceat(d[o], first)):
                    reach[key] = max(reach.get(key, 0.0), float(far))
                child = up[child]
            kids: dict = {}
            for i in np.flatnonzero(up != np.arange(len(rows))):
                kids.setdefault(int(up[i]) * 8192 + int(lev[i]) + 4096, []).append(int(i))
            first_node: dict = {}
            for key in sorted(kids):  # per point, lowest level first
                c, far = key // 8192, reach[key]
                lower = first_node.get(c)
                if lower is not None:
                    far = max(far, radius[lower])
                first_node[c] = len(center)
                center.append(int(rows[c]))
                radius.append(far)
                points.append(rows[kids[key]])
                below.append((lower, kids[key], first_node))
            root = int(np.flatnonzero(up == np.arange(len(rows)))[0])
            self.roots.append((int(rows[root]), first_node.get(root, -1)))
        self.center, self.radius = np.array(center, np.int64), np.array(radius)
        self.points = points
        self.nodes = [np.array([*([low] if low is not None else []), *(f[i] for i in kid if i in f)], np.int64)
                      for low, kid, f in below]


def descend(forest: Forest, rows: np.ndarray, ids: np.ndarray, able: np.ndarray, q: np.ndarray,
            low: np.ndarray, high: np.ndarray, k: int) -> list:
    """Per window [low, high]: the k best rows (scores falling, ids rising) among ``able``."""
    norm = math.sqrt(float((q.astype(np.float64) ** 2).sum()))
    slack = 1e-9 * norm * (math.sqrt(float((rows[forest.center].astype(np.float64) ** 2).sum(axis=1).max()))
                           if len(forest.center) else 0.0) + 1e-6
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
    floor = low.astype(np.float64)
    scores = np.zeros(len(rows), np.float64 if rows.dtype == np.float64 else np.int64)

    def offer(points):
        scores[points] = got = rows[points] @ q
        fit = points[able[points] & (got >= floor.min()) & (got <= high.max())]
        if not len(fit):
            return
        s = scores[fit].astype(np.int64)
        for j in range(len(low)):
            mine = (s >= floor[j]) & (s <= high[j])
            if mine.any():
                p, v = np.concatenate([best[j][0], fit[mine]]), np.concatenate([best[j][1], s[mine]])
                top = np.lexsort((ids[p], -v))[:k]
                best[j] = p[top], v[top]
                if len(top) == k:
                    floor[j] = best[j][1][-1]

    def useful(mid, far):
        return ((mid + far >= floor[:, None]) & (mid - far <= high[:, None])).any(axis=0)

    offer(np.array([r for r, _ in forest.roots], np.int64))
    nodes = np.array([n for _, n in forest.roots if n >= 0], np.int64)
    while len(nodes):
        mid, far = scores[forest.center[nodes]].astype(np.float64), norm * forest.radius[nodes] * (1 + 1e-9) + slack
        keep = useful(mid, far)
        nodes, bound = nodes[keep], (mid + far)[keep]
        if not len(nodes):
            break
        if len(nodes) > STEP:
            order = np.argpartition(-bound, STEP)
            now, nodes = nodes[order[:STEP]], nodes[order[STEP:]]
        else:
            now, nodes = nodes, nodes[:0]
        offer(np.concatenate([forest.points[i] for i in now]))
        nodes = np.concatenate([nodes, *[forest.nodes[i] for i in now]])
    return best


def _matrix(column, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    m = np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), at)
    m[rows, np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return m


def index(vectors: DataFrame, width: int) -> DataFrame:
    """``vectors`` (row, id, label, v) with block, place in it, tree, parent and level."""
    size = max(1, min(ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    n_blocks = max(1, -(-vectors.count() // size))

    def run(t: pa.Table) -> pa.Table:
        labels = t.column("label").to_numpy()
        x = _matrix(t.column("v"), width).astype(np.float64)
        values, back, counts = np.unique(labels, return_inverse=True, return_counts=True)
        tree = np.where(counts[back] >= OWN_TREE, back, len(values)).astype(np.int32)
        parent, level = np.zeros(len(t), np.int32), np.zeros(len(t), np.int32)
        for k in np.unique(tree):
            rows = np.flatnonzero(tree == k)
            up, lev = build(augment(x[rows]))
            parent[rows], level[rows] = rows[up], lev
        for name, c in (("place", np.arange(len(t), dtype=np.int32)), ("tree", tree), ("parent", parent),
                        ("level", level)):
            t = t.append_column(name, pa.array(c))
        return t

    blocked = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    kinds = ", ".join(f"{c} {t}" for c, t in blocked.dtypes)
    return blocked.groupBy("block").applyInArrow(
        run, f"{kinds}, place int, tree int, parent int, level int")


def _search(indexed: DataFrame, queries: DataFrame, width: int, same_label: bool, k: int) -> DataFrame:
    """``queries``: row, label, v, windows array<struct<low, high>>. Per query, window and block
    the k best rows: (q, w, row, id, score)."""
    spark = indexed.sparkSession
    asked = stage(queries, "covertree-queries")
    n_batches = max(1, -(-asked.count() * 8 * max(width, 1) // QUERY_BYTES))
    names, kinds = ["q", "w", "row", "id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(shared):
        def search(t: pa.Table) -> pa.Table:
            t = t.sort_by("place")
            x = _matrix(t.column("v"), width)
            row, ids, label = (t.column(c).to_numpy() for c in ("row", "id", "label"))
            tree, parent, level = (t.column(c).to_numpy() for c in ("tree", "parent", "level"))
            q_rows, q_labels, q_v, q_windows = shared.value
            # products in floating point are exact below 2**53; beyond that, integers
            top = float(np.abs(x).max(initial=0)) * float(np.abs(q_v).max(initial=0)) * max(width, 1)
            rows = x.astype(np.float64) if top < 2.0 ** 53 else x
            forest = Forest(x, tree, parent, level)
            out = [[np.zeros(0, np.int64)] for _ in names]
            for i in range(len(q_rows)):
                able = (label == q_labels[i]) == same_label
                able &= row != q_rows[i]
                if not len(q_windows[i]) or not able.any():
                    continue
                low, high = q_windows[i][:, 0], q_windows[i][:, 1]
                for w, (p, s) in enumerate(descend(forest, rows, ids, able, q_v[i].astype(rows.dtype), low, high, k)):
                    for c, v in zip(out, (np.full(len(p), q_rows[i]), np.full(len(p), w), row[p], ids[p], s)):
                        c.append(v)
            return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], names)

        return search

    out = None
    for b in range(n_batches):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_batches)) == b).toArrow()  # one batch: bounded
        windows = [np.array([(x["low"], x["high"]) for x in w], np.int64).reshape(-1, 2)
                   for w in mine.column("windows").to_pylist()]
        shared = spark.sparkContext.broadcast((mine.column("row").to_numpy(), mine.column("label").to_numpy(),
                                               _matrix(mine.column("v"), width), windows))
        got = indexed.groupBy("block").applyInArrow(run(shared), "q long, w int, row long, id long, score long")
        out = got if out is None else out.unionByName(got)
    return out


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``vectors``: id long, label int, v array<long> (see ``usable``); ``anchors``: a condition on
    these columns. A negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    rows = stage(vectors.withColumn("row", F.monotonically_increasing_id()), "covertree-rows")
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    indexed = stage(index(rows, width), "covertree-index")
    asked = rows.where(anchors)
    whole = F.array(F.struct(F.lit(-2 ** 63).cast("long").alias("low"), F.lit(2 ** 63 - 1).cast("long").alias("high")))
    near = _search(indexed, asked.select("row", "label", "v", whole.alias("windows")), width, True, positives)
    first = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    pos = stage(near.withColumn("p", F.row_number().over(first)).where(F.col("p") <= positives)
                .select("q", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                "covertree-positives")
    # whole scores n with low * s <= 100 * n <= high * s: rounded up and down to multiples of 100
    bounds = pos.select("q", "p", F.expr(f"(-(-{low} * positive_score - pmod(-{low} * positive_score, 100L))) div 100").alias("low"),
                        F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100").alias("high"))
    windows = bounds.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("w")) \
        .select("q", F.transform("w", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
    q = asked.join(windows, F.col("row") == F.col("q")).select("row", "label", "v", "windows")
    far = _search(indexed, q, width, False, negatives).withColumn("p", F.col("w") + 1)
    best = Window.partitionBy("q", "p").orderBy(F.desc("score"), "id", "row")
    top = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return top.join(pos, ["q", "p"]).join(asked.select(F.col("row").alias("q"), F.col("id").alias("anchor_id")), "q") \
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))


def usable(table: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, label, v): whole-number vectors floor(scale * x) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"),
                        x.alias("x")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad) \
        .select("id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label", "embedding", 256)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 100 == 0)


OP12_SQL = """
with v as (
  select row_number() over () as r, vec_id as id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select a.r as q, a.id as anchor_id, b.r, b.id, a.label = b.label as same,
         cast(list_dot_product(a.v, b.v) as bigint) as score
  from v a join v b on a.r <> b.r where a.id % 100 = 0),
pos as (select * from (
  select *, row_number() over (partition by q order by score desc, id, r) as p from scored where same) where p <= 5),
neg as (
  select pos.q, pos.p, pos.anchor_id, pos.id as positive_id, pos.score as positive_score, n.id as negative_id,
         n.score as negative_score, row_number() over (partition by pos.q, pos.p order by n.score desc, n.id) as rank
  from pos join scored n on n.q = pos.q and not n.same
    and 80 * pos.score <= 100 * n.score and 100 * n.score <= 100 * pos.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from neg where rank <= 5
"""
