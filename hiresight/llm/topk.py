"""Exact top-k search by Fagin's threshold algorithm.

Vectors are cut into blocks of about ``ROWS`` rows and queries into blocks of about ``QUERIES``;
every pair of blocks meets in one task of bounded size. There, each dimension has a list of the
block's rows sorted by that component. A query walks all lists in parallel from their best end
(from the top where its own component is positive, from the bottom where it is negative), scores
every row it meets by random access to the whole vector, and stops when the bound on all rows not
yet met, the query's product with the components reached, is below its k-th score; on a tie it
goes on, as an unmet row might have the smaller id. Lists are walked in doubling stretches. The
blocks' winners are merged by a ranked window, which keeps k rows per query and task before its
shuffle.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows with a
null id, take no part; rows repeating an id are rows of their own (each a query of its own, where
it is asked, and a candidate for the others); shorter vectors count as zero beyond their end; a query's own row is no candidate; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ROWS = 8_192
QUERIES = 512
FIRST = 32  # rows of each list in the first stretch


def search_block(ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray,
                 k: int, rows_of: np.ndarray | None = None):
    """Per query the k best rows of the block, as (query row, ids, scores); ties to smaller ids.
    ``rows_of``: what identifies each row (its id if not given); a query's own row is left out."""
    n, d = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
    by_list = np.take_along_axis(vectors, order, axis=0)
    # products in floating point are exact below 2**53; beyond that, integers
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1) < 2.0 ** 53
    rows = vectors.astype(np.float64) if exact else vectors
    rows_of = ids if rows_of is None else rows_of
    for q_id, q in zip(query_rows, queries):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        qf = q.astype(rows.dtype)
        met = rows_of == q_id
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = 0, min(FIRST, n)
        while True:
            if hi == n or not (len(up) or len(down)):
                new = np.flatnonzero(~met)  # the lists are used up
            else:
                mark = np.zeros(n, bool)
                mark[order[n - hi:n - lo, up].ravel()] = True
                mark[order[lo:hi, down].ravel()] = True
                new = np.flatnonzero(mark & ~met)
            met[new] = True
            got = (rows[new] @ qf).astype(np.int64)
            best = np.concatenate([best, ids[new]])
            scores = np.concatenate([scores, got])
            if len(best) > k:
                top = np.lexsort((best, -scores))[:k]
                best, scores = best[top], scores[top]
            if hi == n or not (len(up) or len(down)):
                break
            bound = int((by_list[n - hi, up] * q[up]).sum() + (by_list[hi - 1, down] * q[down]).sum())
            if len(best) == k and scores[-1] > bound:
                break
            lo, hi = hi, min(2 * hi, n)
        yield q_id, best, scores


def _meet(k: int):
    names = ["q", "vec_id", "score"]
    kinds = [pa.int64()] * 3

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        def matrix(t, width):
            lists = t.column("v").to_pylist()
            m = np.zeros((len(lists), width), np.int64)
            for i, x in enumerate(lists):
                m[i, :len(x)] = x
            return m

        if not len(queries) or not len(rows):
            return pa.table([pa.array([], t) for t in kinds], names)
        width = max(max(map(len, t.column("v").to_pylist())) for t in (queries, rows))
        out = list(search_block(rows.column("id").to_numpy(), matrix(rows, width),
                                queries.column("row").to_numpy(), matrix(queries, width), k,
                                rows.column("row").to_numpy()))
        return pa.table([pa.array(np.concatenate([np.full(len(b), q) for q, b, _ in out])),
                         pa.array(np.concatenate([b for _, b, _ in out])),
                         pa.array(np.concatenate([s for _, _, s in out]))], names)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Both inputs: (id long, v array<long>), distinct ids, or with a column ``row`` that tells rows
    apart in both. Returns (query_id, rank, vec_id, score)."""
    vectors, queries = (d if "row" in d.columns else d.withColumn("row", F.col("id")) for d in (vectors, queries))
    rows, asked = stage(vectors, "topk-rows"), stage(queries, "topk-queries")
    nb = max(1, -(-rows.count() // ROWS))
    nq = max(1, -(-asked.count() // QUERIES))
    a = asked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(nq))) \
        .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
    b = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(nb))) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    met = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInArrow(
        _meet(k), "q long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .join(asked.select(F.col("row").alias("q"), F.col("id").alias("query_id")), "q") \
        .select("query_id", "rank", "vec_id", "score")


def usable(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): whole-number vectors floor(scale * x) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), x.alias("x")) \
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad) \
        .select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def op3_topk(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 1024)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    return search(rows, rows.where(F.col("id") % 100 == 0), 10)


OP3_SQL = """
with v as (select row_number() over () as r, vec_id, [floor(1024 * cast(x as double)) for x in embedding] as v
           from embeddings where vec_id is not null and embedding is not null
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (select q.r as q, q.vec_id as query_id, r.vec_id, cast(list_dot_product(q.v, r.v) as bigint) as score
           from v q join v r on r.r <> q.r where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
