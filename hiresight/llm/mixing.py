"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. *Targets.* Sources in code-point order (null last) weigh 1, 2, 3, repeating. Water filling
   shares the total size by weight; no target exceeds ``max_epochs`` times its source's size.
2. *Draw.* ``floor(target / size)`` whole epochs take every document; the rest is drawn without
   replacement as the prefix of a seeded permutation (md5 of the id). The cut is found top down
   over a radix tree of the permutation: word totals of 4096 ranges, then of 4096 ranges inside
   the one that holds the cut, then the few documents left, so no task sees a whole source.
   The document left out at the cut is replaced by the undrawn one nearest to the words missing.
3. *Splitting tree.* The drawn copies form blocks (source, copy, range of the permutation).
   Block counts per source are split recursively among the output shards by multivariate
   hypergeometric draws, so every shard gets its exact quota and a fair mixture; each source's
   blocks, in a second permutation, are dealt disjointly by these quotas. Inside a shard the
   order is a local shuffle by hash.

All row work is DataFrame operations; the driver holds one count per source and shard.

Defined cases: a null text has size 0; documents of size 0 are taken with the whole epochs
only; a null source is a source of its own; rows repeating an id within a source are drawn
together; a null id counts as an id; an empty table gives an empty result; other columns are
passed through by ``mix`` and ignored by ``draw``.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PRE, stage

SEED = 42
MAX_EPOCHS = 3
SHARDS = 16
BLOCK_DIGITS = 2  # hex digits: 256 blocks of each source and copy


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(col).cast("string"), F.lit("null")))
                 .cast("binary"))


def targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, rest): one row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
                           - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    # ascending by cap / weight, the capped sources come first
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("lam", (F.sum("source_size").over(every)
                             - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("capped", F.col("lam") > F.col("cap") / F.col("w"))
    s = s.withColumn("level", F.max(F.when(~F.col("capped"), F.col("lam"))).over(every))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double"))
                     .otherwise(F.least(F.col("w") * F.col("level"), F.col("cap").cast("double"))))
    s = s.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(max_epochs).cast("long"))
                     .otherwise(F.floor(F.col("target") / F.col("source_size"))))
    return s.select("source", "source_size", "target", "epochs",
                    (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _cut(sized: DataFrame, src: DataFrame) -> DataFrame:
    """Per source with a rest: the first permuted key that the prefix leaves out, and the words
    still missing there."""
    left = src.where("rest > 0").select(F.col("source").alias("s"), "rest",
                                        F.lit("").alias("at"), F.lit(0).cast("long").alias("base"))
    run = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    for digits in (3, 6, 32):
        inside = sized.join(left, F.col("source").eqNullSafe(F.col("s"))
                            & (F.substring("key", 1, 3) == F.when(F.col("at") == "", F.substring("key", 1, 3))
                               .otherwise(F.substring("at", 1, 3)))
                            & F.col("key").startswith(F.col("at")))
        cells = inside.groupBy("s", "rest", "base", F.substring("key", 1, digits).alias("k")) \
            .agg(F.sum("size").alias("n"))
        cells = cells.withColumn("upto", F.col("base") + F.sum("n").over(run))
        first = cells.where("upto > rest").groupBy("s", "rest").agg(
            F.min(F.struct("k", (F.col("upto") - F.col("n")).alias("base"))).alias("c"))
        left = stage(first.select("s", "rest", F.col("c.k").alias("at"), F.col("c.base").alias("base")),
                     "mix-cut")
    return left.select("s", "at", (F.col("rest") - F.col("base")).alias("missing"))


def draw(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, copies), one row per document."""
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                              permuted("doc_id", seed).alias("key"), word_count("text").alias("size")),
                  "mix-sizes")
    src = stage(targets(sized, max_epochs), "mix-targets")
    cut = _cut(sized, src)
    # one undrawn document (with its repeats) may fill what the prefix misses
    undrawn = sized.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") >= F.col("at")))
    units = undrawn.groupBy("s", "key", "missing", "at").agg(F.sum("size").alias("n")) \
        .where(F.abs(F.col("n") - F.col("missing")) < F.col("missing"))
    fill = units.groupBy("s").agg(F.min(F.struct(
        F.abs(F.col("n") - F.col("missing")).alias("off"), "key")).alias("f"))
    cut = stage(cut.join(fill.select(F.col("s").alias("fs"), F.col("f.key").alias("fill")),
                         F.col("s").eqNullSafe(F.col("fs")), "left").drop("fs"), "mix-fill")
    plan = src.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("ps"), "source_size", "target", "epochs", "at", "fill")
    drawn = F.coalesce(F.col("key") < F.col("at"), F.lit(False)) \
        | F.coalesce(F.col("key") == F.col("fill"), F.lit(False))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("ps"))).select(
        "doc_id", "source", "key", "size", "source_size", "target",
        (F.col("epochs") + F.when(drawn & (F.col("size") > 0), 1).otherwise(0)).cast("int").alias("copies"))


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block quotas, shards x sources: each half of the shards draws its share of the blocks."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    take = int(counts.sum()) * left // shards
    part = rng.multivariate_hypergeometric(counts, take, method="marginals") if len(counts) else counts
    return np.vstack([split(part, left, rng), split(counts - part, shards - left, rng)])


def deal(drawn: DataFrame, shards: int = SHARDS, seed: int = SEED, digits: int = BLOCK_DIGITS) -> DataFrame:
    """Adds ``shards``: the output shard of each copy of the document, in copy order."""
    spark = drawn.sparkSession
    drawn = drawn.withColumn("block", F.substring("key", 1, digits))
    most = drawn.groupBy("source", "block").agg(F.max("copies").alias("c")).where("c > 0")
    blocks = stage(most.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("copy")),
                   "mix-blocks")
    per = sorted(((r["source"], r["n"]) for r in blocks.groupBy("source").agg(
        F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    quota = split(np.array([n for _, n in per], dtype=np.int64), shards, np.random.default_rng(seed))
    ends = quota.cumsum(axis=0).T.tolist()
    rows = json.dumps([{"qs": s, "ends": e} for (s, _), e in zip(per, ends)])
    quotas = spark.range(1).select(F.inline(F.from_json(
        F.lit(rows), "array<struct<qs: string, ends: array<bigint>>>")))
    order = Window.partitionBy("source").orderBy(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("block"), F.lit(":"), F.col("copy").cast("string")).cast("binary")))
    dealt = blocks.withColumn("rank", F.row_number().over(order)) \
        .join(quotas, F.col("source").eqNullSafe(F.col("qs"))) \
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    # at most max_epochs copies of a block
    by_block = dealt.groupBy(F.col("source").alias("bs"), F.col("block").alias("bb")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("dealt"))
    return drawn.join(by_block, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")), "left") \
        .withColumn("shards", F.when(F.col("copies") > 0, F.slice("dealt", 1, F.col("copies")))
                    .otherwise(F.array().cast("array<int>"))) \
        .drop("bs", "bb", "dealt")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture: the input's rows, each as often as it is taken, with their columns unchanged,
    hash-partitioned by output shard and shuffled inside each."""
    plan = deal(draw(docs, seed, max_epochs), shards, seed) \
        .groupBy(F.col("source").alias(f"{PRE}s"), F.col("key").alias(f"{PRE}k")) \
        .agg(F.first("shards").alias(f"{PRE}shards"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{PRE}row"),
                      F.col("source").cast("string").alias(f"{PRE}src"),
                      permuted("doc_id", seed).alias(f"{PRE}key"))
    out = row.join(plan, F.col(f"{PRE}src").eqNullSafe(F.col(f"{PRE}s"))
                   & (F.col(f"{PRE}key") == F.col(f"{PRE}k"))) \
        .select(f"{PRE}row", f"{PRE}key", F.posexplode(f"{PRE}shards").alias(f"{PRE}copy", f"{PRE}shard"))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"{PRE}key"), F.lit(":"),
                           F.col(f"{PRE}copy").cast("string")).cast("binary"))
    # a shard may span several tasks: its local order is by hash, cut into ranges
    return out.withColumn(f"{PRE}place", place).repartitionByRange(f"{PRE}shard", f"{PRE}place") \
        .sortWithinPartitions(f"{PRE}shard", f"{PRE}place").select(f"{PRE}row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deal(draw(docs)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("shards")).cast("long").alias("taken"))


OP9_SQL = r"""
with sized as (
  select doc_id, source, md5('42:' || coalesce(cast(doc_id as varchar), 'null')) as key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents),
s1 as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
s2 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w,
              source_size * 3 as cap from s1),
s3 as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over b, 0) as double)
              / cast(sum(w) over () - coalesce(sum(w) over b, 0) as double) as lam
       from s2
       window b as (order by cast(cap as double) / cast(w as double), source nulls last
                    rows between unbounded preceding and 1 preceding)),
s4 as (select *, lam > cast(cap as double) / cast(w as double) as capped from s3),
s5 as (select *, max(case when not capped then lam end) over () as level from s4),
s6 as (select source, source_size, case when capped then cast(cap as double)
              else least(w * level, cast(cap as double)) end as target from s5),
s7 as (select *, case when source_size = 0 then 3
              else cast(floor(target / source_size) as bigint) end as epochs from s6),
s8 as (select *, target - epochs * source_size as rest from s7),
units as (select source, key, cast(sum(size) as bigint) as n from sized group by source, key),
cum as (select u.*, s8.rest, sum(n) over (partition by u.source order by key) as upto
        from units u join s8 on u.source is not distinct from s8.source),
cut as (select source, min(key) as at, min(rest - (upto - n)) as missing0
        from cum where rest > 0 and upto > rest group by source),
cut2 as (select c.source, c.at, cum.rest - (cum.upto - cum.n) as missing
         from cut c join cum on c.source is not distinct from cum.source and cum.key = c.at),
fill as (select u.source, arg_min(u.key, struct_pack(off := abs(u.n - c.missing), k := u.key)) as fill
         from units u join cut2 c on u.source is not distinct from c.source and u.key >= c.at
         where abs(u.n - c.missing) < c.missing group by u.source)
select d.doc_id, cast(d.size as bigint) as size, s8.source_size, s8.target,
       cast(d.size * (s8.epochs + case when coalesce(d.key < c.at, false) or coalesce(d.key = f.fill, false)
                                       then 1 else 0 end) as bigint) as taken
from sized d join s8 on d.source is not distinct from s8.source
left join cut2 c on d.source is not distinct from c.source
left join fill f on d.source is not distinct from f.source
"""
