"""Exact interpolated quantiles per group, without holding, sorting or shuffling a whole group.

Values fall into buckets, a fixed and monotone function of the value. A first pass counts rows per
(group, bucket), a few thousand rows per group at most, which is all it shuffles; the counts tell
which buckets hold a needed position. While such a bucket holds more rows than one task should
order, it alone is counted again in finer buckets. The last pass reads only the values of the
buckets found, counts equal ones together (a value that a third of all rows share is one row) and
orders the rest. The list of buckets is broadcast only when it is known to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_back

PER_OCTAVE = 1_024
FINER = 1_024  # by so much a crowded bucket is divided
CROWDED = 2_000_000  # rows of a bucket that one task orders at most, if finer buckets part them
LEVELS = 3
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Quantile:
    """The ``p`` quantile of a value expression: an aggregate for ``agg_by``."""

    value: Column
    p: float = 0.5


def median(value) -> Quantile:
    return Quantile(F.col(value) if isinstance(value, str) else value)


def bucket(v: Column, level: int = 0) -> Column:
    """Monotone in v: steps of equal ratio (``PER_OCTAVE`` per power of two), with values below
    2^-60 in size at 0."""
    size = F.floor((F.log2(F.greatest(F.least(F.abs(v), F.lit(1e300)), F.lit(2.0 ** -60))) + 60)
                   * F.lit(float(PER_OCTAVE * FINER ** level)))
    return F.signum(v).cast("long") * size


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; b's keys are dropped."""
    b = b.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                 *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return a.join(b, cond, how).drop(*[f"_r{i}" for i in range(len(keys))])


def group_quantiles(df: DataFrame, keys: list[str], specs: dict[str, Quantile],
                    weight: str | None = None) -> DataFrame:
    """(keys, one column per spec). Nulls and NaN are left out; groups without any value have no
    row. ``weight``: a column that says how often a row counts."""
    exprs: list[str] = []
    cols: list[Column] = []
    place = {}
    for name, q in specs.items():
        if repr(q.value) not in exprs:
            exprs.append(repr(q.value))
            cols.append(q.value)
        place[name] = exprs.index(repr(q.value))
    w = F.col(weight) if weight else F.lit(1)
    if len(cols) == 1:
        d = df.select(*keys, w.cast("long").alias("_w"), F.lit(0).alias("_m"), cols[0].cast("double").alias("_v"))
    else:
        d = df.select(*keys, w.cast("long").alias("_w"), F.explode(F.array(*[
            F.struct(F.lit(i).alias("_m"), c.cast("double").alias("_v")) for i, c in enumerate(cols)])).alias("_x"))
        d = d.select(*keys, "_w", "_x.*")
    d = d.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    part = Window.partitionBy(*keys, "_m")
    hit = F.lit(False)
    for p in sorted({q.p for q in specs.values()}):
        for at in (F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1))):
            hit = hit | ((at >= F.col("_start")) & (at < F.col("_end")))
    s, level = d.withColumn("_b", bucket(F.col("_v"))), 0
    found = None  # buckets that hold a needed position: (keys, _m, _b, _start, _n)
    while True:
        if found is None:
            t = s.groupBy(*keys, "_m", "_b").agg(F.sum("_w").alias("_t"))
            t = t.withColumns({"_end": F.sum("_t").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)),
                               "_n": F.sum("_t").over(part)}).withColumn("_start", F.col("_end") - F.col("_t"))
        else:  # the buckets inside each one found, after the rows before it
            t = s.groupBy(*keys, "_m", "_up", "_before", "_n", "_b").agg(F.sum("_w").alias("_t"))
            inside = Window.partitionBy(*keys, "_m", "_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
            t = t.withColumn("_end", F.col("_before") + F.sum("_t").over(inside)).withColumn("_start", F.col("_end") - F.col("_t"))
        t = t.where(hit).select(*keys, "_m", "_b", "_start", "_n", "_t")
        few = t.limit(BROADCAST_ROWS + 1).toArrow()  # one row per needed position, if there are not too many
        if few.num_rows <= BROADCAST_ROWS:
            most = max(few.column("_t").to_pylist(), default=0)
            found = F.broadcast(df.sparkSession.createDataFrame(few, schema=t.schema).drop("_t"))
        else:
            found = write_back(t, "quantile-buckets")
            most = found.agg(F.max("_t")).first()[0]
            found = found.drop("_t")
        s = join_null_safe(d.withColumn("_b", bucket(F.col("_v"), level)), found, [*keys, "_m", "_b"])
        if most <= CROWDED or level + 1 >= LEVELS:
            break
        level += 1
        s = s.withColumnRenamed("_b", "_up").withColumnRenamed("_start", "_before").withColumn("_b", bucket(F.col("_v"), level))
    s = s.groupBy(*keys, "_m", "_b", "_start", "_n", "_v").agg(F.sum("_w").alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*keys, "_m", "_b").orderBy("_v")
                           .rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_hi", F.col("_start") + run).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = []
    for name, q in specs.items():
        mine = F.col("_m") == place[name]
        x = F.lit(q.p) * (F.col("_n") - 1)

        def at(pos, mine=mine):
            return F.max(F.when(mine & (pos >= F.col("_lo")) & (pos < F.col("_hi")), F.col("_v")))

        frac = F.max(F.when(mine, x - F.floor(x)))
        a, b = at(F.floor(x)), at(F.ceil(x))
        aggs.append((a + (b - a) * frac).alias(name))
    return s.groupBy(*keys).agg(*aggs)


def agg_by(df: DataFrame, keys, aggs: dict, weight: str | None = None) -> DataFrame:
    """Grouped aggregation whose values are aggregate Columns or ``Quantile``s (null where a
    group has no value). ``weight`` counts rows for the quantiles."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    qs = {n: e for n, e in aggs.items() if isinstance(e, Quantile)}
    plain = [e.alias(n) for n, e in aggs.items() if not isinstance(e, Quantile)]
    g = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    if qs and keys:
        g = join_null_safe(g, group_quantiles(df, keys, qs, weight), keys, "left")
    elif qs:  # one row: a scalar subquery, not a join
        q = group_quantiles(df, [], qs, weight).select(F.struct(*qs)).scalar()
        g = g.withColumns({n: q.getField(n) for n in qs})
    return g.select(*keys, *aggs)
