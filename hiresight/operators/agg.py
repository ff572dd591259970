"""Aggregation operators. All are lazy DataFrame plans; grouping keys drop NULL (the reports
were written against a library whose group-by skips missing keys)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import keep_labels
from ..session import write_back
from .quantiles import Quantile, agg_by, median as median_of


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _notnull(df: DataFrame, cols) -> DataFrame:
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df.where(cond) if cond is not None else df


def count_by(df: DataFrame, keys, name: str = "n") -> DataFrame:
    keys = _keys(keys)
    return _notnull(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_k_counts(df: DataFrame, col: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent non-null labels; ties broken by label so the set is deterministic.
    Planned as a partial count per partition, one shuffle, then TakeOrderedAndProject."""
    return count_by(df, col, name).orderBy(F.col(name).desc(), F.col(col).asc()).limit(k)


def top_k_labels(df: DataFrame, col: str, k: int) -> DataFrame:
    """One-column frame of the top-k labels (at most k rows: safe to broadcast)."""
    return top_k_counts(df, col, k).select(col)


def distribution_pct(df: DataFrame, col: str, name: str = "n", pct: str = "pct") -> DataFrame:
    """Counts of non-null labels and their share of all non-null rows, in percent."""
    c = count_by(df, col, name)
    total = df.where(F.col(col).isNotNull()).select(F.count(F.lit(1))).scalar()
    return c.withColumn(pct, F.col(name) * 100.0 / total)


def median_by(df: DataFrame, keys, value: str, median: str = "median_salary",
              count: str | None = "n", min_count: int | None = None, k: int | None = None,
              ascending: bool = False) -> DataFrame:
    """Exact (interpolated) median of ``value`` per group over non-null values, with count,
    optional ``count >= min_count`` and top-k by median (ties by key)."""
    keys = _keys(keys)
    d = _notnull(df, keys + [value])
    cname = count or "_n"
    g = agg_by(d, keys, {median: median_of(value), cname: F.count(value)})
    if min_count is not None:
        g = g.where(F.col(cname) >= min_count)
    if k is not None:
        o = F.col(median).asc() if ascending else F.col(median).desc()
        g = g.orderBy(o, *[F.col(x).asc() for x in keys]).limit(k)
    return g if count else g.drop(cname)


def order_by_labels(df: DataFrame, col: str, labels: Sequence[str], name: str = "ord",
                    unknown: int = 999) -> DataFrame:
    """The place of each row's label in a fixed order as a column (from 0; other labels and
    missing ones: ``unknown``). Rows carry their order, so no sort is needed to keep it."""
    from ..functions.clean import label_map
    places = label_map(col, {v: i for i, v in enumerate(labels)}, unknown)
    return df.withColumn(name, places.cast("int"))


def rate_by(df: DataFrame, keys, flag: str, name: str = "remote_pct") -> DataFrame:
    """mean(flag) * 100 per group."""
    keys = _keys(keys)
    return _notnull(df, keys).groupBy(*keys).agg((F.avg(flag) * 100).alias(name))


def multi_agg_by(df: DataFrame, keys, aggs: dict[str, Column | Quantile], having: Column | None = None,
                 order: Sequence[Column] | None = None, k: int | None = None) -> DataFrame:
    """Several named aggregates in one pass, then HAVING, ORDER and LIMIT."""
    keys = _keys(keys)
    g = agg_by(_notnull(df, keys), keys, aggs)
    if having is not None:
        g = g.where(having)
    if k is not None:
        g = g.orderBy(*(list(order or []) + [F.col(x).asc() for x in keys])).limit(k)
    return g


def share_matrix(df: DataFrame, row: str, col: str, rows=None, cols=None,
                 name: str = "n", share: str = "share") -> DataFrame:
    """Long form of a row-normalised count matrix: (row, col, n, share%).

    ``rows``/``cols`` restrict labels (list literal or bounded one-column frame). The share
    denominator is the row total over the kept columns. Zero cells are not emitted.
    """
    d = _notnull(df, [row, col])
    d = keep_labels(keep_labels(d, row, rows), col, cols)
    g = d.groupBy(row, col).agg(F.count(F.lit(1)).alias(name))
    return g.withColumn(share, F.col(name) * 100.0 / F.sum(name).over(Window.partitionBy(row)))


def median_matrix(df: DataFrame, row: str, col: str, value: str, rows=None, cols=None,
                  median: str = "median_salary", count: str | None = "n") -> DataFrame:
    """Long form of a median pivot: (row, col, median[, n]) over non-null values."""
    d = _notnull(df, [row, col, value])
    d = keep_labels(keep_labels(d, row, rows), col, cols)
    aggs = {median: median_of(value)}
    if count:
        aggs[count] = F.count(F.lit(1))
    return agg_by(d, [row, col], aggs)


def premium_by(df: DataFrame, group: str, flag: str, value: str,
               names=("remote_median", "office_median")) -> DataFrame:
    """Per group: median of value where flag = 1 and where flag = 0, difference and percent;
    groups lacking either side are dropped. One conditional aggregation, no per-group loop."""
    a, b = names
    g = agg_by(_notnull(df, [group]), group,
               {a: median_of(F.when(F.col(flag) == 1, F.col(value))),
                b: median_of(F.when(F.col(flag) == 0, F.col(value)))})
    return (g.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .withColumn("premium", F.col(a) - F.col(b))
            .withColumn("premium_pct", F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100))


def growth_by(df: DataFrame, group: str, level: str, value: str, a: str, b: str,
              names=("entry_salary", "senior_salary")) -> DataFrame:
    """Per group: median at level ``a`` and ``b``; growth abs and % where both exist, a > 0."""
    na, nb = names
    g = agg_by(_notnull(df, [group]), group,
               {na: median_of(F.when(F.col(level) == a, F.col(value))),
                nb: median_of(F.when(F.col(level) == b, F.col(value)))})
    return (g.where(F.col(na).isNotNull() & F.col(nb).isNotNull() & (F.col(na) > 0))
            .withColumn("growth_pct", (F.col(nb) - F.col(na)) / F.col(na) * 100)
            .withColumn("growth_abs", F.col(nb) - F.col(na)))


def premium_vs_overall(df: DataFrame, group: str, value: str, population: DataFrame,
                       min_count: int = 100, k: int = 15) -> DataFrame:
    """Group median minus the median of ``population`` (a scalar subquery), n >= min_count,
    top k by premium."""
    overall = agg_by(population, [], {"_m": median_of(value)}).scalar()
    g = median_by(df, group, value, "median_salary", "n", min_count=min_count)
    g = g.withColumn("premium_vs_overall", F.col("median_salary") - overall)
    return g.orderBy(F.col("premium_vs_overall").desc(), F.col(group).asc()).limit(k)


def count_per_key(df: DataFrame, key: str, name: str, value: str | None = None) -> DataFrame:
    """Rows per key (``value`` given: non-null values per key)."""
    e = F.count(F.lit(1)) if value is None else F.count(value)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(e.alias(name))


def nunique_per_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias(name))


def boxplot_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles (interpolated), 1.5 IQR whiskers (most extreme points inside the fences),
    outlier count, min, max and n per group. The (group, value) rows are stored once; percentiles
    and then, with the fences joined back (one row per group), whiskers and outliers read these."""
    d = write_back(_notnull(df, [group, value]).select(group, value), "boxplot-rows")
    v = F.col(value)
    q = agg_by(d, group, {"q1": Quantile(v, 0.25), "median": Quantile(v), "q3": Quantile(v, 0.75),
                          "n": F.count(F.lit(1)), "min": F.min(value), "max": F.max(value)})
    fences = q.select(group, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"))
    inside = v.between(F.col("_lo"), F.col("_hi"))
    w = (d.join(fences, group)
         .groupBy(group)
         .agg(F.min(F.when(inside, v)).alias("whisker_low"),
              F.max(F.when(inside, v)).alias("whisker_high"),
              F.count(F.when(~inside, F.lit(1))).alias("n_outliers")))
    return q.join(w, group)


def histogram(df: DataFrame, value: str, bins: int, clip_hi: float | None = None,
              markers: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] of the (clipped) values; the last bin is closed.
    min/max come from one scalar subquery, the bins from one partial aggregation. ``markers``
    adds the mean and the exact median of the values before clipping, equal on every bin."""
    v = F.col(value)
    if clip_hi is not None:
        v = F.least(v, F.lit(clip_hi))
    d = df.where(F.col(value).isNotNull()).select(v.alias("_v"))
    mm = d.select(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()  # one subquery
    lo, hi = mm.getField("lo"), mm.getField("hi")
    width = (hi - lo) / bins
    b = F.least(F.floor(F.try_divide(F.col("_v") - lo, width)), F.lit(bins - 1)).cast("int")
    g = d.select(F.when(width > 0, b).otherwise(F.lit(0)).alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    out = g.select("bin", (lo + F.col("bin") * width).alias("bin_low"),
                   (lo + (F.col("bin") + 1) * width).alias("bin_high"), "n")
    if not markers:
        return out
    at = agg_by(_notnull(df, [value]).select(value), [], {"mean": F.avg(value), "median": median_of(value)})
    at = at.select(F.struct("mean", "median")).scalar()
    return out.withColumns({"mean": at.getField("mean"), "median": at.getField("median")})


def drop_null_top(df: DataFrame, label: str, value: str, k: int) -> DataFrame:
    """The k largest (label, value) rows without missing label or value (ties by label)."""
    return df.select(label, value).na.drop().orderBy(F.col(value).desc(), F.col(label)).limit(k)


def distinct_values(df: DataFrame, cols) -> DataFrame:
    """(column, value, ord): the known values of each column in order, as filter lists show them.
    The order comes from a range-partitioned sort of the distinct values."""
    from .mlstages import OrdinalEncoder
    return OrdinalEncoder(cols=list(cols)).fit(df).tables["codes"].withColumnRenamed("enc", "ord")
