"""Statistics as distributed DataFrame jobs.

The rank-based test needs global ranks of every salaried posting. They come from a value
histogram (one row per distinct value, pre-aggregated map-side) and a two-level prefix sum:
distinct values fall into fixed, monotone value buckets (``quantiles.bucket``), bucket totals
give offsets (a window over a bounded number of rows), and a window partitioned by bucket gives
running counts inside each. No step orders the whole data in one task, and a value held by a
third of all rows is still one histogram row.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_back
from .quantiles import Quantile, bucket, group_quantiles, median

# two-sided 5 % critical value of the standard normal (fixed value)
Z_CRIT_05 = 1.959963984540054


def hash_unit(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random number in [0, 1) from md5('seed:key'); both engines can
    compute it, so samples and folds are checkable in SQL."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10)
    return h.cast("double") / 4294967296.0


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def value_ranks(values: DataFrame, v: str) -> DataFrame:
    """(v, cnt, lo, hi, avg_rank): for each distinct value its first and last 1-based position
    in the sorted multiset and the average rank of its ties. Nulls and NaN have no rank."""
    x = F.col(v).cast("double")
    h = values.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias(v)).agg(F.count(F.lit(1)).alias("cnt"))
    h = h.withColumn("_b", bucket(F.col(v)))
    tot = h.groupBy("_b").agg(F.sum("cnt").alias("_bt"))
    # buckets are fixed ranges of values: a bounded number of rows whatever the data
    off = tot.select(F.col("_b").alias("_ob"), F.coalesce(F.sum("_bt").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    h = h.join(off, F.col("_b") == F.col("_ob"))
    run = F.sum("cnt").over(Window.partitionBy("_b").orderBy(v)
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = h.withColumn("hi", F.col("_off") + run).withColumn("lo", F.col("hi") - F.col("cnt") + 1)
    return h.select(v, "cnt", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2.0).alias("avg_rank"))


def _complement_median(own: DataFrame, ranks: DataFrame, sizes: DataFrame, label: str,
                       v: str, n_total: Column, width_buckets: int = 4096) -> DataFrame:
    """Median of the values *not* carrying each label, without materialising complements.

    With n1 labelled values, the complement's j-th value is the smallest v with
    hi(v) - C_L(v) >= j (C_L = labelled values <= v), and it lies among the distinct values whose
    positions meet [j, j + n1]. Those candidates are found by an equi-join on position buckets
    (each distinct value spans its buckets; each label spans the buckets of its window), so the
    work is linear in the labelled rows plus the distinct values.
    """
    w = F.greatest(F.floor(n_total / width_buckets), F.lit(1))
    s = sizes.select(label, "n1", (n_total - F.col("n1")).alias("n2"))
    s = s.withColumn("j_lo", F.floor((F.col("n2") + 1) / 2)).withColumn(
        "j_hi", F.floor(F.col("n2") / 2) + 1)
    s = s.where(F.col("n2") > 0)
    lab_b = s.select(label, "j_lo", "j_hi", "n1", F.explode(F.sequence(
        F.floor(F.col("j_lo") / w), F.floor((F.col("j_hi") + F.col("n1")) / w))).alias("_pb"))
    val_b = ranks.select(v, "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / w), F.floor(F.col("hi") / w))).alias("_pb"))
    cand = (lab_b.join(val_b, "_pb")
            .where((F.col("hi") >= F.col("j_lo")) & (F.col("lo") <= F.col("j_hi") + F.col("n1")))
            .select(label, v, "hi", "j_lo", "j_hi").distinct())
    u = (cand.withColumn("_c", F.lit(0).cast("long"))
         .unionByName(own.select(label, v, "_c", F.lit(None).cast("long").alias("hi"),
                                 F.lit(None).cast("double").alias("j_lo"),
                                 F.lit(None).cast("double").alias("j_hi")), allowMissingColumns=True))
    # running counts per label in two levels: totals of value buckets, then inside a bucket
    u = u.withColumn("_b", bucket(F.col(v)))
    tot = u.groupBy(label, "_b").agg(F.sum("_c").alias("_bt"))
    off = tot.select(F.col(label).alias("_ol"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_bt").over(
        Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    u = u.join(off, (F.col(label) == F.col("_ol")) & (F.col("_b") == F.col("_ob")))
    cl = F.col("_off") + F.sum("_c").over(Window.partitionBy(label, "_b").orderBy(v)
                                          .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_cl", cl).where(F.col("hi").isNotNull())
    cw = F.col("hi") - F.col("_cl")
    r = u.groupBy(label).agg(F.min(F.when(cw >= F.col("j_lo"), F.col(v))).alias("_a"),
                             F.min(F.when(cw >= F.col("j_hi"), F.col(v))).alias("_b"))
    return r.select(label, ((F.col("_a") + F.col("_b")) / 2).alias("median_without"))


def mann_whitney_by_label(bridge: DataFrame, facts: DataFrame, key: str, label: str, v: str,
                          min_label: int = 200) -> DataFrame:
    """Per label with >= ``min_label`` bridge rows: salaried postings with / without the label
    (n1, n2), their medians, U of the labelled group, max(U1, U2), and the tie-corrected
    normal z with continuity correction (two-sided form)."""
    facts = facts.where(F.col(v).isNotNull()).select(key, v)
    common = (bridge.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") >= min_label).select(label))
    pairs = bridge.join(common, label, "left_semi").select(label, key).distinct()
    pairs_v = pairs.join(facts, key).select(label, v)
    # one row per distinct value, read by three consumers: written once to the shared
    # checkpoint folder instead of being recomputed (and it survives executor loss)
    ranks = write_back(value_ranks(facts, v), "value-ranks")
    n_total = ranks.select(F.sum("cnt")).scalar()
    ties = ranks.select(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt"))).scalar()
    # (label, value) counts: pre-aggregated (a hot value is one row per label) and read twice
    lv = write_back(pairs_v.groupBy(label, v).agg(F.count(F.lit(1)).alias("_c")), "label-values")
    sizes = (lv.join(ranks.select(v, "avg_rank"), v).groupBy(label)
             .agg(F.sum("_c").alias("n1"), F.sum(F.col("_c") * F.col("avg_rank")).alias("_r1")))
    sizes = sizes.join(group_quantiles(lv, [label], {"median_with": median(v)}, weight="_c"), label)
    med_wo = _complement_median(lv, ranks, sizes, label, v, n_total)
    n1 = F.col("n1").cast("double")
    n2 = (n_total - F.col("n1")).cast("double")
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    nn = F.lit(n_total).cast("double")
    sigma = F.sqrt(n1 * n2 / 12 * ((nn + 1) - F.try_divide(ties, nn * (nn - 1))))
    out = sizes.join(med_wo, label, "left").select(
        label, "n1", (n_total - F.col("n1")).alias("n2"), "median_with", "median_without",
        (F.col("median_with") - F.col("median_without")).alias("premium"),
        u1.alias("u_stat"), F.try_divide(u - n1 * n2 / 2 - 0.5, sigma).alias("z"))
    return out


@F.pandas_udf(T.DoubleType())
def _two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2.0))) if pd.notna(x) else float("nan"))


@F.pandas_udf(T.DoubleType())
def inverse_normal(p: pd.Series) -> pd.Series:
    """Standard normal quantile function (Arrow-batched; meant for bounded samples)."""
    from statistics import NormalDist
    nd = NormalDist()
    return p.map(lambda x: nd.inv_cdf(x) if 0 < x < 1 else float("nan"))


def premium_test(bridge: DataFrame, facts: DataFrame, key: str, label: str, v: str,
                 min_label: int = 200, min_side: int = 50, z_crit: float = Z_CRIT_05,
                 with_p: bool = False) -> DataFrame:
    """Labels whose carriers' salaries differ from the rest: both sides >= ``min_side``
    postings and two-sided Mann-Whitney p < 0.05 (|z| beyond the critical value). The p-value
    itself (``with_p``) comes from erfc in an Arrow-batched UDF over the label-sized result."""
    t = mann_whitney_by_label(bridge, facts, key, label, v, min_label)
    t = t.where((F.col("n1") >= min_side) & (F.col("n2") >= min_side) & (F.col("z") > z_crit))
    if with_p:
        t = t.withColumn("pval", _two_sided_p(F.col("z")))
    return t


def top_and_bottom(df: DataFrame, order: str, k: int, tie: str) -> DataFrame:
    """The k highest and k lowest rows of one ranking (a row in both is 'top'). Each side is a
    distributed top-k (per-partition top k, then k of those), so input size does not matter;
    the de-duplication joins two frames of at most k rows."""
    hi = df.orderBy(F.col(order).desc(), F.col(tie)).limit(k).withColumn("side", F.lit("top"))
    lo = df.orderBy(F.col(order).asc(), F.col(tie)).limit(k).withColumn("side", F.lit("bottom"))
    return hi.unionByName(lo.join(F.broadcast(hi.select(tie)), tie, "left_anti"))


def exact_quantiles(df: DataFrame, c: str, probs) -> list:
    """Exact interpolated quantiles (position p * (n - 1), linear between neighbours) as numbers
    on the driver; all None when there is no value."""
    specs = {f"q{i}": Quantile(F.col(c), p) for i, p in enumerate(probs)}
    row = group_quantiles(df, [], specs).first()
    return list(row) if row is not None else [None] * len(specs)


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def normal_fit(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("n"))


def normality_test(df: DataFrame, c: str) -> DataFrame:
    """Jarque-Bera over all rows from distributed moments (population skewness and excess
    kurtosis); p from the chi-square(2) tail exp(-JB/2)."""
    m = df.agg(F.count(c).alias("n"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"))
    jb = F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return m.withColumn("jb", jb).withColumn("pval", F.exp(-F.col("jb") / 2))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if fewer), uniformly without replacement, reproducible: the n
    smallest md5('seed:key') values (TakeOrderedAndProject: a bounded top-n per partition)."""
    return df.orderBy(hash_order(F.col(key), seed)).limit(n)


def kfold_assign(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    h = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, (h % k).cast("int"))


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42,
                      oversample: float = 8.0, slack: int = 20) -> DataFrame:
    """Per stratum max(1, round-half-even(share * n)) rows capped by the stratum size, chosen
    by smallest md5('seed:key'), then the n rows with the smallest md5('seed+1:key') of the
    union.

    Candidate rows are pre-filtered per stratum to a hash threshold that keeps about
    ``oversample`` x quota + ``slack`` rows, so the per-stratum ranking never sorts a whole
    (possibly huge) stratum; strata the filter left short are redone with the full stratum.
    """
    d = df.where(F.col(stratum).isNotNull())
    sizes = d.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    total = d.select(F.count(F.lit(1))).scalar()
    quota = sizes.withColumn("_q", F.least(F.col("_size"), F.greatest(
        F.lit(1), F.bround(F.col("_size") / total * n)).cast("long")))
    thr = F.least(F.lit(1.0), (F.col("_q") * oversample + slack) / F.col("_size"))
    quota = quota.withColumn("_t", thr)
    dd = d.join(quota.select(stratum, "_q", "_t"), stratum)
    u = hash_unit(F.col(key), seed)
    cand = dd.where(u <= F.col("_t"))
    short = (cand.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
             .join(quota, stratum, "right").where(F.coalesce("_c", F.lit(0)) < F.col("_q"))
             .select(stratum))
    cand = cand.join(short, stratum, "left_anti").unionByName(dd.join(short, stratum, "left_semi"))
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed))
    picked = cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_q"))
    return picked.drop("_rn", "_q", "_t").orderBy(hash_order(F.col(key), seed + 1)).limit(n)


def qcut(df: DataFrame, c: str, q: int, name: str = "qbin") -> DataFrame:
    """Equal-frequency bins from exact quantile edges (duplicate edges dropped); first bin
    closed on the left, others (lo, hi]. The q + 1 edges are exact order statistics from the
    distributed ranks, then plain literals in the bin expression."""
    qs = exact_quantiles(df.where(F.col(c).isNotNull()), c, [i / q for i in range(q + 1)])
    edges = sorted(set(x for x in qs if x is not None))
    above = sum(F.when(F.col(c) > F.lit(e), 1).otherwise(0) for e in edges) if edges else F.lit(0)
    return df.withColumn(name, F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), above - 1)))


def rolling_mean_centered(df: DataFrame, order: list, value: str, window: int, name: str = "trend") -> DataFrame:
    """Centred moving mean (``window // 2`` rows before, the rest after), NULL until the frame
    is full. The window is un-partitioned: meant for bounded samples (plots, diagnostics)."""
    before, after = window // 2, window - 1 - window // 2
    w = Window.orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == window, F.avg(value).over(w)))


def grouped_quantiles(df: DataFrame, group: str, v: str, probs, prefix: str = "q") -> DataFrame:
    """Exact interpolated quantiles of ``v`` per group: (group, q0, q1, ...)."""
    return group_quantiles(df.where(F.col(group).isNotNull()), [group],
                           {f"{prefix}{i}": Quantile(F.col(v), p) for i, p in enumerate(probs)})


def split_stratified(df: DataFrame, key: str, y: str, shares: dict[str, float], rest: str, q: int = 8,
                     seed: int = 7, name: str = "part") -> DataFrame:
    """Labels every row with a part. In each of the ``q`` equal-frequency bins of ``y`` exactly
    round(share * rows) rows, those first in hash order, belong to each part of ``shares``, the
    others to ``rest``. Rows without ``y`` form a bin of their own.

    Positions in (bin, hash) order come from one range-partitioned sort of (key, bin, hash); no
    task orders a whole bin."""
    from .mlstages import sorted_positions
    d = qcut(df.select(key, y), y, q, "_bin").select(key, F.coalesce("_bin", F.lit(-1)).alias("_bin"),
                                                     hash_order(F.col(key), seed).alias("_h"))
    d = sorted_positions(d, ["_bin", "_h", key], "_at")
    bins = d.groupBy("_bin").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # q + 1 rows
    d = d.join(F.broadcast(bins), "_bin")
    place, part, before = F.col("_at") - F.col("_first"), F.lit(rest), F.lit(0).cast("long")
    cuts = []
    for label, share in shares.items():
        before = before + F.floor(F.lit(share) * F.col("_n") + 0.5)
        cuts.append((label, before))
    for label, end in reversed(cuts):
        part = F.when(place < end, F.lit(label)).otherwise(part)
    return df.join(d.select(key, part.alias(name)), key)
