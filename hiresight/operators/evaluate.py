"""Evaluation and prediction-interval operators over (actual, prediction) rows.

All statistics are grouped aggregations (sums of moments, exact percentiles); no window spans
a fold or a segment, so a fold holding a fifth of the rows is still combined map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import value_ranks


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metric_aggs(y: str, p: str, mape: bool = True) -> list[Column]:
    """n, rmse, mae, r2 (moment form), mape (rows with y > 0) as aggregate expressions."""
    e = _c(p) - _c(y)
    n = F.count(F.lit(1))
    sst = F.sum(_c(y) * _c(y)) - F.sum(_c(y)) * F.sum(_c(y)) / n
    out = [n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
           F.when(n >= 3, 1 - F.try_divide(F.sum(e * e), sst)).alias("r2")]
    if mape:
        out.append((F.avg(F.when(_c(y) > 0, F.abs(e) / _c(y))) * 100).alias("mape"))
    return out


def metrics(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    d = df.where(_c(y).isNotNull() & _c(p).isNotNull())
    if by:
        return d.groupBy(*([by] if isinstance(by, str) else by)).agg(*metric_aggs(y, p))
    return d.agg(*metric_aggs(y, p))


def error_columns(df: DataFrame, y: str, p: str) -> DataFrame:
    r = _c(p) - _c(y)
    return df.withColumns({"residual": r, "abs_error": F.abs(r),
                           "ape": F.when(_c(y) > 0, F.abs(r) / _c(y) * 100)})


def segment_metrics(df: DataFrame, segments: dict[str, str], y: str, p: str,
                    min_n: dict[str, int] | int = 80, top_n: int = 20) -> DataFrame:
    """(segment, value, n, rmse, mae, r2, bias, median_actual, median_pred) for every segment
    column at once: the segment columns are unpivoted, then one grouped aggregation; groups
    under ``min_n`` rows are dropped and the ``top_n`` worst RMSE kept per segment."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("segment"), _c(col).cast("string").alias("value"))
                                for name, col in segments.items()]))
    d = df.select(_c(y).alias("_y"), _c(p).alias("_p"), pairs.alias("_s")).select("_y", "_p", "_s.*")
    d = d.where(F.col("value").isNotNull())
    e = F.col("_p") - F.col("_y")
    g = d.groupBy("segment", "value").agg(*metric_aggs("_y", "_p", mape=False), F.avg(e).alias("bias"))
    # medians of continuous values per group: rank-based exact quantiles (no task sorts a
    # whole segment value, and no per-group map of every distinct prediction)
    from .stats import grouped_quantiles
    key = F.concat_ws("\u0001", "segment", "value")
    d = d.withColumn("_key", key)
    ma = grouped_quantiles(d, "_key", "_y", [0.5], prefix="ma")
    mp = grouped_quantiles(d, "_key", "_p", [0.5], prefix="mp")
    g = (g.withColumn("_key", key).join(ma, "_key", "left").join(mp, "_key", "left")
         .withColumnRenamed("ma0", "median_actual").withColumnRenamed("mp0", "median_pred").drop("_key"))
    g = g.withColumn("r2", F.when(F.col("n") >= 3, F.col("r2")))
    if isinstance(min_n, dict):
        lim = F.coalesce(*[F.when(F.col("segment") == k, F.lit(v)) for k, v in min_n.items()], F.lit(0))
    else:
        lim = F.lit(min_n)
    g = g.where(F.col("n") >= lim)
    w = Window.partitionBy("segment").orderBy(F.col("rmse").desc(), F.col("value"))
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n).drop("_r")


def residual_quantile_interval(train: DataFrame, df: DataFrame, y: str, p: str, alpha: float = 0.10,
                               name: str = "residual_quantile") -> DataFrame:
    """pred + the alpha/2 and 1-alpha/2 quantiles of (actual - pred) on ``train``, floored at 0."""
    from .stats import exact_quantiles
    r = train.select((_c(y) - _c(p)).alias("_res"))
    q = exact_quantiles(r, "_res", [alpha / 2, 1 - alpha / 2])
    return df.withColumns({"lower": F.greatest(_c(p) + F.lit(q[0]), F.lit(0.0)),
                           "upper": F.greatest(_c(p) + F.lit(q[1]), F.lit(0.0)), "method": F.lit(name)})


def conformal_q(cal: DataFrame, y: str, p: str, alpha: float = 0.10) -> Column:
    """q-hat of split conformal: the order statistic of |actual - pred| at 0-based position
    ceil(level * (n - 1)), level = min(1, ceil((n + 1)(1 - alpha)) / n). Exact: positions come
    from the distributed value ranks, not from an interpolated percentile."""
    r = cal.select(F.abs(_c(y) - _c(p)).alias("_r"))
    ranks = value_ranks(r, "_r")
    n = F.col("_n")
    lvl = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.ceil((n + 1) * (1 - alpha)) / n))
    pos = F.ceil(lvl * (n - 1)) + 1  # 1-based
    at = ranks.agg(F.sum("cnt").alias("_n")).select(pos).scalar()
    return ranks.where((F.col("lo") <= at) & (F.col("hi") >= at)).select(F.max("_r")).scalar()


def conformal_interval(cal: DataFrame, df: DataFrame, y: str, p: str, alpha: float = 0.10,
                       name: str = "conformal") -> DataFrame:
    qh = conformal_q(cal, y, p, alpha)
    return df.withColumns({"lower": F.greatest(_c(p) - qh, F.lit(0.0)),
                           "upper": F.greatest(_c(p) + qh, F.lit(0.0)), "method": F.lit(name)})


def interval_scores(df: DataFrame, y: str, alpha: float = 0.10, by: str = "method") -> DataFrame:
    """Coverage %, mean and median width and Winkler score per method."""
    lo, hi, yy = F.col("lower"), F.col("upper"), _c(y)
    width = hi - lo
    pen = (F.when(yy < lo, (2 / alpha) * (lo - yy)).otherwise(F.lit(0.0))
           + F.when(yy > hi, (2 / alpha) * (yy - hi)).otherwise(F.lit(0.0)))
    g = df.groupBy(by).agg(
        (F.avg(((yy >= lo) & (yy <= hi)).cast("int")) * 100).alias("coverage_pct"),
        F.avg(width).alias("avg_width"), F.avg(width + pen).alias("winkler_score"),
        F.count(F.lit(1)).alias("n"))
    # each method holds every scored row: its median width comes from rank-based quantiles
    from .stats import grouped_quantiles
    med = grouped_quantiles(df.select(by, width.alias("_w")), by, "_w", [0.5], prefix="mw")
    return g.join(med, by, "left").withColumnRenamed("mw0", "median_width").select(
        by, "coverage_pct", "avg_width", "median_width", "winkler_score", "n")


def calibration_deciles(df: DataFrame, y: str, p: str, q: int = 10) -> DataFrame:
    from .stats import qcut
    d = qcut(df.where(_c(p).isNotNull()), p, q, name="pred_decile")
    return d.groupBy("pred_decile").agg(F.avg(p).alias("avg_pred"), F.avg(y).alias("avg_actual"),
                                        F.count(F.lit(1)).alias("n"))


def title_errors(df: DataFrame, title: str, y: str, p: str, min_n: int = 3, k: int = 15) -> DataFrame:
    e = _c(p) - _c(y)
    g = (df.where(_c(title).isNotNull()).groupBy(title)
         .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")))
    return g.where(F.col("n") >= min_n).orderBy(F.col("mae").desc(), F.col(title)).limit(k)


def fold_stability(fold_metrics: DataFrame, by: str = "model", tol: float = 0.01) -> DataFrame:
    """Mean and population std of per-fold R2 / RMSE, stable when the R2 std < ``tol``."""
    g = fold_metrics.groupBy(by).agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
                                     F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
                                     F.count(F.lit(1)).alias("folds"))
    return g.withColumn("stable", F.col("r2_std") < tol)


def overfit_gap(train_r2: Column, oof_r2: Column, tol: float = 0.05) -> list[Column]:
    gap = train_r2 - oof_r2
    return [gap.alias("gap"), F.when(gap < tol, "ok").otherwise("overfit").alias("verdict")]


def prediction_bands(df: DataFrame, p: str, mae: float, rmse: float) -> DataFrame:
    """Practical (+-15 %), expected (+-MAE) and broad (+-RMSE, +-2 RMSE) ranges, floored at 0."""
    z = F.lit(0.0)
    return df.withColumns({
        "practical_low": F.greatest(_c(p) * 0.85, z), "practical_high": _c(p) * 1.15,
        "mae_low": F.greatest(_c(p) - mae, z), "mae_high": _c(p) + mae,
        "rmse_low": F.greatest(_c(p) - rmse, z), "rmse_high": _c(p) + rmse,
        "rmse2_low": F.greatest(_c(p) - 2 * rmse, z), "rmse2_high": _c(p) + 2 * rmse})


def winkler(y: float, lo: float, hi: float, alpha: float = 0.10) -> float:
    """Scalar Winkler score (reference for tests)."""
    pen = (2 / alpha) * (lo - y) if y < lo else ((2 / alpha) * (y - hi) if y > hi else 0.0)
    return (hi - lo) + pen


def conformal_position(n: int, alpha: float) -> int:
    lvl = min(1.0, max(0.0, math.ceil((n + 1) * (1 - alpha)) / n))
    return math.ceil(lvl * (n - 1))
