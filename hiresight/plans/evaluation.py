"""Evaluation reports. The operators are generic over (actual, prediction) rows; here they run
over a deterministic out-of-fold baseline (median log salary of the other four folds for the
posting's experience level), so every statistic has a SQL twin. The learned models of
``plans.modeling`` feed the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, rules
from ..operators import agg, evaluate, features, stats
from ..session import write_back
from ..sources.tables import JobTables
from . import featureset, market

SEGMENTS = {"experience": "formatted_experience_level", "industry": "primary_industry",
            "state": "state", "remote": "remote_label", "salary_band": "salary_band",
            "title_family": "title_family", "pay_period": "pay_period"}
SEGMENT_MIN_N = {"experience": 80, "industry": 80, "state": 80, "title_family": 80,
                 "remote": 40, "salary_band": 40, "pay_period": 40}
ALPHA = 0.10


_CACHE: dict = {}


def baseline_oof(t: JobTables) -> DataFrame:
    """(job_id, fold, actual_salary, pred_salary, segment columns, title, part).

    Read by every evaluation step (train/calibration splits, scalar statistics), so it is
    written once per stored table set under the shared checkpoint folder."""
    key = (t.spark.sparkContext.applicationId, t.source)
    if t.source is not None and key in _CACHE:
        return _CACHE[key]
    d = write_back(_baseline_oof(t), "baseline-oof")
    if t.source is not None:
        _CACHE[key] = d
    return d


def _baseline_oof(t: JobTables) -> DataFrame:
    u = featureset.usable_rows(t)
    enc = features.target_encode_oof(u, "job_id", ["formatted_experience_level"], "y_log", "fold", 5,
                                     smoothing=0.0, min_count=1, prefix="pred_")
    d = u.join(enc, "job_id").select(
        "job_id", "fold", F.col("normalized_salary").alias("actual_salary"),
        F.greatest(F.expm1("pred_formatted_experience_level"), F.lit(0.0)).alias("pred_salary"),
        "formatted_experience_level", "primary_industry", "state", "title_family",
        F.coalesce("pay_period", F.lit("Unknown")).alias("pay_period"), "title",
        F.when(F.col("remote_flag") == 1, "Remote").otherwise("Non-remote / unknown").alias("remote_label"))
    d = d.withColumn("salary_band", clean.band("actual_salary", *rules.SALARY_BANDS_MODEL, include_lowest=True))
    return stats.split_stratified(d, "job_id", "actual_salary", {"cal": 0.2, "test": 0.2}, "fit")


def baseline_metrics(t: JobTables) -> DataFrame:
    return evaluate.metrics(baseline_oof(t), "actual_salary", "pred_salary")


def baseline_fold_metrics(t: JobTables) -> DataFrame:
    return evaluate.metrics(baseline_oof(t), "actual_salary", "pred_salary", by="fold")


def baseline_segment_metrics(t: JobTables) -> DataFrame:
    return evaluate.segment_metrics(baseline_oof(t), SEGMENTS, "actual_salary", "pred_salary",
                                    SEGMENT_MIN_N, top_n=20)


def baseline_intervals(t: JobTables) -> DataFrame:
    """Residual-quantile interval from the fit rows and conformal interval from the calibration
    rows, both scored on the test rows, which neither has seen."""
    fit, cal, test = (baseline_oof(t).where(F.col("part") == x) for x in ("fit", "cal", "test"))
    a = evaluate.residual_quantile_interval(fit, test, "actual_salary", "pred_salary", ALPHA)
    b = evaluate.conformal_interval(cal, test, "actual_salary", "pred_salary", ALPHA)
    cols = ["method", "actual_salary", "lower", "upper"]
    return evaluate.interval_scores(a.select(cols).unionByName(b.select(cols)), "actual_salary", ALPHA)


def split_calibration(t: JobTables) -> DataFrame:
    """The part of every usable posting: 20 % calibration, 20 % test and the rest fit, exactly so in
    each of eight salary bins."""
    return baseline_oof(t).select("job_id", "part")


def baseline_calibration(t: JobTables) -> DataFrame:
    return evaluate.calibration_deciles(baseline_oof(t), "actual_salary", "pred_salary")


def baseline_title_errors(t: JobTables) -> DataFrame:
    return evaluate.title_errors(baseline_oof(t), "title", "actual_salary", "pred_salary")


def baseline_bias_extremes(t: JobTables) -> DataFrame:
    """8 most negative and 8 most positive industry biases (industries with >= 80 rows)."""
    seg = baseline_segment_metrics(t).where(F.col("segment") == "industry")
    return stats.top_and_bottom(seg, "bias", 8, "value")


def baseline_prediction_bands(t: JobTables) -> DataFrame:
    """Ranges around each out-of-fold prediction from the baseline's own MAE and RMSE."""
    d = baseline_oof(t)
    m = evaluate.metrics(d, "actual_salary", "pred_salary")
    mae, rmse = m.select("mae").scalar(), m.select("rmse").scalar()
    return evaluate.prediction_bands(d.select("job_id", "pred_salary"), "pred_salary", mae, rmse)


def baseline_worst_predictions(t: JobTables, k: int = 25) -> DataFrame:
    """The k most over- and k most under-predicted postings."""
    d = evaluate.error_columns(baseline_oof(t), "actual_salary", "pred_salary").select(
        "job_id", "actual_salary", "pred_salary", "residual")
    return stats.top_and_bottom(d, "residual", k, "job_id")


def baseline_best_interval(t: JobTables) -> DataFrame:
    """Highest coverage, then the narrowest mean width."""
    return baseline_intervals(t).orderBy(F.col("coverage_pct").desc(), F.col("avg_width").asc()).limit(1)


def baseline_error_by_band(t: JobTables) -> DataFrame:
    """Median absolute and percentage error, mean residual and rows per actual-salary band."""
    d = evaluate.error_columns(baseline_oof(t), "actual_salary", "pred_salary")
    d = d.withColumn("band", clean.band("actual_salary", *rules.ERROR_BANDS))
    g = agg.multi_agg_by(d, "band", {"mean_residual": F.avg("residual"), "n": F.count(F.lit(1))})
    # a band holds a large share of all rows: medians of the continuous errors are rank-based
    a = stats.grouped_quantiles(d, "band", "abs_error", [0.5], prefix="a")
    p = stats.grouped_quantiles(d, "band", "ape", [0.5], prefix="p")
    return (g.join(a, "band", "left").join(p, "band", "left")
            .select("band", F.col("a0").alias("median_abs"), F.col("p0").alias("median_pct"), "mean_residual", "n"))


def baseline_residual_normality(t: JobTables) -> DataFrame:
    """Normal fit and Jarque-Bera test of the log residuals over all rows."""
    d = baseline_oof(t).withColumn("r", F.log1p("pred_salary") - F.log1p("actual_salary"))
    fit = stats.normal_fit(d, "r")
    jb = stats.normality_test(d, "r").select("skew", "kurt", "jb")
    return fit.select("mean", "std", "n", jb.select("skew").scalar().alias("skew"),
                      jb.select("kurt").scalar().alias("kurt"), jb.select("jb").scalar().alias("jb"))


def baseline_residual_histogram(t: JobTables, bins: int = 80) -> DataFrame:
    """Density histogram of the log residuals over all rows, with the mean and the median of the
    residuals and the density of the fitted normal at each bin's middle."""
    d = baseline_oof(t).select((F.log1p("pred_salary") - F.log1p("actual_salary")).alias("r"))
    fit = stats.normal_fit(d, "r").select(F.struct("mean", "std", "n")).scalar()
    mean, std, n = fit.getField("mean"), fit.getField("std"), fit.getField("n")
    h = agg.histogram(d, "r", bins, markers=True)
    width, middle = F.col("bin_high") - F.col("bin_low"), (F.col("bin_high") + F.col("bin_low")) / 2
    z = F.try_divide(middle - mean, std)
    return h.withColumns({"density": F.try_divide(F.col("n"), n * width),
                          "normal_density": F.try_divide(F.exp(-z * z / 2), std * F.sqrt(F.lit(2.0) * F.pi()))})


def baseline_residual_trend(t: JobTables, n: int = 5000) -> DataFrame:
    """Log residual against the prediction on a reproducible sample of at most ``n`` rows, with
    a centred moving mean of width max(rows / 20, 50)."""
    d = baseline_oof(t).select("job_id", F.log1p("pred_salary").alias("log_pred"),
                               (F.log1p("actual_salary") - F.log1p("pred_salary")).alias("residual"))
    s = stats.sample_n(d, "job_id", n, seed=42)
    rows = s.count()  # at most n
    w = max(rows // 20, 50)
    return stats.rolling_mean_centered(s, [F.col("log_pred"), F.col("job_id")], "residual", w).select(
        "job_id", (F.expm1("log_pred") / 1000).alias("pred_k"), "residual", "trend")


def baseline_qq_points(t: JobTables, n: int = 3000) -> DataFrame:
    """Sorted log residuals of a reproducible sample (at most n rows) against normal quantiles
    at the Filliben plotting positions, with the straight-line fit and its correlation. The
    inverse normal runs in an Arrow-batched UDF over the bounded sample."""
    from pyspark.sql import Window

    d = baseline_oof(t).select("job_id", (F.log1p("actual_salary") - F.log1p("pred_salary")).alias("r"))
    s = stats.sample_n(d, "job_id", n, seed=42)
    m = s.count()
    w = Window.orderBy("r", "job_id")  # bounded sample
    s = s.withColumn("i", F.row_number().over(w))
    pos = (F.when(F.col("i") == 1, 1 - F.pow(F.lit(0.5), 1.0 / m))
           .when(F.col("i") == m, F.pow(F.lit(0.5), 1.0 / m))
           .otherwise((F.col("i") - 0.3175) / (m + 0.365)))
    s = s.withColumn("theoretical", stats.inverse_normal(pos))
    fit = Window.partitionBy()
    return s.select("i", F.col("r").alias("sample"), "theoretical",
                    F.regr_slope("r", "theoretical").over(fit).alias("slope"),
                    F.regr_intercept("r", "theoretical").over(fit).alias("intercept"),
                    F.corr("r", "theoretical").over(fit).alias("r_fit"))
