"""Salary models: feature table, K-fold evaluation of three MLlib learners, inverse-RMSE
ensemble, nested ridge stack, prediction intervals and model diagnostics.

The boosted-tree libraries of the original are replaced by MLlib learners behind one
interface. Target encodings are fitted inside every split (one job for all splits); the stages
that never look at the target are fitted once. The out-of-fold predictions are written once to the shared checkpoint folder and every report
reads them from there.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean, text
from ..operators import evaluate, features, linear, stats
from ..operators.mlstages import sorted_positions
from ..operators.quantiles import Quantile, group_quantiles
from ..session import scratch_path, write_back
from ..sources import sinks
from ..sources.tables import JobTables
from . import evaluation, market, salary_features, views

K = 5
TE_COLS = salary_features.TE_COLS
ALPHA = 0.10
#: the original's search budget per learner, and its tree count; the registered models have fewer trees
FULL_TRIALS = {"gbt": 30, "gbt_deep": 30, "forest": 15}
FULL_TREES = 700
FULL_SIZES = tuple(i / 10 for i in range(1, 11))


def learners(trees: int | None = None) -> dict:
    """Three different learners on the log salary (fixed seeds); ``trees`` sets all tree counts."""
    return {
        "gbt": GBTRegressor(maxIter=trees or 30, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42),
        "gbt_deep": GBTRegressor(maxIter=trees or 20, maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
                                 featureSubsetStrategy="0.6", seed=7),
        "forest": RandomForestRegressor(numTrees=trees or 40, maxDepth=8, subsamplingRate=0.8, seed=42),
    }


_CACHE: dict = {}
_LOCK = threading.Lock()


def _key(t: JobTables):
    return (t.spark.sparkContext.applicationId, t.source)


def cross_validate(t: JobTables, parallelism: int = 2) -> dict:
    """Fit every learner on every split (parallel driver threads submit independent jobs) and
    return {"oof": DataFrame(job_id, fold, model, pred_log, y_log), "importance": ...,
    "train": in-sample predictions}. Cached per stored table set.

    The feature matrix is stored once: the columns that never look at the target, and the target
    encodings of each split as five short vectors next to them. A split's rows are assembled once and
    kept while its learners, each of which passes over them several times, are fitted and score
    them; ``parallelism`` splits are worked on, and kept, at a time.
    """
    k = _key(t)
    with _LOCK:
        if t.source is not None and k in _CACHE:
            return _CACHE[k]
    rows = salary_features.fitted_plain(t)["rows"]
    enc, overall = features.split_encodings(rows, TE_COLS, "y_log", "fold", K, smoothing=40.0, min_count=8)
    d = features.apply_split_encodings(rows, TE_COLS, enc)
    matrix = write_back(d.select("job_id", "fold", "y_log", "plain", *[array_to_vector(F.array(*[
        features.split_value(c, f, overall) for c in TE_COLS])).alias(f"_te{f}") for f in range(K)]), "split-matrix")
    cols = salary_features.feature_names()
    spark: SparkSession = t.spark
    folder = scratch_path(spark, f"split-predictions-{uuid.uuid4().hex[:12]}")

    def run(f):
        d = (VectorAssembler(inputCols=["plain", f"_te{f}"], outputCol="features")
             .transform(matrix).select("job_id", "fold", "y_log", "features").persist(StorageLevel.MEMORY_AND_DISK))
        try:
            ests = learners()
            with ThreadPoolExecutor(len(ests)) as ex:
                models = dict(zip(ests, ex.map(lambda e: e.setFeaturesCol("features").setLabelCol("y_log").fit(
                    d.where(F.col("fold") != f)), ests.values())))
            for side, part in (("oof", d.where(F.col("fold") == f)), ("train", d.where(F.col("fold") != f))):
                for name, m in models.items():
                    part = m.setPredictionCol(f"_{name}").transform(part)
                pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_{n}").alias("pred_log")) for n in models]))
                part.select("job_id", "fold", pairs, "y_log").write.parquet(os.path.join(folder, side, f"split={f}"))
        finally:
            d.unpersist()
        return [(name, f, cols[i], float(v)) for name, m in models.items() for i, v in enumerate(m.featureImportances.toArray())]

    with ThreadPoolExecutor(parallelism) as ex:
        res = list(ex.map(run, range(K)))
    imp = spark.createDataFrame([row for r in res for row in r], "model string, fold int, feature string, importance double")
    out = {"oof": spark.read.parquet(os.path.join(folder, "oof")).select("job_id", "fold", "model", "pred_log", "y_log"),
           "train": spark.read.parquet(os.path.join(folder, "train")).select("model", "split", "pred_log", "y_log"),
           "importance": imp}
    if t.source is not None:
        with _LOCK:
            _CACHE[k] = out
    return out


def _raw(c) -> F.Column:
    return F.greatest(F.expm1(c), F.lit(0.0))


def model_cv_metrics(t: JobTables) -> DataFrame:
    """Per learner and fold: RMSE, MAE, R2 on salary, R2 on log salary."""
    o = cross_validate(t)["oof"].withColumns({"pred": _raw("pred_log"), "actual": F.expm1("y_log")})
    m = evaluate.metrics(o, "actual", "pred", by=["model", "fold"])
    lg = evaluate.metrics(o, "y_log", "pred_log", by=["model", "fold"]).select("model", "fold", F.col("r2").alias("log_r2"))
    return m.join(lg, ["model", "fold"])


def _weights(t: JobTables) -> DataFrame:
    cv = model_cv_metrics(t).groupBy("model").agg(F.avg("rmse").alias("cv_rmse"))
    tot = cv.select(F.sum(1 / F.col("cv_rmse"))).scalar()
    return cv.withColumn("weight", (1 / F.col("cv_rmse")) / tot)


def ensemble_oof(t: JobTables) -> DataFrame:
    """Inverse-RMSE weighted mean of the learners' log predictions, per posting."""
    o = cross_validate(t)["oof"]
    w = F.broadcast(_weights(t).select("model", "weight"))  # one row per learner
    return (o.join(w, "model").groupBy("job_id", "fold")
            .agg((F.sum(F.col("weight") * F.col("pred_log")) / F.sum("weight")).alias("pred_log"),
                 F.first("y_log").alias("y_log")))


def meta_features(t: JobTables) -> tuple[DataFrame, list[str]]:
    """Learner predictions side by side plus their mean, population std, min and max."""
    names = list(learners())
    o = cross_validate(t)["oof"]
    wide = o.groupBy("job_id", "fold", "y_log").pivot("model", names).agg(F.first("pred_log"))
    arr = F.array(*[F.col(n) for n in names])
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / len(names)
    wide = wide.withColumn("base_mean", mean)
    wide = wide.withColumns({
        "base_std": F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - F.col("base_mean")) ** 2) / len(names)),
        "base_min": F.array_min(arr), "base_max": F.array_max(arr)})
    return wide, names + ["base_mean", "base_std", "base_min", "base_max"]


PENALTIES = np.logspace(-4, 4, 50)


def stack_oof(t: JobTables) -> tuple[DataFrame, DataFrame]:
    """Nested ridge stacking: for every outer fold the ridge and its penalty (the best of 50, by
    5-fold R2 inside the other outer folds) never see the held-out fold. One aggregation gathers
    the sums of products per (outer, inner) fold; all 50 x 5 x 6 fits are solved from them. Returns
    (predictions, coefficients of the ridge on all rows). Cached per stored table set."""
    k = ("stack",) + _key(t)
    with _LOCK:
        if t.source is not None and k in _CACHE:
            return _CACHE[k]
    wide, names = meta_features(t)
    wide = write_back(stats.kfold_assign(wide, "job_id", K, seed=11, name="inner"), "meta-features")
    sums = linear.moments(wide, names, "y_log", ["fold", "inner"])
    means = sums.pop(None)

    def fit(outer):
        parts = [sum((s for (f, i), s in sums.items() if f != outer and i == j), np.zeros((len(names) + 2,) * 2))
                 for j in range(K)]
        return linear.ridge_cv(parts, PENALTIES)

    pred = F.coalesce(*[F.when(F.col("fold") == f, linear.predict(names, fit(f)[1], means)) for f in range(K)])
    preds = wide.select("job_id", "fold", "y_log", pred.alias("pred_log"))
    alpha, b, _ = fit(None)
    coef = t.spark.createDataFrame([(n, float(c), alpha) for n, c in sorted(zip(names, b[1:]), key=lambda x: -x[1])],
                                   "feature string, coefficient double, penalty double")
    out = (write_back(preds, "stack-oof"), coef)
    if t.source is not None:
        with _LOCK:
            _CACHE[k] = out
    return out


def model_comparison(t: JobTables) -> DataFrame:
    """Out-of-fold RMSE, MAE, R2, MAPE of each learner, the ensemble and the stack, and how far
    each is from the ensemble (the model before stacking)."""
    o = cross_validate(t)["oof"].withColumns({"pred": _raw("pred_log"), "actual": F.expm1("y_log")})
    a = evaluate.metrics(o, "actual", "pred", by="model")
    e = ensemble_oof(t).withColumns({"pred": _raw("pred_log"), "actual": F.expm1("y_log")})
    b = evaluate.metrics(e, "actual", "pred").withColumn("model", F.lit("ensemble"))
    s = stack_oof(t)[0].withColumns({"pred": _raw("pred_log"), "actual": F.expm1("y_log")})
    c = evaluate.metrics(s, "actual", "pred").withColumn("model", F.lit("ridge_stack"))
    u = a.unionByName(b).unionByName(c)  # one row per model
    base = F.broadcast(b.select(*[F.col(m).alias(f"_{m}") for m in ("rmse", "mae", "r2")]))
    return u.join(base).select(*u.columns, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in ("rmse", "mae", "r2")])


def stack_coefficients(t: JobTables) -> DataFrame:
    return stack_oof(t)[1]


def _interval_rows(t: JobTables) -> DataFrame:
    """Every usable row with its stack prediction and the lower and upper bounds of the three
    methods. Rows are split into fit, calibration and test parts (60 / 20 / 20 in each of eight
    salary bins): residual quantiles and quantile regression come from the fit rows, the conformal
    width from the calibration rows. Cached per stored table set."""
    k = ("intervals",) + _key(t)
    with _LOCK:
        if t.source is not None and k in _CACHE:
            return _CACHE[k]
    wide, names = meta_features(t)
    d = (stack_oof(t)[0].select("job_id", "pred_log").join(wide, "job_id")
         .withColumns({"pred": _raw("pred_log"), "actual": F.expm1("y_log")}))
    d = write_back(stats.split_stratified(d, "job_id", "actual", {"cal": 0.2, "test": 0.2}, "fit"), "interval-rows")
    fit, cal = d.where("part = 'fit'"), d.where("part = 'cal'")
    low, high = linear.quantile_regression(fit, names, "actual", [ALPHA / 2, 1 - ALPHA / 2])

    def line(r):
        return linear.predict(names, np.array([r["intercept"], *r["coefficients"]]), np.zeros(len(names) + 1))

    zero, pred = F.lit(0.0), F.col("pred")
    out = d.withColumns({"quantile_low": F.greatest(F.least(line(low), pred), zero),
                         "quantile_high": F.greatest(line(high), pred)})
    for name, f in (("residual", evaluate.residual_quantile_interval(fit, out, "actual", "pred", ALPHA)),
                    ("conformal", None)):
        f = f if f is not None else evaluate.conformal_interval(cal, out, "actual", "pred", ALPHA)
        out = f.withColumnsRenamed({"lower": f"{name}_low", "upper": f"{name}_high"}).drop("method")
    out = write_back(out.select("job_id", "part", "actual", "pred", *[f"{m}_{e}" for m in (
        "residual", "quantile", "conformal") for e in ("low", "high")]), "interval-bounds")
    if t.source is not None:
        with _LOCK:
            _CACHE[k] = out
    return out


def model_intervals(t: JobTables) -> DataFrame:
    """Coverage, width and Winkler score of the three methods on the test part, which none of them
    has seen."""
    d = _interval_rows(t).where("part = 'test'")
    u = None
    for method, m in (("residual_quantile", "residual"), ("quantile_regression", "quantile"), ("conformal", "conformal")):
        r = d.select(F.lit(method).alias("method"), "actual", F.col(f"{m}_low").alias("lower"), F.col(f"{m}_high").alias("upper"))
        u = r if u is None else u.unionByName(r)
    return evaluate.interval_scores(u, "actual", ALPHA)


def interval_sample(t: JobTables, n: int = 80) -> DataFrame:
    """A reproducible sample of ``n`` postings with all bounds, numbered by actual salary."""
    s = stats.sample_n(_interval_rows(t).drop("part"), "job_id", n, seed=42)
    return s.withColumn("ord", F.row_number().over(Window.orderBy("actual", "job_id")))  # n rows


def _stack_rows(t: JobTables) -> DataFrame:
    s = stack_oof(t)[0].withColumns({"pred_salary": _raw("pred_log"), "actual_salary": F.expm1("y_log")})
    seg = evaluation.baseline_oof(t).drop("pred_salary", "actual_salary", "fold")
    return s.join(seg, "job_id")


def model_segment_metrics(t: JobTables) -> DataFrame:
    return evaluate.segment_metrics(_stack_rows(t), evaluation.SEGMENTS, "actual_salary", "pred_salary",
                                    evaluation.SEGMENT_MIN_N, top_n=20)


def model_calibration(t: JobTables) -> DataFrame:
    return evaluate.calibration_deciles(_stack_rows(t), "actual_salary", "pred_salary")


def model_title_errors(t: JobTables) -> DataFrame:
    return evaluate.title_errors(_stack_rows(t), "title", "actual_salary", "pred_salary")


def model_fold_stability(t: JobTables) -> DataFrame:
    return evaluate.fold_stability(model_cv_metrics(t), by="model")


def model_overfit_gap(t: JobTables) -> DataFrame:
    """Training R2 against out-of-fold R2 of the same learner (log scale)."""
    cv = cross_validate(t)
    tr = evaluate.metrics(cv["train"], "y_log", "pred_log", by="model").select("model", F.col("r2").alias("train_r2"))
    oo = evaluate.metrics(cv["oof"], "y_log", "pred_log", by="model").select("model", F.col("r2").alias("oof_r2"))
    j = tr.join(oo, "model")
    return j.select("model", "train_r2", "oof_r2", *evaluate.overfit_gap(F.col("train_r2"), F.col("oof_r2")))


def model_feature_importance(t: JobTables, k: int = 25) -> DataFrame:
    """Mean split importance of each feature over learners and folds, top k."""
    imp = cross_validate(t)["importance"].groupBy("feature").agg(F.avg("importance").alias("importance"))
    return imp.orderBy(F.col("importance").desc(), "feature").limit(k)


# --- serving: one model fitted on all usable rows, saved, loaded, batch scoring, scenarios -------
def final_model(t: JobTables) -> dict:
    """The whole pipeline (encoders, imputers, text projections, assembly, boosted trees) fitted on
    every usable row, saved with its metrics and loaded again; every score comes from the loaded
    pipeline. Cached per stored table set."""
    k = ("final",) + _key(t)
    with _LOCK:
        if t.source is not None and k in _CACHE:
            return _CACHE[k]
    plain = salary_features.fitted_plain(t)
    models, rows = salary_features.fit_stages(salary_features.target_stages(), plain["rows"], "final-features")
    train = write_back(rows.select("job_id", "y_log", "features"), "final-matrix")
    gbt = learners()["gbt"].setFeaturesCol("features").setLabelCol("y_log").fit(train)
    folder = scratch_path(t.spark, f"salary-model-{uuid.uuid4().hex[:12]}")
    sinks.register_model(PipelineModel(plain["models"] + models + [gbt]), folder, "salary_gbt",
                         {"rows": train.count(), "log_target": 1.0})
    out = {"pipeline": sinks.load_model([os.path.join(folder, "salary_gbt")]), "folder": folder, "model": gbt,
           "columns": salary_features.feature_names(), "base": plain["base"], "train": train}
    if t.source is not None:
        with _LOCK:
            _CACHE[k] = out
    return out


def score_batch(t: JobTables) -> DataFrame:
    """Estimated salary for every posting (requests are rows, scored by one transform)."""
    k = ("scores",) + _key(t)
    with _LOCK:
        if t.source is not None and k in _CACHE:
            return _CACHE[k]
    p = final_model(t)["pipeline"].transform(salary_features.request_rows(t))
    out = write_back(p.select("job_id", F.col("prediction").alias("pred_log"), _raw("prediction").alias("pred_salary")),
                     "batch-scores")
    if t.source is not None:
        with _LOCK:
            _CACHE[k] = out
    return out


def scenario_scores(t: JobTables) -> DataFrame:
    """Each request's four scenarios scored by the final model, with the change against the
    current scenario. A scenario replaces the level and all that follows from it (its interactions
    and codes), the remote flag, the counts of skills and benefits and the indicators of the skills
    and benefits that it adds by name."""
    exp, ind = "formatted_experience_level", "primary_industry"
    feats = salary_features.request_rows(t)
    sc = market.scenarios(t).select(F.col("request_id").alias("job_id"), "scenario", F.col(exp).alias("_level"),
                                    F.col("n_skills").alias("_n_skills"), F.col("n_benefits").alias("_n_benefits"),
                                    F.col("remote_flag").alias("_remote"), "added_skills", "added_benefits")
    rows = feats.join(sc, "job_id")
    changed = F.col("scenario") == "one_level_up"
    rows = rows.withColumn(exp, F.when(changed, F.col("_level")).otherwise(F.col(exp)))
    named = {}
    for bridge, label, k, prefix, added in ((views.skills_bridge(t), "skill_name", 50, "skill_top", "added_skills"),
                                            (views.benefits_known(t), "type", 10, "benefit_top", "added_benefits")):
        for r in features.label_ranks(bridge, label, k).collect():  # at most k labels
            c = f"{prefix}{r['rank']:02d}"
            named[c] = F.greatest(F.col(c), F.array_contains(added, r[label]).cast("double"))
    rows = rows.withColumns({
        **named, "n_skills": F.col("_n_skills").cast("double"), "n_benefits": F.col("_n_benefits").cast("double"),
        "remote_flag": F.col("_remote").cast("double"), "exp_industry": clean.interaction(exp, ind),
        "exp_title_cluster": clean.interaction(exp, "title_cluster"), "remote_industry": clean.interaction("_remote", ind)})
    rows = rows.withColumnRenamed("job_id", "request_id")
    p = final_model(t)["pipeline"].transform(rows).select("request_id", "scenario", _raw("prediction").alias("pred_salary"))
    p = write_back(p, "scenario-scores")
    cur = p.where(F.col("scenario") == "current").select("request_id", F.col("pred_salary").alias("_cur"))
    return p.join(cur, "request_id").withColumn("diff_vs_current", F.col("pred_salary") - F.col("_cur")).drop("_cur")


def saved_model_check(t: JobTables) -> DataFrame:
    """The registry row of the saved pipeline, and the largest difference over all usable rows
    between the loaded pipeline's scores from raw columns and the fitted model's from its matrix."""
    fm = final_model(t)
    a = fm["model"].transform(fm["train"]).select("job_id", F.col("prediction").alias("a"))
    b = fm["pipeline"].transform(fm["base"]).select("job_id", F.col("prediction").alias("b"))
    worst = a.join(b, "job_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d")).select("d").scalar()
    row = sinks.load_manifest(t.spark, fm["folder"])
    return row.select("output", "kind", F.size("columns").alias("n_stages"),
                      F.col("metrics")["rows"].cast("long").alias("n_rows"), worst.alias("max_difference"))


def feature_matrix(t: JobTables) -> DataFrame:
    """The assembled matrix written as a table of its own and entered in a manifest; the query
    returns the manifest's row (rows, columns and label mean are taken during the write)."""
    fm = final_model(t)
    folder = scratch_path(t.spark, f"matrix-{uuid.uuid4().hex[:12]}")
    sinks.write_feature_matrix(fm["train"], folder, "feature_matrix", "job_id", ["features"], "y_log")
    return sinks.load_manifest(t.spark, folder).select(
        "output", "kind", "n_rows", F.col("metrics")["label_mean"].alias("label_mean"))


def _with_value(a: str, i: int, n: int, x: F.Column) -> F.Column:
    """The vector of array ``a``, of ``n`` numbers, with ``x`` at place ``i``; copied in pieces, as a
    lambda would be called for every number."""
    return array_to_vector(F.concat(F.slice(a, 1, i), F.array(x), F.slice(a, i + 2, n - i - 1)))


def permutation_importance(t: JobTables, k: int = 10, seed: int = 5) -> DataFrame:
    """RMSE rise (log scale) when one feature's values are shuffled among the training rows,
    for the k features with the largest split importance. All rows are numbered in a seeded hash
    order and row i takes the values of row i + 1 (one join for all features, no window); the model
    and the other features stay fixed."""
    from pyspark.ml.functions import vector_to_array
    fm = final_model(t)
    cols = fm["columns"]
    imp = sorted(zip(cols, fm["model"].featureImportances.toArray()), key=lambda x: -x[1])[:k]
    d = fm["train"].withColumns({"_a": vector_to_array("features"), "_h": stats.hash_order(F.col("job_id"), seed)})
    d = sorted_positions(d, ["_h", "job_id"], "_at")
    n = d.count()
    partner = d.select(F.pmod(F.col("_at") - 1, F.lit(max(n, 1))).alias("_at"),
                       F.array(*[F.col("_a")[cols.index(c)] for c, _ in imp]).alias("_p"))
    d = write_back(d.join(partner, "_at").select("y_log", "features", "_a", "_p"), "perm-base")
    base_rmse = fm["model"].transform(d).select(F.sqrt(F.avg((F.col("prediction") - F.col("y_log")) ** 2))).scalar()
    out = None
    for place, (name, score) in enumerate(imp):
        i = cols.index(name)
        sh = d.withColumn("features", _with_value("_a", i, len(cols), F.col("_p")[place]))
        r = fm["model"].transform(sh).select(
            F.lit(name).alias("feature"), F.lit(float(score)).alias("split_importance"),
            (F.sqrt(F.avg((F.col("prediction") - F.col("y_log")) ** 2)) - base_rmse).alias("rmse_increase"))
        out = r if out is None else out.unionByName(r)
    return out


def partial_dependence(t: JobTables, k: int = 4, grid: int = 10) -> DataFrame:
    """Mean predicted log salary when one of the k most important features is set to each of
    ``grid`` quantiles of its values (rows x grid via explode of a bounded list), and the
    least-squares slope of that curve."""
    from pyspark.ml.functions import vector_to_array
    fm = final_model(t)
    cols = fm["columns"]
    imp = sorted(zip(cols, fm["model"].featureImportances.toArray()), key=lambda x: -x[1])[:k]
    d = fm["train"].withColumn("_a", vector_to_array("features"))
    out = None
    own = d.select(*[F.col("_a")[cols.index(name)].alias(f"_f{n}") for n, (name, _) in enumerate(imp)])
    found = group_quantiles(own, [], {f"q{n}_{j}": Quantile(F.col(f"_f{n}"), j / (grid - 1))
                                      for n in range(len(imp)) for j in range(grid)}).first()  # k * grid numbers
    for n, (name, _) in enumerate(imp):
        i = cols.index(name)
        qs = [found[f"q{n}_{j}"] for j in range(grid)] if found is not None else []
        vals = sorted(set(float(x) for x in qs if x is not None))  # at most `grid` values
        g = d.withColumn("_x", F.explode(F.array(*[F.lit(x) for x in vals])))
        g = g.withColumn("features", _with_value("_a", i, len(cols), F.col("_x")))
        r = fm["model"].transform(g).groupBy("_x").agg(F.avg("prediction").alias("mean_pred_log"))
        r = r.select(F.lit(name).alias("feature"), F.col("_x").alias("value"), "mean_pred_log")
        out = r if out is None else out.unionByName(r)
    w = Window.partitionBy("feature")  # at most k * grid rows
    return out.withColumn("slope", F.regr_slope("mean_pred_log", "value").over(w))


#: what each learner's search draws from; the first trial is the default setting
SPACES = {
    "gbt": {"maxIter": [20, 30, 40, 60], "maxDepth": [3, 4, 5, 6], "stepSize": [0.05, 0.08, 0.1, 0.15],
            "subsamplingRate": [0.7, 0.8, 0.9, 1.0]},
    "gbt_deep": {"maxIter": [15, 20, 30], "maxDepth": [5, 6, 7], "stepSize": [0.05, 0.08, 0.1],
                 "subsamplingRate": [0.7, 0.8, 0.9]},
    "forest": {"numTrees": [30, 40, 60, 80], "maxDepth": [6, 8, 10], "minInstancesPerNode": [1, 3, 5],
               "subsamplingRate": [0.7, 0.8, 1.0]},
}


def param_search(t: JobTables, trials: dict[str, int] | None = None, seed: int = 3, folds: int = 2) -> DataFrame:
    """Seeded random search of each learner's settings, scored by 2-fold cross-validated RMSE (log
    scale), with the best score so far after each trial. ``trials`` per learner: the original's
    budget, ``FULL_TRIALS``, unless the caller names another. Cached per stored table set."""
    import random
    trials = FULL_TRIALS if trials is None else trials
    k = ("search", tuple(sorted(trials.items())), seed, folds) + _key(t)
    with _LOCK:
        if t.source is not None and k in _CACHE:
            return _CACHE[k]
    d = write_back(stats.kfold_assign(final_model(t)["train"], "job_id", folds, seed=17, name="half"), "search-rows")
    rows = []
    for learner, n in trials.items():
        rnd = random.Random(f"{seed}:{learner}")
        est = learners()[learner].setFeaturesCol("features").setLabelCol("y_log")
        space = [{}] + [{est.getParam(p): rnd.choice(v) for p, v in SPACES[learner].items()} for _ in range(n - 1)]
        cv = CrossValidator(estimator=est, estimatorParamMaps=space, foldCol="half", numFolds=folds, parallelism=6,
                            evaluator=RegressionEvaluator(labelCol="y_log", metricName="rmse")).fit(d)
        rows += [(learner, i + 1, json.dumps({p: {**{est.getParam(q): est.getOrDefault(q) for q in SPACES[learner]}, **m}[
            est.getParam(p)] for p in SPACES[learner]}, sort_keys=True), float(x))
                 for i, (m, x) in enumerate(zip(space, cv.avgMetrics))]
    df = t.spark.createDataFrame(rows, "learner string, trial int, settings string, cv_rmse double")
    w = Window.partitionBy("learner").orderBy("trial").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("best_so_far", F.min("cv_rmse").over(w))  # one row per trial
    if t.source is not None:
        with _LOCK:
            _CACHE[k] = out
    return out


def learning_curve(t: JobTables, sizes=FULL_SIZES, folds: int = 3, plateau: float = 0.005, trees: int = 10) -> DataFrame:
    """Training and validation R2 and RMSE (log scale) of the boosted trees on growing
    hash-selected shares of the training folds, and whether the validation R2 gains less than
    ``plateau`` over the previous size."""
    fm = final_model(t)
    d = stats.kfold_assign(fm["train"], "job_id", folds, seed=23, name="lc_fold")
    d = write_back(d.withColumn("_u", stats.hash_unit(F.col("job_id"), 29)), "learning-curve")
    d = d.persist(StorageLevel.MEMORY_AND_DISK)  # every fit passes over its rows several times
    est = learners(trees)["gbt"].setFeaturesCol("features").setLabelCol("y_log")

    def scores(df, size, f, side):
        return df.select(F.lit(float(size)).alias("size"), F.lit(f).alias("fold"), F.lit(side).alias("side"), "y_log", "prediction")

    def run(task):
        size, f = task
        tr = d.where((F.col("lc_fold") != f) & (F.col("_u") < size))
        m = est.fit(tr)
        both = scores(m.transform(tr), size, f, "train").unionByName(
            scores(m.transform(d.where(F.col("lc_fold") == f)), size, f, "val"))
        return [tuple(r) for r in evaluate.metrics(both, "y_log", "prediction", by=["size", "fold", "side"])
                .select("size", "fold", "side", "n", "r2", "rmse").collect()]  # two rows

    try:
        with ThreadPoolExecutor(4) as ex:
            res = [r for rows in ex.map(run, [(s, f) for s in sizes for f in range(folds)]) for r in rows]
    finally:
        d.unpersist()
    df = t.spark.createDataFrame(res, "size double, fold int, side string, n long, r2 double, rmse double")

    def mean(side, c):
        return F.avg(F.when(F.col("side") == side, F.col(c)))

    g = df.groupBy("size").agg(mean("train", "r2").alias("train_r2"), mean("val", "r2").alias("val_r2"),
                               mean("train", "rmse").alias("train_rmse"), mean("val", "rmse").alias("val_rmse"),
                               mean("train", "n").alias("train_rows"))
    w = Window.orderBy("size")  # len(sizes) rows
    gain = F.col("val_r2") - F.lag("val_r2").over(w)
    return g.withColumn("val_gain", gain).withColumn("plateau", gain < plateau)


def tuning_table(t: JobTables) -> DataFrame:
    """Per learner the default settings against the best searched ones: cross-validated RMSE and
    the change in percent."""
    ps = param_search(t)
    best = ps.groupBy("learner").agg(F.min_by(F.struct("trial", "settings", "cv_rmse"), F.struct("cv_rmse", "trial")).alias("b"),
                                     F.max(F.when(F.col("trial") == 1, F.col("cv_rmse"))).alias("default_rmse"))
    return best.select("learner", "b.trial", "b.settings", F.col("b.cv_rmse").alias("tuned_rmse"), "default_rmse",
                       (F.try_divide(F.col("b.cv_rmse") - F.col("default_rmse"), F.col("default_rmse")) * 100).alias("delta_pct"))


def model_reliability(t: JobTables) -> DataFrame:
    """Reliability of the model's own estimate of every posting."""
    return market.reliability(t, score_batch(t).select("job_id", "pred_salary"))


def estimate_report(t: JobTables) -> DataFrame:
    """One JSON document per posting: when, by which model and for which request (fields and their
    signature) it was made, the model's estimate with practical / MAE / RMSE ranges from the
    ensemble's out-of-fold errors, similar-posting quartiles and reliability."""
    rel = model_reliability(t).select("request_id", "reliability")
    sim = market.similar_postings(t).select("request_id", "p25", "p50", "p75")
    e = model_comparison(t).where("model = 'ensemble'").select("mae", "rmse")
    p = score_batch(t).select(F.col("job_id").alias("request_id"), "pred_salary")
    bands = evaluate.prediction_bands(p, "pred_salary", e.select("mae").scalar(), e.select("rmse").scalar())
    fields = ["title", "formatted_experience_level", "state", "city", "remote_flag", "company_size", "skills", "benefits"]
    req = market.request_profile(t).select(F.col("job_id").alias("request_id"), *fields)
    d = bands.join(sim, "request_id").join(rel, "request_id").join(req, "request_id")
    doc = F.to_json(F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.lit("salary_gbt").alias("model_name"),
        text.signature(*fields).alias("input_signature"), F.round("pred_salary", 2).alias("prediction"),
        F.array(F.round("practical_low", 2), F.round("practical_high", 2)).alias("practical_range"),
        F.array(F.round("mae_low", 2), F.round("mae_high", 2)).alias("expected_zone_mae"),
        F.array(F.round("rmse_low", 2), F.round("rmse_high", 2)).alias("broad_zone_rmse"),
        F.array("p25", "p50", "p75").alias("similar_postings_p25_p50_p75"), "reliability",
        F.struct(*fields).alias("payload")))
    return d.select("request_id", doc.alias("report"))
