"""Cross-validation and learning curve on small matrices of their own."""

import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from hiresight.plans import modeling

TE = modeling.TE_COLS


def _learners(trees=None):
    return {"gbt": GBTRegressor(maxIter=2, maxDepth=2, seed=1), "gbt_deep": GBTRegressor(maxIter=1, maxDepth=3, seed=2)}


@pytest.fixture
def fits(monkeypatch):
    """Whether the rows of each fit were kept."""
    seen, fit, lock = [], GBTRegressor._fit, threading.Lock()

    def record(self, df):
        with lock:
            seen.append("InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString())
        return fit(self, df)

    monkeypatch.setattr(GBTRegressor, "_fit", record)
    monkeypatch.setattr(modeling, "learners", _learners)
    return seen


def test_split_rows_are_kept_for_all_learners(spark, monkeypatch, fits):
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 5, float(10 + r.normal())) for i in range(200)], "job_id long, fold int, y_log double")
    rows = rows.select("*", *[(F.col("job_id") % 3).cast("string").alias(c) for c in TE],
                       array_to_vector(F.array(F.col("job_id") % 7 * 1.0, F.col("y_log"))).alias("plain"))
    monkeypatch.setattr(modeling.salary_features, "fitted_plain", lambda t: {"rows": rows})
    monkeypatch.setattr(modeling.salary_features, "feature_names", lambda: ["a", "b"] + TE)
    out = modeling.cross_validate(SimpleNamespace(spark=spark, source=None))
    assert fits == [True] * 10
    assert out["oof"].columns == ["job_id", "fold", "model", "pred_log", "y_log"]
    assert sorted((x.job_id, x.model) for x in out["oof"].collect()) == sorted((i, m) for i in range(200) for m in _learners())
    assert all(x.fold == x.job_id % 5 for x in out["oof"].collect())
    got = {(x.model, x.split): x.n for x in out["train"].groupBy("model", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(m, f): 160 for m in _learners() for f in range(5)}
    assert out["importance"].count() == 2 * 5 * (2 + len(TE))


def test_learning_curve_keeps_its_rows(spark, monkeypatch, fits):
    r = np.random.default_rng(4)
    d = spark.createDataFrame([(i, float(r.normal())) for i in range(300)], "job_id long, y_log double")
    d = d.withColumn("features", array_to_vector(F.array(F.col("y_log"), F.col("job_id") % 5 * 1.0)))
    monkeypatch.setattr(modeling, "final_model", lambda t: {"train": d})
    got = modeling.learning_curve(SimpleNamespace(spark=spark, source=None), sizes=(0.5, 1.0), folds=2).orderBy("size").collect()
    assert fits == [True] * 4
    assert [x["size"] for x in got] == [0.5, 1.0] and got[1]["train_rows"] == 150 and got[0]["plateau"] is None


def test_param_search_runs_the_whole_budget(spark, monkeypatch):
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "job_id long, y_log double")
    d = d.withColumn("features", array_to_vector(F.array(F.col("y_log"))))
    monkeypatch.setattr(modeling, "final_model", lambda t: {"train": d})

    class Search:
        def __init__(self, estimator, estimatorParamMaps, foldCol, numFolds, **kw):
            self.avgMetrics, self.folds = [1.0 / (i + 1) for i in range(len(estimatorParamMaps))], numFolds

        def fit(self, df):
            assert self.folds == 2 and df.count() == 40
            return self

    monkeypatch.setattr(modeling, "CrossValidator", Search)
    t = SimpleNamespace(spark=spark, source=None)
    got = modeling.param_search(t).collect()
    assert {m: sum(x["learner"] == m for x in got) for m in modeling.learners()} == {"gbt": 30, "gbt_deep": 30, "forest": 15}
    assert modeling.param_search(t, trials={"forest": 1}).count() == 1


def test_a_value_is_set_in_a_vector(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], 9.0), ([4.0, 5.0, 6.0], -1.0)], "a array<double>, x double")
    for i in range(3):
        c = modeling._with_value("a", i, 3, F.col("x"))
        assert "lambda" not in c._jc.toString()
        got = [r[0].toArray().tolist() for r in d.select(c).collect()]
        assert got == [[9.0 if j == i else float(j + 1) for j in range(3)], [-1.0 if j == i else float(j + 4) for j in range(3)]]


def test_partial_dependence_of_a_linear_model(spark, monkeypatch):
    d = spark.createDataFrame([(i, float(i % 11), float(3 * i % 7)) for i in range(77)], "job_id long, u double, v double")
    d = d.select("job_id", (2 * F.col("u") - F.col("v")).alias("y_log"), array_to_vector(F.array("u", "v")).alias("features"))
    model = LinearRegression(labelCol="y_log").fit(d)

    class Fitted:
        featureImportances = DenseVector([0.7, 0.3])
        transform = model.transform

    monkeypatch.setattr(modeling, "final_model", lambda t: {"train": d, "model": Fitted, "columns": ["u", "v"]})
    out = modeling.partial_dependence(None, k=2, grid=3)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["feature"], r["value"]): (r["mean_pred_log"], r["slope"]) for r in out.collect()}
    assert sorted(got) == [("u", 0.0), ("u", 5.0), ("u", 10.0), ("v", 0.0), ("v", 3.0), ("v", 6.0)]
    for (f, x), (mean, slope) in got.items():
        assert mean == pytest.approx(2 * x - 3 if f == "u" else 10 - x) and slope == pytest.approx(2 if f == "u" else -1)
