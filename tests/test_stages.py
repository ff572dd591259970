"""Fitted stages that persist, text projections, stratified splits, fits from sums, prompts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hiresight.operators import joins, linear, mlstages, prompts, quantiles, stats
from hiresight.plans import salary_features
from hiresight.sources import sinks


def _rows(spark):
    titles = ["Senior Data Engineer", "Registered Nurse", "Sales Manager é", "Data Analyst", None, "the", "Ingénieur Data"]
    rows = [(i, titles[i % 7], ["a", "b", None][i % 3], float(i % 7), None if i % 5 == 0 else float(i)) for i in range(70)]
    return spark.createDataFrame(rows, "job_id long, text string, cat string, y double, x double")


def test_pipeline_saves_and_loads_with_equal_scores(spark, tmp_path):
    df = _rows(spark)
    te, svd = ["te_cat"], [f"text_svd_{i:03d}" for i in range(1, 4)]
    pipe = Pipeline(stages=[
        mlstages.MedianTargetEncoder(cols=["cat"], target="y", smoothing=5.0, min_count=2),
        mlstages.OrdinalEncoder(cols=["cat", "text"]), mlstages.MedianImputer(cols=["x"]), mlstages.Log1p(cols=["x"]),
        mlstages.ConstantImputer(cols=["flag"], value=0.0), mlstages.TfIdf(col="text", max_features=40, components=3),
        mlstages.Standardizer(cols=["x"] + te + svd),
        VectorAssembler(inputCols=["x", "cat_code", "flag"] + te + svd, outputCol="features"),
        LinearRegression(labelCol="y", regParam=0.1)])
    model = pipe.fit(df)
    sinks.register_model(model, str(tmp_path), "m", {"rmse": 1.5})
    loaded = sinks.load_model([str(tmp_path / "absent"), str(tmp_path / "m")])
    assert isinstance(loaded, PipelineModel)
    new = df.unionByName(spark.createDataFrame([(900, "unheard of", "zz", None, float("nan"))], df.schema))
    a, b = (m.transform(new).orderBy("job_id").select("job_id", "cat_code", "te_cat", "prediction").collect() for m in (model, loaded))
    assert a == b
    assert a[-1]["cat_code"] == -1 and a[-1]["te_cat"] == pytest.approx(a[2]["te_cat"], abs=10)
    assert sinks.load_metrics_bundle(spark, str(tmp_path)) == {"m": {"rmse": 1.5}}


def test_ordinal_codes_are_alphabetical_ranks(spark):
    r = np.random.default_rng(0)
    words = sorted({"".join(r.choice(list("abé Z"), 4)) for _ in range(400)}, key=lambda w: w.encode())
    fit = spark.createDataFrame([(w,) for w in words for _ in range(2)] + [(None,)], "w string").repartition(7)
    m = mlstages.OrdinalEncoder(cols=["w"]).fit(fit)
    got = {x["w"]: x["w_code"] for x in m.transform(spark.createDataFrame([(w,) for w in words + ["new", None]], "w string")).collect()}
    assert got == {**{w: i for i, w in enumerate(words)}, "new": -1, None: -1}


def test_imputer_and_scaler_match_numpy(spark):
    x = np.array([1.0, 5.0, np.nan, 2.0, 100.0, 7.0])
    df = spark.createDataFrame([(float(v), None if i == 1 else 3.0, None) for i, v in enumerate(x)], "a double, b double, c double")
    m = Pipeline(stages=[mlstages.MedianImputer(cols=["a", "b", "c"]), mlstages.Standardizer(cols=["a", "b", "c"])]).fit(df)
    got = m.transform(df).toPandas()
    full = np.where(np.isnan(x), np.nanmedian(x), x)
    assert np.allclose(got["a"], (full - full.mean()) / full.std())
    assert (got["b"] == 0).all() and (got["c"] == 0).all()  # constant: centred only


def _dense(model, df):
    w = model.weights(df).toPandas()
    a = np.zeros((int(df.agg(F.max("job_id")).first()[0]) + 1, model.tables["vocabulary"].count()))
    a[w["job_id"], w["place"]] = w["w"]
    return a


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_matches_the_definition(spark, sublinear):
    texts = ["Data data engineer", "the data nurse", "Café data", None, "nurse nurse nurse cafe", "x yy"]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id long, text string")
    m = mlstages.TfIdf(max_features=6, min_df=1, max_df=0.5, sublinear=sublinear, strip_accents=True, stopwords=True).fit(df)
    docs = [[], [], [], [], [], []]
    for i, t in enumerate(texts):
        w = [x for x in (t or "").lower().replace("é", "e").split() if len(x) > 1 and x != "the"]
        docs[i] = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    df_of = {x: sum(x in d for d in docs) for d in docs for x in d}
    total = {x: sum(d.count(x) for d in docs) for x in df_of}
    keep = sorted(sorted((x for x in df_of if df_of[x] <= 3), key=lambda x: (-total[x], x))[:6])
    v = {r["term"]: r for r in m.tables["vocabulary"].collect()}
    assert sorted(v) == keep
    assert all(v[x]["doc_freq"] == df_of[x] and v[x]["total"] == total[x] for x in keep)
    for i, d in enumerate(docs):
        w = np.array([((1 + np.log(d.count(x))) if sublinear else d.count(x)) * (np.log(7 / (1 + df_of[x])) + 1) if x in d else 0.0
                      for x in keep])
        got = _dense(m, df)[i]
        assert np.allclose(got, w / np.linalg.norm(w) if w.any() else w)


def test_projection_matches_numpy_svd(spark):
    r = np.random.default_rng(5)
    words = [f"w{i:02d}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words, r.integers(1, 12), p=np.arange(1, 31) / 465))) for i in range(80)] + [(80, "none"), (81, None)]
    df = spark.createDataFrame(rows, "job_id long, text string").repartition(5)
    m = mlstages.TfIdf(max_features=60, min_df=2, components=12).fit(df)
    a = _dense(m, df)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(m["singular"], s[:12], atol=1e-6)
    vocab = m.tables["vocabulary"].orderBy("place").collect()
    v = np.array([x["v"] for x in vocab])
    assert (v[np.abs(v).argmax(axis=0), range(12)] > 0).all()  # sign convention
    p = m.transform(df).orderBy("job_id").select(m.columns()).toPandas().to_numpy()
    assert np.allclose(np.abs(p), np.abs(np.pad(a, ((0, 82 - len(a)), (0, 0))) @ vt[:12].T), atol=1e-6)
    assert not p[80:].any()
    wide = mlstages.TfIdf(max_features=5, components=8).fit(df)  # more components than terms
    assert not np.array(wide["singular"][5:]).any()


def test_repeated_and_null_keys_are_one_document(spark):
    rows = [(1, "red blue"), (1, "red green"), (2, "blue blue"), (None, "red"), (None, "green"), (3, None)]
    df = spark.createDataFrame(rows, "job_id long, text string")
    m = mlstages.TfIdf(max_features=3, components=2).fit(df)
    got = {r["term"]: (r["doc_freq"], r["total"]) for r in m.tables["vocabulary"].collect()}
    assert got == {"red": (2, 3), "blue": (2, 3), "green": (2, 2)}
    assert {(r["job_id"], r["term"]) for r in m.weights(df).collect()} == {(1, "red"), (1, "blue"), (1, "green"), (2, "blue")}
    p = m.transform(df).select("job_id", *m.columns()).collect()
    assert len(p) == 6 and all(tuple(r)[1:] == (0.0, 0.0) for r in p if r["job_id"] in (None, 3))
    assert len({tuple(r) for r in p if r["job_id"] == 1}) == 1


def test_svd_reads_the_rows_once(spark):
    """A wide vocabulary takes the Gram matrix of one pass, not a pass for each step of an iteration."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in r.zipf(1.3, 30) % 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "job_id long, text string").repartition(4)
    m = mlstages.TfIdf(max_features=300).fit(df)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("svd", "svd")
    values, v = mlstages.svd(m.entries(df), 300, 6)
    jobs = len(tracker.getJobIdsForGroup("svd"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    a = _dense(m, df)
    fitted = mlstages.TfIdf(max_features=300, components=6).fit(df)
    assert np.allclose(fitted["singular"], values)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False)[:6]) and np.allclose(np.linalg.norm(a @ v, axis=0), values)
    assert jobs < 30


def test_leading_pairs_of_a_wide_matrix():
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 1_200)) * np.linspace(3, 1, 60)[:, None]
    g = x.T @ x
    w, u = mlstages.leading(g, 10)
    assert np.allclose(w, np.linalg.svd(x, compute_uv=False)[:10] ** 2) and np.allclose(g @ u, u * w, atol=1e-6)


def test_split_has_exact_quotas_per_bin(spark):
    r = np.random.default_rng(2)
    y = np.concatenate([r.normal(size=403), np.zeros(200)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(9000, None)], "k long, y double")
    got = stats.split_stratified(df, "k", "y", {"cal": 0.2, "test": 0.2}, "fit").toPandas()
    assert len(got) == 604 and set(got["part"]) == {"cal", "test", "fit"}
    edges = sorted(set(np.quantile(y, np.arange(9) / 8)))
    got["bin"] = [-1 if pd.isna(v) else max(0, sum(v > e for e in edges) - 1) for v in got["y"]]
    for _, g in got.groupby("bin"):
        q = int(np.floor(0.2 * len(g) + 0.5))
        assert (g["part"] == "cal").sum() == q and (g["part"] == "test").sum() == q
    again = stats.split_stratified(df.repartition(3), "k", "y", {"cal": 0.2, "test": 0.2}, "fit").toPandas()
    assert dict(zip(got["k"], got["part"])) == dict(zip(again["k"], again["part"]))


def test_ridge_from_sums_equals_the_closed_form(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3)) + 11
    x[:, 2] = x[:, 0] + 0.01 * r.normal(size=300)
    y = x @ [1.0, -2.0, 0.5] + r.normal(size=300)
    f = r.integers(0, 5, 300)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "f": f}))
    sums = linear.moments(df, ["a", "b", "c"], "y", ["f"])
    means = sums.pop(None)
    grid = np.logspace(-4, 4, 50)
    alpha, b, scores = linear.ridge_cv([sums[(i,)] for i in range(5)], grid)

    def closed(xt, yt, a):
        m = xt.mean(0)
        w = np.linalg.solve((xt - m).T @ (xt - m) + a * np.eye(3), (xt - m).T @ (yt - yt.mean()))
        return w, yt.mean() - w @ m

    want = []
    for a in grid:
        r2 = []
        for k in range(5):
            w, c = closed(x[f != k], y[f != k], a)
            e, t = y[f == k] - x[f == k] @ w - c, y[f == k]
            r2.append(1 - (e @ e) / ((t - t.mean()) @ (t - t.mean())))
        want.append(np.mean(r2))
    assert np.allclose(scores, want, atol=1e-8) and alpha == grid[int(np.argmax(want))]
    w, c = closed(x, y, alpha)
    assert np.allclose(b[1:], w, atol=1e-8)
    pred = df.select(linear.predict(["a", "b", "c"], b, means).alias("p")).toPandas()["p"]
    assert np.allclose(sorted(pred), sorted(x @ w + c), atol=1e-8)


def test_quantile_regression_reaches_the_optimum(spark):
    r = np.random.default_rng(4)
    n = 2000
    x = r.normal(size=(n, 2))
    x = np.column_stack([x, x.mean(axis=1)])  # a column that is a mix of the others
    y = 10 + x[:, 0] - 2 * x[:, 1] + (1 + 0.5 * np.abs(x[:, 0])) * r.exponential(1, n)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(4)
    for q, tau in zip(linear.quantile_regression(df, ["a", "b", "c"], "y", [0.05, 0.5, 0.95]), (0.05, 0.5, 0.95)):
        assert q["converged"]
        e = y - q["intercept"] - x @ q["coefficients"]
        below = (e < 0).mean()
        assert below == pytest.approx(tau, abs=0.01) and q["share_below"] == pytest.approx(below, abs=1e-3)
        assert (np.abs((x * ((e < 0) - tau)[:, None]).mean(0)) < 0.02).all()  # subgradient near zero

        def loss(c, w):
            u = y - c - x @ w
            return np.mean(u * (tau - (u < 0)))

        base = loss(q["intercept"], np.array(q["coefficients"]))
        assert q["loss"] == pytest.approx(base, rel=1e-3)
        assert all(base <= loss(q["intercept"] + d[0], np.array(q["coefficients"]) + d[1:]) * (1 + 1e-3)
                   for d in 0.05 * r.normal(size=(60, 4)))
    empty = linear.quantile_regression(df.limit(0), ["a"], "y", [0.5])
    assert empty[0]["intercept"] is None


def test_prompts_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(i * 3, f"t{i}", "x" * (i * 40) if i % 4 else None) for i in range(60)],
                               "job_id long, t string, d string").repartition(9)
    got = prompts.build_prompts(df, "job_id", "t", "d", 25, 800).orderBy("batch_id").collect()
    assert [r["n_items"] for r in got] == [25, 25, 10]
    assert [k for r in got for k in r["keys"]] == [i * 3 for i in range(60)]
    items = got[1]["prompt"].split("\n\n", 1)[1].split(prompts.SEPARATOR)
    assert items[0] == "JOB_ID:75\nTITLE:t25\nDESC:" + "x" * 800 and items[3] == "JOB_ID:84\nTITLE:t28\nDESC:"
    assert "25 postings" in got[0]["prompt"] and "10 postings" in got[2]["prompt"]


def test_replies_in_all_forms_and_join_back(spark):
    forms = ['[{"job_id":1,"urgency":"high"},{"job_id":2}]', '```json\n[{"job_id":3,"tech_role":true}]\n```',
             '  ```\n[{"job_id":4}]```  ', "sorry", '[{"job_id":5', None, '{"job_id":6}', "[1, 2]", "", "[]", '[{"job_id":1,"urgency":"low"}]']
    rows = prompts.parse_replies(spark.createDataFrame([(f,) for f in forms], "r string"), "r")
    assert sorted(r["job_id"] for r in rows.collect()) == [1, 1, 2, 3, 4]
    posts = spark.createDataFrame([(1, "a"), (3, "b"), (8, "c")], "job_id long, title string")
    got = prompts.join_back(posts, rows, "job_id").collect()
    assert sorted((r["job_id"], r["title"]) for r in got) == [(1, "a"), (3, "b")]


@pytest.mark.parametrize("crowded", [2_000_000, 40])
def test_quantiles_refine_crowded_buckets(spark, monkeypatch, crowded):
    monkeypatch.setattr(quantiles, "CROWDED", crowded)
    r = np.random.default_rng(1)
    v = np.concatenate([r.lognormal(11, 0.001, 900), -r.lognormal(0, 3, 500), np.zeros(100), r.normal(size=200) * 1e-30,
                        np.full(300, 5.25)])
    g = r.integers(0, 3, len(v))
    df = spark.createDataFrame([(None if a == 2 else int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    got = quantiles.group_quantiles(df, ["g"], {"a": quantiles.Quantile(F.col("v"), 0.1), "b": quantiles.median("v"),
                                                "c": quantiles.Quantile(F.col("v") * 2, 0.9)}).collect()
    for row in got:
        x = v[g == (2 if row["g"] is None else row["g"])]
        assert np.allclose([row["a"], row["b"], row["c"]], [np.quantile(x, 0.1), np.quantile(x, 0.5), np.quantile(2 * x, 0.9)])
    assert len(got) == 3


def test_manifest_of_a_feature_matrix(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(10)], "k long, f double, y double")
    sinks.write_feature_matrix(df, str(tmp_path), "m", "k", ["f"], "y")
    sinks.write_feature_matrix(df.limit(4), str(tmp_path), "m", "k", ["f"], "y")  # the latest row counts
    row = sinks.load_manifest(spark, str(tmp_path)).first()
    assert (row["output"], row["n_rows"], row["columns"]) == ("m", 4, ["k", "f", "y"])
    assert spark.read.parquet(row["path"]).count() == 4
    assert sinks.load_metrics_bundle(spark, str(tmp_path / "none")) == {}


def test_encoder_plan_has_no_pivot(spark):
    df = _rows(spark)
    m = mlstages.MedianTargetEncoder(cols=["cat"], target="y").fit(df)
    plan = m.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "pivot" not in plan.lower() and "Generate" not in plan and "Aggregate" not in plan


def test_restarts_share_one_stored_copy_in_bounded_tasks(spark, tables, monkeypatch):
    from hiresight import session
    from hiresight.plans import clustering, salary_features
    rows = session.write_back(spark.range(1_000).repartition(2), "bounded")
    got = session.bounded_tasks(rows, 100)
    assert got.rdd.getNumPartitions() == 10 and sorted(r[0] for r in got.collect()) == list(range(1_000))
    assert session.bounded_tasks(rows, 1_000) is rows  # enough tasks as stored
    seen = []

    class Recording(clustering.KMeans):
        def fit(self, df):
            seen.append((df.storageLevel.useMemory, df.rdd.getNumPartitions()))
            return super().fit(df)

    limit = tables.postings.count() // 20
    for module, attr in ((clustering, True), (salary_features, False)):
        seen.clear()
        monkeypatch.setattr(module, "KMeans", Recording)
        monkeypatch.setattr(module, "_CACHE", {})
        monkeypatch.setattr(module, "bounded_tasks", lambda df: session.bounded_tasks(df, limit))
        module.title_clusters(tables)
        assert seen and all(kept == attr and tasks >= 15 for kept, tasks in seen)


def test_length_of_a_row_is_taken_once(spark):
    df = spark.createDataFrame([(1, "red blue red"), (2, "blue"), (3, ""), (None, "red"), (4, None)], "job_id long, text string")
    m = mlstages.TfIdf().fit(df)
    d = m.entries(df)
    # inside the lambda it would be summed up again for each entry
    assert "/ SQRT" not in d._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["job_id"]: r["w"] for r in d.collect()}
    assert all(abs(sum(x * x for x in w) - 1) < 1e-12 for k, w in rows.items() if k not in (3, 4)) and rows[3] == rows[4] == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_pass_through_the_code_joins_as_one_column(spark):
    cols = [f"n{i}" for i in range(40)]
    df = spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("a"), F.lit("x").alias("b"), *[
        F.when(F.col("id") % 7 != 0, F.col("id") * (i + 0.5)).alias(c) for i, c in enumerate(cols)])
    m = mlstages.OrdinalEncoder(cols=["a", "b"]).fit(df)
    out = m.transform(df)
    assert out.columns == [*df.columns, "a_code", "b_code"]
    want = [(*r, int(r["a"]), 0) for r in df.orderBy("id").collect()]
    assert [tuple(r) for r in out.orderBy("id").collect()] == want

    def widths(p):
        own = [p.output().size()] if p.nodeName() == "Join" else []
        return own + [w for i in range(p.children().size()) for w in widths(p.children().apply(i))]

    assert max(widths(out._jdf.queryExecution().optimizedPlan())) < 12


def test_rows_with_a_key_are_read_once_for_all_dimensions(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "k long, v string")
    dims = [spark.createDataFrame([(1, float(i))], f"k long, x{i} double") for i in range(4)]
    out = joins.left_join_known(df, dims, "k")
    want = df
    for d in dims:
        want = joins.left_join_known(want, d, "k")
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert _plan(out).count("LogicalRDD") <= 2 + len(dims)


def test_texts_are_weighed_once_for_fit_and_projection(spark, monkeypatch):
    r = np.random.default_rng(6)
    words = [f"w{i:02d}" for i in range(20)]
    rows = spark.createDataFrame([(i, " ".join(r.choice(words, 8, p=np.arange(1, 21) / 210))) for i in range(60)] + [(60, None)],
                                 "job_id long, description_clean string")
    seen, weigh = [], mlstages.TfIdfModel._weigh
    monkeypatch.setattr(mlstages.TfIdfModel, "_weigh", lambda self, df, one: seen.append(one) or weigh(self, df, one))
    monkeypatch.setattr(salary_features, "_rows_of", lambda t, what: (rows, "description_clean"))
    s = {"col": "x", "out": "y", "max_features": 30, "min_df": 1, "components": 4}
    got = salary_features._projection(None, "description", s).orderBy("job_id").toPandas().to_numpy()
    assert seen == [True]
    m = mlstages.TfIdf(**{**s, "col": "description_clean", "out": "component"}).fit(rows)
    assert np.allclose(got, m.transform(rows).select("job_id", *m.columns()).orderBy("job_id").toPandas().to_numpy(), atol=1e-6)
    twice = rows.union(rows.limit(1))  # a repeated key: the rows of one document
    m, d = mlstages.TfIdf(col="description_clean", min_df=1, components=2).fit_transform(twice)
    assert d.count() == 62 and d.columns == [*rows.columns, *m.columns()]


def test_wide_rows_are_stored_once_after_the_texts(spark, monkeypatch):
    names, wb = [], salary_features.write_back
    monkeypatch.setattr(salary_features, "write_back", lambda df, name: names.append(len(df.columns)) or wb(df, name))
    df = _rows(spark)
    stages = [mlstages.OrdinalEncoder(cols=["cat"]), mlstages.MedianImputer(cols=["x"]), mlstages.TfIdf(col="text", max_features=20, components=2),
              mlstages.TfIdf(col="text", out="more", max_features=20, components=2), mlstages.Standardizer(cols=["x"])]
    models, got = salary_features.fit_stages(stages, df, "test-rows")
    assert names == [5 + 1 + 2 + 2]
    for m in models:
        df = m.transform(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
