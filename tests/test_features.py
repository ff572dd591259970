"""Encoders, folds and interval statistics on hand-made inputs."""

from pyspark.sql import functions as F

from hiresight.operators import evaluate, features, mlstages, stats


def test_smoothed_encoding(spark):
    # global median 11; group a: 8 rows with median 12; group b: 7 rows; group c unseen
    rows = [("a", 12.0)] * 8 + [("b", 10.0)] * 7 + [("z", 11.0)] * 16
    df = spark.createDataFrame(rows, "g string, y double")
    model = mlstages.MedianTargetEncoder(cols=["g"], target="y", smoothing=40.0, min_count=8).fit(df)
    assert model["overall"] == 11.0
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, g string")
    got = {r.id: r.te_g for r in model.transform(q).collect()}
    assert abs(got[1] - (11 + 8 / 48)) < 1e-12
    assert got[2] == 11.0 and got[3] == 11.0 and got[4] == 11.0


def test_out_of_fold_encoding_ignores_own_target(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 7), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold int")
    a = {r.id: r.te_g for r in features.target_encode_oof(df, "id", ["g"], "y", "fold", 3, 0.0, 1).collect()}
    rows2 = [(i, g, (100.0 if i == 5 else y), f) for i, g, y, f in rows]
    df2 = spark.createDataFrame(rows2, "id long, g string, y double, fold int")
    b = {r.id: r.te_g for r in features.target_encode_oof(df2, "id", ["g"], "y", "fold", 3, 0.0, 1).collect()}
    assert a[5] == b[5]  # row 5's own target changed; its encoding did not


def test_kfold_is_stable_and_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = stats.kfold_assign(df, "k", 5, 42)
    assert set(r.fold for r in a.select("fold").distinct().collect()) == {0, 1, 2, 3, 4}
    b = stats.kfold_assign(df.repartition(3), "k", 5, 42)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_conformal_order_statistic(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(1, 101)], "y double, p double")
    assert evaluate.conformal_position(100, 0.1) == 91
    assert spark.range(1).select(evaluate.conformal_q(df, "y", "p", 0.1)).first()[0] == 92.0


def test_winkler_and_interval_scores(spark):
    assert evaluate.winkler(0.0, 1.0, 3.0, 0.1) == 22.0
    df = spark.createDataFrame([("m", 0.0, 1.0, 3.0), ("m", 2.0, 1.0, 3.0)], "method string, y double, lower double, upper double")
    r = evaluate.interval_scores(df, "y", 0.1).first()
    assert r.coverage_pct == 50.0 and r.avg_width == 2.0 and r.winkler_score == (22.0 + 2.0) / 2


def test_metrics_moment_form(spark):
    rows = [(float(y), float(y) + (1.0 if y % 2 else -2.0)) for y in range(1, 41)]
    df = spark.createDataFrame(rows, "y double, p double")
    r = evaluate.metrics(df, "y", "p").first()
    import numpy as np
    y = np.array([a for a, _ in rows]); p = np.array([b for _, b in rows])
    assert abs(r.rmse - np.sqrt(np.mean((p - y) ** 2))) < 1e-9
    assert abs(r.r2 - (1 - np.sum((p - y) ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-9


def test_multi_hot_positional(spark):
    bridge = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "z"), (1, "x")], "job_id long, s string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id long")
    got = {r.job_id: (r.t01, r.t02, r.t03) for r in features.multi_hot(keys, bridge, "job_id", "s", 3, "t").collect()}
    assert got == {1: (1, 1, 0), 2: (1, 0, 0), 3: (0, 0, 1), 4: (0, 0, 0)}


def test_latest_per_key_prefers_known_largest(spark):
    from hiresight.operators.joins import latest_per_key
    df = spark.createDataFrame([(1, 10, 5), (1, None, 9), (1, 30, 1), (2, None, 3), (2, 7, 7), (2, 7, 8)],
                               "company_id long, employee_count long, follower_count long")
    got = {r.company_id: (r.employee_count, r.follower_count) for r in latest_per_key(
        df, "company_id", "employee_count", tie="follower_count").collect()}
    assert got == {1: (30, 1), 2: (7, 8)}


def test_left_join_known_keeps_null_keys(spark):
    from hiresight.operators.joins import left_join_known
    facts = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, None)], "job_id long, company_id long")
    dim = spark.createDataFrame([(10, "a"), (12, "c")], "company_id long, name string")
    got = {r.job_id: r.name for r in left_join_known(facts, dim, "company_id").collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None}


def test_top_and_bottom_distributed(spark):
    df = spark.range(1000).select(F.col("id"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    got = stats.top_and_bottom(df.repartition(5), "v", 3, "id").collect()
    assert sorted(r.v for r in got if r.side == "top") == [997.0, 998.0, 999.0]
    assert sorted(r.v for r in got if r.side == "bottom") == [0.0, 1.0, 2.0]
    small = stats.top_and_bottom(df.limit(4), "v", 3, "id").collect()
    assert len(small) == 4  # overlap counted once


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float((i * 37) % 101) / 3 for i in range(257)] + [5.0] * 100
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(df, "v", probs)
    assert np.allclose(got, np.quantile(vals, probs), atol=1e-12)


def test_multi_hot_keeps_bits_not_label_rows(spark):
    """More labels than one number has bits, repeated pairs and keys; each key's state is its bits,
    so the plan neither pivots nor makes pairs distinct."""
    bridge = spark.createDataFrame([(k, f"s{i:03d}") for k in (1, 2) for i in range(k - 1, 70, k) for _ in range(70 - i)],
                                   "job_id long, s string")
    keys = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "job_id long")
    out = features.multi_hot(keys, bridge, "job_id", "s", 70, "t")
    rank = {r["s"]: r["rank"] for r in features.label_ranks(bridge, "s", 70).collect()}
    have = {1: set(range(70)), 2: set(range(1, 70, 2))}
    rows = out.collect()
    assert sorted(str(r["job_id"]) for r in rows) == ["1", "2", "2", "3", "None"]
    for r in rows:
        on = {rank[f"s{i:03d}"] for i in have.get(r["job_id"], ())}
        assert [r[f"t{i:02d}"] for i in range(1, 71)] == [int(i in on) for i in range(1, 71)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" not in plan.lower()
