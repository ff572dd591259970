"""Rank test, ranks, samples and bins against brute force on small inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hiresight.operators import agg, stats


def _brute_mw(vals, labels):
    s = pd.Series(vals)
    ranks = s.rank(method="average")
    n = len(s)
    cnt = s.value_counts().astype(float)
    ties = float((cnt ** 3 - cnt).sum())
    out = {}
    for lab in sorted({l for ls in labels for l in ls}):
        m = np.array([lab in ls for ls in labels])
        n1, n2 = int(m.sum()), int((~m).sum())
        u1 = ranks[m].sum() - n1 * (n1 + 1) / 2
        u = max(u1, n1 * n2 - u1)
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        out[lab] = (n1, u1, (u - n1 * n2 / 2 - 0.5) / sd, s[m].median(), s[~m].median())
    return out


def test_mann_whitney_matches_brute_force(spark):
    rnd = random.Random(7)
    # a hot value held by a third of the rows, plus ties elsewhere
    vals = [50_000.0 if i % 3 == 0 else float(rnd.randint(20, 200) * 1000) for i in range(600)]
    labels = [{l for l in "abc" if rnd.random() < (0.5 if l == "a" else 0.3)} for _ in vals]
    for i in range(0, 60, 2):  # repeated (job, label) pairs must count once
        labels[i].add("a")
    facts = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "job_id long, v double")
    bridge = spark.createDataFrame([(i, l) for i, ls in enumerate(labels) for l in ls] +
                                   [(i, "a") for i in range(0, 60, 2)],
                                   "job_id long, label string")
    got = {r["label"]: r for r in stats.mann_whitney_by_label(bridge, facts, "job_id", "label", "v",
                                                                min_label=1).collect()}
    exp = _brute_mw(vals, labels)
    assert set(got) == set(exp)
    for lab, (n1, u1, z, mw, mwo) in exp.items():
        r = got[lab]
        assert r["n1"] == n1
        assert abs(r["u_stat"] - u1) < 1e-6
        assert abs(r["z"] - z) < 1e-9
        assert abs(r["median_with"] - mw) < 1e-9
        assert abs(r["median_without"] - mwo) < 1e-9
        assert abs(r["n1"] * r["n2"] - (r["u_stat"] + (r["n1"] * r["n2"] - r["u_stat"]))) < 1e-9


def test_value_ranks_bucket_independent(spark):
    vals = [1.0] * 50 + [float(i) for i in range(2, 300)] + [-3.5, -3.5, 1e12, 0.0, 0.001, -1e-9]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "v double")
    a = {r["v"]: r["avg_rank"] for r in stats.value_ranks(df, "v").collect()}
    exp = dict(zip(vals, pd.Series(vals).rank(method="average")))
    assert set(a) == set(exp) and all(abs(a[v] - exp[v]) < 1e-9 for v in a)
    for few in ([], [(2.0,)], [(float("nan"),)]):
        one = spark.createDataFrame(few, "v double")
        assert [r["avg_rank"] for r in stats.value_ranks(one, "v").collect()] == [1.0] * (few == [(2.0,)])
        assert stats.exact_quantiles(one, "v", [0.5]) == ([2.0] if few == [(2.0,)] else [None])


def test_group_quantiles_with_hot_and_odd_groups(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from hiresight.operators.quantiles import Quantile, agg_by, group_quantiles, median
    r = np.random.default_rng(5)
    rows = [("hot", float(x), int(k)) for x, k in zip(r.lognormal(10, 3, 3000), r.integers(0, 2, 3000))]
    rows += [("neg", float(x), 1) for x in r.normal(-5, 100, 500)] + [(None, 7.0, 1), ("one", 3.0, 0), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, k int").repartition(4)
    got = {x["g"]: x for x in agg_by(df, "g", {"n": F.count(F.lit(1)), "m": median("v"), "q": Quantile(F.col("v"), 0.1),
                                               "m1": median(F.when(F.col("k") == 1, F.col("v")))}).collect()}
    for g in ("hot", "neg", None, "one", "none"):
        v = [x[1] for x in rows if x[0] == g and x[1] is not None]
        v1 = [x[1] for x in rows if x[0] == g and x[1] is not None and x[2] == 1]
        assert got[g]["n"] == sum(x[0] == g for x in rows)
        for name, values, p in (("m", v, .5), ("q", v, .1), ("m1", v1, .5)):
            assert got[g][name] == (pytest.approx(np.quantile(values, p), rel=1e-12) if values else None)
    w = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1)], "g string, v double, k int")
    assert group_quantiles(w, ["g"], {"m": Quantile(F.col("v"), 1.0), "l": Quantile(F.col("v"), 0.5)}, "k").first()[1:] == (5.0, 1.0)


def test_sample_n_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in stats.sample_n(df, "k", 37, seed=3).collect()]
    b = [r.k for r in stats.sample_n(df.repartition(7), "k", 37, seed=3).collect()]
    assert len(a) == 37 and sorted(a) == sorted(b)


def test_stratified_sample_quotas(spark):
    rows = [(i, "hot" if i % 3 == 0 else ("mid" if i % 3 == 1 else f"s{i % 11}")) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = stats.stratified_sample(df, "k", "s", 300, seed=1).toPandas()
    sizes = pd.Series([s for _, s in rows]).value_counts()
    quota = {s: min(n, max(1, round(n / len(rows) * 300))) for s, n in sizes.items()}
    assert len(got) == min(300, sum(quota.values()))
    assert got["k"].is_unique
    per = got.groupby("s").size()
    assert all(per[s] <= quota[s] for s in per.index)


def test_qcut_equal_frequency(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    got = stats.qcut(df, "v", 4).groupBy("qbin").count().orderBy("qbin").collect()
    assert [r["count"] for r in got] == [25, 25, 25, 25]


def test_share_rows_sum_to_100_and_partition_invariant(spark, tables):
    from hiresight.plans import reports
    a = reports.q04_1(tables)
    sums = a.groupBy("formatted_experience_level").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in sums)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = reports.q04_1(tables)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_top_k_ties_are_deterministic(spark):
    df = spark.createDataFrame([(x,) for x in "aabbccdde"], "c string")
    got = [r.c for r in agg.top_k_counts(df, "c", 3).collect()]
    assert got == ["a", "b", "c"]


def test_package_strength(spark):
    from hiresight.functions import rules
    hv = rules.HIGH_VALUE_BENEFITS
    rows = ([(1, f"low{i}") for i in range(6)] + [(2, b) for b in hv[:4]] +
            [(3, f"low{i}") for i in range(3)] + [(4, b) for b in hv[:2]] + [(5, "x")])
    df = spark.createDataFrame(rows, "job_id long, type string")

    class T:
        benefits = df
    from hiresight.plans import market
    got = {r.job_id: r.package for r in market.package_strength(T).collect()}
    assert got == {1: "Strong package", 2: "Strong package", 3: "Standard package",
                   4: "Standard package", 5: "Basic package"}


def test_rolling_mean_centered_matches_pandas(spark):
    vals = [float((i * 37) % 11) for i in range(40)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    for w in (4, 5):
        got = [r.trend for r in stats.rolling_mean_centered(df, [F.col("i")], "v", w).orderBy("i").collect()]
        exp = pd.Series(vals).rolling(w, center=True).mean().tolist()
        assert all((a is None and math.isnan(b)) or abs(a - b) < 1e-12 for a, b in zip(got, exp))


def test_inverse_normal(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (0.025,)], "p double")
    got = [r[0] for r in df.select(stats.inverse_normal("p")).collect()]
    assert abs(got[0]) < 1e-12 and abs(got[1] - 1.959963984540054) < 1e-9 and abs(got[2] + 1.959963984540054) < 1e-9


def test_grouped_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(3000)] + [("hot", 0.25)] * 500 + \
           [(f"g{i % 7}", rnd.random() * (i % 7 + 1)) for i in range(700)] + [("single", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in stats.grouped_quantiles(df, "g", "v", probs).collect()}
    exp = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].quantile(probs).unstack()
    assert set(got) == set(exp.index)
    for g, qs in got.items():
        assert np.allclose(qs, exp.loc[g].values, atol=1e-12), g


def test_order_by_labels_puts_other_labels_last(spark):
    from hiresight.operators.agg import order_by_labels
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "lab string")
    got = {r.lab: r.ord for r in order_by_labels(df, "lab", ["a", "b"]).collect()}
    assert got == {"a": 0, "b": 1, "z": 999, None: 999}


def test_histogram_markers_are_of_the_values_before_clipping(spark):
    import numpy as np
    from hiresight.operators.agg import histogram
    v = [1.0, 2.0, 2.5, 4.0, 100.0]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    h = sorted(histogram(df, "v", 3, 10.0, markers=True).collect(), key=lambda r: r.bin)
    assert {(r.mean, r.median) for r in h} == {(np.mean(v), np.median(v))}
    want, edges = np.histogram(np.minimum(v, 10.0), 3)
    assert {r.bin: r.n for r in h} == {i: n for i, n in enumerate(want.tolist()) if n}
    assert all(abs(r.bin_low - edges[r.bin]) < 1e-9 for r in h)
    assert histogram(df.where("v is null"), "v", 3, markers=True).count() == 0
