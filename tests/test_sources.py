"""Readers and sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from hiresight.sources import sinks
from hiresight.sources.tables import find_column, read_table, with_defaults


def test_csv_quoted_newline_is_one_row(spark):
    d = tempfile.mkdtemp(prefix="hs-csv-")
    with open(os.path.join(d, "postings.csv"), "w") as f:
        f.write('job_id,title,description\n1,"Dev","line one\nline ""two"""\n2,QA,plain\n')
    df = read_table(spark, d, "postings", fmt="csv")
    rows = {r.job_id: r.description for r in df.select("job_id", "description").collect()}
    assert rows == {1: 'line one\nline "two"', 2: "plain"}


def test_missing_table_and_columns(spark):
    d = tempfile.mkdtemp(prefix="hs-missing-")
    df = read_table(spark, d, "benefits", optional=True)
    assert df.count() == 0 and df.columns == ["job_id", "type"]
    try:
        read_table(spark, d, "benefits")
        raise AssertionError("expected a failure")
    except Exception as e:  # noqa: BLE001
        assert "benefits" in str(e) or "PATH_NOT_FOUND" in str(e)


def test_find_column_and_defaults(spark):
    df = spark.createDataFrame([(1, "x")], "Skill_ID long, Name string")
    assert find_column(df, ["skill_abr", "skill_id"]) == "Skill_ID"
    assert with_defaults(df, {"currency": "USD", "Name": "?"}).columns == ["Skill_ID", "Name", "currency"]


def test_bundle_and_model_round_trip(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = tempfile.mkdtemp(prefix="hs-bundle-")
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    sinks.write_bundle({"points": df}, d, meta={"alpha": 0.1})
    got = sinks.load_bundle(spark, d, ["points", "absent"])
    assert got["points"].count() == 20 and got["absent"].count() == 0
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"),
                             LinearRegression(featuresCol="f", labelCol="y")]).fit(df)
    sinks.save_model(model, os.path.join(d, "m"), {"r2": 1.0})
    back = sinks.load_model([os.path.join(d, "nope"), os.path.join(d, "m")])
    assert abs(back.transform(df).first()["prediction"] - 1.0) < 1e-6


def test_large_and_odd_doubles_survive_the_registry(spark):
    import math
    from hiresight.plans.registry import stable
    df = spark.createDataFrame([(5e13,), (float("nan"),), (None,), (1.23456789,), (-9.3e12,), (float("inf"),)], "x double")
    got = [r["x"] for r in stable(df).collect()]
    assert got[0] == 5e13 and math.isnan(got[1]) and got[2] is None and got[3] == 1.234568
    assert got[4] == -9.3e12 and got[5] == float("inf")


def test_required_tables_raise_and_optional_ones_are_empty(spark, tmp_path):
    import pytest
    from pyspark.sql.utils import AnalysisException
    from hiresight.sources.tables import JobTables
    t = JobTables.from_dir(spark, str(tmp_path))
    with pytest.raises(AnalysisException):
        t.postings.count()
    assert t.benefits.count() == 0


def test_malformed_csv_ids_become_null(spark, tmp_path):
    from hiresight.sources.tables import read_table
    (tmp_path / "companies.csv").write_text("company_id,name\n12,a\nx9,b\n")
    rows = read_table(spark, str(tmp_path), "companies", fmt="csv").collect()
    assert sorted(r["company_id"] or 0 for r in rows) == [0, 12]


def test_one_row_segments_have_no_r2(spark):
    from hiresight.operators import evaluate
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 3.0), ("b", 3.0, 4.0), ("b", 3.0, 5.0)], "g string, y double, p double")
    got = {r["g"]: r["r2"] for r in evaluate.metrics(df, "y", "p", by="g").collect()}
    assert got == {"a": None, "b": None}


def test_shared_folder_is_required_off_local_masters():
    import pytest
    from types import SimpleNamespace as N
    from hiresight import session
    spark = N(conf=N(get=lambda *_: None), sparkContext=N(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.checkpoint_dir(spark)


def test_reader_knows_other_headers(spark):
    d = tempfile.mkdtemp(prefix="hs-headers-")
    with open(os.path.join(d, "company_specialities.csv"), "w") as f:
        f.write("Company_ID,Specialties,specialities\n7,cloud,none\nx,retail,none\n")
    df = read_table(spark, d, "company_specialities", fmt="csv")
    assert [tuple(r) for r in df.orderBy("speciality").collect()] == [(7, "none"), (None, "none")]
    spark.createDataFrame([(7, "cloud")], "company_id long, Specialties string").write.parquet(
        os.path.join(d, "company_specialities.parquet"))
    assert read_table(spark, d, "company_specialities").columns == ["company_id", "speciality"]
    # a declared column that is present stays, whatever else looks like it
    spark.createDataFrame([(7, "a", "b")], "company_id long, speciality string, specialty string").write.parquet(
        os.path.join(d, "both", "company_specialities.parquet"))
    both = read_table(spark, os.path.join(d, "both"), "company_specialities")
    assert both.select("speciality").first()[0] == "a" and "specialty" in both.columns


def test_market_view_defaults_every_column_the_source_lacks(spark):
    from hiresight.plans.market import POSTING_DEFAULTS, headline, market_view
    from hiresight.sources.schemas import SCHEMAS
    from hiresight.sources.tables import JobTables

    def load(name):
        if name == "postings":
            return spark.createDataFrame([(1,), (2,)], "job_id long")
        return spark.createDataFrame([], SCHEMAS[name])
    t = JobTables(spark, load)
    rows = market_view(t).collect()
    assert len(POSTING_DEFAULTS) == 12 and len(rows) == 2
    r = rows[0]
    assert (r.title, r.location, r.state, r.city, r.currency, r.pay_period) == ("", "Unknown", "Unknown", "Unknown", "USD", "Unknown")
    assert (r.remote_flag, r.salary_usable, r.company_id, r.views, r.normalized_salary) == (0, False, None, None, None)
    assert headline(t).first().asDict() == {"total_postings": 2, "salary_count": 0, "median_salary": None, "remote_pct": 0.0}


def test_large_inputs_are_stored_without_another_shuffle(spark, monkeypatch):
    """Above the size the tables are written as derived: the same rows, but not dealt out by key."""
    import uuid
    from hiresight.sources import fixtures
    from tests.conftest import SF as folder
    small = fixtures.driver_tables(spark, folder)
    key = uuid.uuid4().hex
    monkeypatch.setattr(fixtures, "SMALL_BYTES", 0)
    monkeypatch.setattr(fixtures, "_source_key", lambda *a: key)
    path = fixtures.materialize(spark, folder, ["employee_counts", "job_skills"])
    for name in ("employee_counts", "job_skills"):
        a, b = small.table(name), spark.read.parquet(f"{path}/{name}.parquet")
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert len(b.inputFiles()) and len(spark.read.parquet(f"{path}/employee_counts.parquet").inputFiles()) < len(
        small.table("employee_counts").inputFiles())
