"""Feature tables of the salary model and the profiling / sampling operators, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import agg, features, stats
from ..operators.joins import latest_per_key, left_join_known
from ..operators.mlstages import MedianTargetEncoder
from ..operators.quantiles import Quantile, agg_by
from ..sources.schemas import TABLES
from ..sources.tables import JobTables
from . import market, textual, views

TE_COLS = ["state", "title_family", "formatted_experience_level", "primary_industry"]
SAL = "normalized_salary"


def usable_rows(t: JobTables) -> DataFrame:
    """Usable salary rows with the log target and a 5-fold assignment."""
    m = market.market_view(t).where("salary_usable").withColumn("y_log", F.log1p(SAL))
    return stats.kfold_assign(m, "job_id", 5, 42)


def kfold_assign(t: JobTables) -> DataFrame:
    return usable_rows(t).select("job_id", "fold")


def target_encoding(t: JobTables) -> DataFrame:
    """Smoothed median encoding (s=40, m=8) fitted on usable rows, applied to all postings."""
    model = MedianTargetEncoder(cols=TE_COLS, target="y_log", smoothing=40.0, min_count=8).fit(usable_rows(t))
    return model.transform(market.market_view(t).select("job_id", *TE_COLS)).drop(*TE_COLS)


def target_encoding_oof(t: JobTables) -> DataFrame:
    """The same encoding out of fold: each usable row encoded by the other four folds."""
    return features.target_encode_oof(usable_rows(t), "job_id", TE_COLS, "y_log", "fold", 5)


def skill_vocabulary(t: JobTables, k: int = 50) -> DataFrame:
    return features.label_ranks(views.skills_bridge(t), "skill_name", k)


def multi_hot_skills(t: JobTables, k: int = 50) -> DataFrame:
    return features.multi_hot(t.postings, views.skills_bridge(t), "job_id", "skill_name", k, "skill_top")


def multi_hot_benefits(t: JobTables, k: int = 10) -> DataFrame:
    return features.multi_hot(t.postings, views.benefits_known(t), "job_id", "type", k, "benefit_top")


def latest_employee_count(t: JobTables) -> DataFrame:
    """Per company the row with the largest known employee count (ties: more followers)."""
    return latest_per_key(t.employee_counts, "company_id", "employee_count", tie="follower_count")


def company_job_count(t: JobTables) -> DataFrame:
    p = t.postings.select("job_id", "company_id")
    return features.count_per_key_joined(p, "company_id", "company_job_count").select(
        "job_id", "company_job_count")


def profile_missing(t: JobTables) -> DataFrame:
    """Percent missing per posting column (columns with any missing value)."""
    p = t.postings
    cols = [c for c in p.columns]
    a = p.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return a.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, missing_pct)").where("missing_pct > 0")


def clean_summary(t: JobTables) -> DataFrame:
    """Counts after the shared cleaning: remote postings, salaries, company and state matches."""
    p = views.report_postings(t, with_company=True)
    return p.agg(F.count(F.lit(1)).alias("postings"), F.sum("remote_allowed").cast("long").alias("remote"),
                 F.count(SAL).alias("with_salary"), F.count("name").alias("company_matched"),
                 F.count("state").alias("with_state"))


def sample_postings(t: JobTables, n: int = 500) -> DataFrame:
    return stats.sample_n(t.postings.select("job_id"), "job_id", n, seed=42)


def stratified_postings(t: JobTables, n: int = 500) -> DataFrame:
    """Postings with a description, sampled by experience level in proportion (min 1)."""
    p = t.postings.where(F.col("description").isNotNull()).select(
        "job_id", clean.fill_unknown("formatted_experience_level").alias("formatted_experience_level"))
    return stats.stratified_sample(p, "job_id", "formatted_experience_level", n, seed=42)


def location_features(t: JobTables) -> DataFrame:
    """City and state of the salary model (metro names, company-state fallback)."""
    p = t.postings.select("job_id", "company_id", "location")
    c = t.companies.select("company_id", F.col("state").alias("company_state"))
    return left_join_known(p, c, "company_id").select(
        "job_id", clean.normalize_city("location").alias("city_loc"),
        clean.extract_state_model("location", "company_state").alias("state_final"))


def interactions(t: JobTables) -> DataFrame:
    """Pairwise category interactions used as encoded features (the experience level is the
    imputed one). The sixth pair, with the title cluster, is in ``salary_features``."""
    m = market.market_view(t).select("job_id", "primary_industry", "remote_flag", "pay_period", "formatted_work_type")
    d = m.join(location_features(t), "job_id").join(textual.impute_experience(t), "job_id")
    pay = F.coalesce("pay_period", F.lit("Unknown"))
    return d.select("job_id",
                    clean.interaction("city_loc", "primary_industry").alias("city_industry"),
                    clean.interaction("state_final", "primary_industry").alias("state_industry"),
                    clean.interaction("formatted_experience_level", "primary_industry").alias("exp_industry"),
                    clean.interaction("remote_flag", "primary_industry").alias("remote_industry"),
                    clean.interaction(pay, "formatted_work_type").alias("pay_work_type"))


def salary_bounds(t: JobTables) -> DataFrame:
    """Salary range of the salary model: [max(10k, 1st pct), min(300k, 99th pct)] and the
    rows it keeps (USD or missing currency)."""
    p = t.postings.where(F.col(SAL).isNotNull())
    q = agg_by(p, [], {"q01": Quantile(F.col(SAL), 0.01), "q99": Quantile(F.col(SAL), 0.99)})
    b = q.select("q01", "q99", F.greatest(F.lit(10_000.0), F.col("q01")).alias("lower_bound"),
                 F.least(F.lit(300_000.0), F.col("q99")).alias("upper_bound"))
    lo, hi = b.select("lower_bound").scalar(), b.select("upper_bound").scalar()
    kept = p.where(clean.salary_usable(SAL, "currency", lo, hi)).select(F.count(F.lit(1))).scalar()
    return b.withColumn("rows_kept", kept)


def salary_records(t: JobTables) -> DataFrame:
    """Yearly USD salary rows of known postings with a median or maximum."""
    s = t.salaries.where((F.col("currency") == "USD") & (F.col("pay_period") == "YEARLY")
                         & (F.col("med_salary").isNotNull() | F.col("max_salary").isNotNull()))
    return s.join(t.postings.select("job_id"), "job_id", "left_semi").select(
        "job_id", "min_salary", "max_salary", "med_salary")


def target_encoding_global(t: JobTables) -> DataFrame:
    """The first model's encoding: group median salary over all usable rows (it sees every
    target, so it is only a labelled baseline), fallback the global median, log1p."""
    u = usable_rows(t)
    model = MedianTargetEncoder(cols=TE_COLS, target=SAL, smoothing=0.0, min_count=1).fit(u)
    enc = model.transform(market.market_view(t).select("job_id", *TE_COLS)).drop(*TE_COLS)
    return enc.select("job_id", *[F.log1p(f"te_{c}").alias(f"te_{c}") for c in TE_COLS])


def value_counts_keep_null(t: JobTables) -> DataFrame:
    """Frequency of every experience-level value, missing included."""
    return t.postings.groupBy("formatted_experience_level").agg(F.count(F.lit(1)).alias("n"))


def multi_hot_specialities(t: JobTables, k: int = 20) -> DataFrame:
    """The 20 most frequent company specialities as indicators per company."""
    return features.multi_hot(t.companies, t.company_specialities, "company_id", "speciality", k, "spec_top")


def indicator_columns(t: JobTables) -> DataFrame:
    """(column_name, label, slug): which label each indicator column stands for, and the label's
    name as an identifier. Columns are named by rank so that the schema does not depend on data."""
    out = None
    for bridge, label, k, prefix in ((views.skills_bridge(t), "skill_name", 50, "skill_top"),
                                     (views.benefits_known(t), "type", 10, "benefit_top"),
                                     (t.company_specialities, "speciality", 20, "spec_top")):
        r = features.label_ranks(bridge, label, k).select(
            F.concat(F.lit(prefix), F.lpad(F.col("rank").cast("string"), 2, "0")).alias("column_name"),
            F.col(label).alias("label"), clean.slug(label).alias("slug"))
        out = r if out is None else out.unionByName(r)
    return out


def profile_shape(t: JobTables) -> DataFrame:
    """(table_name, n_rows, n_columns) of every table."""
    out = None
    for name in TABLES:
        df = t.table(name)
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows",
                                                             F.lit(len(df.columns)).alias("n_columns"))
        out = r if out is None else out.unionByName(r)
    return out


def profile_dtypes(t: JobTables) -> DataFrame:
    """(table_name, position, column_name, data_type): the schemas, without reading any row."""
    rows = [(n, i, c, d) for n in TABLES for i, (c, d) in enumerate(t.table(n).dtypes)]
    return t.spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def company_state_location(t: JobTables) -> DataFrame:
    """State at the end of the location, else the company's (the first model's rule)."""
    c = t.companies.select("company_id", F.col("state").alias("company_state"))
    return left_join_known(t.postings.select("job_id", "company_id", "location"), c, "company_id").select(
        "job_id", clean.extract_state_end("location", "company_state").alias("state_final"))


def yearly_salaries(t: JobTables) -> DataFrame:
    """The yearly-only option of the salary model: usable rows paid per year."""
    return usable_rows(t).where(clean.is_yearly("pay_period")).select("job_id", SAL, "y_log")


def filter_options(t: JobTables) -> DataFrame:
    """(column, value, ord): the sorted options of the dashboard's filters."""
    cols = ["formatted_experience_level", "formatted_work_type", "primary_industry", "state", "title_family"]
    return agg.distinct_values(market.market_view(t).select(*cols), cols)


def top_state_salaries(t: JobTables, k: int = 15) -> DataFrame:
    """The bars of the state chart: the k highest median salaries."""
    return agg.drop_null_top(market.state_stats(t, 50), "state", "median_salary", k)
