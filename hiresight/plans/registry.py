"""Registry of the checked queries: name -> (spark, sf_dir) -> DataFrame.

Results are returned with double columns brought to 1e-6 (``stable``), the same arithmetic the
SQL twins in ``oracle`` apply, so both engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..operators import agg
from ..sources.fixtures import driver_tables
from . import clustering, evaluation, featureset, market, modeling, reports, salary_features, textual
from ..sources.fixtures import documents

MARKET = ["headline", "data_quality", "skill_demand", "skill_salary_premium", "benefit_summary",
          "industry_stats", "state_stats", "title_family_stats", "career_ladder", "remote_summary",
          "family_benchmark", "states_by_remote", "similar_postings", "package_strength",
          "scenarios", "explain_rules", "reliability", "family_benchmark_filtered", "role_contexts",
          "request_signatures"]

REPORTS = [
    "mann_whitney", "premium_test",
    'q01_1', 'q01_2', 'q01_3', 'q01_4', 'q01_5', 'q01_6', 'q02_1', 'q02_2',
    'q02_3', 'q02_4', 'q02_5', 'q04_1', 'q04_2', 'q04_3', 'q04_4', 'q04_5',
    'q05_1', 'q05_2', 'q05_3', 'q05_4', 'q05_5', 'q06_1', 'q06_2', 'q06_3',
    'q06_4', 'q06_5', 'q08_1', 'q08_2', 'q08_3', 'q08_4', 'q08_5', 'q09_1', 'q09_2',
    'q09_3', 'q09_4', 'q09_5', 'q10_1', 'q10_2', 'q10_3', 'q10_4', 'q10_5',
    'q11_1', 'q11_2', 'q11_3', 'q11_4', 'q11_5', 'q12_1', 'q12_2', 'q12_3',
    'q12_4', 'q12_5', 'q13_1', 'q13_2', 'q13_3', 'q13_4', 'q13_5', 'q13_6',
]


def stable(df: DataFrame) -> DataFrame:
    """Doubles brought to 1e-6 where that is finer than the number itself and fits a long;
    larger ones, NaN and infinities stay as they are."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name)
            cols.append(F.when(F.abs(x) < 1e12, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(x).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def _on_tables(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(driver_tables(spark, sf_dir))
        if fn.__name__ in rules.REPORT_ORDER:
            df = agg.order_by_labels(df, *rules.REPORT_ORDER[fn.__name__])
        return stable(df)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


FEATURES = ["kfold_assign", "target_encoding", "target_encoding_oof", "skill_vocabulary",
            "multi_hot_skills", "multi_hot_benefits", "latest_employee_count", "company_job_count",
            "profile_missing", "clean_summary", "sample_postings", "stratified_postings",
            "location_features", "interactions", "salary_bounds", "salary_records",
            "target_encoding_global", "value_counts_keep_null", "multi_hot_specialities",
            "indicator_columns", "profile_shape", "profile_dtypes", "company_state_location",
            "yearly_salaries", "filter_options", "top_state_salaries"]
SALARY = ["salary_features", "ordinal_codes", "standardized_numbers", "term_table", "title_term_weights",
          "title_projection_25", "title_projection_30", "description_projection_100"]
EVALUATION = ["baseline_metrics", "baseline_fold_metrics", "baseline_segment_metrics",
              "baseline_intervals", "baseline_calibration", "baseline_title_errors",
              "baseline_bias_extremes", "baseline_prediction_bands", "baseline_worst_predictions",
              "baseline_best_interval", "baseline_error_by_band", "baseline_residual_normality",
              "baseline_residual_trend", "baseline_qq_points", "baseline_residual_histogram", "split_calibration"]
# learned models: no SQL twin (rows-only check); the statistics they feed are SQL-checked
# above through the deterministic baseline
MODELS = ["model_cv_metrics", "model_comparison", "stack_coefficients", "model_intervals",
          "model_segment_metrics", "model_fold_stability", "model_overfit_gap",
          "model_feature_importance", "model_calibration", "model_title_errors", "score_batch",
          "scenario_scores", "permutation_importance", "partial_dependence", "param_search",
          "learning_curve", "tuning_table", "estimate_report", "saved_model_check", "feature_matrix",
          "interval_sample", "model_reliability"]
CLUSTERS = ["q07_1", "q07_2", "q07_3", "q07_4", "q07_5", "title_terms", "title_svd"]
TEXT = ["q03_1", "q03_2", "q03_3", "q03_4", "q03_5", "title_flags", "title_family_model",
        "impute_experience", "experience_imputed_counts", "title_clean_rows", "prompt_batches",
        "reply_join_back"]


def _on_docs(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stable(fn(documents(spark, sf_dir)))
    return run


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report cleaning run as a Structured Streaming job over the stored postings."""
    import os
    from ..streaming.ingest import streamed_report_postings
    t = driver_tables(spark, sf_dir)
    path = os.path.join(t.source, "postings.parquet")
    return stable(streamed_report_postings(spark, path).drop("description"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _on_tables(getattr(reports, name)) for name in REPORTS}
    out.update({name: _on_tables(getattr(market, name)) for name in MARKET})
    out.update({name: _on_tables(getattr(textual, name)) for name in TEXT})
    out.update({name: _on_tables(getattr(featureset, name)) for name in FEATURES})
    out.update({name: _on_tables(getattr(salary_features, name)) for name in SALARY})
    out.update({name: _on_tables(getattr(evaluation, name)) for name in EVALUATION})
    out.update({name: _on_tables(getattr(modeling, name)) for name in MODELS})
    out.update({name: _on_tables(getattr(clustering, name)) for name in CLUSTERS})
    out["streamed_clean_postings"] = _streamed
    out["scrub_salary"] = _on_docs(lambda d: textual.scrub_documents(d, "sentences"))
    out["scrub_salary_light"] = _on_docs(lambda d: textual.scrub_documents(d, "light"))
    out["document_stats"] = _on_docs(textual.document_stats)
    return out
