"""The salary model's own feature table and its preprocessing pipeline.

``feature_rows`` derives every raw column; ``plain_stages`` and ``target_stages`` list the fitted
stages (codes, imputers, scaling, text projections, target encodings) that turn them into a vector. All stages save and
load with the model.
"""

from __future__ import annotations

import threading

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, rules, text
from ..operators import agg, features, mlstages
from ..operators.joins import left_join_known
from ..session import bounded_tasks, write_back
from ..sources.tables import JobTables
from . import featureset, market, textual, views

CAT_COLS = ["formatted_experience_level", "formatted_work_type", "primary_industry", "pay_period", "company_size",
            "state_final", "title_cluster", "title_family"]
TE_COLS = ["state_final", "city_loc", "primary_industry", "company_id", "title_cluster", "title_family",
           "city_industry", "state_industry", "exp_industry", "exp_title_cluster", "remote_industry", "pay_work_type"]
LOG_COLS = ["views", "applies", "employee_count", "follower_count", "company_job_count", "description_len",
            "description_word_count"]
NUM_COLS = ["n_skills", "n_benefits", "company_industry_count", "n_specialities", "follower_per_employee", "title_len",
            "title_word_count"]
FLAG_COLS = ["is_hourly", "remote_flag", "has_applies", "has_views", "has_employee_count", "has_follower_count"]
SKILL_COLS = [f"skill_top{i:02d}" for i in range(1, 51)]
BENEFIT_COLS = [f"benefit_top{i:02d}" for i in range(1, 11)]
SPEC_COLS = [f"spec_top{i:02d}" for i in range(1, 21)]
BIN_COLS = FLAG_COLS + [n for n, _ in rules.TITLE_FLAGS] + SKILL_COLS + BENEFIT_COLS + SPEC_COLS

TITLE_CLUSTERS = 35
TITLE_TEXT = {"col": "title_text", "out": "title_svd", "max_features": 2500, "min_df": 3, "sublinear": True,
              "strip_accents": True, "components": 25}
DESCRIPTION_TEXT = {"col": "description_clean", "out": "description_svd", "max_features": 6000, "min_df": 5,
                    "max_df": 0.85, "sublinear": True, "strip_accents": True, "stopwords": True, "components": 100}
CLUSTER_TEXT = {"col": "title_text", "max_features": 2000, "min_df": 3, "sublinear": True, "strip_accents": True}

_CACHE: dict = {}
_LOCK = threading.Lock()


def title_rows(t: JobTables) -> DataFrame:
    return t.postings.select("job_id", F.coalesce("title", F.lit("")).alias("title_text"))


def description_rows(t: JobTables) -> DataFrame:
    return t.postings.select("job_id", text.scrub_salary("description").alias("description_clean"))


def title_clusters(t: JobTables, k: int = TITLE_CLUSTERS) -> DataFrame:
    """(job_id, title_cluster): k-means of the titles' TF-IDF vectors, min(k, max(5, rows / 300))
    clusters; titles without a known term are in none. Fitted once per stored table set."""
    key = ("clusters", k, t.spark.sparkContext.applicationId, t.source)
    with _LOCK:
        if t.source is not None and key in _CACHE:
            return _CACHE[key]
    rows = title_rows(t)
    vec = mlstages.TfIdf(**CLUSTER_TEXT).fit(rows).vectors(rows, ml=True)
    n = min(k, max(5, t.postings.count() // 300))
    model = KMeans(k=n, seed=42, featuresCol="vector", maxIter=50).fit(bounded_tasks(vec))
    out = write_back(model.transform(vec).select("job_id", F.col("prediction").cast("string").alias("title_cluster")),
                     "model-title-clusters")
    if t.source is not None:
        with _LOCK:
            _CACHE[key] = out
    return out


def model_columns(t: JobTables, *company: DataFrame) -> DataFrame:
    """One row per posting: the model's category, count and flag columns that are plain rules
    (location, imputed level, title family, presence flags, counts), and the columns of further
    ``company`` tables."""
    p = t.postings.select(
        "job_id", "company_id", F.col("views").cast("double").alias("views"), F.col("applies").cast("double").alias("applies"),
        clean.fill_unknown("formatted_work_type").alias("formatted_work_type"),
        clean.fill_unknown("pay_period").alias("pay_period"), clean.remote_flag("remote_allowed").alias("remote_flag"),
        text.impute_experience("formatted_experience_level", "title").alias("formatted_experience_level"),
        clean.rule_label("title", rules.TITLE_FAMILY_RULES_MODEL, rules.TITLE_FAMILY_DEFAULT).alias("title_family"),
        (F.coalesce("pay_period", F.lit("")) == "HOURLY").cast("int").alias("is_hourly"),
        F.col("applies").isNotNull().cast("int").alias("has_applies"),
        F.col("views").isNotNull().cast("int").alias("has_views"))
    emp = featureset.latest_employee_count(t).select(
        "company_id", F.col("employee_count").cast("double").alias("employee_count"),
        F.col("follower_count").cast("double").alias("follower_count"))
    p = left_join_known(p, [t.companies.select("company_id", F.col("company_size").cast("double").alias("_size")), emp,
                            agg.nunique_per_key(t.company_specialities, "company_id", "speciality", "n_specialities"),
                            agg.count_per_key(t.company_industries, "company_id", "company_industry_count"), *company], "company_id")
    none = F.lit(0.0)
    return p.withColumns({
        "company_size": F.coalesce(F.col("_size").cast("int").cast("string"), F.lit("Unknown")),
        "has_employee_count": F.col("employee_count").isNotNull().cast("int"),
        "has_follower_count": F.col("follower_count").isNotNull().cast("int"),
        "follower_per_employee": F.coalesce("follower_count", none) / (F.coalesce("employee_count", none) + 1),
        "n_specialities": F.coalesce("n_specialities", F.lit(0)),
        "company_industry_count": F.coalesce("company_industry_count", F.lit(0))}).drop("_size")


def feature_rows(t: JobTables, rows: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Every raw feature column of the usable salary rows, or of the given market-view ``rows``. With
    ``store`` they are written under that name, before the indicators are spread over columns."""
    if rows is None:
        rows = featureset.usable_rows(t)
    else:
        rows = rows.withColumns({"fold": F.lit(-1), "y_log": F.log1p("normalized_salary")})
    u = rows.select("job_id", "fold", "y_log", "normalized_salary", "primary_industry")
    # indicators stay bits of a number until all tables are joined
    specs = features.label_masks(t.companies, t.company_specialities, "company_id", "speciality", len(SPEC_COLS), "spec_top")
    d = u.join(model_columns(t, specs), "job_id").join(featureset.location_features(t), "job_id")
    for other in (title_clusters(t), textual.title_flags(t),
                  features.label_masks(t.postings, views.skills_bridge(t), "job_id", "skill_name", len(SKILL_COLS), "skill_top"),
                  features.label_masks(t.postings, views.benefits_known(t), "job_id", "type", len(BENEFIT_COLS), "benefit_top"),
                  featureset.company_job_count(t),
                  agg.nunique_per_key(views.skills_bridge(t), "job_id", "skill_name", "n_skills"),
                  agg.count_per_key(views.benefits_known(t), "job_id", "n_benefits"), title_rows(t), description_rows(t)):
        d = d.join(other, "job_id", "left")
    exp, ind = "formatted_experience_level", "primary_industry"
    d = d.withColumns({"title_cluster": F.coalesce("title_cluster", F.lit("Unknown")),
                       "company_id": F.coalesce(F.col("company_id").cast("string"), F.lit("-1")),
                       "description_len": text.text_length("description_clean").cast("double"),
                       "description_word_count": text.word_count("description_clean").cast("double")})
    d = d.withColumns({"city_industry": clean.interaction("city_loc", ind), "state_industry": clean.interaction("state_final", ind),
                       "exp_industry": clean.interaction(exp, ind), "exp_title_cluster": clean.interaction(exp, "title_cluster"),
                       "remote_industry": clean.interaction("remote_flag", ind),
                       "pay_work_type": clean.interaction("pay_period", "formatted_work_type")})
    found = {"skill_top": len(SKILL_COLS), "benefit_top": len(BENEFIT_COLS), "spec_top": len(SPEC_COLS)}
    plain = [c for c in LOG_COLS + NUM_COLS + BIN_COLS if c not in SKILL_COLS + BENEFIT_COLS + SPEC_COLS]
    ids, texts = ["job_id", "fold", "y_log", "normalized_salary", *dict.fromkeys(CAT_COLS + TE_COLS)], ["title_text", "description_clean"]
    d = d.fillna(0, subset=["n_skills", "n_benefits", "company_job_count"]).select(
        *ids, *[F.col(c).cast("double").alias(c) for c in plain], *[f"_{name}0" for name in found], *texts)
    if store:
        d = write_back(d, store)
    bits = [c.cast("double") for name, k in found.items() for c in features.label_bits(k, name)]
    return d.select(*ids, *plain, *bits, *texts)


def text_columns(s: dict) -> list[str]:
    return [f"{s['out']}_{i:03d}" for i in range(1, s["components"] + 1)]


def feature_names() -> list[str]:
    """The assembled vector's columns: codes, logged counts, numbers, indicators, text, encodings."""
    return ([f"{c}_code" for c in CAT_COLS] + LOG_COLS + NUM_COLS + BIN_COLS + text_columns(TITLE_TEXT)
            + text_columns(DESCRIPTION_TEXT) + [f"te_{c}" for c in TE_COLS])


def plain_stages() -> list:
    """The stages that never look at the target: from raw columns to the vector ``plain``."""
    numbers = LOG_COLS + NUM_COLS
    return [mlstages.OrdinalEncoder(cols=CAT_COLS), mlstages.MedianImputer(cols=numbers), mlstages.Log1p(cols=LOG_COLS),
            mlstages.ConstantImputer(cols=BIN_COLS, value=0.0), mlstages.TfIdf(**TITLE_TEXT),
            mlstages.TfIdf(**DESCRIPTION_TEXT),
            mlstages.Standardizer(cols=numbers + text_columns(TITLE_TEXT) + text_columns(DESCRIPTION_TEXT)),
            VectorAssembler(inputCols=feature_names()[:-len(TE_COLS)], outputCol="plain", handleInvalid="keep")]


def target_stages(smoothing: float = 40.0, min_count: int = 8) -> list:
    """Target encodings and the final vector ``features``."""
    te = [f"te_{c}" for c in TE_COLS]
    return [mlstages.MedianTargetEncoder(cols=TE_COLS, target="y_log", smoothing=smoothing, min_count=min_count),
            mlstages.Standardizer(cols=te),
            VectorAssembler(inputCols=["plain", *te], outputCol="features", handleInvalid="keep")]


def salary_pipeline(learner) -> Pipeline:
    """Everything in one estimator, for callers who fit on a table of their own."""
    return Pipeline(stages=plain_stages() + target_stages()
                    + [learner.copy().setFeaturesCol("features").setLabelCol("y_log")])


def fit_stages(stages: list, df: DataFrame, name: str) -> tuple[list, DataFrame]:
    """Fit stages one after another as ``Pipeline`` does, but with the rows stored after the last text
    projection and after target encodings, so that no later fit repeats these. The stages before
    read few columns, so that lookups done again cost them less than rows of all columns written
    each time. Returns (models, rows)."""
    models = []
    texts = [s for s in stages if isinstance(s, mlstages.TfIdf)]
    for stage in stages:
        m = stage.fit(df) if isinstance(stage, Estimator) else stage
        df = m.transform(df)
        if stage in texts[-1:] or isinstance(m, mlstages.MedianTargetEncoderModel):
            df = write_back(df, name)
        models.append(m)
    return models, df


def fitted_plain(t: JobTables) -> dict:
    """Raw feature rows, the fitted plain stages and their output, for the usable salary rows.
    Fitted once per stored table set; cross-validation and the final model share it."""
    key = ("plain", t.spark.sparkContext.applicationId, t.source)
    with _LOCK:
        if t.source is not None and key in _CACHE:
            return _CACHE[key]
    base = feature_rows(t, store="job-features")
    models, rows = fit_stages(plain_stages(), base, "plain-features")
    keep = ["job_id", "fold", "y_log", "normalized_salary", *TE_COLS, "plain"]
    out = {"base": base, "models": models, "rows": write_back(rows.select(*keep), "plain-matrix")}
    if t.source is not None:
        with _LOCK:
            _CACHE[key] = out
    return out


def request_rows(t: JobTables) -> DataFrame:
    """Raw feature rows of every posting with its text projections, which no scenario changes."""
    key = ("requests", t.spark.sparkContext.applicationId, t.source)
    with _LOCK:
        if t.source is not None and key in _CACHE:
            return _CACHE[key]
    rows = feature_rows(t, rows=market.market_view(t), store="request-features")
    for m in fitted_plain(t)["models"]:
        if isinstance(m, mlstages.TfIdfModel):
            rows = m.transform(rows)
    rows = write_back(rows, "request-features")
    if t.source is not None:
        with _LOCK:
            _CACHE[key] = rows
    return rows


# --- registered views of the stages ---------------------------------------------------------------

def salary_features(t: JobTables) -> DataFrame:
    """The rule-based model columns of every posting."""
    return model_columns(t).drop("company_id")


def ordinal_codes(t: JobTables) -> DataFrame:
    """Codes of the category columns, fitted on the usable salary rows, for every posting."""
    cols = ["formatted_experience_level", "formatted_work_type", "pay_period", "company_size", "title_family"]
    d = model_columns(t).select("job_id", *cols)
    fit = d.join(featureset.usable_rows(t).select("job_id"), "job_id", "left_semi")
    return mlstages.OrdinalEncoder(cols=cols).fit(fit).transform(d).select("job_id", *[f"{c}_code" for c in cols])


def standardized_numbers(t: JobTables) -> DataFrame:
    """Logged counts and plain numbers of every posting, missing values at the median, as
    population z-scores; medians, means and deviations from the usable salary rows."""
    logs, nums = ["views", "applies", "employee_count", "follower_count"], ["follower_per_employee", "n_specialities"]
    d = model_columns(t).select("job_id", *logs, *nums)
    fit = d.join(featureset.usable_rows(t).select("job_id"), "job_id", "left_semi")
    stages = [mlstages.MedianImputer(cols=logs + nums), mlstages.Log1p(cols=logs), mlstages.Standardizer(cols=logs + nums)]
    return Pipeline(stages=stages).fit(fit).transform(d).select("job_id", *logs, *nums)


TERM_SETTINGS = {
    "report_titles": ("title", {"max_features": 300, "min_df": 5, "stopwords": True}),
    "model_titles": ("title", {k: v for k, v in TITLE_TEXT.items() if k not in ("col", "out", "components")}),
    "cluster_titles": ("title", {k: v for k, v in CLUSTER_TEXT.items() if k != "col"}),
    "model_descriptions": ("description", {k: v for k, v in DESCRIPTION_TEXT.items() if k not in ("col", "out", "components")}),
}


def _rows_of(t: JobTables, what: str) -> tuple[DataFrame, str]:
    return (title_rows(t), "title_text") if what == "title" else (description_rows(t), "description_clean")


def term_table(t: JobTables) -> DataFrame:
    """(setting, term, doc_freq, total, idf): the vocabulary of each of the four text settings."""
    out = None
    for name, (what, s) in TERM_SETTINGS.items():
        rows, col = _rows_of(t, what)
        v = mlstages.TfIdf(col=col, **s).fit(rows).tables["vocabulary"]
        v = v.select(F.lit(name).alias("setting"), "term", "doc_freq", "total", "idf")
        out = v if out is None else out.unionByName(v)
    return out


def title_term_weights(t: JobTables) -> DataFrame:
    """(job_id, term, w): the TF-IDF matrix of the model's titles, row by row of length 1."""
    rows = title_rows(t)
    return mlstages.TfIdf(col="title_text", **TERM_SETTINGS["model_titles"][1]).fit(rows).weights(rows).drop("place")


def _projection(t: JobTables, what: str, s: dict) -> DataFrame:
    rows, col = _rows_of(t, what)
    m, d = mlstages.TfIdf(**{**s, "col": col, "out": "component"}).fit_transform(write_back(rows, "projected-texts"))
    return d.select("job_id", *m.columns())


def title_projection_25(t: JobTables) -> DataFrame:
    """Titles in 25 components (truncated SVD of the TF-IDF matrix)."""
    return _projection(t, "title", TITLE_TEXT)


def title_projection_30(t: JobTables) -> DataFrame:
    """Titles in 30 components, the earlier model's setting."""
    return _projection(t, "title", {**TITLE_TEXT, "components": 30})


def description_projection_100(t: JobTables) -> DataFrame:
    """Descriptions without pay information in 100 components."""
    return _projection(t, "description", DESCRIPTION_TEXT)
