"""Named report queries Q01-Q13: compositions of the operators over the cleaned views.

Every function takes a ``JobTables`` and returns a lazy DataFrame in long form (labels as
columns, not pivoted), so the same plan serves any table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, rules
from ..operators import agg
from ..operators.joins import keep_labels
from ..operators.quantiles import agg_by, median
from ..session import write_back
from ..sources.tables import JobTables
from . import views

EXP = rules.EXPERIENCE_LEVELS
EXPL = "formatted_experience_level"
SAL = "normalized_salary"


# --- Q01 market overview ----------------------------------------------------------------------
def q01_1(t: JobTables) -> DataFrame:
    """Postings per experience level, the seven known levels only."""
    p = views.report_postings(t)
    return keep_labels(agg.count_by(p, EXPL), EXPL, rules.EXPERIENCE_LEVELS_ALL)


def q01_2(t: JobTables) -> DataFrame:
    """Work-type counts and shares."""
    return agg.distribution_pct(views.report_postings(t), "formatted_work_type")


def q01_3(t: JobTables) -> DataFrame:
    """Remote vs office counts."""
    p = views.report_postings(t).select(
        clean.label_map("remote_allowed", rules.REMOTE_LABELS).alias("remote_label"))
    return agg.count_by(p, "remote_label")


def q01_4(t: JobTables) -> DataFrame:
    """Top 15 states by postings."""
    return agg.top_k_counts(views.report_postings(t), "state", 15)


def q01_5(t: JobTables) -> DataFrame:
    """Median salary (and salaried postings) per experience level."""
    p = keep_labels(views.report_postings(t), EXPL, EXP)
    return agg.median_by(p, EXPL, SAL)


def q01_6(t: JobTables) -> DataFrame:
    """Remote rate (%) per company size."""
    p = views.report_postings(t, with_company=True)
    return agg.rate_by(keep_labels(p, "size_label", rules.SIZE_ORDER), "size_label", "remote_allowed")


def _band(c):
    return clean.band(c, *rules.SALARY_BANDS_REPORT)


def _sal_postings(t: JobTables, with_company: bool = False) -> DataFrame:
    """Postings with a (cleaned) salary."""
    return views.report_postings(t, with_company).where(F.col(SAL).isNotNull())


# --- Q02 skill and industry demand ------------------------------------------------------------
def q02_1(t: JobTables) -> DataFrame:
    """Top 20 skills by posting-skill rows."""
    return agg.top_k_counts(views.skills_bridge(t), "skill_name", 20)


def q02_2(t: JobTables) -> DataFrame:
    """Top 15 industries by posting-industry rows."""
    return agg.top_k_counts(views.industries_bridge(t), "industry_name", 15)


def q02_3(t: JobTables) -> DataFrame:
    """Experience level x top-10 skill shares."""
    js = views.skills_bridge(t)
    top10 = agg.top_k_labels(js, "skill_name", 10)
    d = keep_labels(js, "skill_name", top10).join(
        views.report_postings(t).select("job_id", EXPL), "job_id", "left")
    return agg.share_matrix(d, EXPL, "skill_name", rows=EXP)


def q02_4(t: JobTables) -> DataFrame:
    """15 best-paid skills with at least 100 salaried posting-skill rows."""
    d = views.skills_bridge(t).join(_sal_postings(t).select("job_id", SAL), "job_id")
    return agg.median_by(d, "skill_name", SAL, min_count=100, k=15)


def q02_5(t: JobTables) -> DataFrame:
    """Top-5 industry x top-8 skill shares (both bridges pruned to their top labels before the
    job-level join, so the m x n fan-out only happens on kept rows)."""
    js, ji = views.skills_bridge(t), views.industries_bridge(t)
    a = keep_labels(js, "skill_name", agg.top_k_labels(js, "skill_name", 8)).select("job_id", "skill_name")
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 5)).select(
        "job_id", "industry_name")
    return agg.share_matrix(a.join(b, "job_id"), "industry_name", "skill_name")


# --- Q04 cross sections -----------------------------------------------------------------------
def q04_1(t: JobTables) -> DataFrame:
    """Experience level x salary band shares."""
    p = views.report_postings(t).withColumn("salary_band", _band(SAL))
    return agg.share_matrix(p, EXPL, "salary_band", rows=EXP)


def q04_2(t: JobTables) -> DataFrame:
    """Top-10 industry x salary band shares."""
    p = views.report_postings(t).select("job_id", _band(SAL).alias("salary_band"))
    ji = views.industries_bridge(t)
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 10))
    return agg.share_matrix(p.join(b.select("job_id", "industry_name"), "job_id"),
                            "industry_name", "salary_band")


def q04_3(t: JobTables) -> DataFrame:
    """Top-15 states: postings, remote %, median salary (states without salaries dropped)."""
    p = views.report_postings(t)
    p = keep_labels(p, "state", agg.top_k_labels(p, "state", 15))
    g = agg.multi_agg_by(p, "state", {"n": F.count("job_id"),
                                      "remote_pct": F.avg("remote_allowed") * 100,
                                      "median_salary": median(SAL)})
    return g.where(F.col("median_salary").isNotNull())


def q04_4(t: JobTables) -> DataFrame:
    """Experience level x work type (three main types) shares."""
    return agg.share_matrix(views.report_postings(t), EXPL, "formatted_work_type",
                            rows=EXP, cols=rules.WORK_TYPES_MAIN)


def q04_5(t: JobTables) -> DataFrame:
    """Salary band x top-8 skill shares."""
    p = views.report_postings(t).select("job_id", _band(SAL).alias("salary_band"))
    js = views.skills_bridge(t)
    b = keep_labels(js, "skill_name", agg.top_k_labels(js, "skill_name", 8))
    return agg.share_matrix(p.join(b.select("job_id", "skill_name"), "job_id"),
                            "salary_band", "skill_name")


# --- Q05 geography ----------------------------------------------------------------------------
def q05_1(t: JobTables) -> DataFrame:
    """20 best-paid states with at least 100 salaried postings."""
    return agg.median_by(views.report_postings(t), "state", SAL, min_count=100, k=20)


def q05_2(t: JobTables) -> DataFrame:
    """Remote rate of the 20 largest states."""
    p = views.report_postings(t)
    return agg.rate_by(keep_labels(p, "state", agg.top_k_labels(p, "state", 20)), "state",
                       "remote_allowed")


def q05_3(t: JobTables) -> DataFrame:
    """Top 15 cities."""
    return agg.top_k_counts(views.report_postings(t), "city", 15)


def q05_4(t: JobTables) -> DataFrame:
    """Top-10 state x top-8 industry shares."""
    p = views.report_postings(t)
    ji = views.industries_bridge(t)
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 8))
    d = p.select("job_id", "state").join(b.select("job_id", "industry_name"), "job_id")
    return agg.share_matrix(d, "state", "industry_name", rows=agg.top_k_labels(p, "state", 10))


def q05_5(t: JobTables) -> DataFrame:
    """Top-8 state x experience level shares."""
    p = views.report_postings(t)
    return agg.share_matrix(p, "state", EXPL, rows=agg.top_k_labels(p, "state", 8), cols=EXP)


# --- Q06 companies ----------------------------------------------------------------------------
def q06_1(t: JobTables) -> DataFrame:
    """Top 15 companies by postings."""
    return agg.top_k_counts(views.report_postings(t, with_company=True), "name", 15)


def q06_2(t: JobTables) -> DataFrame:
    """Median salary per company size."""
    return agg.median_by(views.report_postings(t, with_company=True), "size_label", SAL)


def q06_3(t: JobTables) -> DataFrame:
    """Company size x top-8 industry shares."""
    p = views.report_postings(t, with_company=True)
    ji = views.industries_bridge(t)
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 8))
    return agg.share_matrix(p.select("job_id", "size_label").join(
        b.select("job_id", "industry_name"), "job_id"), "size_label", "industry_name")


def q06_4(t: JobTables, min_count: int = 20) -> DataFrame:
    """15 best-paying companies with at least ``min_count`` salaried postings."""
    return agg.median_by(views.report_postings(t, with_company=True), "name", SAL,
                         min_count=min_count, k=15)


def q06_5(t: JobTables) -> DataFrame:
    """Company size x experience level shares."""
    return agg.share_matrix(views.report_postings(t, with_company=True), "size_label", EXPL,
                            cols=EXP)


# --- Q08 benefits -----------------------------------------------------------------------------
def _benefit_counts(t: JobTables) -> DataFrame:
    return agg.count_per_key(views.benefits_known(t), "job_id", "benefit_count")


def q08_1(t: JobTables) -> DataFrame:
    """Top 20 benefit types."""
    return agg.top_k_counts(views.benefits_known(t), "type", 20)


def q08_2(t: JobTables) -> DataFrame:
    """Mean number of benefit rows per job by company size (jobs with benefits only)."""
    d = _benefit_counts(t).join(
        views.report_postings(t, with_company=True).select("job_id", "size_label"), "job_id", "left")
    return agg.multi_agg_by(d, "size_label", {"avg_benefits": F.avg("benefit_count")})


def q08_3(t: JobTables) -> DataFrame:
    """Top-5 industry x top-10 benefit shares."""
    ben, ji = views.benefits_known(t), views.industries_bridge(t)
    a = keep_labels(ben, "type", agg.top_k_labels(ben, "type", 10))
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 5))
    return agg.share_matrix(a.join(b.select("job_id", "industry_name"), "job_id"),
                            "industry_name", "type")


def q08_4(t: JobTables) -> DataFrame:
    """Median salary by number of benefits (1..9, 10+)."""
    d = _benefit_counts(t).join(_sal_postings(t).select("job_id", SAL), "job_id")
    d = d.withColumn("benefit_group", clean.cap_label("benefit_count", 10))
    return agg.median_by(d, "benefit_group", SAL)


def q08_5(t: JobTables) -> DataFrame:
    """Experience level x top-8 benefit shares."""
    ben = views.benefits_known(t)
    a = keep_labels(ben, "type", agg.top_k_labels(ben, "type", 8))
    d = a.join(views.report_postings(t).select("job_id", EXPL), "job_id", "left")
    return agg.share_matrix(d, EXPL, "type", rows=EXP)


# --- Q09 skills and salary --------------------------------------------------------------------
def _skill_salaries(t: JobTables) -> DataFrame:
    return views.skills_bridge(t).join(_sal_postings(t).select("job_id", SAL, EXPL), "job_id")


def q09_2(t: JobTables) -> DataFrame:
    """Box statistics of salary for the 10 most frequent skills."""
    js = views.skills_bridge(t)
    d = keep_labels(_skill_salaries(t), "skill_name", agg.top_k_labels(js, "skill_name", 10))
    return agg.boxplot_stats(d, "skill_name", SAL)


def q09_3(t: JobTables) -> DataFrame:
    """Experience level x top-6 skill median salary."""
    js = views.skills_bridge(t)
    return agg.median_matrix(_skill_salaries(t), EXPL, "skill_name", SAL, rows=EXP,
                             cols=agg.top_k_labels(js, "skill_name", 6))


def q09_4(t: JobTables) -> DataFrame:
    """Top-5 industry x top-6 skill median salary."""
    js, ji = views.skills_bridge(t), views.industries_bridge(t)
    a = keep_labels(_skill_salaries(t), "skill_name", agg.top_k_labels(js, "skill_name", 6))
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 5))
    return agg.median_matrix(a.join(b.select("job_id", "industry_name"), "job_id"),
                             "industry_name", "skill_name", SAL)


def q09_5(t: JobTables) -> DataFrame:
    """Median salary and postings by number of named skills (1..7, 8+)."""
    cnt = agg.count_per_key(views.skills_bridge(t), "job_id", "skill_count", value="skill_name")
    d = cnt.join(_sal_postings(t).select("job_id", SAL), "job_id")
    d = d.where(F.col("skill_count") >= 1).withColumn("skill_group", clean.cap_label("skill_count", 8))
    return agg.median_by(d, "skill_group", SAL)


# --- Q10 competition --------------------------------------------------------------------------
def _competition(t: JobTables) -> DataFrame:
    p = views.report_postings(t)
    return (p.withColumn("competition_score", clean.competition_score("applies", "views"))
            .where(F.col("competition_score").isNotNull())
            .withColumn("title_clean", clean.title_norm("title")))


def q10_1(t: JobTables) -> DataFrame:
    """15 most competitive titles (applies per view) with at least 20 postings."""
    return agg.multi_agg_by(
        _competition(t), "title_clean",
        {"avg_score": F.avg("competition_score"), "avg_applies": F.avg("applies"),
         "n": F.count("job_id")},
        having=F.col("n") >= 20, order=[F.col("avg_score").desc()], k=15)


def q10_2(t: JobTables) -> DataFrame:
    """Median competition of the 12 industries with most competition rows."""
    d = _competition(t).select("job_id", "competition_score").join(
        views.industries_bridge(t).select("job_id", "industry_name"), "job_id")
    d = keep_labels(d, "industry_name", agg.top_k_labels(d, "industry_name", 12))
    return agg.median_by(d, "industry_name", "competition_score", median="median_score", count=None)


def _score_stats():
    return {"median_score": median("competition_score"), "mean_score": F.avg("competition_score"),
            "n": F.count("competition_score")}


def q10_3(t: JobTables) -> DataFrame:
    """Competition by experience level."""
    return agg.multi_agg_by(keep_labels(_competition(t), EXPL, EXP), EXPL, _score_stats())


def q10_4(t: JobTables) -> DataFrame:
    """Competition remote vs office."""
    d = _competition(t).withColumn("work_type", clean.label_map("remote_allowed", rules.REMOTE_LABELS))
    return agg.multi_agg_by(d, "work_type", _score_stats())


def q10_5(t: JobTables) -> DataFrame:
    """15 least competitive titles with at least 20 postings and median salary above 60k."""
    return agg.multi_agg_by(
        _competition(t), "title_clean",
        {"avg_score": F.avg("competition_score"), "median_salary": median(SAL),
         "n": F.count("job_id")},
        having=(F.col("n") >= 20) & (F.col("median_salary") > 60000),
        order=[F.col("avg_score").asc()], k=15)


# --- Q11 career ladder ------------------------------------------------------------------------
def _industry_ladder(t: JobTables, k: int) -> DataFrame:
    ji = views.industries_bridge(t)
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", k))
    s = keep_labels(_sal_postings(t), EXPL, EXP).select("job_id", SAL, EXPL)
    return s.join(b.select("job_id", "industry_name"), "job_id")


def q11_1(t: JobTables) -> DataFrame:
    """Salary distribution per experience level (quartiles, whiskers, extremes)."""
    return agg.boxplot_stats(keep_labels(_sal_postings(t), EXPL, EXP), EXPL, SAL)


def q11_2(t: JobTables) -> DataFrame:
    """Top-6 industry x level median salary, industries with at least two levels."""
    from pyspark.sql import Window
    m = agg.median_matrix(write_back(_industry_ladder(t, 6), "industry-ladder"), "industry_name", EXPL, SAL)
    m = m.withColumn("levels", F.count(F.lit(1)).over(Window.partitionBy("industry_name")))
    return m.where(F.col("levels") >= 2)


def q11_3(t: JobTables) -> DataFrame:
    """Company size (seven sizes, largest left out) x level median salary."""
    s = _sal_postings(t, with_company=True)
    return agg.median_matrix(s, "size_label", EXPL, SAL, rows=rules.SIZE_ORDER[:7], cols=EXP)


def q11_4(t: JobTables) -> DataFrame:
    """Entry to mid-senior salary growth in the top-6 industries."""
    return agg.growth_by(write_back(_industry_ladder(t, 6), "industry-ladder"), "industry_name", EXPL, SAL,
                         "Entry level", "Mid-Senior level")


def q11_5(t: JobTables) -> DataFrame:
    """Remote flag x level median salary."""
    return agg.median_matrix(keep_labels(_sal_postings(t), EXPL, EXP), "remote_allowed", EXPL, SAL)


# --- Q12 remote work --------------------------------------------------------------------------
def q12_1(t: JobTables) -> DataFrame:
    """Remote salary premium within the top-10 industries."""
    ji = views.industries_bridge(t)
    b = keep_labels(ji, "industry_name", agg.top_k_labels(ji, "industry_name", 10))
    d = _sal_postings(t).select("job_id", SAL, "remote_allowed").join(
        b.select("job_id", "industry_name"), "job_id")
    return agg.premium_by(d, "industry_name", "remote_allowed", SAL)


def q12_2(t: JobTables) -> DataFrame:
    """Top-15 skill rows per 100 remote vs per 100 office postings, and the difference.
    One conditional aggregation over the bridge; segment sizes are scalar subqueries."""
    p = views.report_postings(t).select("job_id", "remote_allowed")
    js = views.skills_bridge(t)
    a = keep_labels(js, "skill_name", agg.top_k_labels(js, "skill_name", 15)).join(p, "job_id")
    n_remote = p.where("remote_allowed = 1").select(F.count(F.lit(1))).scalar()
    n_office = p.where("remote_allowed = 0").select(F.count(F.lit(1))).scalar()
    g = a.groupBy("skill_name").agg(
        F.count(F.when(F.col("remote_allowed") == 1, F.lit(1))).alias("remote_rows"),
        F.count(F.when(F.col("remote_allowed") == 0, F.lit(1))).alias("office_rows"))
    g = g.select("skill_name", F.try_divide(F.col("remote_rows") * 100.0, n_remote).alias("remote_pct"),
                 F.try_divide(F.col("office_rows") * 100.0, n_office).alias("office_pct"))
    return g.withColumn("diff", F.col("remote_pct") - F.col("office_pct"))


def q12_3(t: JobTables) -> DataFrame:
    """Per company size: remote %, postings, office and remote median salary (one pass)."""
    p = views.report_postings(t, with_company=True).where(F.col("size_label").isNotNull())
    r = F.col("remote_allowed")
    return agg_by(p, "size_label", {
        "remote_pct": F.avg(r) * 100, "n": F.count(F.lit(1)),
        "office_sal": median(F.when(r == 0, F.col(SAL))), "remote_sal": median(F.when(r == 1, F.col(SAL)))})


def q12_4(t: JobTables) -> DataFrame:
    """Top-20 states: remote % against median salary, with the least-squares line through the
    state points (window over the at most 20 result rows)."""
    from pyspark.sql import Window
    p = views.report_postings(t)
    p = keep_labels(p, "state", agg.top_k_labels(p, "state", 20))
    g = agg.multi_agg_by(p, "state", {"remote_pct": F.avg("remote_allowed") * 100,
                                      "median_salary": median(SAL), "n": F.count("job_id")})
    g = g.where(F.col("median_salary").isNotNull())
    w = Window.partitionBy()
    return g.select("*", F.regr_slope("median_salary", "remote_pct").over(w).alias("trend_slope"),
                    F.regr_intercept("median_salary", "remote_pct").over(w).alias("trend_intercept"))


def q12_5(t: JobTables) -> DataFrame:
    """Level x remote flag median salary."""
    return agg.median_matrix(keep_labels(_sal_postings(t), EXPL, EXP), EXPL, "remote_allowed", SAL)


# --- Q13 salary range gap ---------------------------------------------------------------------
def gap_records(t: JobTables) -> DataFrame:
    """Yearly USD ranges with 10k <= min <= max <= 500k, gap columns, level, state and the
    primary industry of the job."""
    lo, hi = rules.GAP_RANGE
    s = t.salaries
    s = s.where((F.col("pay_period") == "YEARLY") & (F.col("currency") == "USD")
                & F.col("min_salary").isNotNull() & F.col("max_salary").isNotNull()
                & (F.col("min_salary") >= lo) & (F.col("max_salary") <= hi)
                & (F.col("max_salary") >= F.col("min_salary")))
    s = s.select("job_id", "min_salary", "max_salary",
                 (F.col("max_salary") - F.col("min_salary")).alias("gap"),
                 ((F.col("max_salary") - F.col("min_salary")) / F.col("min_salary") * 100).alias("gap_pct"),
                 ((F.col("min_salary") + F.col("max_salary")) / 2).alias("mid_sal"))
    p = t.postings.select("job_id", clean.fill_unknown(EXPL).alias(EXPL),
                          clean.extract_state("location").alias("state"))
    g = s.join(p, "job_id", "left").join(views.primary_industry(t), "job_id", "left")
    return write_back(g, "gap-records")  # read by every statistic of a report


def q13_1(t: JobTables) -> DataFrame:
    """50-bin histograms of the gap (clipped at 200k) and the gap % (clipped at 200), with the
    mean and the median of the unclipped values."""
    g = write_back(gap_records(t).select("gap", "gap_pct"), "gap-values")
    a = agg.histogram(g, "gap", 50, 200_000, markers=True).withColumn("measure", F.lit("gap"))
    b = agg.histogram(g, "gap_pct", 50, 200, markers=True).withColumn("measure", F.lit("gap_pct"))
    return a.unionByName(b)


def _gap_stats(extra=None):
    d = {"median_gap": median("gap"), "median_gap_pct": median("gap_pct")}
    d.update(extra or {})
    d["n"] = F.count("job_id")
    return d


def q13_2(t: JobTables, gaps: DataFrame | None = None) -> DataFrame:
    """Gap statistics of the 15 most frequent primary industries."""
    g = gaps if gaps is not None else gap_records(t)
    g = keep_labels(g, "industry_name", agg.top_k_labels(g, "industry_name", 15))
    return agg.multi_agg_by(g, "industry_name", _gap_stats({"median_sal": median("mid_sal")}))


def q13_3(t: JobTables) -> DataFrame:
    """Gap statistics per experience level."""
    g = keep_labels(gap_records(t), EXPL, EXP)
    return agg.multi_agg_by(g, EXPL, _gap_stats({"median_min": median("min_salary"),
                                                 "median_max": median("max_salary")}))


def q13_4(t: JobTables) -> DataFrame:
    """Gap statistics per salary band of the range midpoint."""
    g = gap_records(t).withColumn("salary_band", _band("mid_sal"))
    return agg.multi_agg_by(g, "salary_band", _gap_stats())


def q13_5(t: JobTables) -> DataFrame:
    """Top-8 industry x level median gap %."""
    g = gap_records(t)
    return agg.median_matrix(g, "industry_name", EXPL, "gap_pct",
                             rows=agg.top_k_labels(g, "industry_name", 8), cols=EXP,
                             median="median_gap_pct")


def q13_6(t: JobTables) -> DataFrame:
    """Headline: rows, median gap and gap %, widest and narrowest of the top-15 industries."""
    g = gap_records(t)
    ind = write_back(q13_2(t, g), "gap-industries")
    # at most 15 rows; ties go to the first name
    rows = F.collect_list(F.struct((-F.col("median_gap")).alias("g"), F.col("industry_name").alias("i")))
    low = F.collect_list(F.struct(F.col("median_gap").alias("g"), F.col("industry_name").alias("i")))
    ends = ind.where(F.col("median_gap").isNotNull()).agg(
        F.array_sort(rows)[0].alias("w"), F.array_sort(low)[0].alias("l")).select(
        F.col("w.i").alias("widest_industry"), (-F.col("w.g")).alias("widest_gap"),
        F.col("l.i").alias("narrowest_industry"), F.col("l.g").alias("narrowest_gap"))
    head = agg_by(g, [], {"n": F.count(F.lit(1)), "median_gap": median("gap"), "median_gap_pct": median("gap_pct")})
    names = ["widest_industry", "widest_gap", "narrowest_industry", "narrowest_gap"]
    e = ends.select(F.struct(*names)).scalar()
    return head.select("*", *[e.getField(c).alias(c) for c in names])


# --- Q09.1 skill premium with a rank test ------------------------------------------------------
def mann_whitney(t: JobTables) -> DataFrame:
    """Per skill with >= 200 rows: salaried postings with/without it, medians, U and z."""
    from ..operators import stats
    return stats.mann_whitney_by_label(views.skills_bridge(t), views.report_postings(t),
                                       "job_id", "skill_name", SAL)


def premium_test(t: JobTables) -> DataFrame:
    """Skills whose salary premium is significant (both sides >= 50, two-sided p < 0.05)."""
    from ..operators import stats
    return stats.premium_test(views.skills_bridge(t), views.report_postings(t),
                              "job_id", "skill_name", SAL)


def q09_1(t: JobTables) -> DataFrame:
    """15 largest and 15 smallest significant skill premiums, with p-values."""
    from ..operators import stats
    sig = stats.premium_test(views.skills_bridge(t), views.report_postings(t),
                             "job_id", "skill_name", SAL, with_p=True)
    # one row per significant label, read by both sides of the ranking: written once
    return stats.top_and_bottom(write_back(sig, "premium-test"), "premium", 15, "skill_name")
