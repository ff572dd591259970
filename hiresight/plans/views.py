"""Cleaned views shared by the report queries (one cleaning layer instead of a copy per report).

``report_postings``  cleaning common to the analysis reports: remote flag 0/1, experience
                     'Unknown' when missing, salary kept in [10k, 1M], state and city from location.
``skills_bridge``    job_skills of known postings with skill names (left lookup: unknown codes keep
                     a NULL name and drop out of label statistics).
``industries_bridge`` the same for industries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, rules
from ..operators.joins import attach_lookup, first_per_key, keep_known, left_join_known
from ..sources.tables import JobTables


def report_clean(p: DataFrame) -> DataFrame:
    """The report cleaning as one projection (usable on batch and streaming frames)."""
    lo, hi = rules.SALARY_RANGE_REPORTS
    return p.select(
        "job_id", "company_id", "title", "description", "location", "formatted_work_type",
        "views", "applies",
        clean.remote_flag("remote_allowed").alias("remote_allowed"),
        clean.fill_unknown("formatted_experience_level").alias("formatted_experience_level"),
        clean.null_outside("normalized_salary", lo, hi).alias("normalized_salary"),
        clean.extract_state("location").alias("state"),
        clean.extract_city("location").alias("city"),
    )


def report_postings(t: JobTables, with_company: bool = False) -> DataFrame:
    out = report_clean(t.postings)
    if with_company:
        out = left_join_known(out, company_view(t), "company_id")
    return out


def company_view(t: JobTables) -> DataFrame:
    return t.companies.select("company_id", "name", F.col("state").alias("company_state"),
                              clean.size_label("company_size").alias("size_label"))


def skills_bridge(t: JobTables, postings: DataFrame | None = None) -> DataFrame:
    ids = (postings if postings is not None else t.postings).select("job_id")
    js = keep_known(t.job_skills, ids)
    return attach_lookup(js, t.skills, "skill_abr", "skill_name")


def industries_bridge(t: JobTables, postings: DataFrame | None = None) -> DataFrame:
    ids = (postings if postings is not None else t.postings).select("job_id")
    ji = keep_known(t.job_industries, ids)
    return attach_lookup(ji, t.industries, "industry_id", "industry_name")


def benefits_known(t: JobTables, postings: DataFrame | None = None) -> DataFrame:
    ids = (postings if postings is not None else t.postings).select("job_id")
    return keep_known(t.benefits, ids)


def primary_industry(t: JobTables) -> DataFrame:
    """(job_id, industry_name): the named industry with the smallest id per job."""
    ji = attach_lookup(t.job_industries, t.industries, "industry_id", "industry_name")
    return first_per_key(ji, "job_id", "industry_name", "industry_id")
