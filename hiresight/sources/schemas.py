"""Declared schemas of the job-market tables (only the columns the queries read)."""

from pyspark.sql import types as T

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS = {
    "postings": _st(("job_id", _L), ("company_id", _L), ("title", _S), ("description", _S),
                    ("location", _S), ("remote_allowed", _D), ("formatted_experience_level", _S),
                    ("formatted_work_type", _S), ("normalized_salary", _D), ("pay_period", _S),
                    ("currency", _S), ("views", _D), ("applies", _D), ("listed_time", _L),
                    ("skills_desc", _S)),
    "companies": _st(("company_id", _L), ("name", _S), ("company_size", _D), ("state", _S),
                     ("city", _S), ("country", _S)),
    "job_skills": _st(("job_id", _L), ("skill_abr", _S)),
    "skills": _st(("skill_abr", _S), ("skill_name", _S)),
    "job_industries": _st(("job_id", _L), ("industry_id", _L)),
    "industries": _st(("industry_id", _L), ("industry_name", _S)),
    "salaries": _st(("job_id", _L), ("min_salary", _D), ("max_salary", _D), ("med_salary", _D),
                    ("pay_period", _S), ("currency", _S)),
    "benefits": _st(("job_id", _L), ("type", _S)),
    "employee_counts": _st(("company_id", _L), ("employee_count", _L), ("follower_count", _L)),
    "company_industries": _st(("company_id", _L), ("industry_id", _L)),
    "company_specialities": _st(("company_id", _L), ("speciality", _S)),
}

#: other headers a source may use for a declared column (fixed values)
SYNONYMS = {"speciality": ["specialty", "specialities", "specialties"]}

TABLES = tuple(SCHEMAS)
