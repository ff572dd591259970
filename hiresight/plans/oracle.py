"""DuckDB SQL twins of the registered queries.

Only the driver tables are registered in the oracle, so each statement inlines the job-market
views it needs as CTEs (the same derivation as ``sources.fixtures``) and the shared cleaning as
further CTEs. Double columns named in ``doubles`` are brought to 1e-6 with the same arithmetic
the Spark side uses (``floor(x * 1e6 + 0.5) / 1e6``), so results compare exactly.
"""

from __future__ import annotations

import re

from ..functions import rules
from ..sources.schemas import SCHEMAS

_FX = {
    "fx_postings": """select o_orderkey as job_id,
 case when o_orderkey % 50 = 0 then null else o_custkey end as company_id,
 case o_orderkey % 12 when 0 then 'Senior Data Engineer' when 1 then 'Registered Nurse' when 2 then 'Sales Manager' when 3 then 'Director of Marketing' when 4 then 'Project Coordinator' when 5 then 'Maintenance Technician' when 6 then 'Software Developer II' when 7 then 'Vice President, Finance' when 8 then 'Product Manager' when 9 then 'Internal Auditor' when 10 then 'HR Recruiter' else null end as title,
 text as description,
 case o_orderkey % 20 when 0 then 'United States' when 1 then 'San Francisco Bay Area' when 2 then 'Remote' when 3 then null else concat('City ', n_nationkey, ', ', concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXY', n_nationkey + 1, 1), 'X')) end as location,
 cast(case when o_orderkey % 8 = 0 then 1.0 else null end as double) as remote_allowed,
 case o_orderpriority when '1-URGENT' then 'Entry level' when '2-HIGH' then 'Associate' when '3-MEDIUM' then 'Mid-Senior level' when '5-LOW' then case when o_orderkey % 2 = 0 then 'Director' else 'Executive' end else null end as formatted_experience_level,
 case o_orderstatus when 'F' then 'Full-time' when 'O' then 'Contract' else 'Part-time' end as formatted_work_type,
 case when o_orderkey % 5 = 0 then null when o_orderkey % 997 = 0 then o_totalprice * 10 else o_totalprice * 0.75 end as normalized_salary,
 case o_orderkey % 7 when 0 then 'HOURLY' when 1 then 'MONTHLY' when 2 then null else 'YEARLY' end as pay_period,
 case when o_orderkey % 11 = 0 then 'EUR' when o_orderkey % 13 = 0 then null else 'USD' end as currency,
 case when o_orderkey % 101 = 0 then 0 else q end as views,
 case when o_orderkey % 9 = 0 then null else r end as applies
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 left join documents on doc_id = o_orderkey
 left join (select l_orderkey, sum(l_quantity) as q, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as r from lineitem group by l_orderkey) on l_orderkey = o_orderkey""",
    "fx_companies": """select c_custkey as company_id, case when c_custkey % 40 = 0 then null else c_name end as name, case when c_custkey % 9 = 0 then null else c_custkey % 9 end as company_size, concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXY', n_nationkey + 1, 1), 'X') as state, r_name as country from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "fx_employee_counts": """select o_custkey as company_id, case when o_orderkey % 17 = 0 then null else cast(floor(o_totalprice / 100) as bigint) end as employee_count, o_orderkey % 10000 as follower_count from orders""",
    "fx_job_skills": """select l_orderkey as job_id, p_brand as skill_abr from lineitem join part on l_partkey = p_partkey""",
    "fx_skills": """select distinct p_brand as skill_abr, concat('Skill ', substr(p_brand, 7)) as skill_name from part where p_brand <> 'Brand#25'""",
    "fx_job_industries": """select l_orderkey as job_id, s_nationkey as industry_id from lineitem join supplier on l_suppkey = s_suppkey where l_linenumber <= 3""",
    "fx_industries": """select n_nationkey as industry_id, n_name as industry_name from nation where n_nationkey <> 24""",
    "fx_benefits": """select l_orderkey as job_id, case when l_linenumber = 7 then null else concat(p_type, ' ', l_returnflag) end as type from lineitem join part on l_partkey = p_partkey where l_linestatus = 'O'""",
    "fx_salaries": """select l_orderkey as job_id, min(l_extendedprice) as min_salary, max(l_extendedprice) as max_salary, case when l_orderkey % 2 = 0 then avg(l_extendedprice) else null end as med_salary, case when l_orderkey % 4 = 0 then 'HOURLY' else 'YEARLY' end as pay_period, case when l_orderkey % 10 = 0 then 'CAD' else 'USD' end as currency from lineitem group by l_orderkey""",
    "fx_company_specialities": """select o_custkey as company_id, p_brand as speciality from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey""",
    "fx_company_industries": """select o_custkey as company_id, s_nationkey as industry_id from orders join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey where l_linenumber = 1""",
}


def _case(col: str, mapping: dict, quote_keys: bool = False) -> str:
    whens = " ".join(
        f"when {col} = {repr(k) if quote_keys else k} then '{v}'" for k, v in mapping.items())
    return f"case {whens} end"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


EXP_IN = _in(rules.EXPERIENCE_LEVELS)
EXP_ALL_IN = _in(rules.EXPERIENCE_LEVELS_ALL)
SIZE_IN = _in(rules.SIZE_ORDER)

_CLEAN = {
    # shared cleaning of the analysis reports
    "v_post": rf"""select job_id, company_id, title, description, location, formatted_work_type, views, applies,
 cast(coalesce(remote_allowed, 0) as integer) as remote_allowed,
 coalesce(formatted_experience_level, 'Unknown') as formatted_experience_level,
 case when normalized_salary between 10000 and 1000000 then normalized_salary end as normalized_salary,
 nullif(regexp_extract(location, ',\s*([A-Z]{{2}})\s*$', 1), '') as state,
 nullif(regexp_extract(location, '^([^,]+)', 1), '') as city
 from fx_postings""",
    "v_comp": f"""select company_id, name, state as company_state, {_case('company_size', rules.SIZE_LABELS)} as size_label from fx_companies""",
    "v_pc": """select v_post.*, v_comp.name, v_comp.company_state, v_comp.size_label from v_post left join v_comp using (company_id)""",
    "v_js": """select j.job_id, j.skill_abr, s.skill_name from fx_job_skills j left join fx_skills s using (skill_abr) where j.job_id in (select job_id from fx_postings)""",
    "v_ji": """select j.job_id, j.industry_id, i.industry_name from fx_job_industries j left join fx_industries i using (industry_id) where j.job_id in (select job_id from fx_postings)""",
    "v_ben": """select * from fx_benefits where job_id in (select job_id from fx_postings)""",
}

_CTES = {**_FX, **_CLEAN}
_ORDER = list(_FX) + list(_CLEAN)


def _needed(text: str) -> set[str]:
    need: set[str] = set()
    todo = [text]
    while todo:
        s = todo.pop()
        for n in _ORDER:
            if n not in need and re.search(rf"\b{n}\b", s):
                need.add(n)
                todo.append(_CTES[n])
    return need


def build(body: str, doubles=(), extra_ctes: dict | None = None) -> str:
    """``WITH <views the body uses> SELECT ... FROM (body)`` with 1e-6 rounding of ``doubles``."""
    extra = extra_ctes or {}
    need = _needed(body + " ".join(extra.values()))
    parts = [f"{n} as ({_CTES[n]})" for n in _ORDER if n in need]
    parts += [f"{n} as ({s})" for n, s in extra.items()]
    sel = "*"
    if doubles:
        sel = "* replace (" + ", ".join(
            f"case when abs({c}) < 1e12 then floor({c} * 1e6 + 0.5) / 1e6 else {c} end as {c}"
            for c in doubles) + ")"
    with_ = ("with " + ",\n".join(parts) + "\n") if parts else ""
    return f"{with_}select {sel} from (\n{body}\n) as q"


SQL: dict[str, str] = {}


def q(name: str, body: str, doubles=(), extra_ctes=None):
    SQL[name] = build(body, doubles, extra_ctes)


# --- Q01 -------------------------------------------------------------------------------------
q("q01_1", f"select formatted_experience_level, count(*) as n from v_post where formatted_experience_level in {EXP_ALL_IN} group by 1")
q("q01_2", """select formatted_work_type, count(*) as n,
 cast(count(*) as double) * 100.0 / (select count(*) from v_post where formatted_work_type is not null) as pct
 from v_post where formatted_work_type is not null group by 1""", ["pct"])
q("q01_3", f"select {_case('remote_allowed', rules.REMOTE_LABELS)} as remote_label, count(*) as n from v_post group by 1")
q("q01_4", "select state, count(*) as n from v_post where state is not null group by 1 order by n desc, state limit 15")
q("q01_5", f"""select formatted_experience_level, median(normalized_salary) as median_salary, count(normalized_salary) as n
 from v_post where formatted_experience_level in {EXP_IN} and normalized_salary is not null group by 1""", ["median_salary"])
q("q01_6", f"select size_label, avg(remote_allowed) * 100 as remote_pct from v_pc where size_label in {SIZE_IN} group by 1", ["remote_pct"])


def topk(view: str, col: str, k: int, where: str = "") -> str:
    w = f" and ({where})" if where else ""
    return (f"(select {col} from {view} where {col} is not null{w} group by {col} "
            f"order by count(*) desc, {col} limit {k})")


def share(row: str, col: str, src: str) -> str:
    return (f"select {row}, {col}, count(*) as n, cast(count(*) as double) * 100.0 / "
            f"sum(count(*)) over (partition by {row}) as share {src} and {row} is not null "
            f"and {col} is not null group by 1, 2")


def band_sql(c: str, edges, labels, include_lowest=False) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{c} >= {lo}" if (i == 0 and include_lowest) else f"{c} > {lo}"
        if hi is not None:
            cond += f" and {c} <= {hi}"
        parts.append(f"when {cond} then '{lab}'")
    return "case " + " ".join(parts) + " end"


BAND = band_sql("normalized_salary", *rules.SALARY_BANDS_REPORT)
TOP_SKILL = lambda k: topk("v_js", "skill_name", k)
TOP_IND = lambda k: topk("v_ji", "industry_name", k)
TOP_STATE = lambda k: topk("v_post", "state", k)

# --- Q02 -------------------------------------------------------------------------------------
q("q02_1", "select skill_name, count(*) as n from v_js where skill_name is not null group by 1 order by n desc, skill_name limit 20")
q("q02_2", "select industry_name, count(*) as n from v_ji where industry_name is not null group by 1 order by n desc, industry_name limit 15")
q("q02_3", share("formatted_experience_level", "skill_name",
                 f"from v_js left join v_post using (job_id) where formatted_experience_level in {EXP_IN} and skill_name in {TOP_SKILL(10)}"), ["share"])
q("q02_4", """select skill_name, median(normalized_salary) as median_salary, count(*) as n from v_js join v_post using (job_id)
 where normalized_salary is not null and skill_name is not null group by 1 having count(*) >= 100 order by median_salary desc, skill_name limit 15""", ["median_salary"])
q("q02_5", share("industry_name", "skill_name",
                 f"from (select job_id, skill_name from v_js where skill_name in {TOP_SKILL(8)}) join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(5)}) using (job_id) where true"), ["share"])

# --- Q04 -------------------------------------------------------------------------------------
q("q04_1", share("formatted_experience_level", "salary_band",
                 f"from (select *, {BAND} as salary_band from v_post) where formatted_experience_level in {EXP_IN}"), ["share"])
q("q04_2", share("industry_name", "salary_band",
                 f"from (select job_id, {BAND} as salary_band from v_post) join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(10)}) using (job_id) where true"), ["share"])
q("q04_3", f"""select state, count(job_id) as n, avg(remote_allowed) * 100 as remote_pct, median(normalized_salary) as median_salary
 from v_post where state in {TOP_STATE(15)} group by 1 having median(normalized_salary) is not null""", ["remote_pct", "median_salary"])
q("q04_4", share("formatted_experience_level", "formatted_work_type",
                 f"from v_post where formatted_experience_level in {EXP_IN} and formatted_work_type in {_in(rules.WORK_TYPES_MAIN)}"), ["share"])
q("q04_5", share("salary_band", "skill_name",
                 f"from (select job_id, {BAND} as salary_band from v_post) join (select job_id, skill_name from v_js where skill_name in {TOP_SKILL(8)}) using (job_id) where true"), ["share"])

# --- Q05 -------------------------------------------------------------------------------------
q("q05_1", """select state, median(normalized_salary) as median_salary, count(*) as n from v_post
 where state is not null and normalized_salary is not null group by 1 having count(*) >= 100 order by median_salary desc, state limit 20""", ["median_salary"])
q("q05_2", f"select state, avg(remote_allowed) * 100 as remote_pct from v_post where state in {TOP_STATE(20)} group by 1", ["remote_pct"])
q("q05_3", "select city, count(*) as n from v_post where city is not null group by 1 order by n desc, city limit 15")
q("q05_4", share("state", "industry_name",
                 f"from v_post join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(8)}) using (job_id) where state in {TOP_STATE(10)}"), ["share"])
q("q05_5", share("state", "formatted_experience_level",
                 f"from v_post where state in {TOP_STATE(8)} and formatted_experience_level in {EXP_IN}"), ["share"])

# --- Q06 -------------------------------------------------------------------------------------
q("q06_1", "select name, count(*) as n from v_pc where name is not null group by 1 order by n desc, name limit 15")
q("q06_2", """select size_label, median(normalized_salary) as median_salary, count(*) as n from v_pc
 where size_label is not null and normalized_salary is not null group by 1""", ["median_salary"])
q("q06_3", share("size_label", "industry_name",
                 f"from v_pc join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(8)}) using (job_id) where true"), ["share"])
q("q06_4", """select name, median(normalized_salary) as median_salary, count(*) as n from v_pc
 where name is not null and normalized_salary is not null group by 1 having count(*) >= 20 order by median_salary desc, name limit 15""", ["median_salary"])
q("q06_5", share("size_label", "formatted_experience_level", f"from v_pc where formatted_experience_level in {EXP_IN}"), ["share"])

# --- Q08 -------------------------------------------------------------------------------------
_BEN_CNT = "(select job_id, count(*) as benefit_count from v_ben group by 1)"
q("q08_1", "select type, count(*) as n from v_ben where type is not null group by 1 order by n desc, type limit 20")
q("q08_2", f"select size_label, avg(benefit_count) as avg_benefits from {_BEN_CNT} left join v_pc using (job_id) where size_label is not null group by 1", ["avg_benefits"])
q("q08_3", share("industry_name", "type",
                 f"from (select job_id, type from v_ben where type in {topk('v_ben', 'type', 10)}) join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(5)}) using (job_id) where true"), ["share"])
q("q08_4", f"""select case when benefit_count >= 10 then '10+' else cast(benefit_count as varchar) end as benefit_group,
 median(normalized_salary) as median_salary, count(*) as n from {_BEN_CNT} join v_post using (job_id) where normalized_salary is not null group by 1""", ["median_salary"])
q("q08_5", share("formatted_experience_level", "type",
                 f"from (select job_id, type from v_ben where type in {topk('v_ben', 'type', 8)}) left join v_post using (job_id) where formatted_experience_level in {EXP_IN}"), ["share"])

# --- Q09 -------------------------------------------------------------------------------------
_SKSAL = "(select v_js.job_id, skill_name, normalized_salary, formatted_experience_level from v_js join v_post using (job_id) where normalized_salary is not null)"
_BOX_DOUBLES = ["q1", "median", "q3", "min", "max", "whisker_low", "whisker_high"]


def box_sql(group: str, src: str) -> str:
    return f"""select b.*, w.whisker_low, w.whisker_high, w.n_outliers from (
 select {group}, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3,
  count(*) as n, min(v) as min, max(v) as max from {src} group by 1) b
 join (select d.{group}, min(case when v between lo and hi then v end) as whisker_low, max(case when v between lo and hi then v end) as whisker_high,
  count(case when not (v between lo and hi) then 1 end) as n_outliers
  from {src} d join (select {group}, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
   select {group}, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from {src} group by 1)) f using ({group})
  group by 1) w using ({group})"""


q("q09_2", box_sql("skill_name", f"(select skill_name, normalized_salary as v from {_SKSAL} where skill_name in {TOP_SKILL(10)})"), _BOX_DOUBLES)
q("q09_3", f"""select formatted_experience_level, skill_name, median(normalized_salary) as median_salary, count(*) as n from {_SKSAL}
 where formatted_experience_level in {EXP_IN} and skill_name in {TOP_SKILL(6)} group by 1, 2""", ["median_salary"])
q("q09_4", f"""select industry_name, skill_name, median(normalized_salary) as median_salary, count(*) as n
 from (select * from {_SKSAL} where skill_name in {TOP_SKILL(6)}) join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(5)}) using (job_id) group by 1, 2""", ["median_salary"])
q("q09_5", """select case when skill_count >= 8 then '8+' else cast(skill_count as varchar) end as skill_group,
 median(normalized_salary) as median_salary, count(*) as n
 from (select job_id, count(skill_name) as skill_count from v_js group by 1) join v_post using (job_id)
 where normalized_salary is not null and skill_count >= 1 group by 1""", ["median_salary"])

# --- Q10 -------------------------------------------------------------------------------------
_COMP = "(select *, applies / views as competition_score, trim(lower(title)) as title_clean from v_post where applies is not null and views is not null and views > 0)"
q("q10_1", f"""select title_clean, avg(competition_score) as avg_score, avg(applies) as avg_applies, count(job_id) as n from {_COMP}
 where title_clean is not null group by 1 having count(job_id) >= 20 order by avg_score desc, title_clean limit 15""", ["avg_score", "avg_applies"])
q("q10_2", f"""with d as (select industry_name, competition_score from {_COMP} c join v_ji using (job_id))
 select industry_name, median(competition_score) as median_score from d where industry_name in {topk('d', 'industry_name', 12)} group by 1""", ["median_score"])
q("q10_3", f"""select formatted_experience_level, median(competition_score) as median_score, avg(competition_score) as mean_score, count(competition_score) as n
 from {_COMP} where formatted_experience_level in {EXP_IN} group by 1""", ["median_score", "mean_score"])
q("q10_4", f"""select {_case('remote_allowed', rules.REMOTE_LABELS)} as work_type, median(competition_score) as median_score, avg(competition_score) as mean_score, count(competition_score) as n
 from {_COMP} group by 1""", ["median_score", "mean_score"])
q("q10_5", f"""select title_clean, avg(competition_score) as avg_score, median(normalized_salary) as median_salary, count(job_id) as n from {_COMP}
 where title_clean is not null group by 1 having count(job_id) >= 20 and median(normalized_salary) > 60000 order by avg_score, title_clean limit 15""", ["avg_score", "median_salary"])

# --- Q11 -------------------------------------------------------------------------------------
_SALP = "(select * from v_post where normalized_salary is not null)"
_LADDER = lambda k: (f"(select job_id, normalized_salary, formatted_experience_level, industry_name from {_SALP} "  # noqa: E731
                     f"join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(k)}) using (job_id) "
                     f"where formatted_experience_level in {EXP_IN})")
q("q11_1", box_sql("formatted_experience_level",
                   f"(select formatted_experience_level, normalized_salary as v from {_SALP} where formatted_experience_level in {EXP_IN})"), _BOX_DOUBLES)
q("q11_2", f"""select * from (select industry_name, formatted_experience_level, median(normalized_salary) as median_salary, count(*) as n,
 count(*) over (partition by industry_name) as levels from {_LADDER(6)} group by 1, 2) where levels >= 2""", ["median_salary"])
q("q11_3", f"""select size_label, formatted_experience_level, median(normalized_salary) as median_salary, count(*) as n from v_pc
 where normalized_salary is not null and size_label in {_in(rules.SIZE_ORDER[:7])} and formatted_experience_level in {EXP_IN} group by 1, 2""", ["median_salary"])
q("q11_4", f"""select *, (senior_salary - entry_salary) / entry_salary * 100 as growth_pct, senior_salary - entry_salary as growth_abs from (
 select industry_name, median(case when formatted_experience_level = 'Entry level' then normalized_salary end) as entry_salary,
 median(case when formatted_experience_level = 'Mid-Senior level' then normalized_salary end) as senior_salary
 from {_LADDER(6)} group by 1) where entry_salary is not null and senior_salary is not null and entry_salary > 0""",
  ["entry_salary", "senior_salary", "growth_pct", "growth_abs"])
q("q11_5", f"""select remote_allowed, formatted_experience_level, median(normalized_salary) as median_salary, count(*) as n from {_SALP}
 where formatted_experience_level in {EXP_IN} group by 1, 2""", ["median_salary"])

# --- Q12 -------------------------------------------------------------------------------------
q("q12_1", f"""select *, remote_median - office_median as premium, (remote_median - office_median) / office_median * 100 as premium_pct from (
 select industry_name, median(case when remote_allowed = 1 then normalized_salary end) as remote_median,
 median(case when remote_allowed = 0 then normalized_salary end) as office_median
 from {_SALP} join (select job_id, industry_name from v_ji where industry_name in {TOP_IND(10)}) using (job_id) group by 1)
 where remote_median is not null and office_median is not null""", ["remote_median", "office_median", "premium", "premium_pct"])
q("q12_2", f"""select *, remote_pct - office_pct as diff from (
 select skill_name, count(case when remote_allowed = 1 then 1 end) * 100.0 / (select count(*) from v_post where remote_allowed = 1) as remote_pct,
 count(case when remote_allowed = 0 then 1 end) * 100.0 / (select count(*) from v_post where remote_allowed = 0) as office_pct
 from (select job_id, skill_name from v_js where skill_name in {TOP_SKILL(15)}) join v_post using (job_id) group by 1)""",
  ["remote_pct", "office_pct", "diff"])
q("q12_3", """select size_label, avg(remote_allowed) * 100 as remote_pct, count(*) as n,
 median(case when remote_allowed = 0 then normalized_salary end) as office_sal, median(case when remote_allowed = 1 then normalized_salary end) as remote_sal
 from v_pc where size_label is not null group by 1""", ["remote_pct", "office_sal", "remote_sal"])
q("q12_4", f"""select *, regr_slope(median_salary, remote_pct) over () as trend_slope, regr_intercept(median_salary, remote_pct) over () as trend_intercept from (
 select state, avg(remote_allowed) * 100 as remote_pct, median(normalized_salary) as median_salary, count(job_id) as n
 from v_post where state in {TOP_STATE(20)} group by 1) where median_salary is not null""",
  ["remote_pct", "median_salary", "trend_slope", "trend_intercept"])
q("q12_5", f"""select formatted_experience_level, remote_allowed, median(normalized_salary) as median_salary, count(*) as n from {_SALP}
 where formatted_experience_level in {EXP_IN} group by 1, 2""", ["median_salary"])

# --- Q13 -------------------------------------------------------------------------------------
_GAP_CTES = {
    "v_gap": """select s.job_id, min_salary, max_salary, max_salary - min_salary as gap, (max_salary - min_salary) / min_salary * 100 as gap_pct,
 (min_salary + max_salary) / 2 as mid_sal, coalesce(p.formatted_experience_level, 'Unknown') as formatted_experience_level,
 nullif(regexp_extract(p.location, ',\\s*([A-Z]{2})\\s*$', 1), '') as state, pi.industry_name
 from fx_salaries s left join fx_postings p using (job_id)
 left join (select job_id, arg_min(industry_name, industry_id) as industry_name from fx_job_industries join fx_industries using (industry_id)
  where industry_name is not null group by 1) pi using (job_id)
 where s.pay_period = 'YEARLY' and s.currency = 'USD' and min_salary is not null and max_salary is not null
  and min_salary >= 10000 and max_salary <= 500000 and max_salary >= min_salary""",
}
_CTES.update(_GAP_CTES)
_ORDER.append("v_gap")


def hist_sql(measure: str, value: str, bins: int, clip: float) -> str:
    v = f"least({value}, {clip})"
    return f"""select bin, lo + bin * w as bin_low, lo + (bin + 1) * w as bin_high, count(*) as n, '{measure}' as measure,
 (select avg({value}) from v_gap) as mean, (select median({value}) from v_gap) as median from (
 select case when w > 0 then cast(least(floor(({v} - lo) / w), {bins - 1}) as integer) else 0 end as bin, lo, w from v_gap,
 (select min({v}) as lo, (max({v}) - min({v})) / {bins} as w from v_gap where {value} is not null) mm where {value} is not null)
 group by bin, lo, w"""


q("q13_1", hist_sql("gap", "gap", 50, 200000) + " union all " + hist_sql("gap_pct", "gap_pct", 50, 200), ["bin_low", "bin_high", "mean", "median"])
_TOP15G = topk("v_gap", "industry_name", 15)
q("q13_2", f"""select industry_name, median(gap) as median_gap, median(gap_pct) as median_gap_pct, median(mid_sal) as median_sal, count(job_id) as n
 from v_gap where industry_name in {_TOP15G} group by 1""", ["median_gap", "median_gap_pct", "median_sal"])
q("q13_3", f"""select formatted_experience_level, median(gap) as median_gap, median(gap_pct) as median_gap_pct, median(min_salary) as median_min,
 median(max_salary) as median_max, count(job_id) as n from v_gap where formatted_experience_level in {EXP_IN} group by 1""",
  ["median_gap", "median_gap_pct", "median_min", "median_max"])
q("q13_4", f"""select {band_sql('mid_sal', *rules.SALARY_BANDS_REPORT)} as salary_band, median(gap) as median_gap, median(gap_pct) as median_gap_pct, count(job_id) as n
 from v_gap group by 1 having salary_band is not null""", ["median_gap", "median_gap_pct"])
q("q13_5", f"""select industry_name, formatted_experience_level, median(gap_pct) as median_gap_pct, count(*) as n from v_gap
 where industry_name in {topk('v_gap', 'industry_name', 8)} and formatted_experience_level in {EXP_IN} group by 1, 2""", ["median_gap_pct"])
q("q13_6", f"""with ig as (select industry_name, median(gap) as median_gap from v_gap where industry_name in {_TOP15G} group by 1)
 select count(*) as n, median(gap) as median_gap, median(gap_pct) as median_gap_pct,
 (select industry_name from ig order by median_gap desc, industry_name limit 1) as widest_industry,
 (select median_gap from ig order by median_gap desc, industry_name limit 1) as widest_gap,
 (select industry_name from ig order by median_gap asc, industry_name limit 1) as narrowest_industry,
 (select median_gap from ig order by median_gap asc, industry_name limit 1) as narrowest_gap from v_gap""",
  ["median_gap", "median_gap_pct", "widest_gap", "narrowest_gap"])

# --- dashboard queries -----------------------------------------------------------------------
_FAMILY = "case " + " ".join(
    f"when regexp_matches(lower(coalesce(title, '')), '{pat}') then '{lab}'"
    for pat, lab in rules.TITLE_FAMILY_RULES) + f" else '{rules.TITLE_FAMILY_DEFAULT}' end"
_CTES["v_pind"] = """select job_id, arg_min(industry_name, industry_id) as industry_name from fx_job_industries join fx_industries using (industry_id)
 where industry_name is not null group by 1"""
_CTES["v_mkt"] = rf"""select p.job_id, company_id, title, location, normalized_salary, currency, pay_period, views, applies, description,
 coalesce(formatted_experience_level, 'Unknown') as formatted_experience_level,
 coalesce(formatted_work_type, 'Unknown') as formatted_work_type,
 case when remote_allowed = 1 then 1 else 0 end as remote_flag,
 coalesce(nullif(regexp_extract(location, ',\s*([A-Z]{{2}})(?:\s|$)', 1), ''), 'Unknown') as state,
 coalesce(nullif(trim(nullif(regexp_extract(location, '^([^,]+)', 1), '')), ''), 'Unknown') as city,
 {_FAMILY} as title_family,
 coalesce(normalized_salary between 10000 and 300000 and (currency in ('USD') or currency is null), false) as salary_usable,
 case when coalesce(views, 0) > 0 then coalesce(applies, 0) / views end as competition_score,
 coalesce(pi.industry_name, 'Unknown') as primary_industry
 from fx_postings p left join v_pind pi using (job_id)"""
_CTES["v_skn"] = """select j.job_id, coalesce(s.skill_name, j.skill_abr) as skill_name from fx_job_skills j
 left join (select skill_abr, min(skill_name) as skill_name from fx_skills where skill_abr is not null group by 1) s using (skill_abr)"""
_ORDER += ["v_pind", "v_mkt", "v_skn"]
_USABLE = "(select * from v_mkt where salary_usable)"

q("headline", """select count(*) as total_postings, count(case when salary_usable then 1 end) as salary_count,
 median(case when salary_usable then normalized_salary end) as median_salary, avg(remote_flag) * 100 as remote_pct from v_mkt""",
  ["median_salary", "remote_pct"])
_DQ = [("Total job postings", "total"), ("Usable salary rows", "usable"), ("Rows with description", "described"),
       ("Rows with applications", "applied"), ("Rows with views", "viewed"), ("Explicit remote postings", "remote"),
       ("Jobs with at least one benefit record", "benefit_jobs")]
q("data_quality", "with a as (select count(*) as total, count(case when salary_usable then 1 end) as usable, count(description) as described, "
  "count(applies) as applied, count(views) as viewed, count(case when remote_flag = 1 then 1 end) as remote, "
  "(select count(distinct job_id) from fx_benefits) as benefit_jobs from v_mkt)\n"
  + "\n union all ".join(f"select '{lab}' as metric, {c} as n, cast({c} as double) * 100.0 / greatest(total, 1) as coverage_pct from a"
                         for lab, c in _DQ), ["coverage_pct"])
q("skill_demand", "select skill_name, count(*) as posting_count from v_skn where skill_name is not null group by 1 order by posting_count desc, skill_name limit 20")
q("skill_salary_premium", f"""with sal as (select job_id, normalized_salary from v_mkt where salary_usable)
 select skill_name, median(normalized_salary) as median_salary, count(*) as n, median(normalized_salary) - (select median(normalized_salary) from sal) as premium_vs_overall
 from v_skn join sal using (job_id) where skill_name is not null group by 1 having count(*) >= 100 order by premium_vs_overall desc, skill_name limit 15""",
  ["median_salary", "premium_vs_overall"])
_BB = band_sql("benefit_count", *rules.BENEFIT_BUCKETS)
q("benefit_summary", f"""select benefit_bucket, median(normalized_salary) as median_salary, count(*) as n from (
 select u.normalized_salary, {_BB} as benefit_bucket from (select job_id, normalized_salary from v_mkt where salary_usable) u
 left join (select job_id, count(*) as c from fx_benefits group by 1) b using (job_id), lateral (select coalesce(b.c, 0) as benefit_count))
 where benefit_bucket is not null and normalized_salary is not null group by 1""", ["median_salary"])
q("industry_stats", f"""select primary_industry, count(job_id) as postings, median(normalized_salary) as median_salary, avg(remote_flag) * 100 as remote_rate,
 avg(competition_score) as mean_competition from {_USABLE} group by 1 having count(job_id) >= 50""", ["median_salary", "remote_rate", "mean_competition"])
q("state_stats", f"""select state, count(job_id) as postings, median(normalized_salary) as median_salary, avg(remote_flag) * 100 as remote_rate
 from {_USABLE} group by 1 having count(job_id) >= 50""", ["median_salary", "remote_rate"])
q("title_family_stats", f"""select title_family, count(job_id) as postings, median(normalized_salary) as median_salary, avg(views) as avg_views,
 avg(applies) as avg_applies, avg(competition_score) as competition from {_USABLE} group by 1 having count(job_id) >= 50""",
  ["median_salary", "avg_views", "avg_applies", "competition"])
_LVL = "case formatted_experience_level " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(rules.EXPERIENCE_LEVELS)) + " else 999 end"
q("career_ladder", f"""select formatted_experience_level, median(normalized_salary) as median_salary, count(normalized_salary) as n, {_LVL} as level_order
 from {_USABLE} where normalized_salary is not null group by 1""", ["median_salary"])
q("remote_summary", f"""select case when remote_flag = 1 then 'Remote' else 'Not explicitly remote' end as remote_label,
 median(normalized_salary) as median_salary, count(normalized_salary) as n from {_USABLE} where normalized_salary is not null group by 1""", ["median_salary"])
q("family_benchmark", f"""select title_family, count(job_id) as postings, median(normalized_salary) as median_salary, avg(views) as avg_views,
 avg(applies) as avg_applies, avg(competition_score) as avg_competition from {_USABLE} group by 1 having count(job_id) >= 20""",
  ["median_salary", "avg_views", "avg_applies", "avg_competition"])
q("states_by_remote", f"""select state, avg(remote_flag) * 100 as remote_rate from {_USABLE} group by 1 having count(job_id) >= 50
 order by remote_rate desc, state limit 15""", ["remote_rate"])

_SIM_RULES = [
    ("same experience + state + industry + title family + remote", ["formatted_experience_level", "state", "title_family", "remote_flag"], True),
    ("same experience + state + title family", ["formatted_experience_level", "state", "title_family"], False),
    ("same experience + industry + title family", ["formatted_experience_level", "title_family"], True),
    ("same experience + title family", ["formatted_experience_level", "title_family"], False),
    ("same experience + state", ["formatted_experience_level", "state"], False),
    ("same experience only", ["formatted_experience_level"], False),
    ("all salary postings", [], False),
]


def _similar_sql(min_n: int = 30) -> str:
    ctes = ["u as (select formatted_experience_level, state, title_family, remote_flag, normalized_salary, lower(primary_industry) as _ind from v_mkt where salary_usable)",
            "req as (select job_id as request_id, title_family, formatted_experience_level, state, lower(primary_industry) as industry, remote_flag from v_mkt)",
            "nm as (select a.industry, b._ind from (select distinct industry from req) a join (select distinct _ind from u) b on contains(b._ind, a.industry))"]
    joins = []
    for i, (_, keys, ind) in enumerate(_SIM_RULES, 1):
        k = keys + (["industry"] if ind else [])
        src = "u join nm using (_ind)" if ind else "u"
        agg_ = f"count(*) as n{i}, quantile_cont(normalized_salary, [0.25, 0.5, 0.75]) as q{i}"
        if k:
            ctes.append(f"g{i} as (select {', '.join(k)}, {agg_} from {src} group by {', '.join(k)})")
            joins.append(f"left join g{i} using ({', '.join(k)})")
        else:
            ctes.append(f"g{i} as (select {agg_} from {src})")
            joins.append(f"cross join g{i}")
    pick = "case " + " ".join(f"when coalesce(n{i}, 0) >= {min_n} then {i}" for i in range(1, 7)) + " else 7 end"
    n_sel = "case rule " + " ".join(f"when {i} then n{i}" for i in range(1, 8)) + " end"
    q_sel = "case rule " + " ".join(f"when {i} then q{i}" for i in range(1, 8)) + " end"
    lab = "case rule " + " ".join(f"when {i} then '{lab_}'" for i, (lab_, _, _) in enumerate(_SIM_RULES, 1)) + " end"
    return ("with " + ",\n".join(ctes) + f"\nselect request_id, rule, {lab} as rule_label, coalesce({n_sel}, 0) as n_similar, "
            f"({q_sel})[1] as p25, ({q_sel})[2] as p50, ({q_sel})[3] as p75 from (select *, {pick} as rule from req "
            + " ".join(joins) + ")")


q("similar_postings", _similar_sql(), ["p25", "p50", "p75"])
_HV = _in(rules.HIGH_VALUE_BENEFITS)
q("package_strength", f"""select *, case when n_benefits >= 6 or n_high_value >= 4 then 'Strong package' when n_benefits >= 3 or n_high_value >= 2 then 'Standard package'
 else 'Basic package' end as package from (select job_id, count(distinct type) as n_benefits, count(distinct case when type in {_HV} then type end) as n_high_value
 from fx_benefits where type is not null and job_id is not null group by 1)""")

# --- rank test -------------------------------------------------------------------------------
_MW = """with sal as (select job_id, normalized_salary as v from v_post where normalized_salary is not null),
common as (select skill_name as label from v_js where skill_name is not null group by 1 having count(*) >= 200),
pairs as (select distinct skill_name, job_id from v_js where skill_name in (select label from common)),
rk as (select job_id, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as avg_rank from sal),
tot as (select cast(sum(c) as bigint) as nt, sum(cast(c as double) * c * c - c) as ties from (select v, count(*) as c from sal group by v)),
w as (select p.skill_name, count(*) as n1, sum(r.avg_rank) as r1, median(r.v) as median_with from pairs p join rk r using (job_id) group by 1),
wo as (select c.label as skill_name, median(s.v) as median_without from common c cross join sal s
 where not exists (select 1 from pairs p where p.skill_name = c.label and p.job_id = s.job_id) group by 1),
m as (select skill_name, n1, nt - n1 as n2, median_with, median_without, median_with - median_without as premium,
 r1 - cast(n1 as double) * (n1 + 1) / 2 as u_stat, cast(n1 as double) as d1, cast(nt - n1 as double) as d2, cast(nt as double) as dn, ties
 from w join wo using (skill_name), tot)
select skill_name, n1, n2, median_with, median_without, premium, u_stat,
 (greatest(u_stat, d1 * d2 - u_stat) - d1 * d2 / 2 - 0.5) / sqrt(d1 * d2 / 12 * ((dn + 1) - ties / (dn * (dn - 1)))) as z from m"""
_MW_D = ["median_with", "median_without", "premium", "u_stat", "z"]
q("mann_whitney", _MW, _MW_D)
q("premium_test", f"select * from ({_MW}) where n1 >= 50 and n2 >= 50 and z > 1.959963984540054", _MW_D)

# --- text ------------------------------------------------------------------------------------
def _rx(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


_SOFT = "case " + " ".join(f"when {_rx('coalesce(description, ' + chr(39) * 2 + ')', p)} then '{lab}'"
                           for lab, p in rules.SOFT_SKILL_RULES) + " else 'none' end"
_CTES["v_sig"] = f"""select *, soft_skill_type <> 'none' as has_soft_skills from (select *,
 {_rx("coalesce(description, '')", rules.DEGREE_PATTERN)} as requires_degree,
 {_SOFT} as soft_skill_type,
 case when {_rx("coalesce(description, '')", rules.URGENCY_HIGH)} then 'high' when {_rx("coalesce(description, '')", rules.URGENCY_LOW)} then 'low' else 'medium' end as urgency,
 {_rx("coalesce(title, '')", rules.TECH_ROLE_PATTERN)} as tech_role
 from v_post where description is not null)"""
_ORDER.append("v_sig")

q("q03_1", "select case when requires_degree then 'Degree required' else 'No degree required' end as degree_label, count(*) as n from v_sig group by 1")
q("q03_2", "select soft_skill_type, count(*) as n from v_sig where has_soft_skills group by 1")
q("q03_3", "select urgency, count(*) as n from v_sig where urgency in ('high', 'medium', 'low') group by 1")
q("q03_4", """select case when tech_role then 'Tech role' else 'Non-tech role' end as role_type, median(normalized_salary) as median_salary,
 count(normalized_salary) as n from v_sig where normalized_salary is not null group by 1""", ["median_salary"])
q("q03_5", "select formatted_experience_level, avg(cast(requires_degree as integer)) * 100 as degree_pct from v_sig group by 1", ["degree_pct"])

_T = "lower(coalesce(title, ''))"
_WC = lambda c: f"case when trim(coalesce({c}, '')) = '' then 0 else cast(len(string_split_regex(trim(coalesce({c}, '')), '\\s+')) as integer) end"
q("title_flags", "select job_id, " + ", ".join(f"cast({_rx(_T, p)} as integer) as {n}" for n, p in rules.TITLE_FLAGS)
  + f", cast(length(coalesce(title, '')) as integer) as title_len, {_WC('title')} as title_word_count from fx_postings")
q("title_family_model", "select job_id, case " + " ".join(f"when {_rx(_T, p)} then '{lab}'" for p, lab in rules.TITLE_FAMILY_RULES_MODEL)
  + f" else '{rules.TITLE_FAMILY_DEFAULT}' end as title_family from fx_postings")
_IMP = "coalesce(formatted_experience_level, case " + " ".join(
    "when " + " or ".join(f"contains({_T}, '{w}')" for w in words) + f" then '{lab}'"
    for lab, words in rules.EXPERIENCE_IMPUTE_RULES) + f" else '{rules.EXPERIENCE_IMPUTE_DEFAULT}' end)"
q("impute_experience", f"select job_id, {_IMP} as formatted_experience_level from fx_postings")
q("experience_imputed_counts", f"select formatted_experience_level, count(*) as n from (select {_IMP} as formatted_experience_level from fx_postings) group by 1")
q("title_clean_rows", """select * from (select job_id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as title_clean
 from fx_postings) where length(title_clean) > 2""")


def _squash(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def _scrub_sql(variant: str) -> str:
    t = _squash("coalesce(text, '')")
    if variant == "light":
        for p in (rules.LIGHT_DOLLAR, rules.LIGHT_AMOUNT_WORD, rules.LIGHT_WORDS):
            t = f"regexp_replace({t}, '{p}', ' ', 'g')"
        return _squash(t)
    parts = f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    t = f"array_to_string(list_filter({parts}, lambda s: not regexp_matches(s, '{rules.SALARY_SENTENCE_KEYWORDS}')), ' ')"
    for p in (rules.DOLLAR_AMOUNT, rules.HOURLY_RATE, rules.CURRENCY_WORDS):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return _squash(t)


for _name, _v in (("scrub_salary", "sentences"), ("scrub_salary_light", "light")):
    q(_name, f"""select doc_id, clean_text, chars_before, cast(length(clean_text) as integer) as chars_after from (
 select doc_id, {_scrub_sql(_v)} as clean_text, cast(length(coalesce(text, '')) as integer) as chars_before from documents)""")
q("document_stats", f"""select doc_id, lang, cast(length(coalesce(text, '')) as integer) as n_chars, {_WC('text')} as n_words,
 regexp_matches(text, '\\$\\s?\\d') as has_dollar from documents""")

# --- features, profiles, samples ----------------------------------------------------------
_FOLD = "cast(('0x' || substr(md5('42:' || cast(job_id as varchar)), 1, 8)) as ubigint) % 5"
_CTES["v_use"] = f"select *, ln(1 + normalized_salary) as y_log, cast({_FOLD} as integer) as fold from v_mkt where salary_usable"
_ORDER.append("v_use")
_TE = ["state", "title_family", "formatted_experience_level", "primary_industry"]
q("kfold_assign", "select job_id, fold from v_use")


def _te_sql() -> str:
    g = "(select median(y_log) from v_use)"
    cols = []
    for c in _TE:
        cols.append(f"""coalesce((select case when n >= 8 then n / (n + 40.0) * m + (1 - n / (n + 40.0)) * {g} else {g} end
  from (select coalesce(cast({c} as varchar), 'Unknown') as v, median(y_log) as m, count(*) as n from v_use group by 1) s
  where s.v = coalesce(cast(p.{c} as varchar), 'Unknown')), {g}) as te_{c}""")
    return "select p.job_id, " + ",\n ".join(cols) + " from v_mkt p"


q("target_encoding", _te_sql(), [f"te_{c}" for c in _TE])


def _te_oof_sql() -> str:
    parts = []
    for c in _TE:
        v = f"coalesce(cast({c} as varchar), 'Unknown')"
        parts.append(f"""coalesce((select case when s.n >= 8 then s.n / (s.n + 40.0) * s.m + (1 - s.n / (s.n + 40.0)) * g.g else g.g end
  from (select f.f, {v} as v, median(y_log) as m, count(*) as n from v_use u, range(5) f(f) where u.fold <> f.f group by 1, 2) s
  join gl g on g.f = s.f where s.f = r.fold and s.v = {v.replace(c, 'r.' + c)}), (select g from gl where gl.f = r.fold)) as te_{c}""")
    return ("with gl as (select f.f, median(y_log) as g from v_use u, range(5) f(f) where u.fold <> f.f group by 1)\n"
            "select r.job_id, " + ",\n ".join(parts) + " from v_use r")


q("target_encoding_oof", _te_oof_sql(), [f"te_{c}" for c in _TE])


def _ranks_sql(view: str, label: str, k: int) -> str:
    return (f"(select row_number() over (order by n desc, {label}) as rank, {label} from (select {label}, count(*) as n "
            f"from {view} where {label} is not null group by 1 order by n desc, {label} limit {k}))")


q("skill_vocabulary", f"select rank, skill_name from {_ranks_sql('v_js', 'skill_name', 50)}")


def _multi_hot_sql(view: str, label: str, k: int, prefix: str) -> str:
    cols = ", ".join(f"cast(coalesce(max(case when h.rank = {i} then 1 end), 0) as integer) as {prefix}{i:02d}" for i in range(1, k + 1))
    return (f"select p.job_id, {cols} from fx_postings p left join (select distinct b.job_id, r.rank from {view} b "
            f"join {_ranks_sql(view, label, k)} r using ({label})) h using (job_id) group by p.job_id")


q("multi_hot_skills", _multi_hot_sql("v_js", "skill_name", 50, "skill_top"))
q("multi_hot_benefits", _multi_hot_sql("v_ben", "type", 10, "benefit_top"))
q("latest_employee_count", """select company_id, employee_count, follower_count from (select *, row_number() over (partition by company_id
 order by employee_count is not null desc, employee_count desc, follower_count desc) as rn from fx_employee_counts where company_id is not null) where rn = 1""")
q("company_job_count", """select job_id, case when company_id is null then 0 else coalesce(c, 0) end as company_job_count
 from fx_postings left join (select company_id, count(*) as c from fx_postings where company_id is not null group by 1) using (company_id)""")
_PCOLS = ["job_id", "company_id", "title", "description", "location", "remote_allowed", "formatted_experience_level",
          "formatted_work_type", "normalized_salary", "pay_period", "currency", "views", "applies", "listed_time", "skills_desc"]
q("profile_missing", "select * from (" + " union all ".join(
    f"select '{c}' as column_name, avg(case when {c} is null then 1 else 0 end) * 100 as missing_pct from (select *, epoch_ms(o_orderdate) as listed_time, cast(null as varchar) as skills_desc from fx_postings join orders on o_orderkey = job_id)"
    for c in _PCOLS) + ") where missing_pct > 0", ["missing_pct"])
q("clean_summary", """select count(*) as postings, cast(sum(remote_allowed) as bigint) as remote, count(normalized_salary) as with_salary,
 count(name) as company_matched, count(state) as with_state from v_pc""")
q("sample_postings", "select job_id from fx_postings order by md5('42:' || cast(job_id as varchar)) limit 500")
q("stratified_postings", """with d as (select job_id, coalesce(formatted_experience_level, 'Unknown') as formatted_experience_level from fx_postings where description is not null),
 s as (select formatted_experience_level, count(*) as sz from d group by 1),
 qq as (select formatted_experience_level, least(sz, greatest(1, round_even(sz / (select count(*) from d) * 500, 0))) as quota from s),
 r as (select d.*, row_number() over (partition by formatted_experience_level order by md5('42:' || cast(job_id as varchar))) as rn from d)
 select job_id, formatted_experience_level from r join qq using (formatted_experience_level) where rn <= quota
 order by md5('43:' || cast(job_id as varchar)) limit 500""")

# --- evaluation over the out-of-fold baseline -------------------------------------------------
_CTES["v_base0"] = f"""select r.job_id, r.fold, r.normalized_salary as actual_salary, greatest(exp(coalesce(s.m, g.g)) - 1, 0) as pred_salary,
 r.formatted_experience_level, r.primary_industry, r.state, r.title_family, coalesce(r.pay_period, 'Unknown') as pay_period, r.title,
 case when r.remote_flag = 1 then 'Remote' else 'Non-remote / unknown' end as remote_label,
 {band_sql('r.normalized_salary', *rules.SALARY_BANDS_MODEL, include_lowest=True)} as salary_band
 from v_use r
 left join (select f.f, coalesce(cast(formatted_experience_level as varchar), 'Unknown') as v, median(y_log) as m
  from v_use u, range(5) f(f) where u.fold <> f.f group by 1, 2) s on s.f = r.fold and s.v = coalesce(r.formatted_experience_level, 'Unknown')
 join (select f.f, median(y_log) as g from v_use u, range(5) f(f) where u.fold <> f.f group by 1) g on g.f = r.fold"""
# 20 % calibration and 20 % test rows, exactly so in each of eight salary bins
_CTES["v_base"] = """with e as (select list_sort(list_distinct(quantile_cont(actual_salary, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) as edges from v_base0),
 b as (select v_base0.*, greatest(0, len(list_filter(edges, lambda x: x < actual_salary)) - 1) as bin from v_base0, e),
 r as (select *, row_number() over (partition by bin order by md5('7:' || cast(job_id as varchar)), job_id) - 1 as pos,
  floor(0.2 * count(*) over (partition by bin) + 0.5) as quota from b)
 select * exclude (bin, pos, quota), case when pos < quota then 'cal' when pos < 2 * quota then 'test' else 'fit' end as part from r"""
_ORDER += ["v_base0", "v_base"]
q("split_calibration", "select job_id, part from v_base")

_MET = ("count(*) as n, sqrt(avg((pred_salary - actual_salary) * (pred_salary - actual_salary))) as rmse, "
        "avg(abs(pred_salary - actual_salary)) as mae, 1 - sum((pred_salary - actual_salary) * (pred_salary - actual_salary)) / "
        "(sum(actual_salary * actual_salary) - sum(actual_salary) * sum(actual_salary) / count(*)) as r2")
_MAPE = ", avg(case when actual_salary > 0 then abs(pred_salary - actual_salary) / actual_salary end) * 100 as mape"
q("baseline_metrics", f"select {_MET}{_MAPE} from v_base", ["rmse", "mae", "r2", "mape"])
q("baseline_fold_metrics", f"select fold, {_MET}{_MAPE} from v_base group by fold", ["rmse", "mae", "r2", "mape"])
_SEG = {"experience": "formatted_experience_level", "industry": "primary_industry", "state": "state",
        "remote": "remote_label", "salary_band": "salary_band", "title_family": "title_family", "pay_period": "pay_period"}
_SEG_MIN = {"experience": 80, "industry": 80, "state": 80, "title_family": 80, "remote": 40, "salary_band": 40, "pay_period": 40}
_SEG_SQL = f"""select * exclude (rn) from (select *, row_number() over (partition by segment order by rmse desc, value) as rn from (
 select segment, value, {_MET}, avg(pred_salary - actual_salary) as bias, median(actual_salary) as median_actual, median(pred_salary) as median_pred
 from (""" + " union all ".join(
    f"select '{k}' as segment, cast({c} as varchar) as value, actual_salary, pred_salary from v_base" for k, c in _SEG.items()) + """)
 where value is not null group by 1, 2) where n >= case segment """ + " ".join(f"when '{k}' then {v}" for k, v in _SEG_MIN.items()) + """ else 0 end) where rn <= 20"""
q("baseline_segment_metrics", f"select * replace (case when n >= 3 then r2 end as r2) from ({_SEG_SQL})",
  ["rmse", "mae", "r2", "bias", "median_actual", "median_pred"])
q("baseline_intervals", """with tr as (select quantile_cont(actual_salary - pred_salary, [0.05, 0.95]) as q from v_base where part = 'fit'),
 cal as (select * from v_base where part = 'cal'),
 te as (select * from v_base where part = 'test'),
 cq as (select least(1.0, greatest(0.0, ceil((count(*) + 1) * cast(0.9 as double)) / count(*))) as lvl, count(*) as n,
        list_sort(list(abs(actual_salary - pred_salary))) as r from cal),
 qh as (select r[cast(ceil(lvl * (n - 1)) as bigint) + 1] as q_hat from cq),
 iv as (select 'residual_quantile' as method, actual_salary, greatest(pred_salary + q[1], 0.0) as lower, greatest(pred_salary + q[2], 0.0) as upper from te, tr
  union all select 'conformal' as method, actual_salary, greatest(pred_salary - q_hat, 0.0) as lower, greatest(pred_salary + q_hat, 0.0) as upper from te, qh)
 select method, avg(cast(actual_salary >= lower and actual_salary <= upper as integer)) * 100 as coverage_pct, avg(upper - lower) as avg_width,
  median(upper - lower) as median_width,
  avg(upper - lower + case when actual_salary < lower then 20.0 * (lower - actual_salary) else 0.0 end
      + case when actual_salary > upper then 20.0 * (actual_salary - upper) else 0.0 end) as winkler_score, count(*) as n
 from iv group by method""", ["coverage_pct", "avg_width", "median_width", "winkler_score"])
q("baseline_calibration", """with e as (select list_sort(list_distinct(quantile_cont(pred_salary, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as edges from v_base where pred_salary is not null)
 select greatest(0, cast(len(list_filter(edges, lambda x: x < pred_salary)) as integer) - 1) as pred_decile, avg(pred_salary) as avg_pred,
  avg(actual_salary) as avg_actual, count(*) as n from v_base, e where pred_salary is not null group by 1""", ["avg_pred", "avg_actual"])
q("baseline_title_errors", """select title, count(*) as n, avg(abs(pred_salary - actual_salary)) as mae, avg(pred_salary - actual_salary) as bias
 from v_base where title is not null group by 1 having count(*) >= 3 order by mae desc, title limit 15""", ["mae", "bias"])
q("baseline_bias_extremes", f"""select * exclude (hi, lo), case when hi <= 8 then 'top' else 'bottom' end as side from (
 select *, row_number() over (order by bias desc, value) as hi, row_number() over (order by bias asc, value) as lo
 from ({_SEG_SQL}) where segment = 'industry') where hi <= 8 or lo <= 8""".replace("select * exclude (hi, lo)", "select * exclude (hi, lo) replace (case when n >= 3 then r2 end as r2)"),
  ["rmse", "mae", "r2", "bias", "median_actual", "median_pred"])
q("baseline_prediction_bands", """with m as (select avg(abs(pred_salary - actual_salary)) as mae, sqrt(avg((pred_salary - actual_salary) * (pred_salary - actual_salary))) as rmse from v_base)
 select job_id, pred_salary, greatest(pred_salary * 0.85, 0.0) as practical_low, pred_salary * 1.15 as practical_high,
  greatest(pred_salary - mae, 0.0) as mae_low, pred_salary + mae as mae_high, greatest(pred_salary - rmse, 0.0) as rmse_low, pred_salary + rmse as rmse_high,
  greatest(pred_salary - 2 * rmse, 0.0) as rmse2_low, pred_salary + 2 * rmse as rmse2_high from v_base, m""",
  ["pred_salary", "practical_low", "practical_high", "mae_low", "mae_high", "rmse_low", "rmse_high", "rmse2_low", "rmse2_high"])
q("streamed_clean_postings", "select * exclude (description) from v_post")

# --- estimator request batch ----------------------------------------------------------------
_CTES["v_req"] = f"""select m.job_id, m.title, m.formatted_experience_level, m.state, m.city, m.remote_flag, m.company_id,
 coalesce(sk.skills, []::varchar[]) as skills, coalesce(bn.benefits, []::varchar[]) as benefits, c.company_size
 from v_mkt m
 left join (select job_id, list_sort(list(distinct skill_name)) as skills from v_skn where skill_name is not null group by 1) sk using (job_id)
 left join (select job_id, list_sort(list(distinct type)) as benefits from fx_benefits where type is not null group by 1) bn using (job_id)
 left join (select company_id, {_case('company_size', rules.SIZE_LABELS)} as company_size from fx_companies) c using (company_id)"""
_ORDER.append("v_req")
_MISS_SK = " + ".join(f"case when list_contains(skills, '{s}') then 0 else 1 end" for s in rules.SCENARIO_SKILLS)
_MISS_BN = " + ".join(f"case when list_contains(benefits, '{b}') then 0 else 1 end" for b in rules.SCENARIO_BENEFITS)
_NEXT = "coalesce(case formatted_experience_level " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.NEXT_LEVEL.items()) + " end, formatted_experience_level)"
_NONE = "cast([] as varchar[]) as added_skills, cast([] as varchar[]) as added_benefits"
_SKL = "['" + "', '".join(rules.SCENARIO_SKILLS) + "']"
_BNL = "['" + "', '".join(rules.SCENARIO_BENEFITS) + "']"
q("scenarios", f"""select job_id as request_id, 'current' as scenario, formatted_experience_level, cast(len(skills) as integer) as n_skills, cast(len(benefits) as integer) as n_benefits, remote_flag, {_NONE} from v_req
 union all select job_id, 'one_level_up', {_NEXT}, cast(len(skills) as integer), cast(len(benefits) as integer), remote_flag, {_NONE} from v_req
 union all select job_id, 'stronger_profile', formatted_experience_level, cast(len(skills) + least(greatest(8 - len(skills), 0), {_MISS_SK}) as integer),
  cast(least(len(benefits) + ({_MISS_BN}), 8) as integer), remote_flag,
  list_filter({_SKL}, lambda x: not list_contains(skills, x))[1:greatest(8 - len(skills), 0)],
  list_filter({_BNL}, lambda x: not list_contains(benefits, x))[1:greatest(8 - len(benefits), 0)] from v_req
 union all select job_id, 'remote', formatted_experience_level, cast(len(skills) as integer), cast(len(benefits) as integer), 1, {_NONE} from v_req""")
_TL = "lower(coalesce(title, ''))"
_POS = [f"case when formatted_experience_level in ('Mid-Senior level', 'Director', 'Executive') then 'seniority_level' end",
        f"case when regexp_matches({_TL}, '{rules.SENIOR_TITLE}') then 'seniority_title' end",
        f"case when regexp_matches({_TL}, '{rules.TECH_TITLE}') then 'technical_family' end",
        f"case when state in {_in(rules.HIGH_PAY_STATES)} then 'high_pay_state' end",
        "case when remote_flag = 1 then 'remote' end",
        "case when len(skills) >= 3 then 'skill_profile' end",
        f"case when company_size in {_in(rules.LARGE_SIZES)} then 'large_company' end",
        "case when len(benefits) >= 5 then 'benefit_package' end"]
_CAU = ["case when formatted_experience_level in ('Entry level', 'Associate') then 'junior_level' end",
        f"case when not (state in {_in(['Unknown'] + rules.HIGH_PAY_STATES)}) then 'location_varies' end",
        "case when len(skills) = 0 then 'no_skills' end",
        "case when len(benefits) <= 1 then 'few_benefits' end",
        "case when city = 'Unknown' then 'unknown_city' end"]
q("explain_rules", f"""select job_id as request_id, list_filter([{', '.join(_POS)}], lambda x: x is not null)[1:5] as positives,
 list_filter([{', '.join(_CAU)}], lambda x: x is not null)[1:5] as cautions from v_req""")
q("reliability", f"""with sim as ({_similar_sql()}),
 d as (select b.job_id as request_id, b.pred_salary, s.n_similar, s.p25, s.p50, s.p75, m.city, m.formatted_experience_level
  from v_base b join sim s on s.request_id = b.job_id join v_mkt m on m.job_id = b.job_id),
 sc as (select *, case when n_similar >= 150 then 2 when n_similar >= 50 then 1 else 0 end
  + case when p75 - p25 <= 35000 then 2 when p75 - p25 <= 60000 then 1 else 0 end
  + case when abs(pred_salary - p50) <= greatest(10000.0, p50 * 0.12) then 1 else 0 end
  + case when city <> 'Unknown' then 1 else 0 end
  + case when not (formatted_experience_level in ('Entry level', 'Associate')) then 1 else 0 end as score from d)
 select request_id, n_similar, pred_salary, p50, score, case when score >= 6 then 'High' when score >= 4 then 'Medium' else 'Low' end as reliability from sc""",
  ["pred_salary", "p50"])

# --- location rules, bounds, records, diagnostics --------------------------------------------
_LOC = "trim(location)"
_CITY = (f"case when location is null or {_LOC} = '' then 'Unknown' when contains(lower({_LOC}), 'remote') then 'Remote' "
         + " ".join(f"when contains(lower({_LOC}), '{k}') then '{v}'" for k, v in rules.CITY_METRO_MAP)
         + f" when contains({_LOC}, ',') then trim(split_part({_LOC}, ',', 1)) else {_LOC} end")
_STATE_M = "case " + " ".join(f"when contains(lower(location), '{k}') then '{v}'" for k, v in rules.STATE_METRO_MAP) + " end"
_CTES["v_loc"] = f"""select p.job_id, {_CITY} as city_loc,
 coalesce(nullif(regexp_extract(location, ',\\s*([A-Z]{{2}})(?:\\s|$)', 1), ''), {_STATE_M}, cast(c.state as varchar), 'Unknown') as state_final
 from fx_postings p left join fx_companies c on c.company_id = p.company_id"""
_ORDER.append("v_loc")
q("location_features", "select * from v_loc")
q("interactions", """select m.job_id, concat_ws('__', l.city_loc, m.primary_industry) as city_industry,
 concat_ws('__', l.state_final, m.primary_industry) as state_industry, concat_ws('__', e.formatted_experience_level, m.primary_industry) as exp_industry,
 concat_ws('__', cast(m.remote_flag as varchar), m.primary_industry) as remote_industry,
 concat_ws('__', coalesce(m.pay_period, 'Unknown'), m.formatted_work_type) as pay_work_type from v_mkt m join v_loc l using (job_id)
 join (select job_id, """ + _IMP + """ as formatted_experience_level from fx_postings) e using (job_id)""")
q("salary_bounds", """with b as (select quantile_cont(normalized_salary, 0.01) as q01, quantile_cont(normalized_salary, 0.99) as q99 from fx_postings where normalized_salary is not null)
 select q01, q99, greatest(10000.0, q01) as lower_bound, least(300000.0, q99) as upper_bound,
 (select count(*) from fx_postings where normalized_salary between greatest(10000.0, q01) and least(300000.0, q99) and (currency in ('USD') or currency is null)) as rows_kept from b""",
  ["q01", "q99", "lower_bound", "upper_bound"])
q("salary_records", """select job_id, min_salary, max_salary, med_salary from fx_salaries where currency = 'USD' and pay_period = 'YEARLY'
 and (med_salary is not null or max_salary is not null) and job_id in (select job_id from fx_postings)""", ["min_salary", "max_salary", "med_salary"])


def _te_global_sql() -> str:
    g = "(select median(normalized_salary) from v_use)"
    cols = [f"""ln(1 + coalesce((select m from (select coalesce(cast({c} as varchar), 'Unknown') as v, median(normalized_salary) as m from v_use group by 1) s
  where s.v = coalesce(cast(p.{c} as varchar), 'Unknown')), {g})) as te_{c}""" for c in _TE]
    return "select p.job_id, " + ",\n ".join(cols) + " from v_mkt p"


q("target_encoding_global", _te_global_sql(), [f"te_{c}" for c in _TE])
q("value_counts_keep_null", "select formatted_experience_level, count(*) as n from fx_postings group by 1")
q("baseline_worst_predictions", """select * exclude (hi, lo), case when hi <= 25 then 'top' else 'bottom' end as side from (
 select job_id, actual_salary, pred_salary, pred_salary - actual_salary as residual,
 row_number() over (order by pred_salary - actual_salary desc, job_id) as hi, row_number() over (order by pred_salary - actual_salary asc, job_id) as lo
 from v_base) where hi <= 25 or lo <= 25""", ["actual_salary", "pred_salary", "residual"])
q("baseline_best_interval", SQL["baseline_intervals"].replace("select * replace", "select * replace", 1) + " order by coverage_pct desc, avg_width asc limit 1",
  [])
_EB = band_sql("actual_salary", *rules.ERROR_BANDS)
q("baseline_error_by_band", f"""select band, median(abs(pred_salary - actual_salary)) as median_abs,
 median(case when actual_salary > 0 then abs(pred_salary - actual_salary) / actual_salary * 100 end) as median_pct,
 avg(pred_salary - actual_salary) as mean_residual, count(*) as n from (select *, {_EB} as band from v_base) where band is not null group by 1""",
  ["median_abs", "median_pct", "mean_residual"])
q("baseline_residual_normality", """with d as (select ln(1 + pred_salary) - ln(1 + actual_salary) as r from v_base),
 m as (select avg(r) as mu, count(r) as n from d),
 c as (select avg(power(r - mu, 2)) as m2, avg(power(r - mu, 3)) as m3, avg(power(r - mu, 4)) as m4 from d, m)
 select mu as mean, sqrt(m2) as std, n, m3 / power(m2, 1.5) as skew, m4 / (m2 * m2) - 3 as kurt,
 n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) as jb from m, c""",
  ["mean", "std", "skew", "kurt", "jb"])
q("baseline_residual_trend", """with s as (select job_id, ln(1 + pred_salary) as log_pred, ln(1 + actual_salary) - ln(1 + pred_salary) as residual
  from v_base order by md5('42:' || cast(job_id as varchar)) limit 5000),
 w as (select greatest(cast(floor(count(*) / 20) as bigint), 50) as w from s),
 r as (select *, row_number() over (order by log_pred, job_id) as rn from s)
 select a.job_id, (exp(a.log_pred) - 1) / 1000 as pred_k, a.residual,
  case when count(*) = max(w.w) then avg(b.residual) end as trend
 from r a cross join w join r b on b.rn between a.rn - w.w // 2 and a.rn + (w.w - 1 - w.w // 2)
 group by a.job_id, a.log_pred, a.residual""", ["pred_k", "residual", "trend"])


# --- the salary model's feature table, its fitted stages, text settings -----------------------
_FAM = "case " + " ".join(f"when {_rx(_T, p)} then '{lab}'" for p, lab in rules.TITLE_FAMILY_RULES_MODEL) + f" else '{rules.TITLE_FAMILY_DEFAULT}' end"
_CTES["v_mcol"] = f"""select p.job_id, cast(p.views as double) as views, cast(p.applies as double) as applies,
 coalesce(formatted_work_type, 'Unknown') as formatted_work_type, coalesce(pay_period, 'Unknown') as pay_period,
 cast(coalesce(remote_allowed, 0) as integer) as remote_flag, {_IMP} as formatted_experience_level, {_FAM} as title_family,
 cast(coalesce(pay_period, '') = 'HOURLY' as integer) as is_hourly, cast(applies is not null as integer) as has_applies,
 cast(views is not null as integer) as has_views, cast(e.employee_count as double) as employee_count, cast(e.follower_count as double) as follower_count,
 coalesce(s.n, 0) as n_specialities, coalesce(i.n, 0) as company_industry_count,
 coalesce(cast(cast(c.company_size as integer) as varchar), 'Unknown') as company_size,
 cast(e.employee_count is not null as integer) as has_employee_count, cast(e.follower_count is not null as integer) as has_follower_count,
 cast(coalesce(e.follower_count, 0) as double) / (coalesce(e.employee_count, 0) + 1) as follower_per_employee
 from fx_postings p left join fx_companies c using (company_id)
 left join (select company_id, employee_count, follower_count from (select *, row_number() over (partition by company_id
  order by employee_count is not null desc, employee_count desc, follower_count desc) as rn from fx_employee_counts where company_id is not null) where rn = 1) e using (company_id)
 left join (select company_id, count(distinct speciality) as n from fx_company_specialities group by 1) s using (company_id)
 left join (select company_id, count(*) as n from fx_company_industries group by 1) i using (company_id)"""
_ORDER.append("v_mcol")
q("salary_features", "select * from v_mcol", ["views", "applies", "employee_count", "follower_count", "follower_per_employee"])
_CATS = ["formatted_experience_level", "formatted_work_type", "pay_period", "company_size", "title_family"]
q("ordinal_codes", "select job_id, " + ", ".join(
    f"coalesce((select cast(r as integer) from (select {c} as v, dense_rank() over (order by {c}) - 1 as r from "
    f"(select distinct {c} from v_mcol where {c} is not null and job_id in (select job_id from v_use))) x where x.v = m.{c}), -1) as {c}_code"
    for c in _CATS) + " from v_mcol m")
_LOGS, _NUMS = ["views", "applies", "employee_count", "follower_count"], ["follower_per_employee", "n_specialities"]
_FILL = ", ".join((f"ln(1 + greatest(coalesce({c}, med_{c}), 0)) as {c}" if c in _LOGS else f"cast(coalesce({c}, med_{c}) as double) as {c}") for c in _LOGS + _NUMS)
q("standardized_numbers", f"""with md as (select {', '.join(f'coalesce(median(cast({c} as double)), 0) as med_{c}' for c in _LOGS + _NUMS)} from v_mcol where job_id in (select job_id from v_use)),
 f as (select job_id, {_FILL} from v_mcol, md),
 sc as (select {', '.join(f'avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}' for c in _LOGS + _NUMS)} from f where job_id in (select job_id from v_use))
 select job_id, {', '.join(f'({c} - m_{c}) / s_{c} as {c}' for c in _LOGS + _NUMS)} from f, sc""", _LOGS + _NUMS)
q("multi_hot_specialities", "select p.company_id, " + ", ".join(
    f"cast(coalesce(max(case when h.rank = {i} then 1 end), 0) as integer) as spec_top{i:02d}" for i in range(1, 21))
  + f" from fx_companies p left join (select distinct b.company_id, r.rank from fx_company_specialities b join {_ranks_sql('fx_company_specialities', 'speciality', 20)} r using (speciality)) h using (company_id) group by p.company_id")
q("indicator_columns", "select column_name, label, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') as slug from ("
  + " union all ".join(f"select '{p}' || lpad(cast(rank as varchar), 2, '0') as column_name, {lab} as label from {_ranks_sql(v, lab, k)}"
                       for v, lab, k, p in (("v_js", "skill_name", 50, "skill_top"), ("v_ben", "type", 10, "benefit_top"),
                                            ("fx_company_specialities", "speciality", 20, "spec_top"))) + ")")


def _terms_ctes(name: str, source: str, max_features: int, min_df: int, max_df: float = 1.0, strip_accents: bool = False,
                stopwords: bool = False, **_) -> str:
    from ..operators.mlstages import ACCENTED, PLAIN, WORD
    t = f"translate(lower(x), '{ACCENTED}', '{PLAIN}')" if strip_accents else "lower(x)"
    w = f"regexp_extract_all({t}, '{WORD}')"
    if stopwords:
        w = f"list_filter({w}, lambda z: z not in {_in(rules.STOP_WORDS)})"
    return f"""{name}_w as (select job_id, {w} as w from ({source})),
 {name}_t as (select job_id, term, count(*) as tf from (select job_id, unnest(w) as term from {name}_w
  union all select job_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from {name}_w) group by 1, 2),
 {name} as (select term, count(*) as doc_freq, cast(sum(tf) as bigint) as total, ln((1.0 + (select count(*) from {name}_w)) / (count(*) + 1)) + 1 as idf
  from {name}_t group by 1 having count(*) >= {min_df} and count(*) <= {max_df} * (select count(*) from {name}_w) order by total desc, term limit {max_features})"""


def _term_tables() -> None:
    from .salary_features import TERM_SETTINGS
    title = "select job_id, coalesce(title, '') as x from fx_postings"
    desc = "select job_id, " + _scrub_sql("sentences").replace("coalesce(text, '')", "coalesce(description, '')") + " as x from fx_postings"
    parts = {n: _terms_ctes(f"t{i}", title if what == "title" else desc, **s) for i, (n, (what, s)) in enumerate(TERM_SETTINGS.items())}
    q("term_table", "with " + ",\n".join(parts.values()) + "\n" + " union all ".join(
        f"select '{n}' as setting, term, doc_freq, total, idf from t{i}" for i, n in enumerate(parts)), ["idf"])
    q("title_term_weights", f"""with {parts['model_titles']}, r as (select job_id, term, (1 + ln(tf)) * idf as w from t1_t join t1 using (term))
 select job_id, term, w / sqrt(sum(w * w) over (partition by job_id)) as w from r""", ["w"])


_term_tables()

# --- prompts and the way back from replies, small dashboard helpers -----------------------------
def _prompts() -> None:
    from ..operators.prompts import INSTRUCTION, SEPARATOR
    head = INSTRUCTION.replace("'", "''")
    _CTES["v_batch"] = """select *, (row_number() over (order by job_id) - 1) // 25 as batch_id from fx_postings where description is not null"""
    _ORDER.append("v_batch")
    q("prompt_batches", f"""select batch_id, n_items, keys, md5(prompt) as prompt_md5, cast(length(prompt) as integer) as prompt_chars from (
 select batch_id, cast(count(*) as integer) as n_items, list(job_id order by job_id) as keys,
 replace('{head}', '{{n}}', cast(count(*) as varchar)) || string_agg('JOB_ID:' || job_id || chr(10) || 'TITLE:' || coalesce(title, '') || chr(10) || 'DESC:' || substr(description, 1, 800), '{SEPARATOR}' order by job_id) as prompt
 from v_batch group by 1)""")
    q("reply_join_back", """select s.job_id, s.title, requires_degree, has_soft_skills, soft_skill_type, urgency, tech_role
 from v_sig s join v_batch b using (job_id) where batch_id % 7 <> 6""")


_prompts()
q("profile_shape", " union all ".join(f"select '{n}' as table_name, count(*) as n_rows, {len(SCHEMAS[n].names)} as n_columns from fx_{n}"
                                      for n in SCHEMAS))
q("company_state_location", """select p.job_id, coalesce(nullif(regexp_extract(location, ',\\s*([A-Z]{2})$', 1), ''), cast(c.state as varchar), 'Unknown') as state_final
 from fx_postings p left join fx_companies c on c.company_id = p.company_id""")
q("yearly_salaries", "select job_id, normalized_salary, y_log from v_use where upper(coalesce(pay_period, '')) = 'YEARLY'", ["normalized_salary", "y_log"])
q("filter_options", " union all ".join(
    f"select '{c}' as \"column\", {c} as value, cast(row_number() over (order by {c}) - 1 as integer) as ord from (select distinct {c} from v_mkt where {c} is not null)"
    for c in ["formatted_experience_level", "formatted_work_type", "primary_industry", "state", "title_family"]))
q("top_state_salaries", f"""select state, median(normalized_salary) as median_salary from {_USABLE} where state is not null group by 1
 having count(job_id) >= 50 order by median_salary desc, state limit 15""", ["median_salary"])
q("family_benchmark_filtered", f"""select title_family, count(job_id) as postings, median(normalized_salary) as median_salary, avg(views) as avg_views,
 avg(applies) as avg_applies, avg(competition_score) as avg_competition from {_USABLE} where formatted_experience_level = 'Mid-Senior level'
 and primary_industry = 'NATION_1' and remote_flag = 1 group by 1 having count(job_id) >= 1""", ["median_salary", "avg_views", "avg_applies", "avg_competition"])
q("role_contexts", f"""select job_id as request_id, coalesce(nullif(concat_ws(' ',
 case when len(skills) > 0 then 'Responsible for ' || array_to_string(list_transform(skills[1:4], lambda x: lower(x)), ', ') || '.' end,
 case when len(benefits) > 0 then 'Primary focus: ' || array_to_string(list_transform(benefits[1:3], lambda x: lower(x)), ', ') || '.' end), ''), '{rules.ROLE_DEFAULT}') as role_context from v_req""")
q("request_signatures", """select job_id as request_id, substr(md5(cast(to_json(struct_pack(city := city, company_size := company_size,
 formatted_experience_level := formatted_experience_level, remote_flag := remote_flag, state := state, title := title)) as varchar)), 1, 10) as signature from v_req""")

q("baseline_residual_histogram", """with e as (select ln(1 + pred_salary) - ln(1 + actual_salary) as r from v_base),
 m as (select min(r) as lo, (max(r) - min(r)) / 80 as w, avg(r) as mean, median(r) as median, stddev_pop(r) as std, count(r) as total from e),
 h as (select case when w > 0 then cast(least(floor((r - lo) / w), 79) as integer) else 0 end as bin, count(*) as n from e, m group by 1)
 select bin, lo + bin * w as bin_low, lo + (bin + 1) * w as bin_high, n, mean, median, n / nullif(total * w, 0) as density,
 exp(-pow((lo + (bin + 0.5) * w - mean) / nullif(std, 0), 2) / 2) / (nullif(std, 0) * sqrt(2 * pi())) as normal_density from h, m""",
  ["bin_low", "bin_high", "mean", "median", "density", "normal_density"])

# --- fixed label order -------------------------------------------------------------------------
for _name, (_col, _labels) in rules.REPORT_ORDER.items():
    SQL[_name] = (f"select r.*, case {_col} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(_labels))
                  + f" else 999 end as ord from ({SQL[_name]}) r")
