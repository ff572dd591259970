"""Dashboard query functions as batch DataFrame jobs (the UI itself is not rebuilt).

``market_view`` is the one cleaned posting view the dashboard reads; the other functions are
aggregations over it. Request-time functions (similar postings, package strength) run for a
whole batch of requests at once: here every posting acts as a request, so the work grows with
the table and needs only equi-joins on aggregated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, rules, text
from ..operators import agg
from ..operators.joins import attach_lookup, keep_labels, left_join_known
from ..operators.quantiles import Quantile, agg_by, median
from ..session import write_back
from ..sources.schemas import SCHEMAS
from ..sources.tables import JobTables, with_defaults
from . import views

SAL = "normalized_salary"
EXPL = "formatted_experience_level"


#: what the dashboard reads of a posting column that the source lacks (all twelve of them)
POSTING_DEFAULTS = {
    "title": "", "location": "Unknown", "remote_allowed": None, SAL: None, "currency": "USD",
    EXPL: "Unknown", "formatted_work_type": "Unknown", "pay_period": "Unknown", "views": None,
    "applies": None, "description": "", "company_id": None,
}


def market_view(t: JobTables) -> DataFrame:
    """Cleaned postings: remote flag, state (token rule, 'Unknown'), city, title family,
    primary industry, salary-usable flag ($10k-$300k, USD or missing) and competition."""
    p = with_defaults(t.postings, POSTING_DEFAULTS, SCHEMAS["postings"])
    lo, hi = rules.SALARY_RANGE_DASHBOARD
    p = p.select(
        "job_id", "company_id", "title", "location", SAL, "currency", "pay_period", "views",
        "applies", "description",
        clean.fill_unknown(EXPL).alias(EXPL),
        clean.fill_unknown("formatted_work_type").alias("formatted_work_type"),
        F.when(F.col("remote_allowed") == 1, 1).otherwise(0).alias("remote_flag"),
        clean.extract_state_token("location").alias("state"),
        clean.extract_city("location", default="Unknown").alias("city"),
        clean.title_family("title").alias("title_family"),
        F.coalesce(clean.salary_usable(SAL, "currency", lo, hi), F.lit(False)).alias("salary_usable"),
        clean.competition_score("applies", "views", null_applies="zero").alias("competition_score"),
    )
    pi = views.primary_industry(t).withColumnRenamed("industry_name", "primary_industry")
    return (p.join(pi, "job_id", "left")
            .withColumn("primary_industry", clean.fill_unknown("primary_industry")))


def _usable(t: JobTables) -> DataFrame:
    return market_view(t).where("salary_usable")


def headline(t: JobTables) -> DataFrame:
    """Totals, usable salary rows, their median and the remote share (one pass)."""
    m = market_view(t)
    return agg_by(m, [], {"total_postings": F.count(F.lit(1)),
                          "salary_count": F.count(F.when(F.col("salary_usable"), 1)),
                          "median_salary": median(F.when(F.col("salary_usable"), F.col(SAL))),
                          "remote_pct": F.avg("remote_flag") * 100})


def data_quality(t: JobTables) -> DataFrame:
    """Metric, count and coverage % of the posting view, plus jobs with a benefit row."""
    m = market_view(t)
    a = m.agg(F.count(F.lit(1)).alias("total"),
              F.count(F.when(F.col("salary_usable"), 1)).alias("usable"),
              F.count("description").alias("described"), F.count("applies").alias("applied"),
              F.count("views").alias("viewed"),
              F.count(F.when(F.col("remote_flag") == 1, 1)).alias("remote"))
    jobs_with_benefit = t.benefits.select(F.count_distinct("job_id")).scalar()
    a = a.withColumn("benefit_jobs", jobs_with_benefit)
    rows = [("Total job postings", "total"), ("Usable salary rows", "usable"),
            ("Rows with description", "described"), ("Rows with applications", "applied"),
            ("Rows with views", "viewed"), ("Explicit remote postings", "remote"),
            ("Jobs with at least one benefit record", "benefit_jobs")]
    stack = ", ".join(f"'{lab}', {c}" for lab, c in rows)
    return a.selectExpr(f"stack({len(rows)}, {stack}) as (metric, n)", "total").select(
        "metric", "n", (F.col("n") * 100.0 / F.greatest(F.col("total"), F.lit(1))).alias("coverage_pct"))


def skills_named(t: JobTables) -> DataFrame:
    """Job-skill rows with a name; unknown codes fall back to the code itself."""
    return attach_lookup(t.job_skills, t.skills, "skill_abr", "skill_name", fallback_to_key=True)


def skill_demand(t: JobTables, k: int = 20) -> DataFrame:
    return agg.top_k_counts(skills_named(t), "skill_name", k, name="posting_count")


def skill_salary_premium(t: JobTables, k: int = 15, min_count: int = 100) -> DataFrame:
    """Skill median salary minus the median over all usable postings."""
    sal = _usable(t).select("job_id", SAL)
    d = skills_named(t).select("job_id", "skill_name").join(sal, "job_id")
    return agg.premium_vs_overall(d, "skill_name", SAL, sal, min_count=min_count, k=k)


def benefit_summary(t: JobTables) -> DataFrame:
    """Median usable salary and postings per benefit-count bucket (0 included)."""
    cnt = agg.count_per_key(t.benefits, "job_id", "benefit_count")
    d = (_usable(t).select("job_id", SAL).join(cnt, "job_id", "left")
         .withColumn("benefit_count", F.coalesce("benefit_count", F.lit(0)))
         .withColumn("benefit_bucket", clean.band("benefit_count", *rules.BENEFIT_BUCKETS)))
    return agg.median_by(d, "benefit_bucket", SAL, count="n")


def industry_stats(t: JobTables, min_count: int = 50) -> DataFrame:
    return agg.multi_agg_by(
        _usable(t), "primary_industry",
        {"postings": F.count("job_id"), "median_salary": median(SAL),
         "remote_rate": F.avg("remote_flag") * 100, "mean_competition": F.avg("competition_score")},
        having=F.col("postings") >= min_count)


def state_stats(t: JobTables, min_count: int = 50) -> DataFrame:
    return agg.multi_agg_by(
        _usable(t), "state",
        {"postings": F.count("job_id"), "median_salary": median(SAL),
         "remote_rate": F.avg("remote_flag") * 100},
        having=F.col("postings") >= min_count)


def title_family_stats(t: JobTables, min_count: int = 50) -> DataFrame:
    return agg.multi_agg_by(
        _usable(t), "title_family",
        {"postings": F.count("job_id"), "median_salary": median(SAL), "avg_views": F.avg("views"),
         "avg_applies": F.avg("applies"), "competition": F.avg("competition_score")},
        having=F.col("postings") >= min_count)


def career_ladder(t: JobTables) -> DataFrame:
    """Median and count per level, with the level's place in the ladder (unknown: 999)."""
    g = agg.median_by(_usable(t), EXPL, SAL, count="n")
    order = clean.label_map(EXPL, {v: i for i, v in enumerate(rules.EXPERIENCE_LEVELS)}, 999)
    return g.withColumn("level_order", order.cast("int"))


def remote_summary(t: JobTables) -> DataFrame:
    d = _usable(t).withColumn(
        "remote_label", F.when(F.col("remote_flag") == 1, "Remote").otherwise("Not explicitly remote"))
    return agg.median_by(d, "remote_label", SAL, count="n")


def family_benchmark(t: JobTables, exp: str = "All", industry: str = "All", remote: str = "All",
                     min_count: int = 20) -> DataFrame:
    """Role-family salary and competition benchmark under the interactive filters
    ('All' = no filter)."""
    m = _usable(t)
    if exp != "All":
        m = m.where(F.col(EXPL) == exp)
    if industry != "All":
        m = m.where(F.col("primary_industry") == industry)
    if remote != "All":
        m = m.where(F.col("remote_flag") == (1 if remote == "Remote" else 0))
    return agg.multi_agg_by(
        m, "title_family",
        {"postings": F.count("job_id"), "median_salary": median(SAL),
         "avg_views": F.avg("views"), "avg_applies": F.avg("applies"),
         "avg_competition": F.avg("competition_score")},
        having=F.col("postings") >= min_count)


def states_by_remote(t: JobTables, k: int = 15, min_count: int = 50) -> DataFrame:
    s = state_stats(t, min_count)
    return s.select("state", "remote_rate").orderBy(F.col("remote_rate").desc(), "state").limit(k)


# --- request batch functions ------------------------------------------------------------------
def requests_from_postings(t: JobTables) -> DataFrame:
    """Every posting as a salary request: its family, level, state, industry, remote flag."""
    m = market_view(t)
    return m.select(F.col("job_id").alias("request_id"), "title_family", EXPL, "state",
                    F.lower(F.col("primary_industry")).alias("industry"), "remote_flag")


SIMILAR_RULES = [
    ("same experience + state + industry + title family + remote",
     [EXPL, "state", "title_family", "remote_flag"], True),
    ("same experience + state + title family", [EXPL, "state", "title_family"], False),
    ("same experience + industry + title family", [EXPL, "title_family"], True),
    ("same experience + title family", [EXPL, "title_family"], False),
    ("same experience + state", [EXPL, "state"], False),
    ("same experience only", [EXPL], False),
    ("all salary postings", [], False),
]


def similar_postings(t: JobTables, requests: DataFrame | None = None, min_n: int = 30) -> DataFrame:
    """For each request: the first of seven filter rules that leaves at least ``min_n`` usable
    postings, its size and the salary quartiles of that set.

    The usable postings are counted once per (all rule keys, industry, salary); each rule's sizes
    and rank-based quartiles are rolled up from these counts and joined to the requests on the
    rule's keys. The industry rules match when the request industry is a case-insensitive
    substring of the posting's industry: every substring of the known industry names (a
    dimension table) is listed, so the match is an equi-join whatever the requests ask for.
    """
    req = requests if requests is not None else requests_from_postings(t)
    u = _usable(t).groupBy(EXPL, "state", "title_family", "remote_flag", SAL,
                           F.lower(F.col("primary_industry")).alias("_ind")).agg(F.count(F.lit(1)).alias("_k"))
    u = write_back(u, "similar-counts")  # read by every rule
    n = F.char_length("_ind")
    known = u.select("_ind").where(F.col("_ind").isNotNull()).distinct()
    parts = known.select("_ind", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), n), lambda i: F.when(i == n, F.array(F.lit(""))).otherwise(F.transform(
            F.sequence(F.lit(1), n - i), lambda k: F.substring(F.col("_ind"), i + 1, k))))))).alias("industry"))
    asked = req.select(F.col("industry").alias("industry")).distinct()
    name_map = parts.join(asked, "industry")
    # every rule's groups at once: (rule, its keys, null where the rule has no such key)
    used = [EXPL, "state", "title_family", "remote_flag"]

    def rows(src, rules, industry):
        keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), *[
            (F.col(k) if k in keys else F.lit(None)).cast("string").alias(f"_k{n}") for n, k in enumerate(used)])
            for i, keys in rules]))
        return src.select(keyed.alias("_x"), industry.alias("_ki"), SAL, "_k").select("_x.*", "_ki", SAL, "_k")

    numbered = [(i, keys, ind) for i, (_, keys, ind) in enumerate(SIMILAR_RULES, start=1)]
    known_keys = u.where(" and ".join(f"`{k}` is not null" for k in used))  # a null key matches no request
    src = rows(known_keys.join(name_map, "_ind"), [(i, k) for i, k, ind in numbered if ind], F.col("industry")).unionByName(
        rows(u, [(i, k) for i, k, ind in numbered if not ind], F.lit(None).cast("string")))
    src = src.groupBy("rule", *[f"_k{n}" for n in range(len(used))], "_ki", SAL).agg(F.sum("_k").alias("_k"))
    src = write_back(src, "similar-groups")
    groups = ["rule", *[f"_k{n}" for n in range(len(used))], "_ki"]
    v = F.col(SAL)
    g = agg_by(src, groups, {"n": F.sum("_k"), "p25": Quantile(v, 0.25), "p50": Quantile(v, 0.5), "p75": Quantile(v, 0.75)},
               weight="_k")
    g = write_back(g, "similar-rules")
    out = req
    for i, keys, by_industry in numbered:
        mine = g.where(F.col("rule") == i)
        q = F.array("p25", "p50", "p75")
        if not keys:  # the whole usable set: one row
            out = out.withColumns({f"n{i}": mine.select("n").scalar(), f"q{i}": mine.select(q).scalar()})
            continue
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k).cast("string") == F.col(f"_r{used.index(k)}"))
        if by_industry:
            on = on & (F.col("industry") == F.col("_ri"))
        mine = mine.select(*[F.col(f"_k{used.index(k)}").alias(f"_r{used.index(k)}") for k in keys], F.col("_ki").alias("_ri"),
                           F.col("n").alias(f"n{i}"), q.alias(f"q{i}"))
        out = out.join(mine, on, "left").drop(*[f"_r{used.index(k)}" for k in keys], "_ri")
    pick = F.lit(len(SIMILAR_RULES))
    for i in range(len(SIMILAR_RULES) - 1, 0, -1):
        pick = F.when(F.coalesce(F.col(f"n{i}"), F.lit(0)) >= min_n, F.lit(i)).otherwise(pick)
    out = out.withColumn("rule", pick)
    sel_n = F.coalesce(*[F.when(F.col("rule") == i, F.col(f"n{i}"))
                         for i in range(1, len(SIMILAR_RULES) + 1)])
    sel_q = F.coalesce(*[F.when(F.col("rule") == i, F.col(f"q{i}"))
                         for i in range(1, len(SIMILAR_RULES) + 1)])
    labels = clean.label_map("rule", {i: lab for i, (lab, _, _) in enumerate(SIMILAR_RULES, 1)})
    return out.select("request_id", "rule", labels.alias("rule_label"),
                      F.coalesce(sel_n, F.lit(0)).alias("n_similar"),
                      sel_q[0].alias("p25"), sel_q[1].alias("p50"), sel_q[2].alias("p75"))


def package_strength(t: JobTables) -> DataFrame:
    """Per job with benefits: distinct benefit types, how many are high-value, and the package
    class (Strong: >= 6 or >= 4 high-value; Standard: >= 3 or >= 2 high-value; else Basic)."""
    b = t.benefits.where(F.col("type").isNotNull())
    hv = F.col("type").isin(rules.HIGH_VALUE_BENEFITS)
    g = b.groupBy("job_id").agg(F.count_distinct("type").alias("n_benefits"),
                                F.count_distinct(F.when(hv, F.col("type"))).alias("n_high_value"))
    n, h = F.col("n_benefits"), F.col("n_high_value")
    return g.withColumn("package", F.when((n >= 6) | (h >= 4), "Strong package")
                        .when((n >= 3) | (h >= 2), "Standard package").otherwise("Basic package"))


def request_profile(t: JobTables) -> DataFrame:
    """Every posting as an estimator request: level, title, state, city, remote flag, company
    size, its named skills and benefit types (per-job sets, bounded by the vocabularies)."""
    m = market_view(t).select("job_id", "title", EXPL, "state", "city", "remote_flag", "company_id")
    sk = (skills_named(t).where(F.col("skill_name").isNotNull()).groupBy("job_id")
          .agg(F.array_sort(F.collect_set("skill_name")).alias("skills")))
    bn = (t.benefits.where(F.col("type").isNotNull()).groupBy("job_id")
          .agg(F.array_sort(F.collect_set("type")).alias("benefits")))
    size = t.companies.select("company_id", clean.size_label("company_size").alias("company_size"))
    empty = F.array().cast("array<string>")
    m = left_join_known(m, size, "company_id")
    return (m.join(sk, "job_id", "left").join(bn, "job_id", "left")
            .withColumns({"skills": F.coalesce("skills", empty), "benefits": F.coalesce("benefits", empty)}))


SCENARIOS = ["current", "one_level_up", "stronger_profile", "remote"]


def scenarios(t: JobTables) -> DataFrame:
    """Four variants per request: as is, one level up, stronger profile (three common skills
    while fewer than 8, three core benefits, at most 8) and remote, with the names that the stronger
    profile adds."""
    r = request_profile(t)
    nxt = clean.label_map(EXPL, rules.NEXT_LEVEL)
    n_sk, n_bn = F.size("skills"), F.size("benefits")
    cap, none = rules.SCENARIO_CAP, F.array().cast("array<string>")
    more_sk = F.slice(F.array_except(F.array(*[F.lit(x) for x in rules.SCENARIO_SKILLS]), "skills"), F.lit(1),
                      F.greatest(F.lit(cap) - n_sk, F.lit(0)))
    # the list with the core benefits is cut at the cap
    more_bn = F.slice(F.array_except(F.array(*[F.lit(x) for x in rules.SCENARIO_BENEFITS]), "benefits"), F.lit(1),
                      F.greatest(F.lit(cap) - n_bn, F.lit(0)))
    strong_bn = F.least(n_bn + F.size(F.array_except(F.array(*[F.lit(x) for x in rules.SCENARIO_BENEFITS]), "benefits")), F.lit(cap))

    def v(name, level, nsk, nbn, remote, sk=none, bn=none):
        return F.struct(F.lit(name).alias("scenario"), level.alias(EXPL), nsk.cast("int").alias("n_skills"),
                        nbn.cast("int").alias("n_benefits"), remote.cast("int").alias("remote_flag"),
                        sk.alias("added_skills"), bn.alias("added_benefits"))
    variants = F.array(
        v("current", F.col(EXPL), n_sk, n_bn, F.col("remote_flag")),
        v("one_level_up", F.coalesce(nxt, F.col(EXPL)), n_sk, n_bn, F.col("remote_flag")),
        v("stronger_profile", F.col(EXPL), n_sk + F.size(more_sk), strong_bn, F.col("remote_flag"), more_sk, more_bn),
        v("remote", F.col(EXPL), n_sk, n_bn, F.lit(1)))
    return r.select(F.col("job_id").alias("request_id"), F.explode(variants).alias("_v")).select(
        "request_id", "_v.*")


def explain_rules(t: JobTables) -> DataFrame:
    """Rule codes that raise or temper each request's estimate (first five of each)."""
    r = request_profile(t)
    title = F.lower(F.coalesce("title", F.lit("")))
    lvl, st = F.col(EXPL), F.col("state")
    n_sk, n_bn = F.size("skills"), F.size("benefits")

    def when(cond, code):
        return F.when(cond, F.lit(code))
    pos = F.array(
        when(lvl.isin("Mid-Senior level", "Director", "Executive"), "seniority_level"),
        when(title.rlike(rules.SENIOR_TITLE), "seniority_title"),
        when(title.rlike(rules.TECH_TITLE), "technical_family"),
        when(st.isin(rules.HIGH_PAY_STATES), "high_pay_state"),
        when(F.col("remote_flag") == 1, "remote"),
        when(n_sk >= 3, "skill_profile"),
        when(F.col("company_size").isin(rules.LARGE_SIZES), "large_company"),
        when(n_bn >= 5, "benefit_package"))
    cau = F.array(
        when(lvl.isin("Entry level", "Associate"), "junior_level"),
        when(~st.isin(["Unknown"] + rules.HIGH_PAY_STATES), "location_varies"),
        when(n_sk == 0, "no_skills"),
        when(n_bn <= 1, "few_benefits"),
        when(F.col("city") == "Unknown", "unknown_city"))
    keep = lambda a: F.slice(F.filter(a, lambda x: x.isNotNull()), 1, 5)
    return r.select(F.col("job_id").alias("request_id"), keep(pos).alias("positives"),
                    keep(cau).alias("cautions"))


def reliability(t: JobTables, estimates: DataFrame | None = None) -> DataFrame:
    """Reliability of each estimate (job_id, pred_salary; the baseline's out-of-fold estimates of
    the usable postings if none are given) from its similar-posting set:
    set size (>=150: 2, >=50: 1), quartile width (<=35k: 2, <=60k: 1), estimate near the
    set median (<= max(10k, 12 %): 1), known city (1), level above Associate (1);
    >= 6 High, >= 4 Medium, else Low."""
    if estimates is None:
        from .evaluation import baseline_oof
        estimates = baseline_oof(t)
    pred = estimates.select(F.col("job_id").alias("request_id"), "pred_salary")
    sim = similar_postings(t)
    req = market_view(t).select(F.col("job_id").alias("request_id"), "city", EXPL)
    d = pred.join(sim, "request_id").join(req, "request_id")
    n, width = F.col("n_similar"), F.col("p75") - F.col("p25")
    near = F.abs(F.col("pred_salary") - F.col("p50")) <= F.greatest(F.lit(10_000.0), F.col("p50") * 0.12)
    score = (F.when(n >= 150, 2).when(n >= 50, 1).otherwise(0)
             + F.when(width <= 35_000, 2).when(width <= 60_000, 1).otherwise(0)
             + F.when(near, 1).otherwise(0)
             + F.when(F.col("city") != "Unknown", 1).otherwise(0)
             + F.when(~F.col(EXPL).isin("Entry level", "Associate"), 1).otherwise(0))
    return d.select("request_id", "n_similar", "pred_salary", "p50", score.alias("score"),
                    F.when(score >= 6, "High").when(score >= 4, "Medium").otherwise("Low").alias("reliability"))


def family_benchmark_filtered(t: JobTables) -> DataFrame:
    """The benchmark under all three interactive filters."""
    return family_benchmark(t, exp="Mid-Senior level", industry="NATION_1", remote="Remote", min_count=1)


def role_contexts(t: JobTables) -> DataFrame:
    """The description an estimate request gets: assembled from its first skills and benefits."""
    r = request_profile(t)
    return r.select(F.col("job_id").alias("request_id"),
                    text.role_context(F.lit(None).cast("string"), "skills", "benefits").alias("role_context"))


def request_signatures(t: JobTables) -> DataFrame:
    """Ten characters that identify each request's fields."""
    r = request_profile(t)
    return r.select(F.col("job_id").alias("request_id"),
                    text.signature("title", EXPL, "state", "city", "remote_flag", "company_size").alias("signature"))
