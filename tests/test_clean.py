"""Edge cases of the cleaning rules (expected values from the behaviour being rebuilt)."""

from pyspark.sql import functions as F

from hiresight.functions import clean, rules, text


def one_col(spark, values, expr, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_salary_bounds(spark):
    vals = [9999.99, 10000.0, 1_000_000.0, 1_000_000.01, None, float("nan")]
    got = one_col(spark, vals, lambda c: clean.null_outside(c, 10_000, 1_000_000))
    assert got == [None, 10000.0, 1_000_000.0, None, None, None]


def test_band_edges(spark):
    got = one_col(spark, [0.0, 40_000.0, 40_000.01, 200_000.0, 200_001.0],
                  lambda c: clean.band(c, *rules.SALARY_BANDS_REPORT))
    assert got == [None, "<$40K", "$40K-70K", "$140K-200K", "$200K+"]


def test_band_include_lowest(spark):
    got = one_col(spark, [0.0, 300_000.0, 300_001.0],
                  lambda c: clean.band(c, *rules.SALARY_BANDS_MODEL, include_lowest=True))
    assert got == ["<$50k", "$200k+", None]


def test_benefit_buckets(spark):
    got = one_col(spark, [0, 1, 2, 3, 4, 5, 8, 9], lambda c: clean.band(c, *rules.BENEFIT_BUCKETS), "int")
    assert got == ["0", "1-2", "1-2", "3-4", "3-4", "5-8", "5-8", "9+"]


def test_state_rules(spark):
    locs = ["Austin, TX", "Austin, TX 78701", "Austin, Texas", "San Francisco Bay Area", None]
    assert one_col(spark, locs, clean.extract_state, "string") == ["TX", None, None, None, None]
    assert one_col(spark, locs, clean.extract_state_token, "string") == [
        "TX", "TX", "Unknown", "Unknown", "Unknown"]


def test_city(spark):
    locs = [None, "", "Reno, NV", "Ohio", "  Austin , TX"]
    assert one_col(spark, locs, lambda c: clean.extract_city(c, default="Unknown"), "string") == [
        "Unknown", "Unknown", "Reno", "Ohio", "Austin"]


def test_title_clean_and_slug(spark):
    assert one_col(spark, ["Sr. C++ Dev (II)", "42", None], clean.title_clean, "string") == [
        "sr c dev ii", "", ""]
    assert one_col(spark, ["401(k)", "--", "Paid  time off"], clean.slug, "string") == [
        "401_k", "unknown", "paid_time_off"]


def test_impute_experience(spark):
    titles = ["Director of Ops", "Project Coordinator", "VP Sales", "Senior Dev", "Intern", None, "Nurse"]
    df = spark.createDataFrame([(None, t) for t in titles], "lvl string, title string")
    compat = [r[0] for r in df.select(text.impute_experience("lvl", "title", compat=True)).collect()]
    assert compat == ["Executive", "Executive", "Director", "Mid-Senior level", "Entry level",
                      "Mid-Senior level", "Mid-Senior level"]
    strict = [r[0] for r in df.select(text.impute_experience("lvl", "title", compat=False)).collect()]
    assert strict[:2] == ["Director", "Mid-Senior level"]


def test_scrub_salary(spark):
    s = "Great team. Salary range is $90k to $120k. Pay $55/hr here! Apply."
    got = one_col(spark, [s], lambda c: text.scrub_salary(c), "string")[0]
    assert "Salary" not in got and "$" not in got
    assert got.startswith("Great team.") and got.endswith("Apply.")


def test_competition_policies(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, 0.0), (1.0, None)], "a double, v double")
    drop = [r[0] for r in df.select(clean.competition_score("a", "v")).collect()]
    zero = [r[0] for r in df.select(clean.competition_score("a", "v", "zero")).collect()]
    assert drop == [0.5, None, None, None]
    assert zero == [0.5, 0.0, None, None]


def test_title_family(spark):
    got = one_col(spark, ["Senior Data Engineer", "Registered Nurse", "HR Recruiter", None],
                  clean.title_family, "string")
    assert got == ["data_ai", "healthcare", "hr_recruiting", "other"]


def test_signals_search_a_pattern_only_where_its_words_stand(spark):
    """Equal to the plain patterns on texts near every rule, and the patterns are guarded."""
    import re
    texts = [None, "", "BACHELOR of arts", "a PhD", "a ph.D.", "xbachelor", "needs BS.", "bs", "ABS", "M.S. wanted", "xM.S.",
             "Communicates", "LEADING the Team", "mislead team", "lead a  team", "lead the team", "Team Player", "problem-Solving",
             "Problem solving", "problem_solving", "organiSational skills", "organizational skills", "A.S.A.P", "ASAP", "no RUSH",
             "flexible and urgent", "team\u212aplayer", "no ru\u017fh", "\u212a teamwor\u212a", "fle\u0130xible"]
    rows = spark.createDataFrame([(i, "SQL clerk" if i % 2 else None, x) for i, x in enumerate(texts)], "i int, title string, d string")
    got = {r["i"]: r for r in text.rule_signals(rows, "title", "d").collect()}
    assert set(got[0].asDict()) == {"i", "title", "d", "requires_degree", "soft_skill_type", "has_soft_skills", "urgency", "tech_role"}

    def has(p, x):
        return re.search(p, x, re.ASCII) is not None if "(?i" not in p else re.search(p.encode(), x.encode()) is not None

    for i, x in enumerate(t or "" for t in texts):
        soft = next((lab for lab, p in rules.SOFT_SKILL_RULES if has(p, x)), "none")
        urgency = "high" if has(rules.URGENCY_HIGH, x) else "low" if has(rules.URGENCY_LOW, x) else "medium"
        assert (got[i]["requires_degree"], got[i]["soft_skill_type"], got[i]["has_soft_skills"], got[i]["urgency"],
                got[i]["tech_role"]) == (has(rules.DEGREE_PATTERN, x), soft, soft != "none", urgency, i % 2 == 1), x
    plan = text.rule_signals(rows, "title", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "Contains(" in plan
