"""Text operators as built-in column expressions (regex, split, higher-order array functions):
no Python UDF, so they run inside whole-stage codegen on every executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .clean import col


def lower_text(c) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def regex_flags(df: DataFrame, c: str, flag_rules=rules.TITLE_FLAGS) -> DataFrame:
    """One 0/1 column per (name, pattern) rule, searched in lower(c)."""
    t = lower_text(c)
    return df.withColumns({name: t.rlike(p).cast("int") for name, p in flag_rules})


def rule_label(c, rule_table, default: str) -> Column:
    from .clean import rule_label as _rl
    return _rl(c, rule_table, default)


def impute_experience(level, title, compat: bool = True) -> Column:
    """Keep the level; else the first title rule that matches; else 'Mid-Senior level'.
    ``compat`` keeps plain substring tests; otherwise the words need word boundaries."""
    t = lower_text(title)
    e = None
    for lab, words in rules.EXPERIENCE_IMPUTE_RULES:
        if compat:
            cond = None
            for w in words:
                cond = t.contains(w) if cond is None else cond | t.contains(w)
        else:
            alts = "|".join(w.replace(".", r"\.") for w in words)
            cond = t.rlike(rf"(^|[^a-z0-9_])({alts})([^a-z0-9_]|$)")
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return F.coalesce(col(level), e.otherwise(F.lit(rules.EXPERIENCE_IMPUTE_DEFAULT)))


def text_length(c) -> Column:
    return F.length(F.coalesce(col(c), F.lit("")))


def word_count(c) -> Column:
    """Whitespace-separated tokens; empty or missing text has 0."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def squash_spaces(c) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def scrub_salary(c, variant: str = "sentences") -> Column:
    """Remove pay information from a description.

    ``sentences``: collapse whitespace, split into sentences after . ! ?, drop sentences with a
    pay keyword, then remove dollar amounts/ranges, hourly rates and currency words.
    ``light``: remove the amounts and the pay words only (sentences stay).
    """
    t = squash_spaces(F.coalesce(col(c), F.lit("")))
    if variant == "light":
        t = F.regexp_replace(t, rules.LIGHT_DOLLAR, " ")
        t = F.regexp_replace(t, rules.LIGHT_AMOUNT_WORD, " ")
        t = F.regexp_replace(t, rules.LIGHT_WORDS, " ")
        return squash_spaces(t)
    sentences = F.split(t, r"(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda s: ~s.rlike(rules.SALARY_SENTENCE_KEYWORDS))
    t = F.array_join(kept, " ")
    for p in (rules.DOLLAR_AMOUNT, rules.HOURLY_RATE, rules.CURRENCY_WORDS):
        t = F.regexp_replace(t, p, " ")
    return squash_spaces(t)


def rule_signals(df: DataFrame, title: str, text: str) -> DataFrame:
    """The five enrichment fields by explicit rules: degree wording, first soft-skill family,
    urgency (high / low / medium) and technical role. A pattern is searched only in texts that hold one
    of its words, which plain substring tests on the text, lowered once, tell much sooner."""
    d, low = F.coalesce(F.col(text), F.lit("")), F.col("_low")

    def found(pattern, words, letters=()):
        held = F.lit(False)
        for w in words:
            held = held | F.contains(low, F.lit(w))
        for w in letters:
            held = held | F.contains(d, F.lit(w))
        return held & d.rlike(pattern)

    df = df.withColumn("_low", F.lower(d))
    soft = None
    for lab, p in rules.SOFT_SKILL_RULES:
        hit = found(p, rules.SOFT_SKILL_WORDS[lab])
        soft = F.when(hit, F.lit(lab)) if soft is None else soft.when(hit, F.lit(lab))
    soft = soft.otherwise(F.lit("none"))
    tech_src = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")))
    return df.withColumns({
        "requires_degree": found(rules.DEGREE_PATTERN, rules.DEGREE_WORDS, rules.DEGREE_LETTERS),
        "soft_skill_type": soft,
        "has_soft_skills": soft != "none",
        "urgency": F.when(found(rules.URGENCY_HIGH, rules.URGENCY_HIGH_WORDS), "high")
                    .when(found(rules.URGENCY_LOW, rules.URGENCY_LOW_WORDS), "low").otherwise("medium"),
        "tech_role": tech_src.rlike(rules.TECH_ROLE_PATTERN),
    }).drop("_low")


def role_context(own, responsibilities, focuses) -> Column:
    """Description of a requested role: the requester's own text if there is one, else a sentence
    from at most four responsibilities and one from at most three focuses, else a default."""
    def listed(c, n, head):
        items = F.array_join(F.transform(F.slice(col(c), 1, n), F.lower), ", ")
        return F.when(F.size(F.coalesce(col(c), F.array().cast("array<string>"))) > 0, F.concat(F.lit(head), items, F.lit(".")))

    text = F.nullif(F.concat_ws(" ", listed(responsibilities, 4, "Responsible for "), listed(focuses, 3, "Primary focus: ")),
                    F.lit(""))
    return F.coalesce(F.nullif(F.trim(F.coalesce(col(own), F.lit(""))), F.lit("")), text, F.lit(rules.ROLE_DEFAULT))


def signature(*cols: str) -> Column:
    """Ten characters that identify a request: md5 of its fields as JSON, in name order."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})), 1, 10)
