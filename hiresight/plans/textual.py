"""Text reports: rule-based posting signals (Q03), title features, experience imputation,
salary-text scrubbing and text statistics, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, rules, text
from ..operators import agg, prompts
from ..operators.joins import keep_labels
from ..sources.tables import JobTables
from . import views

SAL = "normalized_salary"
EXPL = "formatted_experience_level"


def posting_signals(t: JobTables) -> DataFrame:
    """Postings with a description and the five rule signals (whole descriptions)."""
    p = views.report_postings(t).where(F.col("description").isNotNull())
    return text.rule_signals(p, "title", "description")


def q03_1(t: JobTables) -> DataFrame:
    """Postings that ask for a degree vs not."""
    s = posting_signals(t).withColumn("degree_label", F.when(F.col("requires_degree"), "Degree required")
                                      .otherwise("No degree required"))
    return agg.count_by(s, "degree_label")


def q03_2(t: JobTables) -> DataFrame:
    """Soft-skill families among postings that name one."""
    return agg.count_by(posting_signals(t).where("has_soft_skills"), "soft_skill_type")


def q03_3(t: JobTables) -> DataFrame:
    """Urgency counts (high, medium, low)."""
    return keep_labels(agg.count_by(posting_signals(t), "urgency"), "urgency", ["high", "medium", "low"])


def q03_4(t: JobTables) -> DataFrame:
    """Median salary of technical vs other roles."""
    s = posting_signals(t).withColumn("role_type", F.when(F.col("tech_role"), "Tech role")
                                      .otherwise("Non-tech role"))
    return agg.median_by(s, "role_type", SAL)


def q03_5(t: JobTables) -> DataFrame:
    """Share of postings asking for a degree per experience level (%)."""
    s = posting_signals(t).withColumn("_deg", F.col("requires_degree").cast("int"))
    return agg.rate_by(s, EXPL, "_deg", name="degree_pct")


def title_flags(t: JobTables) -> DataFrame:
    """19 keyword flags, length and word count of every posting title."""
    p = t.postings.select("job_id", "title")
    p = text.regex_flags(p, "title")
    return p.withColumns({"title_len": text.text_length("title"),
                          "title_word_count": text.word_count("title")}).drop("title")


def title_family_model(t: JobTables) -> DataFrame:
    """Title family by the salary model's rule table."""
    return t.postings.select("job_id", clean.rule_label(
        "title", rules.TITLE_FAMILY_RULES_MODEL, rules.TITLE_FAMILY_DEFAULT).alias("title_family"))


def impute_experience(t: JobTables, compat: bool = True) -> DataFrame:
    """Experience level filled from the title where missing."""
    p = t.postings
    return p.select("job_id", text.impute_experience(EXPL, "title", compat=compat).alias(EXPL))


def experience_imputed_counts(t: JobTables) -> DataFrame:
    return agg.count_by(impute_experience(t), EXPL)


def scrub_documents(t_docs: DataFrame, variant: str = "sentences") -> DataFrame:
    """Every document with its pay information removed, and the lengths before/after."""
    s = text.scrub_salary("text", variant)
    return t_docs.select("doc_id", s.alias("clean_text"), text.text_length("text").alias("chars_before"),
                         F.length(s).alias("chars_after"))


def document_stats(docs: DataFrame) -> DataFrame:
    """Characters, words and whether any dollar amount is present, per document."""
    return docs.select("doc_id", "lang", text.text_length("text").alias("n_chars"),
                       text.word_count("text").alias("n_words"),
                       F.col("text").rlike(r"\$\s?\d").alias("has_dollar"))


def title_clean_rows(t: JobTables) -> DataFrame:
    """Normalised titles longer than two characters (input of the title clusters)."""
    p = t.postings.select("job_id", clean.title_clean("title").alias("title_clean"))
    return p.where(F.length("title_clean") > 2)


def _described(t: JobTables) -> DataFrame:
    return t.postings.where(F.col("description").isNotNull()).select("job_id", "title", "description")


def prompt_batches(t: JobTables, batch: int = 25, max_chars: int = 800) -> DataFrame:
    """All postings with a description as prompts of 25, numbered without gaps."""
    return prompts.build_prompts(_described(t), "job_id", "title", "description", batch, max_chars).select(
        "batch_id", "n_items", "keys", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def rule_replies(t: JobTables, batch: int = 25) -> DataFrame:
    """(batch_id, reply): the replies a model would send, written by the signal rules, in the forms
    that occur: plain, in code fences, in fences marked json, and (every seventh) cut off."""
    s = posting_signals(t).select("job_id", "requires_degree", "has_soft_skills", "soft_skill_type", "urgency", "tech_role")
    b = prompts.build_prompts(_described(t), "job_id", "title", "description", batch).select(
        "batch_id", F.explode("keys").alias("job_id"))
    fields = [c for c in s.columns if c != "job_id"]
    g = b.join(s, "job_id").groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("job_id", *fields)))).alias("j"))
    form = F.col("batch_id") % 7
    return g.select("batch_id", F.when(form == 6, F.expr("substring(j, 1, length(j) - 20)"))
                    .when(form % 3 == 1, F.concat(F.lit("```\n"), "j", F.lit("\n```")))
                    .when(form % 3 == 2, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.col("j")).alias("reply"))


def reply_join_back(t: JobTables) -> DataFrame:
    """Postings with the five fields read from the replies; postings of unreadable replies drop out."""
    return prompts.join_back(_described(t).select("job_id", "title"), prompts.parse_replies(rule_replies(t), "reply"), "job_id")
