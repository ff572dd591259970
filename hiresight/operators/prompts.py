"""Batched prompts for an external language model and the way back from its replies.

The model itself is not called here: ``build_prompts`` gives one request per batch, replies come
back as a table of texts, ``parse_replies`` turns them into rows and ``join_back`` attaches those
to the postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import col
from .mlstages import sorted_positions

#: the five fields asked for, as the schema replies are read with
REPLY = ("job_id long, requires_degree boolean, has_soft_skills boolean, soft_skill_type string, "
         "urgency string, tech_role boolean")
SEPARATOR = "---"
INSTRUCTION = """For each of the {n} postings below give one object with job_id (number), requires_degree (true or false), \
has_soft_skills (true or false), soft_skill_type (communication, leadership, teamwork, analytical, other or none), \
urgency (high, medium or low) and tech_role (true or false). Answer with one JSON array of these objects and nothing else.

"""


def truncate(c, n: int = 800) -> Column:
    return F.substring(F.coalesce(col(c), F.lit("")), 1, n)


def build_prompts(df: DataFrame, key: str, title: str, text: str, batch: int = 25, max_chars: int = 800) -> DataFrame:
    """(batch_id, n_items, keys, prompt): rows in the order of ``key``, numbered without gaps across
    all partitions and cut into batches of ``batch``; only the last batch may be smaller."""
    item = F.concat(F.lit("JOB_ID:"), F.col(key).cast("string"), F.lit("\nTITLE:"), F.coalesce(F.col(title), F.lit("")),
                    F.lit("\nDESC:"), truncate(text, max_chars))
    d = sorted_positions(df.select(key, item.alias("_item")), [key], "_at")
    d = d.groupBy(F.floor(F.col("_at") / batch).alias("batch_id")).agg(
        F.array_sort(F.collect_list(F.struct("_at", key, "_item"))).alias("_x"))  # at most ``batch`` items
    n = F.size("_x")
    head = F.replace(F.lit(INSTRUCTION), F.lit("{n}"), n.cast("string"))
    return d.select("batch_id", n.alias("n_items"), F.col(f"_x.{key}").alias("keys"),
                    F.concat(head, F.array_join("_x._item", SEPARATOR)).alias("prompt"))


def json_body(reply) -> Column:
    """The JSON of a reply: what stands between code fences if it starts with one (without a
    leading 'json'), else the whole text."""
    def strip(c):
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    t = strip(F.coalesce(col(reply), F.lit("")))
    inside = F.regexp_replace(F.coalesce(F.get(F.split(t, "```"), F.lit(1)), F.lit("")), r"^json", "")
    return strip(F.when(t.startswith("```"), inside).otherwise(t))


def parse_replies(replies: DataFrame, reply: str, schema: str = REPLY) -> DataFrame:
    """The objects of all replies as rows. A reply that is no JSON array of objects gives none."""
    body = json_body(reply)
    first = schema.split()[0]
    whole = F.when(body.startswith("[") & body.endswith("]"), F.from_json(body, f"array<struct<{_fields(schema)}>>"))
    rows = replies.select(F.explode(whole).alias("_r")).select("_r.*")
    return rows.where(F.col(first).isNotNull())


def _fields(schema: str) -> str:
    return ",".join(":".join(f.split()) for f in schema.split(","))


def join_back(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with their result; a key answered more than once counts once (the smallest
    answer), so no row is multiplied, and rows without an answer drop out."""
    others = [c for c in results.columns if c != key]
    one = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("_a"))
    return df.join(one, key).select(*df.columns, "_a.*")
