"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a
DataFrame; ``run`` writes every stage's result as Parquet in the shared folder and rereads it as
the next stage's documents. All stages but the last return the columns of ``documents``.

1. quality_rules: documents that the base rules or the certified thresholds reject go.
2. simhash_dedup: of each group of near-duplicates the smallest doc_id stays.
3. pii: personal data is replaced by <KIND>; n_chars follows the text.
4. mix_sources: documents appear as often as the mixture takes them (0 to 3 times).
5. best_fit_packing: one row per piece with its sequence, offset and ids.

Missing columns of ``documents`` are read as null; other columns are dropped at the first stage.
Null and empty texts, repeated rows and empty tables are handled as each operator documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresight.llm import mixing, packing, pii, quality, simhash
from hiresight.llm.common import stage

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHINGLE, MAX_BITS = 4, 4
CAPACITY = 4096


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
                         for c, t in COLUMNS.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedupe(_columns(docs), SHINGLE, MAX_BITS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(_columns(docs)).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_columns(docs), public_tokenizers.path(TOKENIZER), END_ID, CAPACITY)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("pii", redact_pii),
          ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the fitted thresholds, trees and the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
