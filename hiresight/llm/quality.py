"""Quality rules with risk-controlled thresholds.

Each rule scores a document (higher is worse) and rejects it above a cutoff. Cutoffs are not
guessed: per stratum (language by default) the labelled good documents are a holdout on which
the false rejections of every candidate cutoff are counted. A cutoff is accepted when the exact
binomial (Clopper-Pearson) test shows, at level ``delta / (strata x rules)`` (Bonferroni), that
its false-rejection rate is below ``alpha / rules``; candidates are tried from lenient to strict
and the walk stops at the first failure (fixed-sequence testing, so the grid itself needs no
further correction). Together: with probability 1 - delta, every stratum loses at most ``alpha``
of its good documents to these rules. A stratum with too few labels accepts no cutoff and keeps
its documents.

Defined cases: a null or empty text has no words (fails the base rule); a null stratum is a
stratum of its own; labels repeated for a document count once and as good only if all are good;
null labels are ignored; repeated documents are judged separately; an empty table gives an empty
result; other columns of the input are ignored by ``judge`` and passed through by ``keep``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PRE, stage, text_bytes

#: rule -> score from the counts (all ratios, so one grid serves every rule)
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_words, 1)",
}
GRID = 100  # candidate cutoffs 1/100 apart
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper"]
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"


def count_text(raw: bytes) -> tuple[int, ...]:
    """The counts of COUNTS for one whole text; words are runs without ASCII white space."""
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, _SPACES)
    chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            hit = np.zeros(n, bool)
            at = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            hit[:-2] |= at
            hit[1:-1] |= at
            hit[2:] |= at
            repeat = int(hit.sum())
    upper = sum(map(bytes.isupper, words))
    return n, chars, symbols, dup, len(lines), repeat, upper


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    rows = [count_text(t or b"") for t in texts.to_pylist()]
    cols = list(zip(*rows)) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], COUNTS)


text_counts = text_counts.asNondeterministic()  # evaluated once, however often it is used


def tail_below(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(X <= k) for X ~ Binomial(n, p), exact sum of the terms."""
    if n == 0:
        return np.ones(len(k))
    i = np.arange(int(k.max()) + 1)
    lg = np.array([math.lgamma(x + 1) for x in i])
    rest = np.array([math.lgamma(n - x + 1) for x in i])
    logs = math.lgamma(n + 1) - lg - rest + i * math.log(p) + (n - i) * math.log1p(-p)
    return np.minimum(np.cumsum(np.exp(logs))[k], 1.0)


def thresholds(scored: DataFrame, labels: DataFrame, strata: str = "stratum",
               alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest certified cutoffs.

    ``scored`` holds doc_id, the stratum and one score column per rule. One row per
    (stratum, rule, grid cell) is all that is gathered, by a partial aggregation.
    """
    good = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"),
                 F.least(F.ceil(F.col(r) * GRID), F.lit(GRID + 1)).cast("int").alias("cell"))
        for r in RULES]))
    held = scored.join(good, "doc_id").select(strata, cells.alias("c"))
    hist = held.groupBy(strata, "c.rule", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    tests = F.count_distinct(F.coalesce(F.col(strata), F.lit(""))) \
        + F.max(F.col(strata).isNull().cast("int"))
    hist = stage(hist, "quality-hist")
    m = max(int(hist.agg(tests).first()[0] or 1), 1) * len(RULES)
    level, rate = delta / m, alpha / len(RULES)

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(GRID + 2, np.int64)
        np.add.at(count, pdf["cell"].to_numpy(), pdf["n"].to_numpy())
        n = int(count.sum())
        # rejected above cutoff g/GRID: cells g+1 and up
        rejected = count[::-1].cumsum()[::-1][1:]
        order = np.arange(GRID, -1, -1)  # lenient to strict
        ok = tail_below(rejected[order], n, rate) <= level
        passed = np.logical_and.accumulate(ok)
        if not passed.any():
            return pd.DataFrame(columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"])
        g = int(order[passed][-1])
        return pd.DataFrame([[pdf[strata].iloc[0], pdf["rule"].iloc[0], g / GRID, n,
                              int(rejected[g])]],
                            columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"])

    return hist.groupBy(strata, "rule").applyInPandas(
        certify, "stratum string, rule string, cutoff double, n_good long, n_rejected long")


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumns({r: F.expr(e) for r, e in RULES.items()})


def _verdict(scored: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds base_failed and kept. ``cut`` has one row per stratum, joined null-safely."""
    wide = cut.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{PRE}cut_{r}") for r in RULES])
    wide = wide.withColumnRenamed("stratum", f"{PRE}s")
    out = scored.join(wide, scored["stratum"].eqNullSafe(wide[f"{PRE}s"]), "left")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(r) > F.col(f"{PRE}cut_{r}"), F.lit(False))
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~bad)


def _counted(docs: DataFrame, strata: str) -> DataFrame:
    s = F.col(strata).cast("string") if strata in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", s.alias("stratum"), text_counts(text_bytes()).alias("c")) \
        .select("doc_id", "stratum", "c.*")


def judge(docs: DataFrame, labels: DataFrame, strata: str = "lang", alpha: float = 0.02,
          delta: float = 0.05) -> DataFrame:
    """One row per document: the counts, each rule's score, base_failed and kept."""
    scored = _scores(stage(_counted(docs, strata), "quality-counts"))
    return _verdict(scored, thresholds(scored, labels, "stratum", alpha, delta))


def keep(docs: DataFrame, labels: DataFrame, strata: str = "lang", alpha: float = 0.02,
         delta: float = 0.05) -> DataFrame:
    """The documents that pass, with their columns unchanged; texts are not shuffled."""
    scored = _scores(stage(_counted(docs, strata), "quality-counts"))
    cut = stage(thresholds(scored, labels, "stratum", alpha, delta), "quality-cutoffs")
    s = F.col(strata).cast("string") if strata in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{PRE}row"),
                      s.alias("stratum"), text_counts(text_bytes()).alias("c")) \
        .select(f"{PRE}row", "stratum", "c.*")
    return _verdict(_scores(own), cut).where("kept").select(f"{PRE}row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols",
                                      "n_dup_lines", "n_repeat_words", "base_failed", "kept")
