"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its text; the probability that one document is
preferred to another is the logistic function of the difference of their scores. Preference pairs
set a training document labelled good against one labelled bad; the weights minimise the logistic
loss on the feature differences of the pairs, without an intercept, as only differences matter.
The cutoff is a score quantile: among ``GRID`` quantile steps of all training scores, the one that
separates the labels best (mean of the two classes' hit rates, weighted as ``WEIGHT_GOOD``). The
result is the logistic function of score minus cutoff, shifted so that the cutoff lies at ``AT``.

Only the fit uses a bounded sample: the ``TRAIN`` documents of each label with the smallest hashes,
each paired with ``ROUNDS`` documents of the other label. The cutoff covers all training documents,
and every document is scored.

Features describe the whole text (words, marks, repetition, lines) and never use labels, language,
source or id. Defined cases: a null or empty text has zero counts and is scored like any other;
labels repeated for a document count once, and as good only if all are good; null labels are
ignored; documents repeated in the table are scored one by one; a document with a null id is not
held out and has no label; without training documents of both labels every document gets the
smoothed share of good ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, stage, text_bytes

TRAIN = 20_000  # documents of each label that the weights are fitted on
ROUNDS = 4  # pairs of each document of the larger class
GRID = 4_096  # score steps among which the cutoff is chosen
WEIGHT_GOOD = 0.5
AT = 0.7

_SPACES = b" \t\n\r\x0b\x0c"
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
#: what is measured per word, line or byte of a text; the model sees each value and its square root
MEASURES = ["symbols", "shouts", "upper", "again", "windows", "dup_lines", "bare", "digits", "marks",
            "top_word", "distinct", "ends", "line_rate", "wide", "short", "long", "tiny"]
N_FEATURES = 2 * len(MEASURES)


def _lacking(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def measure(raw: bytes) -> list[float]:
    """The values of MEASURES for one whole text, each between 0 and 1."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(MEASURES) - 1) + [1.0]
    solid = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    seen = Counter(words)
    windows = len(set(zip(words, words[1:], words[2:])))
    shares = [
        min(_lacking(raw, _SYMBOLS) / n, 4.0) / 4,
        min(_lacking(raw, b"!?") / n, 4.0) / 4,
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - windows / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        1 - len(raw.translate(None, _MARKS + _DIGITS).split()) / n,
        _lacking(raw, _DIGITS) / solid,
        min(_lacking(raw, _MARKS) / n, 4.0) / 4,
        max(seen.values()) / n,
        np.log1p(len(seen)) / np.log1p(n),
        min(_lacking(raw, b".!?") / n, 1.0),
        min(len(lines) / n, 1.0),
        1 - len(raw.decode("utf-8", "replace")) / len(raw) if not raw.isascii() else 0.0,
        min(solid / n, 32.0) / 32,
        min(max(map(len, words)), 256) / 256,
        1 / (1 + np.log1p(n)),
    ]
    return [min(max(float(x), 0.0), 1.0) for x in shares]


@F.arrow_udf(T.ArrayType(T.DoubleType(), False))
def features(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts:
        x = np.array(measure(t.as_py() or b""))
        rows.append(np.concatenate([x, np.sqrt(x)]))
    flat = np.concatenate(rows) if rows else np.zeros(0)
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_FEATURES, pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(flat)).cast(pa.list_(pa.field("element", pa.float64(), False)))


features = features.asNondeterministic()  # evaluated once, however often it is used


def preferences(good: DataFrame, bad: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(d array, label): feature differences of pairs; both inputs are bounded samples with ``x``.

    Every document of the larger sample meets ``rounds`` different ones of the other; half of the
    pairs are turned round, so that both outcomes occur.
    """
    def numbered(df):
        return df.withColumn("i", F.row_number().over(Window.orderBy("h", "doc_id")) - 1)

    a, b = numbered(good), numbered(bad)
    n_a, n_b = a.count(), b.count()
    flip = n_a < n_b
    large, small, m = (b, a, n_a) if flip else (a, b, n_b)
    turn = F.explode(F.array(*[F.lit(r) for r in range(min(rounds, max(m, 1)))]))
    left = large.select(F.col("x").alias("x1"), "i", turn.alias("r"))
    left = left.withColumn("j", F.pmod(F.col("i") + F.col("r") * F.lit(max(m // rounds, 1)), F.lit(max(m, 1))))
    pairs = left.join(small.select(F.col("x").alias("x2"), F.col("i").alias("j")), "j")
    sign = F.when((F.col("i") + F.col("r")) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    d = F.zip_with("x1", "x2", lambda u, v: u - v)
    won = sign * (-1.0 if flip else 1.0)
    return pairs.select(F.transform(d, lambda v: v * sign).alias("d"), (won > 0).cast("double").alias("label"))


def fit(known: DataFrame, train: int = TRAIN, rounds: int = ROUNDS) -> np.ndarray | None:
    """Bradley-Terry weights from ``known`` (doc_id, x, good boolean); None without both labels."""
    one = known.dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    good, bad = (stage(one.where(c).orderBy("h", "doc_id").limit(train), f"preference-{n}")
                 for n, c in (("good", F.col("good")), ("bad", ~F.col("good"))))
    if good.isEmpty() or bad.isEmpty():
        return None
    pairs = stage(preferences(good, bad, rounds), "preference-pairs").select(array_to_vector("d").alias("d"), "label")
    model = LogisticRegression(featuresCol="d", labelCol="label", fitIntercept=False, regParam=1e-5,
                               maxIter=100).fit(pairs)
    return model.coefficients.toArray()


def utility(weights: np.ndarray, x: str = "x") -> Column:
    """The Bradley-Terry score as a column expression."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cutoff(scored: DataFrame, weight_good: float = WEIGHT_GOOD) -> float:
    """The score quantile that separates the labels best; ``scored``: s, good.

    Scores are counted on ``GRID`` steps of the logistic scale around their own middle; these counts
    are all that is gathered. The cutoff lies midway between the lowest score kept and the highest not kept.
    """
    mid, spread = scored.agg(F.avg("s"), F.coalesce(F.stddev_pop("s"), F.lit(0.0))).first()
    spread = spread or 1.0
    step = F.floor(1 / (1 + F.exp(-(F.col("s") - F.lit(mid)) / F.lit(spread))) * GRID).cast("int")
    counts = np.zeros((GRID + 2, 2))
    lows, highs = np.full(GRID + 2, np.inf), np.full(GRID + 2, -np.inf)
    for b, good, n, low, high in scored.groupBy(step.alias("b"), "good") \
            .agg(F.count(F.lit(1)), F.min("s"), F.max("s")).collect():
        counts[b, int(good)] += n
        lows[b], highs[b] = min(lows[b], low), max(highs[b], high)
    below = np.cumsum(counts, axis=0) - counts  # kept: this step and up
    bad, good = counts.sum(axis=0)
    value = weight_good * (1 - below[:, 1] / good) + (1 - weight_good) * below[:, 0] / bad
    value[np.isinf(lows)] = -1
    b = int(value.argmax())
    under = highs[:b].max(initial=-np.inf)
    return float(lows[b] if np.isinf(under) else (lows[b] + under) / 2)


def classify(docs: DataFrame, labels: DataFrame, trainable: Column, train: int = TRAIN,
             rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, trainable, utility, score, predicted) for every document; labels are used only of
    documents for which ``trainable`` (a condition on doc_id) holds."""
    x = stage(docs.select("doc_id", F.coalesce(trainable, F.lit(True)).alias("trainable"),
                          features(text_bytes()).alias("x")), "preference-features")
    known = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.min("quality") > 0).alias("good")).join(x.where("trainable"), "doc_id"))
    known = stage(known, "preference-known")
    w = fit(known, train, rounds)
    if w is None:
        good, n = known.agg(F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
        out = x.withColumn("utility", F.lit(0.0)).withColumn("score", F.lit((good + 1) / (n + 2)))
    else:
        at = cutoff(known.select(utility(w).alias("s"), "good"))
        # >= at the cutoff itself, despite rounding
        logit = F.col("utility") - F.lit(at) + F.lit(float(np.log(AT / (1 - AT))) + 1e-9)
        out = x.withColumn("utility", utility(w)).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "trainable", "utility", "score", (F.col("score") >= AT).cast("int").alias("predicted"))


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return rows.select("doc_id", (~F.col("trainable")).alias("held_out"), "score", "predicted")
