"""Feature operators: out-of-fold target encoding, positional multi-hot matrices and per-key
counts, all as grouped DataFrame jobs. Fitted stages that persist are in ``mlstages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..session import write_back
from .joins import left_join_known
from .mlstages import lookup_column, smoothed, unpivot
from .quantiles import agg_by, median


def split_encodings(df: DataFrame, cols, target: str, fold: str, k: int, smoothing: float = 40.0,
                    min_count: int = 8) -> tuple[DataFrame, dict]:
    """Encoders of all k splits in one job: every row feeds the encoders of the k-1 splits whose
    held-out fold it is not in (explode of a bounded fold list); statistics are grouped by
    (split, column, value). Returns the encodings (column, value, enc: map of split to encoding),
    written once, and the overall median of each split."""
    cols = list(cols)
    d = df.where(F.col(target).isNotNull())
    others = F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda f: f != F.col(fold))
    train = d.select(fold, target, *cols).withColumn("_f", F.explode(others))
    overall = {r["_f"]: r["_g"] for r in agg_by(train, "_f", {"_g": median(target)}).collect()}  # k numbers
    stats = agg_by(unpivot(train, cols, ["_f", target]), ["_f", "column", "value"],
                   {"m": median(target), "n": F.count(F.lit(1))})
    enc = smoothed(F.col("n"), F.col("m"), split_number(F.col("_f"), overall), smoothing, min_count)
    wide = (stats.select("column", "value", F.struct("_f", enc.alias("e")).alias("_fe")).groupBy("column", "value")
            .agg(F.map_from_entries(F.collect_list("_fe")).alias("enc")))  # at most k entries each
    return write_back(wide, "split-encodings"), overall


def split_number(split, numbers: dict) -> "F.Column":
    """The number of a split (one per split, so a CASE over k values)."""
    return clean.label_map(split, numbers).cast("double")


def apply_split_encodings(df: DataFrame, cols, stats: DataFrame) -> DataFrame:
    """Adds ``_enc_<col>``: per category column the map of split to encoding, by one lookup join."""
    for c in cols:
        df = lookup_column(df, stats, c, f"_enc_{c}", F.lit(None))
    return df


def split_value(c: str, split, overall: dict) -> "F.Column":
    """The encoding of column ``c`` by one split's encoder (after ``apply_split_encodings``)."""
    s = split if not isinstance(split, int) else F.lit(split)
    return F.coalesce(F.try_element_at(f"_enc_{c}", s), split_number(s, overall))


def target_encode_oof(df: DataFrame, key: str, cols, target: str, fold: str, k: int,
                      smoothing: float = 40.0, min_count: int = 8, prefix: str = "te_") -> DataFrame:
    """Out-of-fold encoding: each row reads the encoder of the split that holds its fold out, so a
    row's own target never reaches its encoding."""
    cols = list(cols)
    stats, overall = split_encodings(df, cols, target, fold, k, smoothing, min_count)
    enc = apply_split_encodings(df.select(key, fold, *[c for c in cols if c not in (key, fold)]), cols, stats)
    return enc.select(key, *[split_value(c, F.col(fold), overall).alias(prefix + c) for c in cols])


def label_ranks(bridge: DataFrame, label: str, k: int) -> DataFrame:
    """(rank, label) of the k most frequent labels (1-based, ties by label)."""
    from pyspark.sql import Window
    top = (bridge.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.col("_n").desc(), F.col(label)).limit(k))
    # at most k rows: a one-partition window is fine here
    return top.select(F.row_number().over(Window.orderBy(F.col("_n").desc(), F.col(label))).alias("rank"),
                      label)


def multi_hot(keys: DataFrame, bridge: DataFrame, key: str, label: str, k: int, prefix: str) -> DataFrame:
    """One 0/1 column per top-k label, named by rank (``<prefix>01``..), so the schema does not
    depend on the data; ``label_ranks`` gives the names. Keys without any label get zeros."""
    return label_masks(keys, bridge, key, label, k, prefix).select(key, *label_bits(k, prefix))


def label_masks(keys: DataFrame, bridge: DataFrame, key: str, label: str, k: int, prefix: str) -> DataFrame:
    """The state of ``multi_hot`` before it is spread over k columns, for tables that are joined first."""
    ranks = label_ranks(bridge, label, k)
    bit = F.col("rank") - 1
    # one bit per label, in numbers of 62: a key's state is k bits, whatever the number of its rows
    masks = [F.coalesce(F.bit_or(F.when(F.floor(bit / 62) == j, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 62))),
                        F.lit(0).cast("long")).alias(f"_{prefix}{j}") for j in range((k + 61) // 62)]
    wide = bridge.join(F.broadcast(ranks), label).groupBy(key).agg(*masks)
    return keys.select(key).join(wide, key, "left")


def label_bits(k: int, prefix: str) -> list:
    """The columns that ``label_masks`` stands for; rows without a mask get zeros."""
    return [F.coalesce(F.getbit(f"_{prefix}{i // 62}", F.lit(i % 62)), F.lit(0)).cast("int").alias(f"{prefix}{i + 1:02d}")
            for i in range(k)]


def count_per_key_joined(df: DataFrame, key: str, name: str) -> DataFrame:
    """``count(*) over (partition by key)`` as an aggregation joined back (a hot key is
    combined map-side; the join side is split by AQE skew handling); null keys give 0."""
    c = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return left_join_known(df, c, key).withColumn(name, F.coalesce(name, F.lit(0)))
