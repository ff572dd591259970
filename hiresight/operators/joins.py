"""Join operators: lookups, membership, dedupe-then-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast hint for a frame whose size is bounded by construction (a top-k list, a
    fixed label table). Data-sized lookups are left to the planner: the size estimate against
    ``autoBroadcastJoinThreshold`` and AQE's runtime statistics decide broadcast vs shuffle."""
    return F.broadcast(df)


def keep_known(df: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``ids`` (semi join; null keys never match)."""
    return df.join(ids.select(key), key, "left_semi")


def drop_known(df: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def keep_labels(df: DataFrame, col: str, labels) -> DataFrame:
    """Keep rows whose ``col`` is in ``labels``: a literal list, or a bounded one-column frame."""
    if labels is None:
        return df
    if isinstance(labels, DataFrame):
        lab = labels.select(F.col(labels.columns[0]).alias(col))
        return df.join(bounded(lab), col, "left_semi")
    return df.where(F.col(col).isin(list(labels)))


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str, name: str,
                  out: str | None = None, fallback_to_key: bool = False) -> DataFrame:
    """Left join one attribute of a lookup table; the lookup is first reduced to one row per
    key (smallest name) so a duplicated lookup key cannot fan the fact rows out."""
    lk = (lookup.where(F.col(key).isNotNull())
          .groupBy(key).agg(F.min(name).alias(out or name)))
    res = df.join(lk, key, "left")
    if fallback_to_key:
        res = res.withColumn(out or name, F.coalesce(F.col(out or name), F.col(key).cast("string")))
    return res


def latest_per_key(df: DataFrame, key: str, order: str, tie: str | None = None) -> DataFrame:
    """One row per key: the row with the largest ``order`` (rows with a known value win),
    ties by the largest ``tie``. An aggregation (max of a struct), so a key holding a third of
    all rows is combined map-side instead of being sorted in one task."""
    others = [c for c in df.columns if c != key]
    rank = F.struct(F.col(order).isNotNull(), F.col(order), *([F.col(tie)] if tie else []))
    best = F.max_by(F.struct(*others), rank).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_best.*")


def first_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value of the row with the smallest ``order`` among non-null
    values; a deterministic stand-in for "first non-null in file order"."""
    return (df.where(F.col(value).isNotNull()).groupBy(key)
            .agg(F.min_by(value, order).alias(value)))


def drop_duplicates(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first by ``order`` (deterministic, unlike dropDuplicates)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def left_join_known(df: DataFrame, dim, key: str) -> DataFrame:
    """Left join in which rows with a NULL key (they can never match) skip the shuffle: they
    are appended with NULL attributes instead of all hashing to one reducer. ``dim`` may be a
    list of tables: each call reads ``df`` twice, so calls in a row would read it 2, 4, 8 times."""
    dims = dim if isinstance(dim, (list, tuple)) else [dim]
    known = df.where(F.col(key).isNotNull())
    for d in dims:
        known = known.join(d, key, "left")
    unknown = df.where(F.col(key).isNull()).select(
        *df.columns, *[F.lit(None).cast(d.schema[c].dataType).alias(c) for d in dims for c in d.columns if c != key])
    return known.unionByName(unknown)
