"""Positions of pattern matches as array expressions, without Python and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRE


def locate(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds a column per pattern: array<struct<s, e, m>>, the leftmost non-overlapping matches.

    ``s`` and ``e`` are code points, end exclusive. The matches and the pieces between them give
    the lengths; their running sums give the positions. The sums go over square-root-sized slices,
    so a text with n matches takes n**1.5 steps rather than n**2.
    """
    p = PRE

    def step(df: DataFrame, make) -> DataFrame:
        return df.withColumns({f"{p}{k}_{n}": make(n) for n in patterns for k in (make.__name__,)})

    def m(n):
        return F.regexp_extract_all(F.col(text), F.lit(patterns[n]), F.lit(0))

    def d(n):  # what lies between two starts: the match before and the piece before
        return F.when(F.size(f"{p}m_{n}") == 0, F.expr("array()").cast("array<int>")).otherwise(
            F.expr(f"transform({p}m_{n}, (x, i) -> char_length({p}g_{n}[i])"
                   f" + if(i = 0, 0, char_length({p}m_{n}[i - 1])))"))

    def g(n):
        return F.when(F.size(f"{p}m_{n}") > 0, F.split(F.col(text), patterns[n], -1))

    def b(n):
        c = f"cast(ceil(sqrt(size({p}d_{n}))) as int)"
        return F.expr(f"if(size({p}d_{n}) = 0, cast(array() as array<array<int>>), "
                      f"transform(sequence(0, cast((size({p}d_{n}) - 1) div {c} as int)), "
                      f"k -> slice({p}d_{n}, k * {c} + 1, {c})))")

    def t(n):
        return F.expr(f"transform({p}b_{n}, x -> aggregate(x, 0, (a, y) -> a + y))")

    def o(n):
        return F.expr(f"transform({p}t_{n}, (x, k) -> aggregate(slice({p}t_{n}, 1, k), 0, (a, y) -> a + y))")

    def s(n):
        return F.expr(f"flatten(transform({p}b_{n}, (x, k) -> transform(x, (y, i) -> {p}o_{n}[k]"
                      f" + aggregate(slice(x, 1, i + 1), 0, (a, z) -> a + z))))")

    for make in (m, g, d, b, t, o, s):
        df = step(df, make)
    out = {n: F.expr(f"transform({p}m_{n}, (x, i) -> struct({p}s_{n}[i] as s, "
                     f"{p}s_{n}[i] + char_length(x) as e, x as m))") for n in patterns}
    return df.withColumns(out).drop(*[f"{p}{k}_{n}" for n in patterns for k in "mgdbtos"])


def joined(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """``kind:start:end`` by start, then kind as listed (or by kind, then start), comma-joined.
    ``spans``: array<struct<k, s, e>> with k the number of the kind."""
    key = (lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))) if by_start else \
        (lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(spans, key))), lambda x: F.concat(
        F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def numbered(col: str, k: int) -> Column:
    """The spans of one kind as array<struct<k, s, e>>."""
    return F.transform(F.col(col), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
