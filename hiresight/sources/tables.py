"""Readers for the job-market tables and the ``JobTables`` bundle every query takes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from .schemas import SCHEMAS, SYNONYMS, TABLES


#: tables that a source may lack; queries then see them empty
OPTIONAL = {"benefits", "company_specialities", "company_industries"}


class JobTables:
    """Lazily built DataFrames for the eleven job-market tables.

    ``loader(name) -> DataFrame`` is called at most once per table; nothing is read until an
    action runs, so a query that touches three tables scans three.
    """

    def __init__(self, spark: SparkSession, loader: Callable[[str], DataFrame], source: str | None = None):
        self.spark = spark
        self.source = source  # storage location when the tables are stored, else None
        self._loader = loader
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._loader(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @classmethod
    def from_dir(cls, spark: SparkSession, path: str, fmt: str = "parquet") -> "JobTables":
        """Tables stored as ``<path>/<name>.<fmt>`` (parquet, or CSV with header). Only the
        tables in ``OPTIONAL`` may be absent; a missing required table raises."""
        return cls(spark, lambda name: read_table(spark, path, name, fmt=fmt, optional=name in OPTIONAL),
                   source=path)


def _csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    # multiLine + escape: descriptions hold quoted newlines and doubled quotes
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_table(spark: SparkSession, path: str, name: str, cols: Iterable[str] | None = None,
               fmt: str = "parquet", optional: bool = False) -> DataFrame:
    """Scan ``name`` with an optional column list.

    ``optional=False``: a missing file or column raises, listing the columns that exist.
    ``optional=True``: a missing file gives an empty frame with the declared schema, and only
    the wanted columns that exist are kept (all columns when none of them exists). Headers are
    matched by ``with_known_names``. CSV values that do not parse as the declared type become null.
    """
    full = os.path.join(path, f"{name}.{fmt}")
    schema = SCHEMAS.get(name)
    try:
        if fmt == "csv":
            df = with_known_names(_csv(spark, full), name)
            if schema is not None:
                df = df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else
                                F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        else:
            df = with_known_names(spark.read.format(fmt).load(full), name)
    except AnalysisException as e:
        if not optional or e.getCondition() != "PATH_NOT_FOUND":
            raise
        if schema is None:
            return spark.createDataFrame([], "dummy string")
        df = spark.createDataFrame([], schema)
    if cols is None:
        return df
    cols = list(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing and not optional:
        raise AnalysisException(
            f"table {name}: columns {missing} not found; available: {df.columns}")
    keep = [c for c in cols if c in df.columns]
    return df.select(keep) if keep else df


def read_optional(spark: SparkSession, path: str, name: str, cols=None, fmt="parquet") -> DataFrame:
    return read_table(spark, path, name, cols=cols, fmt=fmt, optional=True)


def find_column(df: DataFrame, names: Iterable[str]) -> str | None:
    """First column whose name matches one of ``names`` case-insensitively (header synonyms)."""
    lower = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    return None


def with_known_names(df: DataFrame, name: str) -> DataFrame:
    """Headers that differ from the declared column only in case, or that are one of its
    ``SYNONYMS``, renamed to it. A declared column that is present is never replaced."""
    found = {}
    for f in SCHEMAS.get(name, ()):
        if f.name not in df.columns:
            have = find_column(df, [f.name, *SYNONYMS.get(f.name, ())])
            if have is not None and have not in found:
                found[have] = f.name
    return df.withColumnsRenamed(found) if found else df


def with_defaults(df: DataFrame, defaults: dict, schema: StructType | None = None) -> DataFrame:
    """Add absent columns with a constant default, in the type that ``schema`` declares for the
    column (needed for None); present columns are untouched."""
    types = {f.name: f.dataType for f in schema or ()}
    add = {c: F.lit(v).cast(types[c]) if c in types else F.lit(v)
           for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df
