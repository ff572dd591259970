"""Pipeline stages that MLlib lacks, as Estimators and Models that save and load.

A fitted stage holds its settings as one JSON parameter and its lookup tables as DataFrames, which
are written as parquet next to the parameters; so a ``PipelineModel`` of these and MLlib's own
stages is saved and loaded as one. All fits are grouped aggregations; lookups are joined, never
collected, and broadcast only where Spark's own size estimate allows it or a parameter bounds them.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReader, MLWriter)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..session import write_back
from .quantiles import Quantile, agg_by, group_quantiles, median


class _Settings(Params):
    """Keyword arguments kept as one parameter, checked against ``defaults``."""

    defaults: dict = {}
    settings = Param(Params._dummy(), "settings", "keyword arguments of the stage")

    def __init__(self, **kw):
        super().__init__()
        unknown = set(kw) - set(self.defaults)
        if unknown:
            raise TypeError(f"{type(self).__name__}: unknown settings {sorted(unknown)}")
        self._set(settings={**self.defaults, **kw})

    def __getitem__(self, name: str):
        return self.getOrDefault("settings")[name]


class _Stage(_Settings, Estimator, DefaultParamsWritable, DefaultParamsReadable):
    pass


class _Step(_Settings, Transformer, DefaultParamsWritable, DefaultParamsReadable):
    pass


class _Fitted(_Settings, Model, DefaultParamsWritable, DefaultParamsReadable):
    """A fitted stage; ``tables`` holds its lookup tables by name."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, **kw):
        Params.__init__(self)
        self._set(settings=kw)
        self.tables = dict(tables or {})

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: _Fitted):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession,
                                         extraMetadata={"tables": sorted(self.stage.tables)})
        for name, df in self.stage.tables.items():
            df.write.parquet(os.path.join(path, name))


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        stage.tables = {n: self.sparkSession.read.parquet(os.path.join(path, n)) for n in meta["tables"]}
        return stage


# --- wide rows ------------------------------------------------------------------------------------

def pack(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` with its double columns in one array, and the columns that give ``df`` back. Rows of
    over 100 columns pass through a join column by column, without generated code."""
    at = {c: i for i, c in enumerate(f.name for f in df.schema if isinstance(f.dataType, T.DoubleType))}
    if not at:
        return df, [F.col(c) for c in df.columns]
    d = df.select(*[c for c in df.columns if c not in at], F.array(*at).alias("_numbers"))
    return d, [F.get("_numbers", F.lit(at[c])).alias(c) if c in at else F.col(c) for c in df.columns]


# --- target encoding ------------------------------------------------------------------------------

def _as_category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))


def unpivot(df: DataFrame, cols, extra=()) -> DataFrame:
    """(extra..., column, value) rows of the category columns; missing values are 'Unknown'."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _as_category(c).alias("value")) for c in cols]))
    return df.select(*extra, pairs.alias("_cv")).select(*extra, "_cv.*")


def lookup_column(df: DataFrame, table: DataFrame, c: str, out: str, default: Column, on: dict | None = None) -> DataFrame:
    """``df`` with ``out``: the ``enc`` of the row's category ``c`` in ``table`` (column, value,
    enc and, for ``on`` = {table column: row expression}, further keys), else ``default``. One
    lookup join; the rows themselves are neither unpivoted nor regrouped."""
    on = on or {}
    lk = table.where(F.col("column") == c).select(
        F.col("value").alias("_value"), F.col("enc").alias("_enc"), *[F.col(k).alias(f"_on_{k}") for k in on])
    cond = _as_category(c) == F.col("_value")
    for k, e in on.items():
        cond = cond & (e == F.col(f"_on_{k}"))
    got = df.join(lk, cond, "left")
    return got.withColumn(out, F.coalesce("_enc", default)).drop("_value", "_enc", *[f"_on_{k}" for k in on])


def smoothed(n: Column, m: Column, overall: Column, smoothing: float, min_count: int) -> Column:
    """w * group median + (1 - w) * overall median with w = n / (n + smoothing); groups under
    ``min_count`` rows get the overall median."""
    w = n / (n + F.lit(float(smoothing)))
    return F.when(n >= min_count, w * m + (1 - w) * overall).otherwise(overall)


class MedianTargetEncoder(_Stage):
    """Smoothed median target encoding of category columns, all in one grouped aggregation.
    Missing categories count as 'Unknown'; unseen ones get the overall median."""

    defaults = {"cols": [], "target": "y", "smoothing": 40.0, "min_count": 8, "prefix": "te_"}

    def _fit(self, df: DataFrame) -> "MedianTargetEncoderModel":
        y = self["target"]
        d = df.where(F.col(y).isNotNull())
        overall = agg_by(d, [], {"g": median(y)}).first()[0]  # one number
        g = F.lit(overall).cast("double")
        stats = agg_by(unpivot(d, self["cols"], [y]), ["column", "value"],
                       {"m": median(y), "n": F.count(F.lit(1))})
        enc = smoothed(F.col("n"), F.col("m"), g, self["smoothing"], self["min_count"])
        table = write_back(stats.select("column", "value", enc.alias("enc")), "target-encodings")
        return MedianTargetEncoderModel({"encodings": table}, cols=self["cols"], prefix=self["prefix"], overall=overall)


class MedianTargetEncoderModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        for c in self["cols"]:
            df = lookup_column(df, self.tables["encodings"], c, self["prefix"] + c,
                               F.lit(self["overall"]).cast("double"))
        return df


# --- ordinal codes --------------------------------------------------------------------------------

def sorted_positions(df: DataFrame, cols: list[str], name: str = "position") -> DataFrame:
    """0-based positions of the rows in the order of ``cols``, without a one-task window: rows are
    range-partitioned and written once with their partition, partition sizes (one number each)
    give the offsets, and each partition numbers its own rows."""
    d = write_back(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "sorted-positions")
    offsets, before = [], 0
    for part, n in sorted(d.groupBy("_part").count().collect()):  # one row per partition
        offsets.append((part, before))
        before += n
    off = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return (d.join(F.broadcast(off), "_part").withColumn(name, F.col("_offset") + place - 1)
            .drop("_part", "_offset"))


class OrdinalEncoder(_Stage):
    """Codes 0, 1, ... by alphabetical order of the values seen in the fit; -1 for values that
    were missing or not seen. One sort covers all columns."""

    defaults = {"cols": [], "suffix": "_code"}

    def _fit(self, df: DataFrame) -> "OrdinalEncoderModel":
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                    for c in self["cols"]]))
        vocab = df.select(pairs.alias("_cv")).select("_cv.*").where(F.col("value").isNotNull()).distinct()
        pos = sorted_positions(vocab, ["column", "value"])
        first = pos.groupBy("column").agg(F.min("position").alias("_first"))  # one row per column
        enc = pos.join(F.broadcast(first), "column").select(
            "column", "value", (F.col("position") - F.col("_first")).cast("int").alias("enc"))
        return OrdinalEncoderModel({"codes": write_back(enc, "ordinal-codes")}, cols=self["cols"], suffix=self["suffix"])


class OrdinalEncoderModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        codes = [c + self["suffix"] for c in self["cols"]]
        if any(isinstance(df.schema[c].dataType, T.DoubleType) for c in self["cols"]) or set(codes) & set(df.columns):
            d, columns = df, None
        else:
            d, columns = pack(df)  # the numbers pass through the joins as one column
        for c, code in zip(self["cols"], codes):
            lk = self.tables["codes"].where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("enc").alias("_enc"))
            d = (d.join(lk, F.col(c).cast("string") == F.col("_value"), "left")
                 .withColumn(code, F.coalesce("_enc", F.lit(-1))).drop("_value", "_enc"))
        return d if columns is None else d.select(*columns, *codes)


# --- numeric columns ------------------------------------------------------------------------------

def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


class MedianImputer(_Stage):
    """Missing numbers (null, NaN) become the column's exact median; a column without any value
    becomes 0. The medians of all columns come from one pass."""

    defaults = {"cols": []}

    def _fit(self, df: DataFrame) -> "MedianImputerModel":
        cols = self["cols"]
        row = group_quantiles(df, [], {c: Quantile(_number(c)) for c in cols}).first() if cols else None
        return MedianImputerModel(cols=cols, medians=[float(row[c] or 0.0) if row else 0.0 for c in cols])


class MedianImputerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(_number(c), F.lit(m)) for c, m in zip(self["cols"], self["medians"])})


class ConstantImputer(_Step):
    """Missing values become ``value``; with ``create``, columns that are absent are added."""

    defaults = {"cols": [], "value": 0.0, "create": True}

    def _transform(self, df: DataFrame) -> DataFrame:
        v = F.lit(self["value"])
        return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c in self["cols"]
                               if c in df.columns or self["create"]})


class Log1p(_Step):
    """log(1 + max(x, 0)); null, NaN and infinite values count as 0."""

    defaults = {"cols": []}

    def _transform(self, df: DataFrame) -> DataFrame:
        from ..functions import clean
        return df.withColumns({c: clean.log1p_safe(c) for c in self["cols"]})


class Standardizer(_Stage):
    """(x - mean) / population standard deviation; a constant column is only centred."""

    defaults = {"cols": [], "suffix": ""}

    def _fit(self, df: DataFrame) -> "StandardizerModel":
        cols = self["cols"]
        row = df.agg(*[f(_number(c)) for c in cols for f in (F.avg, F.stddev_pop)]).first() if cols else ()
        pairs = [(float(row[2 * i] or 0.0), float(row[2 * i + 1] or 0.0) or 1.0) for i in range(len(cols))]
        return StandardizerModel(cols=cols, suffix=self["suffix"], scale=pairs)


class StandardizerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c + self["suffix"]: (_number(c) - F.lit(m)) / F.lit(s)
                               for c, (m, s) in zip(self["cols"], self["scale"])})


# --- text -----------------------------------------------------------------------------------------

def _folding() -> tuple[str, str]:
    """Accented letters and their plain letter, from Unicode's own decompositions, then the
    combining accents, which are dropped."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in range(0xC0, 0x250)]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()
WORD = r"[\p{L}\p{N}_]{2,}"


def terms_of(c: str, strip_accents: bool, stopwords: bool) -> Column:
    """Words of two or more characters, then the pairs of neighbours, in lower case; stop words
    are removed before pairing."""
    t = F.lower(F.coalesce(F.col(c), F.lit("")))
    if strip_accents:
        t = F.translate(t, ACCENTED, PLAIN)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(rules.STOP_WORDS))
    return words


def term_column(c: str, strip_accents: bool, stopwords: bool) -> Column:
    """All terms of a text in one array: the words, then the pairs of neighbours."""
    def with_pairs(w):
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b)))

    # bound to a variable, so that the words are taken from the text once
    return F.get(F.transform(F.array(terms_of(c, strip_accents, stopwords)), with_pairs), F.lit(0))


class TfIdf(_Stage):
    """TF-IDF with the usual settings: unigrams and bigrams; a vocabulary of the ``max_features``
    most frequent terms (ties by term) whose document frequency lies between ``min_df`` rows and
    the share ``max_df`` of all rows; idf = ln((1 + n) / (1 + df)) + 1; term frequency plain or
    1 + ln(tf); rows scaled to length 1. With ``components`` also a truncated SVD of the matrix.

    The vocabulary table (term, place, doc_freq, total, idf and, with components, the term's row of
    V) is bounded by ``max_features`` and may be broadcast."""

    defaults = {"key": "job_id", "col": "text", "out": "text_svd", "max_features": 300, "min_df": 1, "max_df": 1.0,
                "sublinear": False, "strip_accents": False, "stopwords": False, "components": 0}

    def _fit(self, df: DataFrame) -> "TfIdfModel":
        model = self._with_vocabulary(df)
        if self["components"]:
            model._decompose(model.entries(df))
        return model

    def fit_transform(self, df: DataFrame) -> tuple["TfIdfModel", DataFrame]:
        """The fitted model and ``df`` with its projection; the rows are weighed once for both."""
        if not self["components"] or repeated(df, self["key"]):
            model = self.fit(df)
            return model, model.transform(df)
        model = self._with_vocabulary(df)
        d = write_back(model._weigh(df, True), "tfidf-entries")
        model._decompose(d.select(self["key"], "place", "w"))
        return model, model._projected(d)

    def _with_vocabulary(self, df: DataFrame) -> "TfIdfModel":
        key = self["key"]
        df = df.select(key, self["col"])
        n = df.count()
        t = self._term_counts(df)
        t = t.where((F.col("doc_freq") >= self["min_df"]) & (F.col("doc_freq") <= F.lit(self["max_df"] * n)))
        top = t.orderBy(F.desc("total"), "term").limit(self["max_features"])
        place = F.row_number().over(Window.orderBy("term")) - 1  # at most max_features rows
        vocab = top.select("term", place.cast("int").alias("place"), "doc_freq", "total",
                           (F.log(F.lit(n + 1.0) / (F.col("doc_freq") + 1)) + 1).alias("idf"))
        return TfIdfModel({"vocabulary": write_back(vocab, "tfidf-vocabulary")}, **self.getOrDefault("settings"))

    def _term_counts(self, df: DataFrame) -> DataFrame:
        """(term, doc_freq, total). A row's terms are counted inside the row (equal terms are
        neighbours in the sorted array), so that only terms with their sums are shuffled; where a
        key repeats, its rows are first counted together."""
        key, text = self["key"], term_column(self["col"], self["strip_accents"], self["stopwords"])
        if repeated(df, key):
            rows = df.select(key, F.explode(text).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        else:
            # no filter on the arrays before they are exploded: it would be evaluated beside them, on the text
            d = df.select(F.sort_array(text).alias("_s"))
            first = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), lambda i: (i == 1) | (
                F.get(F.col("_s"), i - 1) != F.get(F.col("_s"), i - 2)))
            d = d.select("_s", first.alias("_i"), F.size("_s").alias("_n"))
            ends = F.concat(F.slice("_i", 2, F.size("_i")), F.array(F.col("_n") + 1))
            runs = F.zip_with("_i", ends, lambda a, b: F.struct(F.get(F.col("_s"), a - 1).alias("term"), (b - a).alias("tf")))
            rows = d.select(F.inline(runs)).where(F.col("term").isNotNull())
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total"))


def repeated(df: DataFrame, key: str) -> bool:
    """Whether a key (null included) stands in more than one row."""
    return not df.groupBy(key).count().where("count > 1").isEmpty()


class TfIdfModel(_Fitted):
    def weights(self, df: DataFrame) -> DataFrame:
        """(key, term, place, w): the non-zero entries of the scaled matrix."""
        key = self["key"]
        d = self.entries(df).where(F.col(key).isNotNull()).select(key, F.explode(F.arrays_zip("place", "w")).alias("_e"))
        terms = F.broadcast(self.tables["vocabulary"].select("place", "term"))  # at most max_features rows
        return d.select(key, "_e.place", "_e.w").join(terms, "place").select(key, "term", "place", "w")

    def _vocabulary(self) -> list:
        return self.tables["vocabulary"].select("place", "term", "idf").orderBy("place").collect()  # max_features rows

    def _weigh(self, df: DataFrame, one: bool) -> DataFrame:
        """``df`` with place and w: the vocabulary terms of each row (each key, unless ``one`` row
        has it alone) in order and their weights, scaled to length 1."""
        key, vocab = self["key"], self._vocabulary()
        if not vocab:
            none = {"place": F.array().cast("array<int>"), "w": F.array().cast("array<double>")}
            return df.withColumns(none) if one else df.select(key).distinct().withColumns(none)
        d = df.withColumn("_t", term_column(self["col"], self["strip_accents"], self["stopwords"]))
        count = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], inputCol="_t", outputCol="_c")
        # the idf comes with each entry, from MLlib's product: a column of all of them would be copied a row
        scale = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in vocab]), inputCol="_c", outputCol="_d")
        d = scale.transform(count.transform(d)).withColumns({"_c": F.unwrap_udt("_c"), "_d": F.unwrap_udt("_d")}).drop("_t")
        place, n = F.col("_c.indices"), F.col("_c.values")
        idf = F.zip_with("_d.values", "_c.values", lambda x, n: x / n)
        if one:
            d = d.withColumns({"place": place, "_n": n, "_f": idf}).drop("_c", "_d")
        else:
            d = d.select(key, F.explode_outer(F.arrays_zip(place.alias("place"), n.alias("n"), idf.alias("f"))).alias("_e"))
            d = d.groupBy(key, "_e.place").agg(F.sum("_e.n").alias("n"), F.max("_e.f").alias("f"))
            d = d.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "n", "f")))).alias("_e"))
            d = d.select(key, F.col("_e.place").alias("place"), F.col("_e.n").alias("_n"), F.col("_e.f").alias("_f"))
        w = F.zip_with("_n", "_f", lambda x, f: (F.log(x) + 1 if self["sublinear"] else x) * f)
        d = d.withColumn("_w", w).drop("_n", "_f")
        norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x * x))
        # named twice, as a column named once would be put into the lambda and summed up again for each entry
        scaled = F.when(F.col("_l") > 0, F.transform("_w", lambda x: x / F.col("_l"))).otherwise(F.col("_w"))
        return d.withColumn("_l", norm).withColumn("w", scaled).drop("_w", "_l")

    def entries(self, df: DataFrame) -> DataFrame:
        """(key, place, w): per key its row of the scaled matrix as two arrays, empty without a known
        term. Rows with a key of their own are not shuffled."""
        d = df.select(self["key"], self["col"])
        return self._weigh(d, not repeated(d, self["key"])).select(self["key"], "place", "w")

    def vectors(self, df: DataFrame, ml: bool = False) -> DataFrame:
        """(key, vector): one sparse vector per row of ``df`` that holds a known term."""
        return self._as_vectors(self.entries(df), ml)

    def _as_vectors(self, entries: DataFrame, ml: bool = False) -> DataFrame:
        """The columns of a vector type are stored as MLlib stores them and read back with its schema,
        so that no row passes through Python."""
        from pyspark.ml.linalg import VectorUDT as MlVector
        from pyspark.mllib.linalg import VectorUDT
        key = self["key"]
        size = self.tables["vocabulary"].count()
        d = entries.select(key, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                                         F.col("place").alias("indices"), F.col("w").alias("values")).alias("vector"))
        from ..session import scratch_path
        import uuid
        path = scratch_path(d.sparkSession, f"tfidf-vectors-{uuid.uuid4().hex[:12]}")
        d.write.parquet(path)
        schema = T.StructType([d.schema[key], T.StructField("vector", MlVector() if ml else VectorUDT())])
        return d.sparkSession.read.schema(schema).parquet(path).where(F.size(F.unwrap_udt("vector")["indices"]) > 0)

    def _decompose(self, entries: DataFrame) -> None:
        """Adds the truncated SVD of the matrix with the rows ``entries`` (key, place, w)."""
        vocab, k = self.tables["vocabulary"], self["components"]
        width = vocab.count()
        singular, v = local_svd(self._as_vectors(entries), width, k) if width < 100 or 2 * k > width else svd(entries, width, k)
        rows_of_v = vocab.sparkSession.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "place int, v array<double>")
        self.tables["vocabulary"] = write_back(vocab.join(F.broadcast(rows_of_v), "place"), "tfidf-vocabulary")
        self._set(settings={**self.getOrDefault("settings"), "singular": singular.tolist()})

    def columns(self) -> list[str]:
        return [f"{self['out']}_{i:03d}" for i in range(1, self["components"] + 1)]

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds the SVD projection; rows without a known term or key lie at the origin. A table that has
        the columns already (projected earlier, as for variants of one request) keeps them."""
        key, names = self["key"], self.columns()
        if set(names) <= set(df.columns):
            return df
        if not repeated(df, key):
            return self._projected(self._weigh(df, True))
        d = self._with_product(self._weigh(df.select(key, self["col"]), False))
        return df.join(d.select(key, "_p"), key, "left").select(*df.columns, *self._components())

    def _with_product(self, d: DataFrame) -> DataFrame:
        key, rows_of_v = self["key"], self.tables["vocabulary"].select("place", "v").orderBy("place").collect()
        project = projection([r["v"] for r in rows_of_v], self["components"])
        return d.withColumn("_p", F.when(F.col(key).isNotNull(), project("place", "w")))

    def _components(self) -> list[Column]:
        return [F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(self.columns())]

    def _projected(self, weighed: DataFrame) -> DataFrame:
        """Weighed rows, one a key, with their projection instead of the weights."""
        d = self._with_product(weighed).drop("place", "w")
        return d.select(*[c for c in d.columns if c != "_p"], *self._components())


def projection(rows_of_v: list, k: int):
    """Arrow-batched product of a sparse row, given as places and weights, with the factor V."""
    v = np.array(rows_of_v, dtype=float).reshape(-1, k)

    @F.arrow_udf("array<double>")
    def project(place: pa.Array, w: pa.Array) -> pa.Array:
        out = np.zeros((len(place), k))
        i, x = place.flatten().to_numpy(), w.flatten().to_numpy()
        end = np.cumsum(place.value_lengths().fill_null(0).to_numpy())
        for r, (s, e) in enumerate(zip(np.concatenate([[0], end[:-1]]), end)):
            if e > s:
                out[r] = x[s:e] @ v[i[s:e]]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * k, pa.int32()), pa.array(out.ravel()))

    return project


GRAM_ROWS = 64


def gram(entries: DataFrame, width: int):
    """The Gram matrix (width x width) of sparse rows (place, w). Each task adds its rows up in one
    matrix, equal rows of a batch at once; the matrices are added band by band on the executors, one
    band of upper-triangle rows a key, whatever the number of rows. At most one task per core."""
    def add(batches):
        g = np.zeros((width, width))
        for b in batches:
            place, w = b.column("place"), b.column("w")
            i, x = place.flatten().to_numpy(), w.flatten().to_numpy()
            cut = place.offsets.to_numpy() - place.offsets[0].as_py()
            same: dict = {}
            for s, e in zip(cut[:-1], cut[1:]):
                k = (i[s:e].tobytes(), x[s:e].tobytes())
                same[k] = same.get(k, 0) + 1
            for (ki, kx), n in same.items():
                at, v = np.frombuffer(ki, i.dtype), np.frombuffer(kx, x.dtype)
                g[at[:, None], at] += np.outer(n * v, v)
        for s in range(0, width, GRAM_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([g[s:s + GRAM_ROWS, s:].tobytes()], pa.binary())],
                                             ["band", "sums"])

    def total(t: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_buffer()) for x in t.column("sums"))
        return pa.table({"band": pa.array([t.column("band")[0].as_py()], pa.int32()), "sums": pa.array([out.tobytes()], pa.binary())})

    schema = "band int, sums binary"
    parts = entries.select("place", "w").coalesce(entries.sparkSession.sparkContext.defaultParallelism).mapInArrow(add, schema)
    g = np.zeros((width, width))
    for r in parts.groupBy("band").applyInArrow(total, schema).toLocalIterator():
        s = r["band"]
        g[s:s + GRAM_ROWS, s:] = np.frombuffer(r["sums"]).reshape(-1, width - s)
    for s in range(0, width, GRAM_ROWS):  # the lower triangle
        g[s + GRAM_ROWS:, s:s + GRAM_ROWS] = g[s:s + GRAM_ROWS, s + GRAM_ROWS:].T
    return g


def leading(g, k: int, tol: float = 1e-12):
    """(k largest eigenvalues in falling order, their vectors) of a symmetric matrix. Small ones are
    solved whole; for large ones a block of a few more than k vectors is multiplied and projected
    until every wanted pair fits to ``tol`` of the largest value."""
    def ritz(q):
        w, u = np.linalg.eigh(q.T @ (g @ q))
        return w[::-1], q @ u[:, ::-1]

    n = len(g)
    if n > max(1_000, 8 * k):
        x = np.random.default_rng(0).normal(size=(n, k + 20))
        for _ in range(60):
            block = [np.linalg.qr(x)[0]]
            for _ in range(3):
                block.append(np.linalg.qr(g @ block[-1])[0])
            w, u = ritz(np.linalg.qr(np.concatenate(block, axis=1))[0])
            x = u[:, :k + 20]
            if np.linalg.norm(g @ x[:, :k] - x[:, :k] * w[:k], axis=0).max() <= tol * max(w[0], 1e-300):
                return w[:k], x[:, :k]
    w, u = np.linalg.eigh(g)
    return w[::-1][:k], u[:, ::-1][:, :k]


def local_svd(vectors: DataFrame, width: int, k: int):
    """``svd`` by MLlib, for widths at which it takes the Gram matrix in one pass by itself: under 100
    or under 2 k. Beyond, it would run a job for every step of an iteration."""
    from pyspark.mllib.linalg.distributed import RowMatrix

    if width == 0 or vectors.isEmpty():
        return np.zeros(k), np.zeros((width, k))
    got = RowMatrix(vectors.select("vector")).computeSVD(min(k, width), computeU=False)
    return _signed(got.s.toArray(), got.V.toArray(), width, k)


def _signed(found, right, width: int, k: int):
    values, v = np.zeros(k), np.zeros((width, k))
    sign = np.sign(right[np.abs(right).argmax(axis=0), np.arange(len(found))])
    values[:len(found)], v[:, :len(found)] = found, right * sign
    return values, v


def svd(entries: DataFrame, width: int, k: int):
    """(k singular values, width x k right factor) of the sparse rows ``entries`` (place, w), from
    the eigenvectors of their Gram matrix, which one pass adds up on the executors and the driver
    solves (width squared numbers, whatever the number of rows). The largest entry of each component
    is made positive; components beyond the rank are 0."""
    if width == 0:
        return np.zeros(k), np.zeros((width, k))
    found, right = leading(gram(entries, width), min(k, width))
    ok = found > max(found[0], 0.0) * max(width, 100) * np.finfo(float).eps
    return _signed(np.sqrt(found[ok]), right[:, ok], width, k)
