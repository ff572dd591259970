"""Q07: title clusters. TF-IDF of cleaned titles (unigrams + bigrams after stop-word removal,
vocabulary = most frequent terms with a minimum document frequency, idf = ln((1+n)/(1+df)) + 1,
L2-normalised rows), k-means with several seeds keeping the lowest cost, clusters named by their
centroid's top terms, then the usual profile statistics per cluster."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (IDF, PCA, CountVectorizer, ElementwiseProduct, NGram, Normalizer,
                                RegexTokenizer, StopWordsRemover)
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import agg, mlstages, stats
from ..operators.joins import keep_labels
from ..session import bounded_tasks, write_back
from ..sources.tables import JobTables
from . import textual, views

N_CLUSTERS = 8
RESTARTS = 10
SAL = "normalized_salary"
EXPL = "formatted_experience_level"

_CACHE: dict = {}
_LOCK = threading.Lock()


def tfidf(rows: DataFrame, col: str, max_features: int = 300, min_df: int = 5):
    """(vectors DataFrame with ``tfidf``, vocabulary list). Spark's IDF is ln((n+1)/(df+1));
    the +1 of the smoothed textbook form is added by an element-wise product."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=col, outputCol="_tok", pattern=r"\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="_tok", outputCol="_words"),
        NGram(n=2, inputCol="_words", outputCol="_bigrams"),
    ])
    d = pipe.fit(rows).transform(rows).withColumn("_terms", F.concat("_words", "_bigrams"))
    cvm = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_features, minDF=min_df).fit(d)
    d = cvm.transform(d)
    idfm = IDF(inputCol="_tf", outputCol="_unused").fit(d)
    scale = Vectors.dense(idfm.idf.toArray() + 1.0)  # vocabulary-sized
    d = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_w").transform(d)
    d = Normalizer(p=2.0, inputCol="_w", outputCol="tfidf").transform(d)
    return d.drop("_tok", "_words", "_bigrams", "_terms", "_tf", "_w"), list(cvm.vocabulary), idfm


def title_clusters(t: JobTables) -> dict:
    """Fit once per stored table set: {"assign": (job_id, cluster, cluster_label),
    "labels": (cluster, cluster_label), "vectors": (job_id, tfidf), "cost": best cost}."""
    key = (t.spark.sparkContext.applicationId, t.source)
    with _LOCK:
        if t.source is not None and key in _CACHE:
            return _CACHE[key]
    rows = textual.title_clean_rows(t)
    vec, vocab, _ = tfidf(rows, "title_clean")
    vec = write_back(vec.select("job_id", "tfidf"), "title-tfidf")

    # kept once for all restarts, which else keep a copy each, and in tasks of bounded size
    kept = bounded_tasks(vec).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(seed):
        return KMeans(k=N_CLUSTERS, seed=seed, featuresCol="tfidf", maxIter=50).fit(kept)

    try:
        with ThreadPoolExecutor(5) as ex:
            models = list(ex.map(fit, range(RESTARTS)))
    finally:
        kept.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    labels = []
    for i, c in enumerate(best.clusterCenters()):  # k x vocabulary numbers
        top = [vocab[j] for j in np.argsort(c)[::-1][:5]]
        labels.append((i, " / ".join(top[:3])))
    lab = t.spark.createDataFrame(labels, "cluster int, cluster_label string")
    assign = best.transform(vec).select("job_id", F.col("prediction").alias("cluster"))
    assign = write_back(assign.join(F.broadcast(lab), "cluster"), "title-clusters")
    out = {"assign": assign, "labels": lab, "vectors": vec, "cost": best.summary.trainingCost}
    if t.source is not None:
        with _LOCK:
            _CACHE[key] = out
    return out


def _clustered(t: JobTables) -> DataFrame:
    return title_clusters(t)["assign"].join(views.report_postings(t), "job_id")


def q07_1(t: JobTables) -> DataFrame:
    """Postings per title cluster."""
    return agg.count_by(title_clusters(t)["assign"], "cluster_label")


def q07_2(t: JobTables, n: int = 10_000) -> DataFrame:
    """2-D projection of a 10k sample: principal components of the centred TF-IDF vectors."""
    c = title_clusters(t)
    s = stats.sample_n(c["vectors"], "job_id", n, seed=42)
    mean = s.select(Summarizer.mean(F.col("tfidf")).alias("m")).first()["m"]  # vocabulary-sized
    from pyspark.ml.functions import array_to_vector, vector_to_array
    centred = s.withColumn("_c", array_to_vector(F.zip_with(
        vector_to_array("tfidf"), F.array(*[F.lit(float(x)) for x in mean.toArray()]), lambda a, b: a - b)))
    pca = PCA(k=2, inputCol="_c", outputCol="_pc").fit(centred)
    p = pca.transform(centred).withColumn("_a", vector_to_array("_pc"))
    return p.select("job_id", F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2")).join(
        c["assign"].select("job_id", "cluster", "cluster_label"), "job_id")


def q07_3(t: JobTables) -> DataFrame:
    """Median salary per title cluster."""
    return agg.median_by(_clustered(t), "cluster_label", SAL)


def q07_4(t: JobTables) -> DataFrame:
    """Cluster x experience level shares."""
    return agg.share_matrix(_clustered(t), "cluster_label", EXPL, cols=rules.EXPERIENCE_LEVELS)


def q07_5(t: JobTables) -> DataFrame:
    """Remote rate per title cluster."""
    return agg.rate_by(_clustered(t), "cluster_label", "remote_allowed")


def title_terms(t: JobTables) -> DataFrame:
    """Relational view of the fitted vocabulary: (term, document frequency, idf + 1)."""
    rows = textual.title_clean_rows(t)
    _, vocab, idfm = tfidf(rows, "title_clean")
    df_counts = idfm.docFreq
    idf = idfm.idf.toArray() + 1.0
    return t.spark.createDataFrame([(v, int(d), float(w)) for v, d, w in zip(vocab, df_counts, idf)],
                                   "term string, doc_freq long, idf double")


def title_svd(t: JobTables, k: int = 25) -> DataFrame:
    """Truncated SVD of the title TF-IDF matrix: singular values and the share of squared norm each
    component carries (rows have length 1, so the total is the number of rows with a known term)."""
    rows = textual.title_clean_rows(t)
    m = mlstages.TfIdf(col="title_clean", max_features=300, min_df=5, stopwords=True, components=k).fit(rows)
    total = m.vectors(rows).count()
    return t.spark.createDataFrame([(i + 1, float(v), float(v * v / total) if total else None)
                                    for i, v in enumerate(m["singular"])],
                                   "component int, singular_value double, norm_share double")
