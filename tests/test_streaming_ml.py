"""Streaming cleaner and TF-IDF weights."""

import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from hiresight.sources.schemas import SCHEMAS
from hiresight.streaming.ingest import clean_postings_stream


def _postings(spark, ids):
    rows = [(i, None, "Dev", None, "Austin, TX", 1.0 if i % 2 else None, None, "Full-time",
             50_000.0 * (i % 3), "YEARLY", "USD", 10.0, 2.0, 0, None) for i in ids]
    return spark.createDataFrame(rows, SCHEMAS["postings"])


def test_stream_cleans_each_file_once(spark):
    root = tempfile.mkdtemp(prefix="hs-stream-")
    src, sink, ckpt = (os.path.join(root, x) for x in ("src", "sink", "ckpt"))
    _postings(spark, range(0, 10)).write.parquet(os.path.join(src, "batch1"))
    # the source is the folder of batches: point the stream at the files themselves
    files_dir = os.path.join(root, "landing")
    os.makedirs(files_dir)
    for f in os.listdir(os.path.join(src, "batch1")):
        if f.endswith(".parquet"):
            os.rename(os.path.join(src, "batch1", f), os.path.join(files_dir, "a-" + f))
    clean_postings_stream(spark, files_dir, sink, checkpoint=ckpt)
    first = spark.read.parquet(sink)
    assert first.count() == 10
    _postings(spark, range(10, 15)).write.parquet(os.path.join(src, "batch2"))
    for f in os.listdir(os.path.join(src, "batch2")):
        if f.endswith(".parquet"):
            os.rename(os.path.join(src, "batch2", f), os.path.join(files_dir, "b-" + f))
    clean_postings_stream(spark, files_dir, sink, checkpoint=ckpt)
    out = spark.read.parquet(sink)
    assert out.count() == 15 and out.select("job_id").distinct().count() == 15
    r = out.where("job_id = 3").first()
    assert r.state == "TX" and r.remote_allowed == 1 and r.normalized_salary is None  # 0 salary dropped
    assert r.formatted_experience_level == "Unknown"


def test_tfidf_matches_smoothed_formula(spark):
    from hiresight.plans.clustering import tfidf
    docs = ["data engineer", "senior data engineer", "nurse", "registered nurse", "data analyst",
            "senior nurse", "data engineer", "sales manager", "data manager", "nurse manager"]
    df = spark.createDataFrame(list(enumerate(docs)), "job_id long, t string")
    vec, vocab, _ = tfidf(df, "t", max_features=50, min_df=2)
    n = len(docs)
    toks = [d.split() for d in docs]
    terms = [t + [" ".join(p) for p in zip(t, t[1:])] for t in toks]
    dfreq = {w: sum(w in ts for ts in terms) for w in vocab}
    idf = {w: math.log((1 + n) / (1 + dfreq[w])) + 1 for w in vocab}
    for r in vec.collect():
        raw = np.array([terms[r.job_id].count(w) * idf[w] for w in vocab])
        exp = raw / np.linalg.norm(raw) if np.linalg.norm(raw) > 0 else raw
        assert np.allclose(r.tfidf.toArray(), exp, atol=1e-9)
