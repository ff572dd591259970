"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "hiresight",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    On a cluster ``master`` stays None and the launcher decides; local runs pass ``local[N]``.
    AQE re-plans joins and coalesces shuffle partitions at runtime; the session zone is UTC so
    epoch conversions agree with the SQL oracle.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A ``local`` master that names none (tests) gets a private scratch folder; anywhere else a
    machine's own folder would be invisible to the other machines, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        d = tempfile.mkdtemp(prefix="hiresight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def write_back(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and return it read back.

    Cuts the lineage (a lost executor re-reads the files instead of recomputing the plan) and,
    unlike ``Dataset.checkpoint``, computes the plan once. For intermediate results that
    several later steps read, such as per-value histograms.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(df, key: str | None = None):
    """Hash-repartition ``df`` when it is stored in fewer files than the cluster has cores (a
    small file with one row group feeding CPU-heavy work such as regexes over whole texts).
    Only the plan changes; inputs in many files, as any large input is, pass untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


ROWS_A_TASK = 250_000


def bounded_tasks(df, rows: int = ROWS_A_TASK):
    """``df``, a stored table, in tasks of at most about ``rows`` rows each. Narrow rows are packed by the
    million into one scan task, whose files are small but whose rows in memory are not. Only tables
    with more rows a task are dealt out again."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path's scheme, so shared
    checkpoint folders on HDFS or object stores work like local ones."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
