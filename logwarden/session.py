"""Session settings and the shared working folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app_name: str = "logwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Adaptive execution sizes shuffles from what a stage really wrote, so
    ``spark.sql.shuffle.partitions`` is only the starting point; on a cluster
    pass it (and memory settings) through ``conf`` or spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        # collect_set/collect_list groups fall back to sorting after this many
        # keys per task; the default of 128 is far below a real task's group count
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()
_local_folders: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever their working folder: its sources go to every executor, once
    per application. The driver's ``sys.path`` is not theirs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "logwarden.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in sorted(os.walk(home)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    A local temporary folder is used only in local mode with the setting absent
    (tests); a cluster without it is an error, because a machine-local folder
    would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return _local_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/logwarden/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def spread(df: DataFrame, rows_a_task: int = 50_000, always: bool = False) -> DataFrame:
    """Use all cores on an input that few tasks would read: tasks of at most ``rows_a_task`` rows, one per core at least.

    Splits say little: a split of a Parquet file in which no row group starts has no rows, and a row group of a million
    rows is one task whatever the number of cores. So the rows of every split are counted (Parquet gives them from its
    footers). An input that keeps all cores busy is left alone, without a shuffle; with ``always`` (narrow rows with much
    work each) only if its tasks are no larger than twice that many rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    busy, most, rows = split.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if busy >= cores and not (always and most > 2 * rows_a_task):
        return df
    return df.repartition(max(cores, -(-rows // rows_a_task)))


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage at a fork: write the table to the shared folder and read it back.

    Several outputs hang off the classified events; writing them once means
    neither a second consumer nor a lost executor parses the raw lines again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once_per_session(build: Callable) -> Callable:
    """Remember the column expressions a function builds.

    Columns are unresolved trees that fit any DataFrame with the named columns.
    Building the large ones takes thousands of calls into the JVM, which is
    worth doing once per Spark context. Arguments must be hashable.
    """
    kept: dict = {}

    @functools.wraps(build)
    def cached(*args, **kwargs):
        key = (id(SparkContext._active_spark_context), args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = build(*args, **kwargs)
        return kept[key]

    return cached
