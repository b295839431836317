"""Tables in the session's shared scratch folder: plain ones, and ones bucketed so that later joins and aggregates need no shuffle."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a plain local session may go without the setting; it gets a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    given = tempfile.mkdtemp(prefix="vellum-")
    atexit.register(shutil.rmtree, given, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", given)
    return given


def path_of(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/vellum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its lineage is cut, and its size is known to the planner, which broadcasts it only if it is small."""
    path = path_of(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str, order: str) -> DataFrame:
    """``df`` written in ``buckets`` files by the hash of ``key``, each sorted by ``order``. ``df`` must be partitioned by that key and number already
    (``repartition(buckets, key)``), so that each task writes one file. Zstandard: large tables of text take a third less than with Spark's default."""
    spark = df.sparkSession
    table = f"vellum_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(order).option("path", path_of(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a version of the files at ``path``: the number of bytes and the last change."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary, status = system.getContentSummary(where), system.getFileStatus(where)
    return (path, summary.getLength(), summary.getFileCount(), status.getModificationTime())
