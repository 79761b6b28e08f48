"""Shared-folder tables that cut lineage, and small column helpers.

Intermediate tables go below ``spark.checkpoint.dir`` (all executors see it),
so losing an executor costs the running tasks only.  ``drop_scratch`` removes
the tables of a session once its results are written.
"""
from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.session import ensure_checkpoint_dir

_WRITTEN: dict[str, list[str]] = {}
NULL_ID = -(2 ** 63)


def cut(df: DataFrame, name: str = "t", frees: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``frees``: earlier results of ``cut`` that nothing needs from now on; their
    files go.  The driver then collects its garbage, so that Spark's cleaner
    drops the shuffle files of the finished step while the job goes on.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    for old in frees:
        _drop(spark, {f.rsplit("/", 1)[0] for f in old.inputFiles()})
    _collect_garbage(spark)
    return spark.read.schema(schema).parquet(path)


def keep(spark: SparkSession, path: str) -> str:
    """Note ``path`` as a scratch table, so that ``drop_scratch`` removes it."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _collect_garbage(spark: SparkSession) -> None:
    """Twice, with a pause: the first run lets go of the finished query, whose
    end the listeners report a moment later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, paths) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables written by ``cut`` (call after results are stored)."""
    _drop(spark, [p.rsplit("/", 1)[0] for p in _WRITTEN.pop(spark.sparkContext.applicationId, [])])


def row_id(col: str = "doc_id") -> Column:
    """Join key of a row: a null id becomes the smallest long."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def public_id(col: str) -> Column:
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 512 rows, so that long texts stay bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
