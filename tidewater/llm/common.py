"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (as in tests) a temporary folder is taken and set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = os.path.join(shared_dir(df.sparkSession), f"tidewater-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over: it does so once their plans are collected as garbage on the driver,
    which otherwise may come long after a chain of jobs has filled the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def free(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that none of ``columns`` has, case aside."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a table that ``saved`` wrote and that nothing will read again."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("tidewater-"):
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether ``crc32(id as text) mod folds`` is ``fold``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (an array of one element carries it)."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def bounded_sample(labels: DataFrame, id_col: str, rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` rows at most, the same ones each time (a threshold on a hash of the id)."""
    n = labels.count()
    if n <= rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(1_000_000 * rows / n))
