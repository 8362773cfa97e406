"""Sources and sinks: CSV with ragged rows, JSON, Parquet, several named sources, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.metrics import Blocked
from tidewater.operators.ranking import written


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(rows, over-wide rows)``. All columns are strings; fields beyond the header are ignored, not shifted in, and quoted fields may hold newlines and delimiters.

    One pass reads rows and counts: the reader hands out what it could not fit to the header, and in those records the fields outside quotes are counted.
    """
    reader = lambda: spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    header = reader().csv(path).columns
    bad = "bad"
    while bad in header:
        bad += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, bad]])
    rows = written(reader().schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", True).csv(path))
    bare = F.regexp_replace(F.col(f"`{bad}`"), r'"(?:[^"]|"")*"', "")
    wide = rows.where(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(header)).count()
    return rows.drop(bad), wide


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or one object as one row."""
    return spark.read.option("multiLine", True).json(path)


def read_sources(spark: SparkSession, sources: list[dict]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Named sources ({name, type, path}); unreadable or empty ones are reported and skipped. Blocked if none is left."""
    out, issues = {}, []
    for s in sources:
        try:
            kind = s.get("type", "csv")
            df = read_csv(spark, s["path"])[0] if kind == "csv" else read_json(spark, s["path"]) if kind == "json" else spark.read.format(kind).load(s["path"])
            if df.limit(1).count() == 0:
                issues.append((s["name"], "empty"))
                continue
            out[s["name"]] = df
        except Exception as e:  # a source that cannot be read is an issue to report, whatever its reader raises
            issues.append((s["name"], type(e).__name__))
    if not out:
        raise Blocked("no source could be read")
    return out, issues


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """For masked tables only: the caller masks first."""
    df.write.mode("overwrite").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """A dated copy of what a run reads, one partition per run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
