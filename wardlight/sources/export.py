"""Writing: versioned feature folders, tensors, and summary tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the storage the cluster shares; without the setting, a local one in a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-")


def write_features(df: DataFrame, base: str, version: str | None = None) -> str:
    """Write a feature frame as its own version; earlier versions stay readable next to it."""
    path = f"{base.rstrip('/')}/version={version or uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_tensor(df: DataFrame, base: str, version: str | None = None) -> str:
    """Nested arrays keyed by entity id; no positional index is needed to read them back."""
    return write_features(df, base, version)


def summary_report(df: DataFrame, category: str | None = None) -> DataFrame:
    """(item, key, n): rows, columns, missing cells in all, and rows per category; one scan."""
    missing = sum((F.col(c).isNull().cast("long") for c in df.columns[1:]), F.col(df.columns[0]).isNull().cast("long"))
    keys = [category] if category else []
    part = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(missing).alias("missing"))
    overall = part.agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    report = overall.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("item"), F.lit("").alias("key"), F.col("rows").alias("n")),
                F.struct(F.lit("columns").alias("item"), F.lit("").alias("key"), F.lit(len(df.columns)).cast("long").alias("n")),
                F.struct(F.lit("missing").alias("item"), F.lit("").alias("key"), F.coalesce("missing", F.lit(0)).alias("n")),
            )
        ).alias("r")
    ).select("r.*")
    if category:
        report = report.unionByName(
            part.select(F.lit("category").alias("item"), F.coalesce(F.col(category).cast("string"), F.lit("")).alias("key"), F.col("rows").alias("n"))
        )
    return report
