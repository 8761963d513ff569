"""Reading: typed CSV ingest, event scans, note files, embeddings, pair lists, run metrics."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import blank_to_null


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def list_dir(spark: SparkSession, path: str, suffix: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def read_csv_text(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column text; doubled quotes are kept.

    A file with line breaks inside quotes needs ``multi_line``, which makes one task read a whole file; all
    other files are split.
    """
    return spark.read.options(header=True, multiLine=multi_line, escape='"', inferSchema=False).csv(path)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to the schema; blanks and unreadable values become null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (blank_to_null(F.col(have[f.name.lower()])).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def ingest_csv_dir(spark: SparkSession, csv_dir: str, out_dir: str, schemas: Mapping[str, T.StructType] | None = None, multi_line: Sequence[str] = ()) -> list[str]:
    """Every ``*.csv`` of a folder becomes one Parquet table named after the file; returns the names.

    ``multi_line`` names the tables whose quoted texts hold line breaks.
    """
    names = []
    for path in list_dir(spark, csv_dir, ".csv"):
        name = os.path.basename(path)[: -len(".csv")]
        df = read_csv_text(spark, path, name in multi_line)
        if schemas and name in schemas:
            df = typed(df, schemas[name])
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        names.append(name)
    return names


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Only the named columns of a CSV, typed; filters and partial sums run inside the scan stage."""
    return typed(read_csv_text(spark, path), schema)


def scan_events(
    events: DataFrame, item: str, items: Sequence, value: str, columns: Sequence[str], ids: DataFrame | None = None, on: str | None = None
) -> DataFrame:
    """Needed columns of the wanted items with a value, for the ids of a cohort."""
    df = events.where(F.col(item).isin(list(items)) & F.col(value).isNotNull()).select(*columns)
    return df.join(ids.select(on), on, "left_semi") if ids is not None else df


def scan_inputs_union(sources: Sequence[tuple[DataFrame | None, Sequence[str]]], key: str, amount: str) -> DataFrame:
    """Union of sources whose time column differs: per source the first listed time column it has."""
    parts = []
    for df, times in sources:
        if df is None:
            continue
        ts = next(c for c in times if c in df.columns)
        parts.append(df.select(key, F.col(ts).alias("ts"), F.col(amount).cast("double").alias("amount")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_note_files(spark: SparkSession, paths: Sequence[str], required: Sequence[str], text: str) -> DataFrame:
    """All existing note files as one frame; missing files are skipped, empty texts dropped."""
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        raise FileNotFoundError("none of the note files exists")
    frames = []
    for p in present:
        df = read_csv_text(spark, p, multi_line=True)  # notes hold line breaks
        lacking = [c for c in required if c not in df.columns]
        if lacking:
            raise ValueError(f"{p} lacks columns {lacking}")
        frames.append(df.select(*required))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(F.length(F.trim(F.col(text))) > 0)


def read_feature_metadata(path: str, columns: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column lists of a feature file; without a metadata file, columns ending in ``_measured``."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as fh:
            meta = json.load(fh)
        return {k: list(meta.get(k, [])) for k in ("id_cols", "measured_cols", "numeric_cols", "categorical_cols")}
    return {
        "id_cols": [], "measured_cols": [c for c in columns if c.endswith("_measured")], "numeric_cols": [], "categorical_cols": [],
    }


def read_embeddings(vectors: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """Vectors with the ids of their index; both sides must have the same number of rows."""
    n_vectors, n_index = vectors.count(), index.count()
    if n_vectors != n_index:
        raise ValueError(f"{n_vectors} vectors for {n_index} index rows")
    return vectors.join(index, on, "inner")


def parse_interactions(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines ``A & B: score`` to (a, b, score); other lines are skipped."""
    head = F.trim(F.split_part(F.col(line), F.lit(":"), F.lit(1)))
    sides = F.split(head, " & ")
    return lines.where(F.col(line).contains(" & ") & (F.size(sides) == 2)).select(
        sides[0].alias("a"), sides[1].alias("b"),
        F.trim(F.regexp_extract(F.col(line), r":\s*([-0-9.eE]+)\s*$", 1)).try_cast("double").alias("score"),
    )


def read_interaction_list(spark: SparkSession, path: str, top_n: int | None = None) -> DataFrame:
    """Pairs of a list file; ``top_n`` keeps the first ones in file order."""
    lines = spark.read.text(path)
    if top_n is None:
        return parse_interactions(lines)
    # scan partitions are not in file order: file, block and place in the block are
    at = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    ordered = lines.select("value", *[c.alias(f"__at{i}") for i, c in enumerate(at)]).where(F.col("value").contains(" & "))
    return parse_interactions(ordered.orderBy("__at0", "__at1", "__at2").limit(top_n))


def passing_runs(runs: DataFrame, threshold: float = 0.5, strict: bool = False, file: str = "file") -> DataFrame:
    """Folders of the runs whose precision, recall and F1 all reach (or exceed) the threshold."""
    numbers = [F.col(c).try_cast("double") for c in ("precision", "recall", "f1")]
    worst = F.least(*numbers)
    # least() skips nulls, so an unreadable metric must be ruled out on its own.
    known = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    good = worst > threshold if strict else worst >= threshold
    folder = F.regexp_replace(F.trim(F.col(file)), r"/[^/]*$", "")
    return runs.where(known & good & (F.trim(F.col(file)) != "")).select(folder.alias("dir")).distinct()


def read_run_metrics(spark: SparkSession, paths: Sequence[str], threshold: float = 0.5, strict: bool = False) -> DataFrame:
    return passing_runs(read_csv_text(spark, list(paths)), threshold, strict)
