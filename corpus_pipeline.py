"""A corpus pipeline out of the operators of wardlight.llm.

Each stage takes what the one before it kept. What one stage decides takes effect: rejected and repeated
documents go, test passages leave the texts, personal data is replaced, and the last stage packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import decontam, jaccard, packing, pii, quality
from wardlight.llm.queries import quality_model, table
from wardlight.llm.storage import keep

ACCEPT = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below ``ACCEPT`` go. Columns stay as they are."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, "text", model, ACCEPT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts stays: the one with the smallest id (null last), then the smallest text key.

    Every row counts by its own text, so rows that share an id or have none lose nothing to each other but copies.
    """
    rows = keep(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = keep(jaccard.similar(rows, "__row", "text").select(F.col("id").alias("__row"), "component"))
    several = found.join(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component")
    several = several.join(rows.select("__row", "doc_id", F.xxhash64("text").alias("h")), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "__row"))
    gone = several.join(several.groupBy("component").agg(first.alias("first")), "component").where(F.col("__row") != F.col("first.__row"))
    return rows.join(gone.select("__row"), "__row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark leave the texts; ``n_chars`` follows."""
    return decontam.cleaned(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("n_chars", F.length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms of the same format; ``n_chars`` follows."""
    out = pii.pseudonymize(docs, "text", found_col="__found").drop("__found")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a text, with its sequence and place there."""
    import public_tokenizers

    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: trained scores, tokenizers and keyed permutations cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs)
    return docs
