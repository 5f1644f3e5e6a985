"""A training corpus in five stages; each reads what the one before wrote.

Stages 1 to 4 return the columns of ``documents``; the last returns the documents that the mix takes with their copies. The quality classifier
and the entropy-balanced mix have no SQL form, so the pipeline as a whole has none; the stages are tested one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import stored, table
from tracefold.llm.decontaminate import remove_contaminated
from tracefold.llm.jaccard_join import one_of_each
from tracefold.llm.line_dedup import delete_repeated_lines
from tracefold.llm.mixing import mix
from tracefold.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged by their shape alone; without labels all stay; repeated rows fare alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; a document of nothing else goes. ``n_chars`` follows the text. Null and empty texts stay."""
    out = delete_repeated_lines(docs, names=("_lines", "_removed", "_longest"))
    left = (F.col("_removed") == 0) | (F.trim("text") != "")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.where(left).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8): the smallest key. Texts without words and rows without a key stay."""
    return one_of_each(docs, width=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go. Null and empty texts, and all documents where the benchmark is empty, stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with ``size, target`` (of the source), ``copies`` and ``taken`` (words); these replace columns of the same names."""
    plan = mix(docs).where("copies > 0").select(F.col("key").alias("_mix_key"), F.col("rank").alias("_mix_hash"), "size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    hashed = docs.drop("size", "target", "copies", "taken").withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return hashed.join(plan, hashed["doc_id"].eqNullSafe(plan["_mix_key"]) & (hashed["_text_hash"] == plan["_mix_hash"])).drop("_mix_key", "_mix_hash", "_text_hash")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing to target weights", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
