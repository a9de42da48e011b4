"""The corpus pipeline: five operators over documents, each on what its predecessor kept.

quality -> toxicity -> near duplicates -> repeated passages -> packing. Every stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results in every stage: null and empty texts are documents like any other (the quality rules
reject them); repeated rows share a fate, but near-duplicate detection keeps one of equal (id, text)
rows; rows without an id are only compared as equal rows; columns beyond doc_id and text are passed
on whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm import packing, quality, simhash, substring, toxicity

#: The classifiers' verdicts and the token boundaries of BPE cannot be expressed in SQL.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with neutral names for all columns but doc_id and text, and the columns that give the names back."""
    own = {c: c if c in ("doc_id", "text") else f"__column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), [F.col(v).alias(k) for k, v in own.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose calibrated quality is at least 0.5."""
    plain, names = _plain(docs)
    model = quality.fit(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality(plain, model).where("kept").select(names)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    plain, names = _plain(docs)
    model = toxicity.fit(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(plain, model).where("predicted = 0").select(names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies (5-word shingles, similarity 0.8)."""
    plain, names = _plain(docs)
    found = simhash.near_duplicates(plain, size=5, similarity=0.8)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return plain.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word windows that stand earlier in the corpus; texts that lose nothing stay as they are."""
    plain, names = _plain(docs)
    cut = substring.substring_dedup(plain, 20)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        own = f"__column_{docs.columns.index('n_chars')}"
        cut = cut.withColumn(own, F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return cut.select(names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is checkpointed for the next one."""
    from navloom.session import ready

    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
