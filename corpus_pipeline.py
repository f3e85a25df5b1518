"""A training-data pipeline over the documents table; each stage works on all rows that its predecessor kept.

Every stage but the last returns the columns of ``documents``. Null and empty texts pass all filters that do not judge
them: they score as the labelled average, are no near duplicates, hold no entities, weigh no words, and pack as their
end id alone. Rows with a null id pass, too. Repeated rows are near duplicates with one id, and stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.llm import jaccard, mixing, packing, quality, surrogates
from tillbook.llm.common import table
from tillbook.session import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; its labels come from the labelled documents of ``docs``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 80 % of common five-word shingles."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data exchanged in the text; ``n_chars``, where there is one, counts the new text."""
    replaced = surrogates.replace_entities(docs)
    if "n_chars" not in docs.columns:
        return replaced
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return replaced.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order (not at all beyond their source's target)."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and their place in it; a document taken twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("PII surrogates", with_surrogates),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

# The classifier and the tokens are not expressible in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
