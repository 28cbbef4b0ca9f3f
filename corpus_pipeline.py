"""From raw documents to packed sequences of tokens.

Each stage takes what its predecessor kept: bad documents go, of each group of near duplicates one stays, passages that an earlier
document has are cut out, personal data is generalised, and what is left is packed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.llm import bestfit, likeness, privacy, quality, suffixes
from ticketflow.llm.common import cut, give_back, table
from ticketflow.session import stage

#: No stage can be said in SQL: a trained model, XXH64 samples, suffix sorting and a tokenizer file.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones, does not reject."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that operator 8 links, or that share 80 % or more of their five-word runs, the row with the smallest doc_id."""
    return likeness.first_of_alike(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that a document with a smaller doc_id has are cut out, in whole characters; null text stays null."""
    out = suffixes.without_repeats(docs, characters=True)
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept").cast("string"))
    out = out.withColumn("text", F.when(F.size("removed") > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it generalised or removed."""
    return privacy.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences of 1024."""
    return bestfit.pack(cut(bestfit.token_pieces(docs)))


STAGES = [("quality", keep_good), ("near_duplicates", keep_first_of_near_copies), ("repeated_passages", cut_repeats),
          ("personal_data", hide_personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage returns is written below the shared folder and read from there."""
    out = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        out = stage(step(spark, out, sf_dir), name)
        give_back(spark)
    return out
