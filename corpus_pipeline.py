"""The training-data pipeline: documents go in, packed token sequences come out.

Each stage gets the rows that the one before has kept, as reread from Parquet. All but the last return the columns of
``documents``, with the stage's decisions carried out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm import decontamination, packing, secrets, simhash, toxicity
from sitelode.llm.common import fold, shared_folder, table


def recounted(documents: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where there is such a column."""
    return documents.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below its threshold; it learns from the labels of two thirds of the ids."""
    net = toxicity.learned(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)
    return docs.where(toxicity.toxicity(F.col("text"), net) < toxicity.TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints."""
    return simhash.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, without the passages that the benchmark has too."""
    return recounted(decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with a mark in place of each secret."""
    return recounted(docs.withColumn("text", secrets.masked(F.col("text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

# Networks, fingerprints and tokens are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written to the shared folder as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs.write.parquet(folder := shared_folder(spark, name))
            docs = spark.read.parquet(folder)
    return docs
