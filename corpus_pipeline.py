"""From documents to packed sequences: each stage writes what it keeps, and the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelmark.llm.batches import remainder, table
from duelmark.llm.catalog import TOKENIZER
from duelmark.llm.decontaminate import drop_contaminated
from duelmark.llm.exact import drop_exact_copies
from duelmark.llm.packing import pack_documents
from duelmark.llm.simhash import drop_near_copies
from duelmark.llm.toxicity import drop_toxic, train
from duelmark.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the labels of four fifths of them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter("label IS NOT NULL")
    known = docs.select("doc_id", "text").join(labels, "doc_id").filter(remainder("doc_id", 5) != 0)
    return drop_toxic(docs, train(known))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the longest with the smallest id."""
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near-equal fingerprints connect, the one with the smallest id."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of every benchmark item's shingles."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with the ids (little-endian unsigned 32 bits) and their CRC-32."""
    pieces = pack_documents(docs, TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("packing", packing)]

# toxicity is a trained model, which SQL cannot repeat; tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is written to the shared folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
