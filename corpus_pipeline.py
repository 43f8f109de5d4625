"""From raw documents to token ids: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.byte_bpe import bpe_round_trip
from weldsight.llm.common import table, written
from weldsight.llm.exact_dedup import without_copies
from weldsight.llm.mixing import SHARE, take
from weldsight.llm.near_dedup import near_duplicates
from weldsight.llm.toxicity import learn_toxicity, without_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents whose score is 0.5 or more. Null and empty texts stay; an empty table stays empty."""
    lexicon = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return without_toxic(docs, lexicon)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays, one of repeated rows."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id. Null doc_ids stay."""
    others = near_duplicates(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias("other")).distinct()
    return docs.join(others, docs["doc_id"].cast("long") == others["other"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by the probabilities that rake SHARE of the tokens to the source, language and topic targets."""
    return take(docs, share=SHARE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of what they decode to."""
    return bpe_round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Signatures, a trained lexicon and BPE have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
