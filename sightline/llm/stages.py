"""The steps of the corpus pipeline, each a thin use of one operator.

All but the last return the columns of their input, whatever extra ones it has, and work on empty tables. Null and empty
texts are clean, have no lines and leak nothing; of near copies only rows without words count as equal texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, sentence_pieces, simhash, toxicity
from .common import free_name, sized, table, written

TOXIC_FROM = 0.7
#: Fewer than the operator alone: the executors' heap has grown in the stages before.
CHUNKS = 1 << 17


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below TOXIC_FROM, each judged by itself; the chain is fitted on a bounded sample of the labels. Null and empty texts score as texts without toxic words."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.below(docs, chain, TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats; documents that keep nothing go. Rows without an id or text stay as they are; rows that repeat one id and text are one document."""
    return line_dedup.apply(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: five-word shingles, similarity 0.8 or more. Texts without words are one group; rows of one id are one document and stay or go together; rows without an id stay."""
    groups = simhash.similar_documents(docs, width=5, similarity=0.8)
    name = free_name("gone", docs)
    gone = groups.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone"))
    gone = sized(written(gone.where("gone").select(F.col("doc_id").alias(name))))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, judged by text: copies go together, whatever their id. Null texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row; other columns end here. Null texts have no ids."""
    out = sentence_pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), remember=CHUNKS)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
