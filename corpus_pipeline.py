"""The corpus pipeline: five stages from documents to token ids, each written as Parquet and read again.

Null and empty texts pass the first stages: they are not toxic, have no lines and leak nothing; texts without words are one
group of copies, of which the smallest doc_id stays. Rows without a doc_id are judged by their text and otherwise left
alone. Ties go to the smaller doc_id; repeated rows of one id and text stay or go together. Extra columns stay up to the
last stage, whatever their names. An empty table, or one without labels, gives an empty result or no toxic rows; without
benchmark items nothing leaks. The tables labels and benchmark must be there, if only empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import stages
from sightline.llm.common import remove, scratch, shared_dir

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("benchmark_decontamination", stages.drop_leaks),
    ("sentence_pieces", stages.encode_pieces),
]

#: A fitted chain, fingerprints and token ids are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; returns the last stage's rows. Of the stages' outputs only the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, before)
        before = path
    return docs
