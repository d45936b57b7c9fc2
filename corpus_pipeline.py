"""A corpus pipeline of the language-model operators: STAGES, run() and ORACLE_SQL.

Every stage but the last takes documents and returns those it keeps, with their columns as they were.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import langid, neardup, packing, toxicity
from terracell.llm.common import map_batches, ship, staged, table
from terracell.llm.queries import WORD_BPE


def kept(docs: DataFrame, decide: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows of docs for whose texts decide() is true, unchanged."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(decide(batch.column("text").to_pylist())))

    return map_batches(docs, run, docs.schema)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents in none of the learnt languages, or without letters, go."""
    ship(spark)
    models = langid.train(docs, langid.crc_mod("doc_id", 5) != 0)
    sent = spark.sparkContext.broadcast(models)
    return kept(docs, lambda texts: ~langid.predictions(sent, texts)[2])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: documents that are predicted to be toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), langid.crc_mod("doc_id", 4) != 2)
    sent = spark.sparkContext.broadcast(model)
    return kept(docs, lambda texts: toxicity.scored(sent, texts)[0] < toxicity.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of each group of near-duplicates the document with the smallest id stays, one of those without an id if none has any."""
    ship(spark)
    return neardup.firsts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: what remains, cut into sequences of power-of-two length."""
    ship(spark)
    return packing.pack(docs, WORD_BPE, max_length=2048, end_id=1).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each on what its predecessor kept, written and read again between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the models nor the tokenizer; the tests hold near-duplicates against all pairs in plain Python, language and toxicity against the labels of
#: their fixture, and packing against its checksums.
ORACLE_SQL = None
