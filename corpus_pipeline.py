"""A corpus pipeline: toxic and poor documents go, one of each group of near copies stays, documents
with benchmark passages go, and what is left is packed into training sequences.

``STAGES`` names the stages in order. Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``; all but the last return the columns of
``docs`` and whole rows of it.

Defined results: null and empty texts are scored as empty texts, have no near copies and no benchmark
passages, and are packed as a lone end mark; copies are told by their texts, never by ids: of the rows
of a group one stays, the one with the smallest id (rows without an id come last), and rows with one id
and unrelated texts all stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnline.llm import decontam, ngram_join, packing, quality, toxicity
from cairnline.llm.common import materialise, read, ship
from cairnline.llm.learning import keep, labelled_sample
from cairnline.llm.queries import byte_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", 8_000))
    return keep(docs, model, below=0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", 4_000))
    return keep(docs, model, least=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, byte_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores and tokenizers can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
