"""The corpus pipeline: documents to packed sequences. Counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder
and gives the written table to the next stage.

Defined results, for every stage: ``documents`` needs doc_id, text, lang and source, any of them null in any row; extra
columns pass through the first four stages whatever their names, and column order stays. Rows are judged one by one, so a
repeated row is kept or dropped as often as it stands there, but for the third stage, which leaves one row of each group. An
empty table passes through all stages and gives an empty result; without labels the first stage keeps all and the second
applies the base rule alone. Ties are broken as each operator states, by id and text, never by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versemill.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from versemill.llm.queries import tokenizer_path
from versemill.llm.staging import Staging


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: P(grade >= 1) of 0.5 or more. Null and empty texts are scored like others."""
    return quality_classifier.keep_documents(docs, _labels(spark, sf_dir))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs. Null and empty texts fail the base rule; a null language is a stratum of its own."""
    return quality_rules.keep_documents(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; rows without an id, and different texts under one id, are told apart."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources take them. A null source is a source of its own, a null id an id like others."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens. A null text is one end token."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_join", drop_near_duplicates),
    ("mix_sources", mix),
    ("pack_sequences", pack),
]

#: Fitted models, shingle hashes and tokenization are beyond SQL; tests hold stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents at ``sf_dir``."""
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
