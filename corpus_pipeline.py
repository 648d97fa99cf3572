"""A training-data pipeline over the documents table: each stage's rows are written and read again by the next.

Stages: toxic documents go; one document of each SimHash group stays; contaminated documents go; personal data is
replaced; texts are encoded. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm.bpe import encoding_digests, tokenizer_path
from flowspark.llm.common import table, written
from flowspark.llm.decontaminate import without_contaminated
from flowspark.llm.simhash import keep_one
from flowspark.llm.surrogates import with_surrogates
from flowspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from these documents and the labels table."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked fingerprints: three-word shingles, at most 2 bits apart."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which fewer than a twentieth of the words lie in a window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data exchanged for surrogates."""
    return with_surrogates(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    return encoding_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("encoding", encoding),
]

#: The classifier and the tokenizer have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
