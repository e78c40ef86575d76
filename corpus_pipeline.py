"""From raw documents to tokens: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.llm import bpe, decontam, jaccard, langid, secrets
from braidframe.llm.common import Scratch, table
from braidframe.llm.queries import VOCABULARY

#: A text whose best code is no shorter than its plain bytes is in none of the languages.
MOST_BITS = 8.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in none of the learned languages: null texts, texts without a letter, incompressible ones.

    Without a single labelled text there is nothing to learn, and all documents stay.
    """
    sample = langid.training_rows(docs)
    if not sample:
        return docs
    model = langid.train(sample)
    columns = tuple(docs.columns)
    marked = langid.identify(docs, model, keep=columns, names=("__lang", "__score", "__bits"))
    return marked.where((F.col("__lang") != "und") & (F.col("__bits") < MOST_BITS)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each component of texts whose five-word shingle sets are similar by 0.8 or more."""
    return jaccard.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace credentials in the texts, but for widely copied examples."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again."""
    return bpe.encode_decode(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]
#: No stage can be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
