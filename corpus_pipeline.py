"""Corpus pipeline: five stages from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what a stage returns is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents; columns
beside them are ignored, whatever their names. Empty tables give empty ones.

Null and empty texts go in the first stage. Rows that agree in doc_id and text are one document, rows of one doc_id
with different texts are documents of their own, and a row without doc_id is linked with none. Of a group of near
copies any one row stays. A null source is a source of its own in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import written
from paperloom.llm.decontam import clean_documents
from paperloom.llm.langid import confident_documents
from paperloom.llm.mixing import poisson_mix
from paperloom.llm.neardup import distinct_documents
from paperloom.llm.wavelet import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; without letters, or of too uncertain a language, they go."""
    return confident_documents(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked at a similarity of 0.8 on five-word shingles."""
    return distinct_documents(docs.select(*COLUMNS), size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words lie in windows of benchmark items."""
    return clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of as many rows in which every source has the same expected share; a document may repeat."""
    return poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards of the mix: each row's place, length and checksum as read back."""
    return token_output(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]
#: SQL cannot express the language model, the token ids or the reading back; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
