"""A corpus pipeline of five stages: documents in, token files out.

Each stage is a function (spark, docs, sf_dir) whose result is written as Parquet and read again as
the next one's docs; all but the last return the columns of documents, whatever other columns there are
and however they are named. Every stage takes whole texts of any length and gives no rows for an empty
table; rows without a doc_id go through like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quittance.llm import decontam, language, mixing, simhash, tokenio
from quittance.llm.common import stored

#: Language identification and the files' digests have no SQL counterpart; tests hold run() against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; learns from the labelled ones that aren't held out.

    Null text and text without a letter goes, as does all if no document is labelled. Ties of two languages go to
    the first by name, unless neither reaches one half: then the document goes. Repeated rows are judged alike and stay repeated.
    """
    return language.recognised(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the least doc_id; of rows without a doc_id the least by their hash.

    Of repeated rows one stays. Null texts and texts without words are all alike, so one of them stays.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item.

    Null and empty texts stay, and with an empty benchmark all do. Repeated rows stay or go together.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.contamination(docs, items).where("NOT contaminated").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    Null and empty texts have size 0 and are taken like others of their source; a source without words isn't taken. A null source is a source of its
    own, the last one. Repeated rows are taken together. A null doc_id is drawn as the text 'null'.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in plane files; doc_id, start, n_tokens and ids_crc32 as read back from them.

    Documents are in the order of doc_id, null ones first, and repeated rows one after the other. Null and empty text gives the end id alone.
    """
    return tokenio.token_output(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
