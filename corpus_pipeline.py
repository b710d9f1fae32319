"""A training corpus from documents: language, near-duplicates, repeated strings, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last returns the token ids of each document. Between stages the documents are a Parquet table in the shared folder.

Null ids, and repeated ids, are kept as rows of their own by every stage but near_duplicates, where rows of equal text are
copies. A null or empty text has no language and goes in the first stage; the later ones would keep it (near_duplicates
one of all such). An empty table gives no rows. Very long texts are read whole. Columns of any further name are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.stored import own_tables
from boxwright.llm import decontamination, language_id, near_copies, suffix_dedup, wfst
from boxwright.llm.util import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter. All others are predicted one of the learned labels, whatever codes the table uses, and stay. Null labels are not learned from; if no row has one, all with a letter stay."""
    return language_id.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, of op4's links and of texts with a five-word similarity of 0.8 or more: that with the smallest id (null first), of equal ids that with the smallest hash of its text."""
    return near_copies.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings leave the texts; n_chars is that of what is left."""
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_fallback, ids_crc32, round_trip, ids of every document; a null text has no ids."""
    return wfst.encode_documents(docs, wfst.model_path(), with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: Fingerprint links, induced suffixes and merges have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are a table; when it is written, what this run made it from is deleted. Runs side by side do not meet."""
    with own_tables() as own:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
            own.discard_all_but(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
