"""The corpus pipeline: documents to packed training sequences.

STAGES are applied in order; each reads all rows its predecessor kept,
written as Parquet. All but the last return the columns of documents.

For every stage: columns beside doc_id, text, lang, source and n_chars pass
through as they are, whatever their names; texts of any length are taken
whole; an empty table gives no rows. language_id rejects null and empty texts
and breaks ties between languages by name; line_dedup leaves rows without a
source as they are; simhash_dedup keeps one row of each group, the smallest
id, and every row without an id; mix_sources takes null sources for one of
their own; repeated rows are documents of their own but in simhash_dedup.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import lang_id, line_dedup, mixing, packing, simhash
from marketspark.session import scratch_path

#: documents whose best language stays below this score are rejected
MIN_LANGUAGE_SCORE = 0.25
#: pages of a source that must hold a line before it can be boilerplate
BOILERPLATE_PAGES = 20
#: words a packing worker remembers: few, as the stages share their workers' memory
REMEMBER_WORDS = 50_000


#: columns the stages work on; all others only pass through
OWN_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _passing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on documents whose other columns carry names that no
    operator uses, and get their own names back."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = [c if c in OWN_COLUMNS else f"_pass_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*safe), sf_dir)
        return out.select(*safe).toDF(*docs.columns)
    return run_stage


@_passing
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn profiles from the labelled documents, predict every document's
    language and keep those with one: ``und`` and scores below
    MIN_LANGUAGE_SCORE are rejected. lang becomes the predicted language."""
    profiles = lang_id.train(docs)
    out = lang_id.predict(docs, profiles, keep=docs.columns)
    kept = out.where((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@_passing
def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut each source's boilerplate lines out of its documents. Copies are
    still among them here, and a group of copies is no reason to lose its
    text: a line counts from BOILERPLATE_PAGES pages on."""
    out = line_dedup.drop_boilerplate(docs, min_pages=BOILERPLATE_PAGES)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_passing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group (3-word shingles, 2 bits)."""
    return simhash.keep_one(docs, shingle_words=simhash.SHINGLE_WORDS, max_bits=simhash.MAX_BITS)


@_passing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' drawn blocks: one row per document and pass."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix and the sequence and offset of each."""
    return packing.pack_documents(docs, remember_words=REMEMBER_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: SQL has no tokenizer, XXH64 or n-gram ranking: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
