"""A corpus pipeline of training-data operators: language ID, near-dedup, substring dedup, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. Nulls, empty texts, repeated rows and an empty table are handled as the
operators' docstrings say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, mixing, sentencepiece_codec, simhash, substrings
from tracewright.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score of the out-of-place distance under which a text is in no known language.
LEAST_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those too far from every language's profile."""
    profiles = language_id.learn_profiles(docs.filter(~language_id.held_out()))
    found = language_id.predict_language(docs.select(*COLUMNS), profiles)
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the word windows that an earlier document has; a document that loses every word goes. Texts that lose
    nothing stay as they are; in the others the words that are left are joined by single spaces."""
    found = substrings.remove_repeats(docs, keep=("lang", "source", "n_chars"), as_is=True)
    left = found.filter("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return left.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "rest.lang", "rest.source", n_chars)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, and checks that they decode to the text."""
    coded = sentencepiece_codec.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    whole = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), whole)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each stage but the last is written to the shared folder and read again; what a
    stage wrote is removed when the next one's rows are written. The last folder stays, as the returned rows are read
    from it."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = f"{folder}/{k}-{name}"
            docs.write.parquet(written)
            docs = spark.read.parquet(written)
            if before:
                _remove(spark, before)
            before = written
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
