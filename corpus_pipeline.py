"""A training-data pipeline: language ID, near-dedup, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir), reads what the stage before it kept and returns a DataFrame; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import langid, mixing, neardup, packing, pii
from rivulet.llm.common import durable

#: Least calibrated probability of the predicted language.
LEAST_SCORE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: those with no letter, no text or no language of LEAST_SCORE go.

    If there is nothing to learn from, every text with a letter stays. Null and empty texts go; rows with a null id or
    language, very long texts and repeated rows are judged by their text like any other. An empty table stays empty.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    told = langid.predict(docs, model, names=("__lang_pred", "__score"))
    known = (F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE) if model.languages else F.col("text").rlike(r"\p{L}")
    return told.where(known).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with five-word similarity 0.8 or more: one with the smallest doc_id, null last.

    Components are told apart by their texts, so a null or repeated doc_id joins none. Null, empty and blank texts are
    one text. Of rows equal in every column one stays. Very long texts are compared whole. An empty table stays empty.
    """
    found = durable(neardup.near_duplicates(docs), "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "__r1", "__r2")
    first = durable(found.groupBy("root").agg(F.min(order).alias("first")).select("first.__r1", "first.__r2"), "first")
    # rows are as many as documents, so they are shuffled at any size, never broadcast
    kept = neardup.identified(docs).join(first.hint("merge"), ["__r1", "__r2"], "left_semi")
    several = durable(found.groupBy("__r1", "__r2").count().where("count > 1").drop("count").join(first, ["__r1", "__r2"], "left_semi"), "repeated-rows")
    if not several.isEmpty():  # of rows equal in every column, one
        kept = kept.join(several, ["__r1", "__r2"], "left_anti").unionByName(kept.join(several, ["__r1", "__r2"], "left_semi").dropDuplicates(["__r1", "__r2"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with format-preserving pseudonyms in place of personal numbers, dates, addresses and keys.

    Null and empty texts stay; equal values, in repeated rows or anywhere else, get equal pseudonyms; very long texts are
    searched whole. The key is the session's (pii.session_key). An empty table stays empty.
    """
    return pii.pseudonymise(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes; a row taken twice stands twice.

    Null and empty texts hold no words and cost nothing, so they are taken as their source is. A null source is a source of
    its own; rows with equal or null ids have equal hashes and are taken alike, so ties are taken or left together. An
    empty table stays empty.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: its document, place and sequence.

    Null and empty texts are a piece of the end id alone; very long texts are cut into pieces of whole sequences; repeated
    rows are packed each, in any order among themselves. An empty table gives an empty result.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", keep_known_language),
    ("near_dedup", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned models and tokenizers can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
