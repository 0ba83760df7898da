"""A training corpus from raw documents: known languages, one of each near-duplicate group, no repeated passages, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A row counts as clean for a stage unless the stage's own
operator says otherwise, and then passes unchanged.

Defined results: a null or empty text, or one without letters, goes in the language stage, so later stages meet none from
run(); alone, near-duplicate and mixing stages keep one empty text, the passage stage keeps all, and the encoding has null or no
ids. Rows that agree in doc_id and text are near copies, and one stays; rows of one doc_id and different texts are rows of
their own in every stage. A null doc_id is an id like others and ranks last, a null lang is filled in, a null source is a
source. Ties go to the smaller doc_id, then the smaller hash of the text. Very long texts are taken whole. Extra columns of any
name pass through unchanged. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topolake.llm import langid, linededup, mixing, nearcopies, pieces
from topolake.llm.util import fresh, stored

#: Below this share of n-grams of its best language a text is in none that we know.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts in no known language go; a null lang is filled in."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.annotate(docs, langid.learn(docs), lang, score).where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go: fingerprints that chain at 3 or fewer bits, then five-word similarity of 0.8 or more to one that stays."""
    return nearcopies.keep_one(docs, shingle=5, similarity=0.8, radius=3)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of lines and passages are cut out; documents of which no word is left go."""
    removed = fresh(docs, "removed")
    cut = linededup.remove_repeats(docs, removed_as=removed).where((F.size(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or up to three times."""
    return mixing.copied(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the piece ids of its text, their number and score, and the next two segmentations."""
    return pieces.encode(docs, nbest=3)


STAGES = [("language ID", known_language), ("SimHash near-dedup", near_dedup), ("substring dedup", passage_dedup), ("mixing", mix_sources), ("piece encoding", encode)]

#: No stage but the mix's sizes can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
