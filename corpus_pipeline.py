"""A corpus pipeline: language, near-duplicates, benchmark passages, mixing, packed token ids.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, language, mixing, neardup, packing
from shelfmark.llm.queries import VOCABULARY, held_out
from shelfmark.scratch import drop, new_path, passing, saved
from shelfmark.session import table

#: A document whose best language is less probable goes, as does one without a letter.
LEAST_PROBABILITY = 0.3
#: In percent: near-duplicates link from this similarity of their five-word shingles.
NEAR = 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of unknown language: null or empty texts, none with a letter, or a low probability.

    A null key doesn't matter here; rows that repeat go or stay together; an empty table, or one without any
    language to learn from, gives no rows; further columns pass through, whatever their names.
    """
    net = language.fit(language.training_texts(docs, ~held_out()))
    return language.keep_known(docs, net, LEAST_PROBABILITY)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least key.

    Texts without a word resemble nothing: one row of a key's stays. Rows that agree in key and text are one;
    of different columns then, that of the least hash stays. Rows without key stay; an empty table gives no rows.
    """
    return neardup.deduplicate(docs, percent=NEAR)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark.

    Null and empty texts and null keys stay; rows that repeat go or stay together; without items all rows
    stay; an empty table gives no rows; further columns pass through.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, up to three times.

    A null source is a source, a null or empty text has size 0, a null key is a key; rows that agree in key and
    text are decided together; an empty table gives no rows; further columns pass through.
    """
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.

    Null and empty texts have no tokens; a null key stays null; rows that repeat are packed each; an empty
    table gives no rows; further columns are ignored.
    """
    return packing.pack(docs, VOCABULARY)


STAGES = [("language", by_language), ("near-duplicates", without_copies), ("decontamination", without_benchmarks), ("mixing", to_weights), ("tokens", to_tokens)]

#: Trained networks, components and packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of what all stages keep of documents.

    Each stage is written, and what it and the stage before it have left in the scratch folder then goes. An empty
    table of documents gives no rows.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with passing(spark):
            docs = saved(stage(spark, docs, sf_dir), path)
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
