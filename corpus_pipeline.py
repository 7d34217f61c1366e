"""From raw documents to packed training sequences: five stages, each one operator over all that the one
before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the last
returns the pieces of the packed sequences. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import langid, mixing, packing, quality, simhash
from quillspark.llm.common import table, written
from quillspark.llm.queries import tokenizer_path

#: Bits per character beyond which no learned language explains a text; prose of one stays below 5.
MAX_BITS = 8.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of label 1; the others, empty texts among them, go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents show; those without letters and those that
    no language explains go."""
    return langid.keep_identified(docs, MAX_BITS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by their weights: a document once for each pass over its source that takes words
    of it, with those words as its text."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]

#: Classifier, language ID, tokens and seeded permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
