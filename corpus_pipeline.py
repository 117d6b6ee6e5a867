"""Documents to training sequences: five stages, each a written table that the next one reads.

1. language_id      documents without a language (null, or no letter) go
2. near_duplicates  of each class of texts linked by 80 % common 5-word shingles the smallest doc_id stays
3. repeats          passages of 35 words and more that occur elsewhere are cut out of the text
4. mixing           documents as often as the source mix takes them
5. packing          sequences of 2048 tokens; returns pieces instead of documents

Stages 1 to 4 return the columns of their input, whatever these are called; an
empty table gives an empty one.
"""

from __future__ import annotations

from graphloom.llm import langid, mixing, near, packing, substring
from graphloom.llm._shared import fresh_path, long_rows, made, sweep
from graphloom.llm.queries import tokenizer_path
from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents themselves; keeps what has a language.

    Null and empty texts and texts without a letter go; repeated rows go or stay
    together; without any label nothing has a language, and all rows go. The
    session's Arrow batches are small from here on (1,000 rows): texts are long.
    """
    long_rows(spark)
    return langid.known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash classes, completed to all pairs of 80 %; of each class one row stays.

    It is the one with the smallest doc_id, of several the one with the smallest
    hash of its text, of equal ones any. Rows without a doc_id stay. All texts
    without words are one class. Long texts count with all their shingles.
    """
    return near.first_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; only texts with repeats change, and may become empty.

    Null stays null; of repeated rows all words go that a window covers.
    """
    return substring.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, to the nearest whole copy; rows without words stay once.

    The null source is one of its own; repeated rows are taken each for itself.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; null and empty texts are the end id alone, copies are documents of their own."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixed), ("packing", packed)]

#: The stages hash, learn and iterate; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves in the shared folder goes when its own table is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path, before = fresh_path(spark, name), made()
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, before, *filter(None, [last]))
        docs, last = spark.read.parquet(path), path
    return docs
