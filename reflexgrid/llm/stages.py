"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .queries import tokenizer, toxicity_model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.5 or more go."""
    from .toxicity import keep_clean

    return keep_clean(docs, toxicity_model(spark, sf_dir, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on shingles of five words, the one with the smallest id stays."""
    from .jaccard import one_of_each

    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take its error budget, go."""
    from .decontaminate import clean

    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars is the new length."""
    from .pii import mask

    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences, as in query op9."""
    from .packing import pack

    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
