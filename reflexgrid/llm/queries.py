"""Registered queries of this package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_token_counts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from .toxicity import score

    return _scored(table(spark, sf, "documents"), lambda docs: score(docs, toxicity_model(spark, sf)), 5, 0)


def toxicity_model(spark: SparkSession, sf: str, docs: DataFrame | None = None):
    """Trained on at most 1,200 labelled documents of each class; those with crc32 of the id divisible by 5 are held out."""
    from .labelled import fold, sample
    from .toxicity import train

    docs = table(spark, sf, "documents") if docs is None else docs
    return train(sample(docs, table(spark, sf, "labels"), "toxic", fold("doc_id", 5) != 0, 1200))


@query("op7_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from .labelled import fold, sample
    from .quality import score, train

    docs = table(spark, sf, "documents")
    model = train(sample(docs, table(spark, sf, "labels"), "quality", fold("doc_id", 3) != 1, 1500))
    return _scored(docs, lambda d: score(d, model), 3, 1)


def _scored(docs: DataFrame, score: Callable, parts: int, held: int) -> DataFrame:
    from .labelled import fold

    held_out = F.coalesce(fold("doc_id", parts) == held, F.lit(False))
    return score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_pii")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf, "documents"))


@query("op3_repeated_passages")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from .repeats import removals

    return removals(table(spark, sf, "documents"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op6_ngram_jaccard")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from .jaccard import classes

    return classes(table(spark, sf, "documents"), size=3, percent=90)


@query("op10_near_vectors")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


@query("op4_main_text")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from .pages import main_text, train

    pages = table(spark, sf, "pages")
    return main_text(pages, train(pages))


@query("op11_turn_repair")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from .turns import audit, damaged

    turns = table(spark, sf, "conversations")
    return audit(damaged(turns), turns)


@query("op12_vector_codes")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from .codes import compress

    return compress(table(spark, sf, "embeddings"))


@query("op13_warc")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf, "pages"))
