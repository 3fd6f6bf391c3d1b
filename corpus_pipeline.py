"""A corpus from raw documents to packed windows: language, quality, near copies, repeated strings, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.catalog.binding import read
from breathline.llm.language_id import keep_identified
from breathline.llm.near_dup import keep_one_of_each
from breathline.llm.packing import pack_documents
from breathline.llm.quality_model import keep_good
from breathline.llm.queries import QUALITY_CUT, language_model, quality_model
from breathline.llm.repeats import remove_repeats
from breathline.llm.shared import Workspace
from breathline.session import ship_package

#: bytes that have to occur again for a passage to go: under what 51 words take (of the passages of that length and more in
#: the tables 99 % have over 200 bytes, the median 579), and over what single lines or chance repeat
PASSAGE_BYTES = 200


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or without a likely language go."""
    ship_package(spark)
    return keep_identified(docs, language_model(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to have label 0."""
    ship_package(spark)
    return keep_good(docs, quality_model(docs, read(spark, sf_dir, "labels")), cut=QUALITY_CUT)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    ship_package(spark)
    return keep_one_of_each(docs, Workspace(spark, "pipeline-near"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without bytes under strings of ``PASSAGE_BYTES`` that occur again.

    Halves of characters at a cut go too. Null and empty texts stay as they are; of equal texts of that length nothing stays.
    """
    ship_package(spark)
    cut = remove_repeats(docs, Workspace(spark, "pipeline-repeats"), length=PASSAGE_BYTES, characters=True)
    shorter = F.col("_kept").cast("string")
    changed = F.size("_spans") > 0
    new = {"text": F.when(changed, shorter).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(shorter).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: models, components and packing cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.write(stage(spark, docs, sf_dir))
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
