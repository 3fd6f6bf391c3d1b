"""The operators with production parameters over the driver's tables, and the SQL where it can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.catalog.binding import read
from breathline.llm.byte_bpe import encode_texts
from breathline.llm.html_text import extract_main_text, train_node_model
from breathline.llm.language_id import identify_languages, train_language_model
from breathline.llm.near_dup import near_duplicates
from breathline.llm.oracle import SQL as SQL
from breathline.llm.packing import pack_documents
from breathline.llm.periodic_runs import periodic_runs
from breathline.llm.quality_model import score_quality, train_quality_model
from breathline.llm.quality_rules import quality_rules
from breathline.llm.repeats import remove_repeats
from breathline.llm.sentence_piece import encode_pieces
from breathline.llm.shared import Workspace
from breathline.llm.url_filter import url_filter
from breathline.llm.vector_dup import vector_duplicates
from breathline.llm.whitening import whiten_embeddings

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

QUALITY_CUT = 0.3


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(read(spark, folder, "documents").select("doc_id", "text"), Workspace(spark, "op2"))
    sizes = F.transform("_spans", lambda s: s["end"] - s["start"])
    removed = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select(
        "doc_id", (F.length("_kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


def id_remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def language_model(documents: DataFrame):
    return train_language_model(documents.where(id_remainder("doc_id", 3) != 1), "text", "lang", "doc_id")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    found = identify_languages(documents, language_model(documents))
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_texts(read(spark, folder, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(read(spark, folder, "documents"), Workspace(spark, "op5"))


def quality_model(documents: DataFrame, labels: DataFrame):
    return train_quality_model(documents, labels.where(id_remainder("doc_id", 5) != 0), "doc_id", "text", "quality")


def op7_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    scored = score_quality(documents, quality_model(documents, read(spark, folder, "labels")))
    return scored.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter(read(spark, folder, "pages"), URL_RULES, Workspace(spark, "op6"))


def op8_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), Workspace(spark, "op8"), words_each=4)


def op9_vector_dup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_duplicates(read(spark, folder, "embeddings"), Workspace(spark, "op9"))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return extract_main_text(pages, train_node_model(pages, "html"))


def op11_sentence_piece(spark: SparkSession, folder: str) -> DataFrame:
    return encode_pieces(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten_embeddings(read(spark, folder, "embeddings"), Workspace(spark, "op12"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs(read(spark, folder, "documents"), plant=True, digests=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_repeats, op3_language_id, op4_byte_bpe, op5_quality_rules, op6_url_filter, op7_quality_model, op8_near_dup, op9_vector_dup,
        op10_html_text, op11_sentence_piece, op12_whitening, op13_periodic_runs,
    )
}
