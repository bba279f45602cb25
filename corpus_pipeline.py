"""A training-data pipeline over `documents`: STAGES in order, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from callgrain.llm.base import scratch, staged, unstage
from callgrain.llm.decontamination import decontaminate
from callgrain.llm.language_id import fit, predict
from callgrain.llm.line_dedup import line_dedup
from callgrain.llm.ngram_join import ngram_join
from callgrain.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of the likelihoods no language stands out: the text is in none of the learned languages, or in no language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: `und` goes (no text, or no letter in it), and what no learned language explains better than the others.
    The model learns from the labelled documents of this stage's input; lang becomes the prediction where it was null."""
    model = fit(docs.where("lang is not null").select("lang", "text", F.col("doc_id").alias("key")), public_tokenizers.path("piece_bpe_32k.model"))
    kept = predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop late lines; a document that has no text left goes, the others keep their other lines and get their new n_chars."""
    out = line_dedup(docs)
    kept = out.where((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id. Documents
    without words and rows with a null id are in no group and stay."""
    joined = ngram_join(docs, width=5, percent=80)
    late = staged(joined.where("n_shingles > 0 and component_id <> doc_id").select("doc_id").distinct())
    unstage(joined)
    return docs.join(late.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their digest."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again, and goes once the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch() as keep:
            done = keep(staged(stage(spark, docs, sf_dir)))
        if k:
            unstage(docs)
        docs = done
    return docs


#: The stages learn, cut and pack; SQL can't express them. tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL: str | None = None
