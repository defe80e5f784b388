"""The registered query of each training-data operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weirstone.llm import ball_simhash, gif_frames, id_shards, kneser_ney, line_windows, nearest_toxic, piece_codec, run_index, soft_mixing, unit_hashes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity verdict of every document."""
    return kneser_ney.judge(table(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and evidence of every document; learnt from labels outside the held-out third."""
    docs = table(spark, sf_dir)
    return nearest_toxic.score(docs, nearest_toxic.fit(docs, table(spark, sf_dir, "labels")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and the fitted rate of every document."""
    return soft_mixing.rated(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings take from every document."""
    return run_index.digests(table(spark, sf_dir))


def op5_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word_bpe_49k ids with the end id 1, written to dictionary-compressed shards and read back."""
    folder, dictionary = id_shards.write(table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return id_shards.read(spark, folder, dictionary)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a GIF, read back from the stored bytes, with its colour histogram."""
    return gif_frames.digests(gif_frames.with_media(table(spark, sf_dir)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return ball_simhash.near_duplicates(table(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated three-line windows take from every document."""
    return line_windows.digests(table(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated lines take from every document, with original offsets."""
    return unit_hashes.digests(table(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through piece_bpe_32k: ids, round trip and span digests."""
    return piece_codec.digests(table(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_source_mixing": op3_source_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_id_shards": op5_token_id_shards,
    "op6_gif": op6_gif,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op8_line_dedup": line_windows.ORACLE,
    "op9_substring_dedup": unit_hashes.ORACLE,
}
