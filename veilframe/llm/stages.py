"""The stages of corpus_pipeline.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as _bpe
from . import decontam as _decontam
from . import linededup as _linededup
from . import quality as _quality
from . import simhash as _simhash
from .common import spread, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labelled rows of sf_dir) rejects go.

    A score below 0.3 rejects; null and empty texts are scored like others. Columns stay.
    """
    model = _quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _quality.score(spread(docs), model).where("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more in whole lines that an earlier place has go from the texts.

    n_chars follows. Documents of which nothing but white space is left go; documents that lose
    nothing stay as they are, empty and null texts included.
    """
    found = _linededup.delete_repeated(docs)
    found = found.where((F.col("n_removed") == 0) | (F.regexp_replace("text", r"\s+", "") != ""))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: groups by SimHash and pigeonring, whose texts are
    held against the group's first (five-word shingles, similarity 0.8), then an exact check for the pairs
    that fingerprints lose. Columns stay."""
    return _simhash.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten consecutive words of a benchmark item (or a whole
    shorter item) go. Columns stay."""
    found = _decontam.contamination(spread(docs), table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document; round_trip says whether decoding the
    ids gives the text's bytes again."""
    import public_tokenizers

    return _bpe.with_round_trip(spread(docs.select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids", "round_trip")
