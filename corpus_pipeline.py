"""A training-corpus pipeline in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again before the next. The
filtering stages and mixing return rows of documents in all their columns; packing returns pieces of token sequences.

Nulls and odd input: null and empty texts go at the first stage, as they have no letter; rows without an
id stay or go like others, and their least hash decides in their group; null sources and languages are values of their own to mixing. Repeated rows are
judged alike by the filters and one of them stays after near_dedup. Very long texts are read whole by every stage. Columns beyond
those of documents are carried along, whatever their names. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperflow.llm import langid, mixing, neardup, packing, quality
from paperflow.llm.common import dropped, written

CACHE_BYTES = 10 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty texts, no letters, or ambiguous beyond what the code corrects) go. Equal texts share
    their fate."""
    return langid.accepted(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below one half go; a score of exactly one half stays. Without labels
    every score is one half, so all stay."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity of 0.8 or more) stays, that of the smallest id; of rows
    that share it, the one of the least hash. Texts without words are near nothing."""
    return neardup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to the source, language and topic targets. The draw is a hash of the id: the same rows
    stay on every run, and copies of a row share their fate."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; null and empty texts have their end token alone. Fewer words are
    remembered than by packing alone, as the stages before leave the executors' heaps full."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=CACHE_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. A stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
