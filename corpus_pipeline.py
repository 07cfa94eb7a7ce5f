"""A training-data pipeline: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes what its predecessor kept, as a Parquet table. All but the last return
the columns of documents, whatever they are. Null and empty texts go in the first stage;
rows without doc_id are never dropped as copies or for benchmark passages; rows that share
a doc_id share their fate there; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.common import table, without_ids
from lexiloom.llm.mixing import mixed
from lexiloom.llm.near import near_duplicates
from lexiloom.llm.quality import accepted
from lexiloom.llm.shards import shard_rows
from lexiloom.llm.winnow import contamination
from lexiloom.runtime import materialize

SIMILARITY = 80
SHARDS = 40
READ = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with neutral names for all columns that no operator reads, so none can clash with a helper."""
    return docs.toDF(*[c if c in READ else f"extra{i}" for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantiles of trusted text stay."""
    plain = apart(docs)
    return accepted(plain, table(spark, sf_dir, "labels")).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    dropped = near_duplicates(docs, percent=SIMILARITY).filter("not kept")
    return without_ids(docs, dropped.select("doc_id"), "doc_id").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make a twentieth or more go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return without_ids(docs, found.select("doc_id"), "doc_id").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, at the target shares of source, language and topic where they reach."""
    plain = apart(docs)
    return mixed(plain).filter("_kept").select(*plain.columns).toDF(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

# Perplexities, sketches and the capacity search have no SQL form; tests/llm compare the
# pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
