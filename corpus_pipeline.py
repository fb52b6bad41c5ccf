"""A training corpus from raw documents: five stages, each over all that the one before kept.

language -> near duplicates -> decontamination -> mixing -> sharding. A stage
returns the columns of ``documents``; the last adds shard and slot. Nulls, empty
texts and repeated rows: see the operator of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import decontamination, jaccard, language, mixing, sharding
from rillgraph.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language more than another, go."""
    model = language.fit(docs.where(~language.held_out()))
    return language.keep_identified(docs.select(*COLUMNS), model, min_score=0.4)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 4-word Jaccard of 0.85, the smallest id stays."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten consecutive words of a benchmark item go."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for each time that the mix takes at least half of it, twice at most.

    A document without words stays once.
    """
    return mixing.repeated(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    return sharding.shard_by_bytes(docs, 24)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The fitted language model and the hashed schedule can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
