"""A training corpus from raw documents: known languages, one of each group of near copies, no benchmark leaks, mixed, sharded.

Each stage takes (spark, docs, folder of the tables) and works on all that the one before kept; all but the last return
the columns of documents, the last one each document's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placekit.llm import decontaminate, jaccard, langid, mixing, sharding
from placekit.llm.common import cut, read


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network, trained on those of them that aren't held out, can tell."""
    return langid.keep_known(docs, langid.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles and a similarity of 0.8."""
    return jaccard.drop_near_copies(docs, jaccard.CORPUS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out."""
    return mixing.repeat_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row of the mix."""
    return sharding.shard(docs)


STAGES = [("language", known_language), ("near_copies", one_of_each), ("decontamination", without_leaks), ("mix", mixed), ("shards", sharded)]

# the network of the first stage can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
