"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placekit.llm import ann, decontaminate, divergence, html, interaction, jaccard, langid, licenses, mixing, pieces, sharding, tokens, warc
from placekit.llm.common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, by a byte network trained on the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have Jaccard similarity of 0.9 or more."""
    return jaccard.near_copies(read(spark, sf_dir, "documents")).drop("_row")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    import public_tokenizers

    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("_row")


ORACLE["op2_source_mix"] = mixing.oracle()


@query
def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes over fixed virtual slots."""
    return sharding.shard(read(spark, sf_dir, "documents"))


@query
def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without what its site repeats."""
    return html.extract(read(spark, sf_dir, "pages"))


@query
def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query found by multi-index hashing."""
    return ann.search(read(spark, sf_dir, "embeddings"))


@query
def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and the licences their order names, of every whole text."""
    return licenses.scan(read(spark, sf_dir, "documents"))


ORACLE["op4_license_sentences"] = licenses.oracle()


@query
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its place."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return divergence.audit(read(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = divergence.oracle()


@query
def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at every step of each of their orders, per language."""
    return interaction.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE["op12_filter_interaction"] = interaction.oracle()


@query
def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded to piece ids and decoded again."""
    import public_tokenizers

    return pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
