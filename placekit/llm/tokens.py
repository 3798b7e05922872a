"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A pre-token is a run of blanks with the word after it, or a line end with the word after it. In a vocabulary
without a piece that goes on past a word's end into a blank, and without line ends inside pieces, merges never
cross such a border, so a document has as many tokens as its pre-tokens together. ``check_vocabulary`` proves
this for the model that is given; where it doesn't hold, ``count_tokens`` refuses.

Frequent pre-tokens come from a dictionary of at most ``dictionary_size`` entries, taken from about
``dictionary_docs`` documents and counted once; all others are shuffled by pre-token, and counted once each where
the rows of its documents meet. Which pre-tokens are in the dictionary decides only where the work is done, never a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import cut, slices

BLANK = "▁"  # the model's mark of a blank; in a text it means the same
PRE_TOKEN = re.compile(f"[ {BLANK}]+[^ {BLANK}\n]*|\n[^ {BLANK}\n]*")


def check_vocabulary(path: str) -> None:
    """Raise unless the model's merges stay inside pre-tokens."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
        raise ValueError("the model rewrites texts before it splits them; pre-tokens can't be counted apart")
    if model.trainer_spec.model_type != 2:
        raise ValueError("only pair-merge models are counted by pre-token")
    for piece in model.pieces:
        if piece.type in (1, 4, 5) and (BLANK in piece.piece.lstrip(BLANK) or "\n" in piece.piece or piece.type == 4):
            raise ValueError(f"piece {piece.piece!r} can cross the border of a pre-token")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; the model's blank before the first word is part of the first."""
    return PRE_TOKEN.findall(" " + text) if text else []


class PieceCounter:
    """Pieces of pre-tokens, by the library itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, tokens: list[str]) -> list[int]:
        # the library puts a blank before each text: it stands for the pre-token's first one,
        # and before a line end it is one piece more
        bare = [t[1:] if t[0] != "\n" else t for t in tokens]
        pieces = self.model.encode(bare, num_threads=1) if bare else []
        # a pre-token of one blank has an empty rest, which the library doesn't mark
        return [len(p) - (t[0] == "\n") if b else 1 for t, b, p in zip(tokens, bare, pieces, strict=True)]


def _sample(docs: DataFrame, want: int) -> DataFrame:
    """About ``want`` documents, spread over the table by a hash."""
    every = max(1, docs.count() // want)
    return docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        seen: Counter = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(pre_tokens(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])


def count_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """One row per row of ``tokens(token)`` with its number of pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches:
            words = batch.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(counter.counts(words), pa.int32())], ["token", "pieces"])

    return tokens.select("token").mapInArrow(count, "token string, pieces int")


def _priced(path: str):
    """Join of ``row, token, times``, sorted by token, to each token's pieces, which are counted once."""

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, last, last_pieces = PieceCounter(path), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("token").dictionary_encode()
            tokens = coded.dictionary.to_pylist()
            pieces = [last_pieces, *counter.counts(tokens[1:])] if tokens[0] == last else counter.counts(tokens)
            last, last_pieces = tokens[-1], pieces[-1]
            more = np.array(pieces, np.int64)[coded.indices.to_numpy()] * batch.column("times").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(more, pa.int64())], ["row", "more"])

    return price


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, dictionary_docs: int = 4000, dictionary_size: int = 200_000) -> DataFrame:
    """Tokens of each document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text has 0 bytes and 0
    tokens. Rows that repeat, also with one doc_id, each give a row. An empty table gives an empty result.
    ``model_path`` must be readable on every executor.
    """
    check_vocabulary(model_path)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = (_sample(docs, dictionary_docs).select("text").mapInArrow(_tally, "token string, n long")
                .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(dictionary_size))
    # bounded by dictionary_size: some MB
    known = spark.sparkContext.broadcast({r["token"]: r["pieces"] for r in count_pieces(frequent.coalesce(4), model_path).collect()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in slices(batches, "text"):
            size, total, words, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                size.append(len(text.encode("utf-8", "surrogatepass")))
                n, rare, often = 0, [], []
                for token, f in Counter(pre_tokens(text)).items():
                    pieces = get(token)
                    if pieces is None:
                        rare.append(token)
                        often.append(f)
                    else:
                        n += pieces * f
                total.append(n)
                words.append(rare)
                times.append(often)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "known", "tokens", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = cut(docs.mapInArrow(split, f"doc_id {kind}, n_bytes long, known long, tokens array<string>, times array<int>")
                .withColumn("row", F.monotonically_increasing_id()))  # fixed once stored
    rest = (parts.where(F.size("tokens") > 0).select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t"))
            .select("row", F.col("t.tokens").alias("token"), F.col("t.times").alias("times")))
    # a pre-token outside the dictionary is rare, so no key is hot; all rows of one meet in one task, side by side
    met = rest.repartition("token").sortWithinPartitions("token")
    sums = met.mapInArrow(_priced(model_path), "row long, more long").groupBy("row").agg(F.sum("more").alias("more"))
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return parts.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
