"""How filters interact: what each removes alone, after others, and in every order, with duplicates found by text tries.

A document's failures are five bits. Four of them its own text tells; the fifth, that a smaller ``doc_id`` has the same
text, is found in compressed tries of whole texts. Texts are dealt by range of their prefix, and a prefix that too many
bytes share is lengthened until none does, so a task's trie stays of bounded size; copies can't be told apart by any
prefix, so each task that reads documents first folds its own in a trie and sends on only those that may be the smallest.
Each trie holds the smallest id at the end of every text. All orders of the filters are then sums over counts per bits.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.llm.common import cut, slices

LETTERS = "ABCDE"
MIN_WORDS = 100         # A: fewer words
DISTINCT_SHARE = 80     # B: distinct words under this share of all, per cent
CAPITAL_SHARE = 10      # C: capitals over this share of code points, per cent
SYMBOLS = b"#$%&*|"     # D: holds any of these
CAPITALS = bytes(range(65, 91))

LENGTHS = (8, 64, 512, 4096, 32768, 262144, 2097152, 16777216)  # code points of a prefix, each tried where the one before is shared by too many
TASK_BYTES = 32_000_000  # of texts a task's trie holds
ROW_BYTES = 256          # what a row weighs beside its text
FOLD_BYTES = 48_000_000  # of texts a reading task remembers to fold its copies


class TextTrie:
    """A compressed trie of byte strings with the smallest id at each text's end.

    A node is ``[label, children by first byte, has an end, smallest id]``; labels of children start with different bytes.
    """

    def __init__(self):
        self.root = [b"", {}, False, None]
        self.size = 0  # bytes held in labels

    def insert(self, text: bytes, number: int | None) -> list:
        """The node where ``text`` ends, with ``number`` taken into its smallest id (null is no number)."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, False, None]
                node[1][text[at]] = child
                self.size += len(child[0]) + ROW_BYTES
                node, at = child, len(text)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, text, at)
            upper = [label[:same], {label[same]: child}, False, None]
            child[0] = label[same:]
            node[1][text[at]] = upper
            node, at = upper, at + same
        node[2] = True
        if number is not None and (node[3] is None or number < node[3]):
            node[3] = number
        return node

    def ends(self) -> Iterator[tuple[bytes, int | None]]:
        """Every text with its smallest id, in byte order."""
        todo = [(self.root, b"")]
        while todo:
            node, before = todo.pop()
            if node[2]:
                yield before, node[3]
            todo += [(node[1][b], before + node[1][b][0]) for b in sorted(node[1], reverse=True)]


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes ``label`` and ``text`` from ``at`` on share; they don't share all of ``label``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def own_failures(text: bytes, points: int) -> int:
    """Bits of the failures that a text alone tells, A the lowest."""
    words = text.split()  # of bytes: at the six ASCII blanks
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
            | (100 * capitals > CAPITAL_SHARE * points) << 2 | (len(text.translate(None, SYMBOLS)) != len(text)) << 3)


def prefix_key(heavy: list[list[int]]) -> Column:
    """The prefix by which a text is dealt: eight code points, and where too many bytes share them, a hash of the first
    longer prefix that few share. Texts that are equal have equal keys."""
    short = F.substring("text", 1, LENGTHS[0])
    if not heavy:
        return short
    key = F.when(~_shared(0, heavy[0]), short)
    for level in range(1, len(heavy) + 1):
        longer = F.concat(short, F.lit("\x00"), F.lpad(F.hex(_hash(level)), 16, "0"))
        key = key.when(~_shared(level, heavy[level]), longer) if level < len(heavy) else key.otherwise(longer)
    return key


def _hash(level: int) -> Column:
    return F.xxhash64(F.substring("text", 1, LENGTHS[level]))


def _shared(level: int, hashes: list[int]) -> Column:
    return _hash(level).isin(hashes)


def shared_prefixes(texts: DataFrame, limit: float) -> list[list[int]]:
    """Per length the hashes of prefixes under which different texts weigh more than ``limit``.

    At most (weight of all / limit) come to the driver at each length, eight bytes each. A length is looked at only
    under prefixes that the one before it found.
    """
    found: list[list[int]] = []
    open_ = texts
    for level, length in enumerate(LENGTHS[:-1]):
        if found:
            open_ = open_.where(_shared(level - 1, found[-1]) & (F.length("text") > LENGTHS[level - 1]))
        whole = F.xxhash64("text")
        heavy = (open_.groupBy(_hash(level).alias("prefix")).agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("weight"), F.min(whole).alias("a"), F.max(whole).alias("b"))
                 .where((F.col("weight") > limit) & (F.col("a") != F.col("b"))))
        hashes = sorted(r["prefix"] for r in heavy.select("prefix").collect())
        if not hashes:
            break
        found.append(hashes)
    return found


def _ranges(texts: DataFrame, key: Column, parts: int) -> list[str]:
    """Borders that deal keys to ``parts`` ranges of near-even weight, from a sample of at most 40 rows a range.

    The rows of smallest hash are the sample; it decides only where work is done. A key has 25 characters at most.
    """
    sample = (texts.select(key.alias("key"), (F.octet_length("text") + ROW_BYTES).alias("weight"), F.xxhash64("doc_id", F.octet_length("text"), "key").alias("h"))
              .orderBy("h").limit(40 * parts).select("key", "weight").collect())
    rows = sorted((r["key"], r["weight"]) for r in sample)
    total, borders, run = sum(w for _, w in rows), [], 0
    for key_, weight in rows:
        run += weight
        if run * parts >= total * (len(borders) + 1) and len(borders) < parts - 1 and (not borders or borders[-1] != key_):
            borders.append(key_)
    return borders


def _fold(borders: list[str]):
    """Rows of one reading task: own failures, the range of the text, and no text where a copy read before is as small."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TextTrie()
        for batch in slices(batches, "text"):
            texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
            points = pc.utf8_length(batch.column("text")).to_pylist()
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            nodes = [trie.insert(text, number) for text, number in zip(texts, ids, strict=True)]
            fails, sent = [], []
            for i, (node, number) in enumerate(zip(nodes, ids, strict=True)):
                own = own_failures(texts[i], points[i])
                if number is None:
                    settled = True  # has no order: never a copy of a smaller one, never smaller
                elif node[3] < number:
                    own, settled = own | 16, True
                else:
                    settled = False
                fails.append(own)
                sent.append(None if settled else texts[i])
            range_ = [bisect_right(borders, k) if s is not None else i for i, (k, s) in enumerate(zip(keys, sent, strict=True))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(fails, pa.int32()), pa.array(sent, pa.binary()), pa.array(range_, pa.int32())],
                ["doc_id", "lang", "fails", "text", "range"])
            if trie.size > FOLD_BYTES:
                trie = TextTrie()

    return fold


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range with the bit of copies, once its trie holds all of its texts."""
    trie, held = TextTrie(), []
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        nodes = [None if t is None else trie.insert(t, n) for t, n in zip(batch.column("text").to_pylist(), ids, strict=True)]
        held.append((batch.select(["doc_id", "lang", "fails"]), nodes))
    for rows, nodes in held:
        ids = rows.column("doc_id").to_pylist()
        copy = np.array([n is not None and n[3] < i for n, i in zip(nodes, ids, strict=True)], np.int32)
        fails = rows.column("fails").to_numpy() | copy * 16
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array(fails, pa.int32())], ["doc_id", "lang", "fails"])


def failures(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id, lang, fails`` of each document, ``fails`` the bits of the filters that it fails on its own (A is 1, E is 16).

    ``docs`` needs ``doc_id, text, lang``; other columns are ignored. A null text is an empty one, a null lang the empty
    string. A document without an id has no order: it is no copy and makes none. Rows that repeat an id don't make each
    other copies. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    weight = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / task_bytes))
    # a range may hold several prefixes, none of them more than a quarter of it
    heavy = shared_prefixes(rows, min(task_bytes, weight / parts) / 4)
    keyed = prefix_key(heavy)
    borders = _ranges(rows, keyed, parts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = rows.withColumn("key", keyed).mapInArrow(_fold(borders), f"doc_id {kind}, lang string, fails int, text binary, range int")
    return sent.repartitionById(parts, "range").mapInArrow(_settle, f"doc_id {kind}, lang string, fails int")


def _steps() -> Column:
    """All 600 steps: each order of the filters, each place in it, its filter's bit and the bits before it."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            rows.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every step of every order of the five filters, per language.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; 600 rows per
    language, zeros too. ``labels`` needs ``doc_id, quality, toxic``; a document is good or toxic if any row of its id says 1,
    and rows without an id label nothing. Documents are handled as in ``failures``. An empty table gives an empty result.
    """
    marks = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    failed = failures(docs).join(marks, "doc_id", "left")
    # 32 rows a language at most
    per = cut(failed.groupBy("lang", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), 1).otherwise(0)).alias("toxic")))
    each = per.withColumn("s", F.explode(_steps())).select("lang", "fails", "n", "good", "toxic", "s.*")
    fails_it, earlier = (F.col("fails").bitwiseAND(F.col("bit"))) != 0, (F.col("fails").bitwiseAND(F.col("before"))) != 0

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(F.lit(0)))

    sums = each.groupBy(F.col("lang").alias("part"), "filter_order", "step", "bit").agg(
        total("n", ~fails_it & ~earlier).alias("kept"), total("n", fails_it & ~earlier).alias("removed"), total("n", fails_it & earlier).alias("redundant"),
        total("n", F.col("fails") == F.col("bit")).alias("unique_fails"), total("good", fails_it & ~earlier).alias("good_lost"), total("toxic", fails_it & ~earlier).alias("toxic_lost"))
    # each filter stands once in each order: 120 rows a window
    return sums.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def oracle() -> str:
    """The same in DuckDB."""
    blank = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{blank}') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part,
    CAST(len(words) < {MIN_WORDS} AS INT)
    + 2 * CAST(100 * len(list_distinct(words)) < {DISTINCT_SHARE} * len(words) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_SHARE} * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(first < doc_id, false) AS INT) AS fails FROM w),
m AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY part, fails),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || e.letter || g.letter AS filter_order FROM l a, l b, l c, l e, l g
    WHERE a.bit + b.bit + c.bit + e.bit + g.bit = 31 AND a.bit | b.bit | c.bit | e.bit | g.bit = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, l.bit,
    (SELECT coalesce(sum(x.bit), 0) FROM l x WHERE position(x.letter IN filter_order) < step) AS before
    FROM o, range(1, 6) r(step), l WHERE l.letter = substr(filter_order, step, 1)),
t AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & bit = 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t"""
