"""How far sources drift apart: exact divergences of every pair of a language's sources over its kept terms.

Work is a cube. Sources of a language are dealt to group blocks, its kept terms to term blocks, and a task owns a cell
(group block, group block, term block): it gets the two slices of counts it needs, so a slice is sent once per group
block, and adds up what its terms contribute to each pair of its sources. A sum along the term axis ends it. A hot
source or term is one row in each of few cells; nothing grows with the number of documents.

A term that neither source of a pair holds contributes the same for all such terms, so cells add up only the difference
to that and the number of kept terms times it comes last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.llm.common import cut, slices

MIN_DOCS = 10        # documents of its language that hold a kept term
SCALE = 1_000_000_000
TOP_TERMS = 10       # ranks of the term part
GROUP_BLOCK = 64     # sources of a group block, about
TERM_BLOCK = 4096    # terms of a term block, about
TABLE_ROOM = 400_000  # counts a reading task gathers before it sends them on

# letters of a term as they are counted, all else a blank: terms are runs of ASCII letters and of what is not ASCII
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, per language and source, of what one task reads."""
    tables: dict = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), table in tables.items():
            terms = list(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array([v[0] for v in table.values()], pa.int64()), pa.array([v[1] for v in table.values()], pa.int64())],
                ["lang", "source", "term", "n", "docs"])

    for batch in slices(batches, "text"):
        texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            table = tables.setdefault((lang, source), {})
            held -= len(table)
            seen: dict = {}
            for term in text.translate(_LETTERS).split():
                seen[term] = seen.get(term, 0) + 1
            for term, n in seen.items():
                entry = table.get(term)
                if entry is None:
                    table[term] = [n, 1]
                else:
                    entry[0] += n
                    entry[1] += 1
            held += len(table)
            if held > TABLE_ROOM:
                yield from rows()
                tables.clear()
                held = 0
    yield from rows()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n`` of the kept terms: occurrences in a source and in its language.

    One shuffle by language and term serves the counts, the documents that hold a term, and the language's total.
    """
    counted = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    each = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    all_ = W.partitionBy("lang", "term")
    return (each.withColumn("lang_n", F.sum("n").over(all_)).withColumn("lang_docs", F.sum("docs").over(all_))
            .withColumn("first", F.row_number().over(all_.orderBy("source")) == 1)
            .where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals: a long would overflow from 9e9 occurrences on."""
    high = count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")
    low = total.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)") * terms.cast("decimal(17,0)")
    return F.when(terms > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * high, low) + 1).otherwise(F.lit(0)).cast("long")


def _drift(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, each under 2^31."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0)).cast("long")


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of a cell: pairs of the sources of its two group blocks over its terms."""
    key = rows.iloc[0]
    ids, names = pd.factorize(rows["source"], sort=True)  # a pair of one block in the same order in each of its cells
    block, base = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    marks = rows["term"].isna().to_numpy()
    block[ids[marks]], base[ids[marks]] = rows["block"].to_numpy()[marks], rows["p"].to_numpy()[marks]
    terms, found = pd.factorize(rows["term"][~marks])
    shares = np.repeat(base[:, None], len(found), axis=1)
    shares[ids[~marks], terms] = rows["p"].to_numpy()[~marks]
    one, two = np.flatnonzero(block == key["bi"]), np.flatnonzero(block == key["bj"])
    out = []
    for at, i in enumerate(one):
        # in one block each pair once
        others = one[at + 1:] if key["bi"] == key["bj"] else two
        if not len(others):
            continue
        apart, both = shares[others] - shares[i], shares[others] + shares[i]
        empty_apart, empty_both = base[others] - base[i], base[others] + base[i]
        empty = empty_apart * empty_apart // np.maximum(empty_both, 1)
        part = (apart * apart // np.maximum(both, 1) - empty[:, None]).sum(axis=1) if len(found) else np.zeros(len(others), np.int64)
        out.append(pd.DataFrame({"lang": key["lang"], "a": names[i], "b": names[others], "part": part, "empty": empty}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "part": [], "empty": []}).astype({"lang": str, "a": str, "b": str, "part": "int64", "empty": "int64"})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each source from every other source of its language
    (``pair``), and the terms that set a source most apart from its language (``term``).

    ``docs`` needs ``text, lang, source``, null meaning the empty string; other columns are ignored, so rows that repeat count
    as often as they stand. A source without terms is still a source. Where a language keeps no term, pairs have the
    value 0 and there are no term rows. An empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(term_counts(docs, min_docs))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    sources = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left")
    langs = sources.groupBy("lang").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("firsts"), F.lit(0)).alias("terms"), F.count(F.lit(1)).alias("sources"))
    blocks = F.ceil(F.col("sources") / group_block).cast("int")
    groups = cut(sources.join(langs, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "terms", blocks.alias("blocks"),
        F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"), F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)).cast("int").alias("slices")))
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"),
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    # a row without a term names a source of the cell and its share of a term it doesn't hold
    marks = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                          _share(F.lit(0), F.col("total"), F.col("terms")).alias("p"))
    sent = shares.drop("q").unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = sent.select("lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "slice", "block", "source", "term", "p")
    parts = cells.groupBy("lang", "bi", "bj", "slice").applyInPandas(_cell, "lang string, a string, b string, part long, empty long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.first("empty").alias("empty")).join(langs.select("lang", "terms"), "lang")
    value = F.col("part") + F.col("empty") * F.col("terms")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    apart = pairs.select("lang", ways.alias("w"), value.alias("value")).select("lang", "w.*", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), _drift(F.col("p"), F.col("q")).alias("value"))
    term_rows = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair_rows.unionByName(term_rows.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def oracle() -> str:
    """The same in DuckDB."""
    term, upper = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(map(chr, range(65, 91)))
    share = "CAST(1 + {scale} * (CAST({n} AS HUGEINT) + 2) // ({total} + 2 * {terms}) AS HUGEINT)"
    drift = "(({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q}))"
    p = share.format(scale=SCALE, n="coalesce(c.n, 0)", total="g.total", terms="g.terms")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{term}')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS terms, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM k GROUP BY lang),
n AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(n.total, 0) AS total, coalesce(v.terms, 0) AS terms, coalesce(v.lang_total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, {p} AS p, coalesce(c.n, 0) AS n, {share.format(scale=SCALE, n="k.lang_n", total="g.lang_total", terms="g.terms")} AS q
    FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum({drift.format(p='x.p', q='y.p')}) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
    UNION ALL SELECT lang, source, 'term', term, {drift.format(p='p', q='q')} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
