"""Mixing sources to target weights by Pareto order sampling.

Every source gets a number of words; what it may not take beyond ``most`` times its own words goes to the others by
weight. Inside a source longer documents are taken more often: a document of ``size`` words has weight
``length of size in binary``, and its expected copies are in proportion to that weight, at most ``most``. Whole copies
are certain. For the fraction that remains, documents are ranked by random odds divided by inclusion odds (Pareto
order sampling), and the sample has a fixed size in words: documents are taken in that order as long as they fit; the
gap that the first one too long leaves is filled from the later ones that fit, twice over.

Random numbers are hashes of the id, so reruns agree. Running sums go over counted buckets of the order first; only
the bucket in which a source's sample ends is sorted, so a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.llm.common import WORD, cut, fresh, row_id
from placekit.plans.session import number_rows

WEIGHTS = (5, 2, 1)
MOST = 3
ROUNDS = 3
BUCKET_ROWS = 256
EPS = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: shares by weight, capped and reshared."""
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    room = F.lit(most) * F.col("source_size")
    total = ranked.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    share, capped = 0.0, -1
    while True:  # a few scalars each time; ends when no source is newly above its room
        over = F.lit(share) * F.col("weight") > room
        r = ranked.agg(F.coalesce(F.sum(F.when(over, room)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
                       F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        share, capped = (total - r["full"]) / r["open"], r["n"]
    return ranked.select("source", "source_size", F.least(F.lit(share) * F.col("weight"), room.cast("double")).alias("target"))


def expected_copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Whole copies and the remaining inclusion probability of each ``(source, weight)`` class.

    ``classes`` has ``source, weight, words, source_size, target``. Copies are ``k * weight``, at most ``most``, with
    the one ``k`` per source for which the words come to the target. A source has at most 64 classes.
    """
    down = W.partitionBy("source").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(0, W.unboundedFollowing))
    tried = classes.withColumn("k", F.try_divide(F.col("target") - most * before, rest))
    fit = F.max(F.when(F.col("k") * F.col("weight") <= most + EPS, F.struct("weight", "k"))).over(W.partitionBy("source"))["k"]
    copies = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(F.least(F.coalesce(fit, F.lit(0.0)) * F.col("weight"), F.lit(float(most))))
    made = tried.withColumn("copies", copies).withColumn("whole", F.floor(F.col("copies") + EPS))
    return made.withColumn("chance", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0))).drop("k", "copies")


def uniform(doc_id: Column) -> Column:
    """A number between 0 and 1 from the id's hash, neither included."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("~")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + 0.5) / F.lit(float(1 << 52))


def take(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The rows that fit, in order of ``score, doc_id, size``, into their source's budget of words.

    ``rows`` has ``_row, source, doc_id, size, score``; ``budgets`` has ``source, budget, rows``. Returns ``_row, source, size``.
    """
    buckets = F.greatest(F.lit(1), F.col("rows") / BUCKET_ROWS).cast("long")
    at = F.least(F.floor(F.col("score") / (1 + F.col("score")) * buckets), buckets - 1)
    b = budgets.select(F.col("source").alias("s"), "budget", "rows")
    placed = rows.join(b, F.col("source").eqNullSafe(F.col("s"))).where("size <= budget").withColumn("bucket", at)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = sums.withColumn("upto", running).where(F.col("upto") > F.col("budget")).groupBy(F.col("source").alias("s2")).agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    split = placed.join(edge, F.col("source").eqNullSafe(F.col("s2")), "left")
    sure = split.where(F.col("edge").isNull() | (F.col("bucket") < F.col("edge.bucket")))
    order = W.partitionBy("source").orderBy("score", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    close = split.where(F.col("bucket") == F.col("edge.bucket")).withColumn("upto", F.col("edge.before") + F.sum("size").over(order)).where("upto <= budget")
    return sure.select("_row", "source", "size").unionByName(close.select("_row", "source", "size"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix takes of each document of a stored table.

    ``docs`` needs ``doc_id, source, text``; other columns are ignored. Returns ``_row, doc_id, source, size,
    source_size, target, copies, taken``: one row per document, repeated rows each on their own. Size counts words (a
    null or empty text: 0, and then nothing is taken). Sources are weighed in code point order, the null source last.
    ``taken`` is ``copies * size``. Ties in the order go to the smaller id, then the shorter text. An empty table
    gives an empty result.
    """
    rows = cut(row_id(docs.select("doc_id", "source", "text")).select("_row", "doc_id", "source", size_of(F.col("text")).alias("size"))
               .withColumn("weight", F.length(F.bin("size"))))
    classes = cut(rows.groupBy("source", "weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    goal = cut(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    g = goal.withColumnRenamed("source", "s")
    plan = cut(expected_copies(classes.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s"), most))
    p = plan.select(F.col("source").alias("s"), F.col("weight").alias("w"), "source_size", "target", "whole", "chance")
    drawn = rows.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("weight") == F.col("w"))).drop("s", "w", "weight")
    u = uniform(F.col("doc_id"))
    odds = F.col("chance") / (1 - F.col("chance"))
    drawn = cut(drawn.withColumn("score", F.when((F.col("chance") > EPS) & (F.col("size") > 0), u / (1 - u) / odds)))
    budgets = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("budget"), F.sum("n").alias("rows"))
    taken = None
    for _ in range(ROUNDS):
        left = drawn.where(F.col("score").isNotNull())
        left = left if taken is None else left.join(taken.select("_row"), "_row", "left_anti")
        got = cut(take(left, budgets))
        taken = got if taken is None else taken.unionByName(got)
        spent = got.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("spent"))
        budgets = cut(budgets.join(spent, F.col("source").eqNullSafe(F.col("s")), "left")
                      .select("source", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"), "rows"))
    out = drawn.join(taken.select("_row", F.lit(1).alias("once")), "_row", "left")
    copies = (F.col("whole") + F.coalesce("once", F.lit(0))).cast("long")
    return out.select("_row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: all columns of ``docs``, each document as often as it is taken."""
    row, copies, copy = (fresh(docs, c) for c in ("_row", "_copies", "_copy"))
    taken = mix_sources(docs, weights, most).where((F.col("copies") > 0) & (F.col("size") > 0)).select(F.col("_row").alias(row), F.col("copies").cast("int").alias(copies))
    kept = row_id(docs, row).join(taken, row)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """The same in DuckDB."""
    places = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    sql = f"""
WITH r0 AS (SELECT row_number() OVER () AS _row, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
r AS (SELECT *, length(bin(size)) AS weight FROM r0),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM r GROUP BY source),
sw AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {places} END AS w FROM src),
-- a source is capped before all whose size per weight is larger
so AS (SELECT *, coalesce(sum({most} * ss) OVER (ORDER BY ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
  sum(w) OVER (ORDER BY ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, (SELECT sum(ss) FROM sw) AS t FROM sw),
lam AS (SELECT max(CAST(t - full_words AS DOUBLE) / CAST(open_weight AS DOUBLE)) AS share FROM so WHERE CAST(t - full_words AS DOUBLE) / CAST(open_weight AS DOUBLE) * w <= {most} * ss),
goal AS (SELECT source, ss AS source_size, least(coalesce(share, 1e300) * w, CAST({most} * ss AS DOUBLE)) AS target FROM sw, lam),
cl AS (SELECT r.source, weight, CAST(sum(size) AS BIGINT) AS words, any_value(source_size) AS source_size, any_value(target) AS target
  FROM r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source GROUP BY r.source, weight),
tried AS (SELECT *, (target - {most} * coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(words * weight) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM cl),
fit AS (SELECT *, first_value(k) OVER (PARTITION BY source ORDER BY CASE WHEN k * weight <= {most} + {EPS} THEN 0 ELSE 1 END, weight DESC) AS kk,
  max(CASE WHEN k * weight <= {most} + {EPS} THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS ok FROM tried),
cp AS (SELECT *, CASE WHEN target >= {most} * source_size THEN {most}.0::DOUBLE ELSE least(CASE WHEN ok = 1 THEN kk ELSE 0 END * weight, {most}.0::DOUBLE) END AS copies FROM fit),
plan AS (SELECT *, CAST(floor(copies + {EPS}) AS BIGINT) AS whole, greatest(copies - floor(copies + {EPS}), 0) AS chance FROM cp),
d0 AS (SELECT r._row, r.doc_id, r.source, r.size, source_size, target, whole, chance,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE AS u
  FROM r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source AND r.weight = p.weight),
d AS (SELECT *, CASE WHEN chance > {EPS} AND size > 0 THEN u / (1 - u) / (chance / (1 - chance)) END AS score FROM d0),
b0 AS (SELECT source, any_value(target) - CAST(sum(whole * words) AS DOUBLE) AS budget FROM plan GROUP BY source)"""
    done = []
    for i in range(ROUNDS):
        skip = " AND ".join(f"NOT EXISTS (SELECT 1 FROM t{j} WHERE t{j}._row = d._row)" for j in done) or "true"
        sql += f""",
t{i} AS (SELECT _row, source, size FROM (SELECT d._row, d.source, d.size, budget, sum(size) OVER (PARTITION BY d.source ORDER BY score, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b{i} b ON d.source IS NOT DISTINCT FROM b.source WHERE score IS NOT NULL AND size <= budget AND {skip}) WHERE upto <= budget),
b{i + 1} AS (SELECT b.source, budget - coalesce(spent, 0) AS budget FROM b{i} b LEFT JOIN (SELECT source, CAST(sum(size) AS DOUBLE) AS spent FROM t{i} GROUP BY source) s ON b.source IS NOT DISTINCT FROM s.source)"""
        done.append(i)
    once = " UNION ALL ".join(f"SELECT _row FROM t{j}" for j in done)
    return sql + f"""
SELECT doc_id, source, d.size, source_size, target, whole + CASE WHEN o._row IS NULL THEN 0 ELSE 1 END AS copies, (whole + CASE WHEN o._row IS NULL THEN 0 ELSE 1 END) * d.size AS taken
FROM d LEFT JOIN ({once}) o ON d._row = o._row"""
