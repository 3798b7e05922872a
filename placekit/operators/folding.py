"""Ordered folding: rows from strongest to weakest, each folded into a kept host or kept.

The outcome is that of one row after another, found by dependency: who may decide about whom is joined once, and a row
decides as soon as no undecided stronger row is left that could. The number of rounds is the longest chain of such
waits, not the number of rows; where hosts gather kinds, blocks of space settle such chains in order. Where very many
rows crowd one place, rounds of leaders thin it first, so that the pairs stay near a fixed number per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.operators import spatial
from placekit.plans.session import cut, is_empty

FOLDS = "guest_id string, host_id string, km double"

# rule -> does the first or the nearest host win, and do hosts gather their guests' kinds
NEAREST, FIRST, KINDS = "nearest", "first", "kinds"
CROWD = 256  # undecided rows of a block from which on leaders thin it before pairs are made
BLOCK_RADII = 64  # least width of a block that is walked in order
GOLDEN = 0.381966  # share of a width by which blocks move between rounds, so that borders do not come back soon


def fold(rows: DataFrame, on: list[str], rule: str, crowd: int = CROWD) -> DataFrame:
    """Fold ``rows`` (id, rank, lat, lon, radius, foldable, mask, *on) within groups of equal ``on``.

    Ranks are unique. Rows that cannot fold must outrank the ones that can; KINDS takes one radius for all. Returns
    guest_id, host_id, km.
    """
    rows = cut(rows.select("id", "rank", "lat", "lon", "radius", "foldable", "mask", *on))
    return _gathering(rows, on, crowd) if rule == KINDS else _fixed(rows, on, rule, crowd)


def _as_hosts(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.select(F.col("id").alias("host_id"), F.col("rank").alias("h_rank"), F.col("mask").alias("h_mask"),
                       F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), *on)


def _crowded(rows: DataFrame, km: str, on: list[str], crowd: int) -> bool:
    return not is_empty(rows.groupBy(spatial.block_of(km).alias("_block"), *on).count().where(F.col("count") > crowd))


def settle(waits: DataFrame) -> DataFrame | None:
    """Who is kept when a row folds exactly if a kept row it waits for exists: id, of ``waits`` (id, host_id).

    Rows that wait for nobody are kept and are not listed; they must all be among the hosts or not matter.
    """
    waits = cut(waits.select("id", "host_id").distinct())
    kept = cut(waits.select(F.col("host_id").alias("id")).distinct().join(waits.select("id").distinct(), "id", "left_anti"))
    out = []
    while not is_empty(kept):
        out.append(kept)
        folded = cut(waits.join(kept.withColumnRenamed("id", "host_id"), "host_id").select("id").distinct())
        rest = cut(waits.join(folded, "id", "left_anti").join(folded.withColumnRenamed("id", "host_id"), "host_id", "left_anti"))
        # what waited and waits no more is kept
        kept = cut(waits.select("id").distinct().join(folded, "id", "left_anti").join(rest.select("id").distinct(), "id", "left_anti"))
        waits = rest
    return union(out)


def union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _fixed(rows: DataFrame, on: list[str], rule: str, crowd: int) -> DataFrame:
    """Hosts never change once kept, so a row with any host in range is sure to fold."""
    order = ("h_rank", "km") if rule == FIRST else ("km", "h_rank")
    best = F.min(F.struct(*order, "host_id")).alias("_b")

    def reach(guests: DataFrame, hosts: DataFrame) -> DataFrame:
        pairs = spatial.radius_join(guests, hosts, "radius", on).where(F.col("h_rank") < F.col("rank"))
        return pairs.groupBy("id").agg(best)

    todo = rows.where("foldable")
    fixed = rows.where(~F.col("foldable"))
    if is_empty(fixed):
        kind = ", ".join(f"{c}: {'double' if c == 'km' else 'bigint'}" for c in order)
        todo = todo.withColumn("_b", F.lit(None).cast(f"struct<{kind}, host_id: string>"))
    else:
        # the nearest fixed host is enough: later hosts only compete with it
        near = spatial.nearest(todo, _as_hosts(fixed, on), "radius", "id", "host_id", on)
        ranks = fixed.select(F.col("id").alias("host_id"), F.col("rank").alias("h_rank"))
        near = near.join(ranks, "host_id").select("id", F.struct(*order, "host_id").alias("_b"))
        todo = todo.join(near, "id", "left")
    todo = cut(todo)

    def with_hosts(hosts: DataFrame) -> DataFrame:
        rest = todo.join(hosts.select("id"), "id", "left_anti")
        found = reach(rest.drop("_b"), _as_hosts(hosts, on)).withColumnRenamed("_b", "_new")
        return cut(rest.join(found, "id", "left").withColumn("_b", F.least("_b", "_new")).drop("_new"))

    open_ = todo.where(F.col("_b").isNull()).drop("_b")
    while _crowded(open_, "radius", on, crowd):
        firsts = spatial.block_min(open_, "rank", "radius", on).withColumnRenamed("rank", "_first")
        leaders = open_.withColumn("_block", spatial.block_of("radius")).join(firsts, ["_block", *on])
        todo = with_hosts(cut(leaders.where(F.col("rank") == F.col("_first")).drop("_block", "_first")))
        open_ = todo.where(F.col("_b").isNull()).drop("_b")
    open_ = cut(open_)
    waits = cut(spatial.radius_join(open_, _as_hosts(open_, on), "radius", on).where(F.col("h_rank") < F.col("rank")).select("id", "host_id"))
    kept = settle(waits)
    alone = open_.select("id").join(waits.select("id"), "id", "left_anti")
    kept = alone if kept is None else alone.unionByName(kept).distinct()
    todo = with_hosts(cut(open_.join(kept, "id", "left_semi")))
    return todo.where(F.col("_b").isNotNull()).select(F.col("id").alias("guest_id"), F.col("_b.host_id"), F.col("_b.km"))


def _gathering(rows: DataFrame, on: list[str], crowd: int) -> DataFrame:
    """Hosts gather kinds, which changes whom they accept.

    A row must know what stronger rows made of the hosts in its reach, and they did so within two radii of it. Rows go
    to blocks of space, and each block decides in order all that waits for nobody outside it; the borders of blocks
    move from round to round. So rounds follow how often a chain of waits crosses borders, not its length.
    """
    todo, hosts, folds = thin_crowds(rows, on, crowd)
    own = ["rank", "mask", "lat", "lon", "radius", *on]
    stronger = F.col("h_rank") < F.col("rank")
    # beyond the radius a row is only waited for
    waits = spatial.radius_join(todo.withColumn("_twice", F.expr("2 * radius")), _as_hosts(todo, on), "_twice", on).where(stronger).select(
        *own, "h_rank", F.when(F.col("km") <= F.col("radius"), F.col("km")).alias("km"), F.lit(None).cast("long").alias("held"))
    met = spatial.radius_join(todo, hosts, "radius", on).where(stronger).select(*own, "h_rank", "km", F.col("h_mask").cast("long").alias("held"))
    lone = todo.select(*own, F.lit(None).cast(rows.schema["rank"].dataType).alias("h_rank"), F.lit(None).cast("double").alias("km"), F.lit(None).cast("long").alias("held"))
    open_, turn, done = cut(waits.unionByName(met).unionByName(lone)), 0, []
    while not is_empty(open_):
        block = spatial.block_of(f"{BLOCK_RADII}D * radius", turn * GOLDEN % 1)
        dealt = open_.select(F.xxhash64(block, *on).alias("block"), F.col("rank").cast("long"), F.col("mask").cast("long").alias("mask"),
                             F.coalesce("h_rank", F.lit(-1)).cast("long").alias("h_rank"), F.coalesce("km", F.lit(-1.0)).alias("km"),
                             F.coalesce("held", F.lit(-2)).cast("long").alias("held"))
        step = cut(dealt.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(_walk, "rank long, mask long, host long, km double"))
        done.append(step.where(F.col("host").isNotNull()).select("rank", "host", "km"))
        # a kept row brings its own kinds, a guest brings its host more, and a guest is nobody's host
        guest = F.col("host").isNotNull()
        news = step.select(F.col("rank").alias("h_rank"), F.when(~guest, F.col("mask")).alias("more"), guest.alias("gone")).unionByName(
            step.where(guest).select(F.col("host").alias("h_rank"), F.col("mask").alias("more"), F.lit(False).alias("gone")))
        news = news.groupBy("h_rank").agg(F.bit_or("more").alias("more"), F.max("gone").alias("gone"))
        left = open_.join(step.select("rank"), "rank", "left_anti").join(news, "h_rank", "left").where(~F.coalesce("gone", F.lit(False)))
        left = left.withColumn("held", F.when(F.col("more").isNull(), F.col("held")).otherwise(F.coalesce("held", F.lit(0).cast("long")).bitwiseOR(F.col("more"))))
        open_ = cut(left.where(F.col("h_rank").isNull() | F.col("held").isNull() | F.col("km").isNotNull()).select(*open_.columns))
        turn += 1
    if done:
        names = cut(rows.select("rank", "id"))
        found = union(done).join(names.withColumnRenamed("id", "guest_id"), "rank").drop("rank")
        folds.append(found.join(names.select(F.col("rank").alias("host"), F.col("id").alias("host_id")), "host").select("guest_id", "host_id", "km"))
    if folds:
        return union(folds)
    return rows.select(F.col("id").alias("guest_id"), F.col("id").alias("host_id"), F.lit(0.0).alias("km")).limit(0)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, rank), one for each stronger row met: those that can be decided, with their hosts.

    A row waits when a stronger one in two radii is undecided and not in its block, or waits itself. But it folds at once
    when it brings its host no new kind and nobody nearer can still become one that takes it: hosts only ever gain kinds,
    so the host takes it in any case, and who is waited for sees that host as if the row had not come.

    There are no nulls: a row that meets nobody has the host -1, who is beyond the radius the km -1, who is undecided holds -2.
    """
    block = rank = mask = best = nearer = None
    waiting, state = False, {}  # of a kept row its kinds, of a guest -1; who waits is not in it
    out: list[tuple] = []

    def decide() -> None:
        if rank is None:
            return
        if waiting and (best is None or mask & ~best[2] or (nearer is not None and nearer < best[:2])):
            return
        if best is None:
            state[rank] = mask
            out.append((rank, mask, None, None))
        else:
            state[rank] = -1
            state[best[1]] = best[2] | mask
            out.append((rank, mask, best[1], best[0]))

    def found() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["rank", "mask", "host", "km"])
        out.clear()
        return got

    for batch in batches:
        for at, number, own, host, km, held in zip(*(batch.column(c).to_numpy().tolist() for c in ("block", "rank", "mask", "h_rank", "km", "held")), strict=True):
            if at != block or number != rank:
                decide()
                if at != block:
                    state = {}
                block, rank, mask, best, nearer, waiting = at, number, own, None, None, False
            if host < 0:
                continue
            held = state.get(host, held)
            if held == -2:
                waiting = True
            if km < 0 or held == -1:
                continue
            if held >= 0 and (own == 0 or held == 0 or own & held):
                if best is None or (km, host) < best[:2]:
                    best = (km, host, held)
            elif nearer is None or (km, host) < nearer:
                nearer = (km, host)  # undecided, or may still learn a kind of the row's
        yield found()
    decide()
    yield found()


def thin_crowds(rows: DataFrame, on: list[str], crowd: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Undecided rows, kept hosts and folds once no block of two radii is crowded with undecided rows.

    Only a row that becomes a host, or teaches its host a new kind, changes anything. Rows ahead of the first such row
    within two radii are settled together; that row is applied.
    """
    todo, folds = rows, []
    hosts = _as_hosts(rows, on).limit(0)
    twice = "2 * radius"
    while _crowded(todo, twice, on, crowd):
        mask, held = F.col("mask"), F.col("h_mask")
        pairs = spatial.radius_join(todo, hosts, "radius", on).where(F.col("h_rank") < F.col("rank"))
        pairs = pairs.where((mask == 0) | (held == 0) | (mask.bitwiseAND(held) != 0))
        best = pairs.groupBy("id").agg(F.min(F.struct("km", "h_rank", "host_id", "h_mask")).alias("_b"))
        seen = todo.join(best, "id", "left")
        grows = F.col("_b").isNull() | (mask.bitwiseAND(F.bitwise_not(F.col("_b.h_mask"))) != 0)
        seen = cut(seen.withColumn("_moves", F.coalesce(grows, F.lit(True))).withColumn("_block", spatial.block_of(twice)))
        firsts = spatial.block_min(seen.where("_moves"), "rank", twice, on).withColumnRenamed("rank", "_first")
        seen = seen.join(firsts, ["_block", *on], "left")
        ahead = F.col("_first").isNull() | (F.col("rank") < F.col("_first"))
        step = cut(seen.withColumn("_now", F.when(F.col("_moves"), F.col("rank") == F.col("_first")).otherwise(ahead)))
        done = step.where("_now")
        folds.append(done.where(F.col("_b").isNotNull()).select(F.col("id").alias("guest_id"), F.col("_b.host_id"), F.col("_b.km")))
        taught = done.where(F.col("_b").isNotNull() & F.col("_moves")).groupBy("_b.host_id").agg(F.bit_or("mask").alias("_more"))
        grown = hosts.join(taught, "host_id", "left").withColumn("h_mask", F.col("h_mask").bitwiseOR(F.coalesce("_more", F.lit(0)))).drop("_more")
        hosts = cut(grown.unionByName(_as_hosts(done.where(F.col("_b").isNull()), on)))
        todo = cut(step.where(~F.col("_now")).select(*rows.columns))
    return todo, hosts, folds


def roots(folds: DataFrame) -> DataFrame:
    """Follow guest -> host links to the surviving host: guest_id, root_id.

    Every pass doubles the length of the links followed.
    """
    links = cut(folds.select("guest_id", F.col("host_id").alias("root_id")))
    while True:
        nxt = links.select(F.col("guest_id").alias("root_id"), F.col("root_id").alias("_next"))
        if is_empty(links.join(nxt, "root_id", "left_semi")):
            return links
        links = cut(links.join(nxt, "root_id", "left").select(
            "guest_id", F.coalesce("_next", "root_id").alias("root_id")))
