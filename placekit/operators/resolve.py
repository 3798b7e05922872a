"""One place, not two spellings or a suburb and its city.

A candidate frame has one row per candidate:
``candidate_id, name, country, lat, lon, is_site, population, tiers, landforms, relief_m,
coherence, historic_capital, profile, reach, has_lodging, access, overtourism, kinds, sources``.

Each step returns a :class:`Resolved`: the survivors, a log of what folded into what, and is
exact in the order it states. Steps do not commute.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import geo, kinds, text
from placekit.functions.vocab import (
    CITY_RADIUS, CITY_RADIUS_MAX, CITY_RADIUS_MIN, PARAMS, PROTECTED_SOURCES, PROTECTED_TIERS,
    TIER_WEIGHT, Params, lookup,
)
from placekit.operators import spatial
from placekit.operators.folding import FIRST, GOLDEN, KINDS, NEAREST, fold, roots, union
from placekit.operators.scoring import bulk
from placekit.plans.session import cut, is_empty, number_rows

CANDIDATE = (
    "candidate_id", "name", "country", "lat", "lon", "is_site", "population", "tiers", "landforms",
    "relief_m", "coherence", "historic_capital", "profile", "reach", "has_lodging", "access",
    "overtourism", "kinds", "sources",
)
DEFAULTS = {
    "is_site": lambda: F.lit(False), "population": lambda: F.lit(0.0), "tiers": kinds.no_tiers,
    "landforms": lambda: F.array().cast("array<string>"), "relief_m": lambda: F.lit(0.0),
    "coherence": lambda: F.lit(0.0), "historic_capital": lambda: F.lit(False),
    "profile": lambda: F.create_map().cast("map<string,string>"), "reach": lambda: F.lit("near"),
    "has_lodging": lambda: F.lit(True), "access": lambda: F.lit("open"),
    "overtourism": lambda: F.lit(False), "kinds": kinds.zero,
    "sources": lambda: F.array().cast("array<string>"),
}


@dataclass
class Resolved:
    """Survivors and the log: country, guest_id, host_id, kept, folded, decision, km, similarity."""

    kept: DataFrame
    log: DataFrame


def complete(cands: DataFrame) -> DataFrame:
    """Fill in missing candidate columns with their defaults."""
    have = set(cands.columns)
    return cands.select(*[F.col(c) if c in have else DEFAULTS[c]().alias(c) for c in CANDIDATE])


# ------------------------------------------------------------------ who is stronger
def harvest_only() -> Column:
    """The record exists because a crawl found it, not a globally adjudicated list."""
    listed = " or ".join(f"{kinds.tier_at('tiers', t)} > 0" for t in PROTECTED_TIERS)
    names = ", ".join(f"'{s}'" for s in PROTECTED_SOURCES)
    return F.expr(f"not ({listed} or arrays_overlap(sources, array({names})))")


def density_extra(p: Params = PARAMS) -> Column:
    return harvest_only() & (F.col("population") < p.harvest_city_pop)


def city_radius(heads: Column) -> Column:
    out = F.lit(CITY_RADIUS_MIN)
    for floor, km in reversed(CITY_RADIUS):
        out = F.when(heads >= floor, km).otherwise(out)
    return out


def strength(p: Params = PARAMS) -> list[Column]:
    """Sort keys, strongest first; the id makes it a total order."""
    total = F.aggregate("tiers", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return [
        F.when(F.col("population") >= p.harvest_city_pop, 0).otherwise(1),
        F.when(harvest_only(), 1).otherwise(0),
        -F.col("population"), -F.size("sources"), -total, F.length("name"), F.col("candidate_id"),
    ]


def _fold_rows(cands: DataFrame, p: Params) -> DataFrame:
    keyed = cands.select(
        "*", *[c.alias(f"_s{i}") for i, c in enumerate(strength(p))])
    return number_rows(keyed, [F.col(f"_s{i}") for i in range(7)]).drop(*[f"_s{i}" for i in range(7)])


# ------------------------------------------------------------------ applying folds
def apply_folds(cands: DataFrame, folds: DataFrame, kinds_scale: float = 1.0,
                population: str = "max") -> DataFrame:
    """Fold guests into surviving hosts: sums of counts, maxima of measures, unions of sets.

    Only guest rows are shuffled to their hosts, as partial aggregates.
    """
    gone = folds.select(F.col("guest_id").alias("candidate_id"), F.col("root_id").alias("_host"))
    guests = cands.join(gone, "candidate_id")
    pop = F.sum("population") if population == "sum" else F.max("population")
    gain = guests.groupBy("_host").agg(
        kinds.tier_sum("tiers").alias("_tiers"), kinds.max_vector("kinds").alias("_kinds"),
        F.array_distinct(F.flatten(F.collect_set("landforms"))).alias("_forms"),   # vocabulary-sized
        F.array_distinct(F.flatten(F.collect_set("sources"))).alias("_sources"),   # vocabulary-sized
        F.max("relief_m").alias("_relief"), F.max("coherence").alias("_coherence"), pop.alias("_pop"),
        F.max("historic_capital").alias("_capital"))
    out = cands.join(gone.select("candidate_id"), "candidate_id", "left_anti")
    out = out.join(gain.withColumnRenamed("_host", "candidate_id"), "candidate_id", "left")
    met = F.col("_pop").isNotNull()

    def merged(name: str, value: Column) -> Column:
        return F.when(met, value).otherwise(F.col(name)).alias(name)

    heads = F.greatest("population", "_pop") if population == "max" else F.col("population") + F.col("_pop")
    capital = F.col("historic_capital") | F.col("_capital")
    if population == "keep":  # an absorbed site brings neither residents nor a seat of state
        heads, capital = F.col("population"), F.col("historic_capital")
    new = {
        "tiers": kinds.add_tiers(F.col("tiers"), F.col("_tiers")),
        "kinds": kinds.longest(F.col("kinds"), F.transform("_kinds", lambda w: w * kinds_scale)),
        "landforms": F.array_sort(F.array_union("landforms", "_forms")),
        "sources": F.array_sort(F.array_union("sources", "_sources")),
        "relief_m": F.greatest("relief_m", "_relief"), "coherence": F.greatest("coherence", "_coherence"),
        "historic_capital": capital, "population": heads,
    }
    return out.select(*[merged(c, new[c]) if c in new else F.col(c) for c in cands.columns])


def _log(cands: DataFrame, folds: DataFrame, decision: str, digits: int) -> DataFrame:
    who = cands.select(F.col("candidate_id").alias("guest_id"), "country", F.col("name").alias("folded"))
    host = cands.select(F.col("candidate_id").alias("host_id"), F.col("name").alias("kept"))
    return (folds.join(who, "guest_id").join(host, "host_id")
            .select("country", "guest_id", "host_id", "kept", "folded", F.lit(decision).alias("decision"),
                    F.bround("km", digits).alias("km"), F.lit(None).cast("double").alias("similarity")))


def _finish(cands: DataFrame, folds: DataFrame, decision: str, digits: int, chained: bool,
            **kw) -> Resolved:
    folds = cut(folds)
    ends = roots(folds) if chained else folds.select("guest_id", F.col("host_id").alias("root_id"))
    return Resolved(apply_folds(cands, ends, **kw), _log(cands, folds, decision, digits))


# ------------------------------------------------------------------ G01, J07
# Buckets up to this size compare every pair; larger ones join on shared near-spellings. One of 17 letters has up to 154 of these, each
# opened, sorted and met, which is dearer than comparing it with a few hundred others.
BUCKET_PAIRS = 512


def _spellings(name: Column) -> Column:
    """A folded name and every form with one or two letters left out.

    Two names within two edits, or a prefix short of two, always share one of these.
    """
    def drop_one(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(
            F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    one = F.array_distinct(drop_one(name))
    two = F.array_distinct(F.flatten(F.transform(one, drop_one)))
    return F.array_distinct(F.concat(F.array(name), one, two))


def transliteration_pairs(cands: DataFrame, p: Params = PARAMS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Pairs at one rounded point of one country whose names spell each other: strong_id, weak_id, s."""
    keys = ["country", "_y", "_x"]
    rows = cands.select("candidate_id", "name", "country", F.bround("lat", 3).alias("_y"),
                        F.bround("lon", 3).alias("_x"), F.struct(*[c.alias(f"s{i}") for i, c in enumerate(strength(p))]).alias("s"))
    shared = rows.groupBy(*keys).count().where(F.col("count") > 1)  # most points hold one candidate
    rows = cut(rows.join(shared, keys).withColumn("f", text.fold_key("name")))

    def matched(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        left = a.select(*on, F.col("candidate_id").alias("strong_id"), "s", F.col("f").alias("_fa"))
        right = b.select(*on, F.col("candidate_id").alias("weak_id"), F.col("s").alias("_sb"), F.col("f").alias("_fb"))
        return (left.join(right, on).where((F.col("s") < F.col("_sb")) & text.transliterates(F.col("_fa"), F.col("_fb")))
                .select("strong_id", "weak_id", "s"))

    few = rows.where(F.col("count") <= bucket_pairs)
    many = rows.where(F.col("count") > bucket_pairs)
    pairs = matched(few, few, keys)
    if not is_empty(many):
        spelt = many.where(F.length("f") > 0).withColumn("_v", F.explode(_spellings(F.col("f"))))
        pairs = pairs.unionByName(matched(spelt, spelt, [*keys, "_v"]).distinct())
    return pairs


def merge_transliterations(cands: DataFrame, p: Params = PARAMS, bucket_pairs: int = BUCKET_PAIRS) -> Resolved:
    """Same country, same rounded point, two spellings: one place, strongest record first."""
    pairs = cut(transliteration_pairs(cands, p, bucket_pairs))
    live, gone = pairs, None
    while not is_empty(live):
        # a record no stronger undecided one can claim is kept; what it matches folds
        weak = live.select(F.col("weak_id").alias("strong_id")).distinct()
        new = cut(live.join(weak, "strong_id", "left_anti").select("weak_id").distinct())
        gone = new if gone is None else gone.unionByName(new)
        live = cut(live.join(new, "weak_id", "left_anti")
                   .join(new.withColumnRenamed("weak_id", "strong_id"), "strong_id", "left_anti"))
    if gone is None:
        folds = pairs.select(F.col("weak_id").alias("guest_id"), F.col("strong_id").alias("host_id"), F.lit(0.0).alias("km")).limit(0)
    else:
        hosts = pairs.join(gone, "weak_id").join(gone.withColumnRenamed("weak_id", "strong_id"), "strong_id", "left_anti")
        folds = hosts.groupBy("weak_id").agg(F.min(F.struct("s", "strong_id")).alias("_b")).select(
            F.col("weak_id").alias("guest_id"), F.col("_b.strong_id").alias("host_id"), F.lit(0.0).alias("km"))
    return _finish(cands, folds, "transliteration", 1, False)


# ------------------------------------------------------------------ G02
FIRST_HEADS = 4096  # heads of the first slice, or a share of all
HEADS_SHARE, HEADS_STEP = 64, 4
GROWTH_BLOCK_KM = 256.0  # least width of a block whose heads are walked in order


def _grow_cities(rows: DataFrame, share: float, first_heads: int = FIRST_HEADS) -> DataFrame:
    """Suburbs of each growing head: guest_id, host_id, km.

    Heads are taken in slices from the largest on, each some times wider than those before it. Smaller heads cannot
    change what larger ones do, and by the time they are looked at, most of what they could take is gone; so pairs are
    made of what is left only.
    """
    towns = cut(number_rows(rows, [F.col("population").desc(), F.col("candidate_id")]).withColumn("size", F.col("population")))
    able = cut(_with_guests(towns.where(F.col("population") > 0), towns, share).select("candidate_id", "rank"))
    last = able.agg(F.max("rank").alias("r")).first()["r"] or 0
    done, end, folds = 0, max(first_heads, last // HEADS_SHARE), [towns.select(F.col("candidate_id").alias("guest_id"), F.col("candidate_id").alias("host_id"), F.lit(0.0).alias("km")).limit(0)]
    while True:
        chosen = able.where((F.col("rank") > done) & (F.col("rank") <= end)).select("candidate_id")
        taken, grown = _grow_slice(towns.join(chosen, "candidate_id", "left_semi"), towns, share)
        folds += taken
        if end >= last:
            return union(folds)
        if taken:
            gone, sizes = union(taken).select(F.col("guest_id").alias("candidate_id")), union(grown).select(F.col("host_id").alias("candidate_id"), "now")
            towns = cut(towns.join(gone, "candidate_id", "left_anti").join(sizes, "candidate_id", "left")
                        .withColumn("size", F.coalesce("now", "size")).drop("now"))
        done, end = end, end * HEADS_STEP


def _as_guests(towns: DataFrame) -> DataFrame:
    return spatial.as_right(towns.where("harvest").select("candidate_id", "country", "lat", "lon", "size", F.col("rank").alias("g_rank")), guest_id="candidate_id")


def _with_guests(heads: DataFrame, towns: DataFrame, share: float) -> DataFrame:
    """Heads with somebody small enough in reach; the others never have one, for towns only grow or go."""
    wide = heads.withColumn("reach", city_radius(F.col("population"))).select("candidate_id", "country", "lat", "lon", "population", "reach")
    first = spatial.radius_join(wide, _as_guests(towns), "reach", ["country"]).where(
        (F.col("guest_id") != F.col("candidate_id")) & (F.col("size") <= F.col("population") * share))
    return heads.join(first.select("candidate_id").distinct(), "candidate_id", "left_semi")


def _rising(pairs: DataFrame, share: float, most: bool) -> DataFrame:
    """The least fixed point of "a head holds those in reach and small enough": host_id, now. Growth only ever adds.

    With ``most``, larger guests count with what they can hold themselves, so that no head comes to more than this.
    """
    grown = pairs.groupBy("host_id").agg(F.first("heads").alias("now"))
    inside = (F.col("km") <= city_radius(F.col("now"))) & (F.col("size") <= F.col("now") * share)

    def relax(cur: DataFrame) -> DataFrame:
        met, brought = pairs.join(cur, "host_id"), F.col("size")
        if most:
            met = met.join(cur.select(F.col("host_id").alias("guest_id"), F.col("now").alias("_held")), "guest_id", "left")
            brought = F.when(F.col("g_rank") < F.col("h_rank"), F.greatest("size", "_held")).otherwise(F.col("size"))
        gain = met.groupBy("host_id").agg(F.first("heads").alias("heads"), F.sum(F.when(inside, brought).otherwise(0.0)).alias("_more"))
        return gain.select("host_id", (F.col("heads") + F.col("_more")).alias("now"))

    while True:
        before = cut(relax(grown) if most else relax(relax(grown)))
        grown = cut(relax(before))
        if is_empty(grown.join(before.withColumnRenamed("now", "_was"), "host_id").where(F.col("now") > F.col("_was") + 1e-6)):
            return grown


def _grow_slice(heads: DataFrame, towns: DataFrame, share: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """What the heads of one slice take (guest_id, host_id, km) and come to (host_id, now), in rounds.

    A head decides once no larger one can take the head or any of its guests, and no larger head is among these; who
    can is judged by the most that each can come to. A head whose guests are all gone is done and keeps nobody waiting.
    Blocks of space decide in order all heads that wait for nobody outside; their borders move from round to round.
    """
    able = cut(_with_guests(heads, towns, share).select(F.col("candidate_id").alias("host_id"), "country", "lat", "lon", F.col("population").alias("heads"), F.col("rank").alias("h_rank")))
    # no head outgrows all that lies in the widest circle around it
    pairs = cut(spatial.radius_join(able, _as_guests(towns), CITY_RADIUS_MAX, ["country"]).where(F.col("guest_id") != F.col("host_id"))
                .select("host_id", "lat", "lon", "h_rank", "heads", "guest_id", "g_rank", "size", "km"))
    inside = (F.col("km") <= city_radius(F.col("now"))) & (F.col("size") <= F.col("now") * share)
    pairs = cut(pairs.join(_rising(pairs, share, True), "host_id").where(inside).select("lat", "lon", "h_rank", "heads", "g_rank", "size", "km"))
    names = towns.select("rank", "candidate_id")
    folds, sizes, turn = [], [], 0
    while not is_empty(pairs):
        dealt = cut(pairs.withColumn("block", spatial.block_of(GROWTH_BLOCK_KM, turn * GOLDEN % 1)).drop("lat", "lon"))
        # of each town the two blocks with the largest heads that can take it, and the block in which it is a head
        claims = dealt.groupBy("g_rank", "block").agg(F.min("h_rank").alias("least")).groupBy(F.col("g_rank").alias("rank")).agg(
            F.slice(F.array_sort(F.collect_list(F.struct("least", "block"))), 1, 2).alias("claims"))
        about = cut(claims.join(dealt.groupBy(F.col("h_rank").alias("rank")).agg(F.first("block").alias("own")), "rank", "full"))
        told = (dealt.join(about.withColumnsRenamed({"rank": "g_rank", "claims": "_g", "own": "_at"}), "g_rank")
                .join(about.select(F.col("rank").alias("h_rank"), F.col("claims").alias("_h")), "h_rank"))

        def outside(claims: str) -> Column:
            return F.coalesce(F.exists(claims, lambda c: (c["block"] != F.col("block")) & (c["least"] < F.col("h_rank"))), F.lit(False))

        above = F.coalesce((F.col("_at") != F.col("block")) & (F.col("g_rank") < F.col("h_rank")), F.lit(False))
        told = told.select("block", F.col("h_rank").cast("long"), "heads", F.col("g_rank").cast("long"), "size", "km", outside("_h").alias("claimed"), (outside("_g") | above).alias("shared"))
        step = cut(told.repartition("block").sortWithinPartitions("block", "h_rank").mapInArrow(lambda batches: _walk_heads(batches, share), "rank long, host long, value double"))
        guest = F.col("host").isNotNull()
        named = step.where(guest).join(names, "rank").select(F.col("candidate_id").alias("guest_id"), F.col("host").alias("rank"), F.col("value").alias("km"))
        folds.append(cut(named.join(names, "rank").select("guest_id", F.col("candidate_id").alias("host_id"), "km")))
        sizes.append(cut(step.where(~guest).join(names, "rank").select(F.col("candidate_id").alias("host_id"), F.col("value").alias("now"))))
        news = cut(step.groupBy("rank").agg(F.max(guest).alias("gone"), F.max(F.when(~guest, F.col("value"))).alias("now")))
        pairs = cut(pairs.join(news.select(F.col("rank").alias("h_rank")), "h_rank", "left_anti").join(news.withColumnRenamed("rank", "g_rank"), "g_rank", "left")
                    .where(~F.coalesce("gone", F.lit(False))).withColumn("size", F.coalesce("now", "size")).select(*pairs.columns))
        turn += 1
    return folds, sizes


def _walk_heads(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, h_rank), one for each guest of a head: what the heads take, and what they come to.

    ``claimed`` and ``shared`` say that a larger head of another block is to be waited for, because of the head or of
    the guest. Returns (guest, head, km) and (head, null, size).
    """
    block = head = None
    heads, claimed, guests = 0.0, False, []
    gone, grown, waiting, held = set(), {}, set(), set()
    out: list[tuple] = []

    def decide() -> None:
        if head is None or head in gone:
            return
        left = [(g, grown.get(g, size), km, shared) for g, size, km, shared in guests if g not in gone]
        if claimed or head in held or any(shared or g in held or g in waiting for g, _, _, shared in left):
            waiting.add(head)
            held.update(g for g, *_ in left)
            return
        now = heads
        while True:
            reach = next((km for floor, km in CITY_RADIUS if now >= floor), CITY_RADIUS_MIN)
            got = [g for g in left if g[2] <= reach and g[1] <= now * share]
            if not got:
                break
            now += sum(g[1] for g in got)
            out.extend((g[0], head, g[2]) for g in got)
            taken = {g[0] for g in got}
            gone.update(taken)
            left = [g for g in left if g[0] not in taken]
        grown[head] = now
        out.append((head, None, now))

    def found() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.float64())
        got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(types)], ["rank", "host", "value"])
        out.clear()
        return got

    columns = ("block", "h_rank", "heads", "g_rank", "size", "km", "claimed", "shared")
    for batch in batches:
        for at, number, people, guest, size, km, mine, shared in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if at != block or number != head:
                decide()
                if at != block:
                    gone, grown, waiting, held = set(), {}, set(), set()
                block, head, heads, claimed, guests = at, number, people, mine, []
            guests.append((guest, size, km, shared))
        yield found()
    decide()
    yield found()


def agglomerate(cands: DataFrame, p: Params = PARAMS) -> Resolved:
    """Fold suburbs into growing cities, largest head first (G02); comparable cities never merge."""
    rows = cut(cands.where(~F.col("is_site")).select(
        "candidate_id", "country", "lat", "lon", "population", harvest_only().alias("harvest")))
    return _finish(cands, _grow_cities(rows, p.suburb_share), "agglomerated", 1, True, population="sum")


# ------------------------------------------------------------------ G03
def absorb_near_duplicates(cands: DataFrame, p: Params = PARAMS) -> Resolved:
    """Same country, closer than two kilometres, a kind in common or none known: one place."""
    rows = _fold_rows(cands, p).select(
        F.col("candidate_id").alias("id"), "rank", "lat", "lon", F.lit(float(p.close_pair_km)).alias("radius"),
        F.lit(True).alias("foldable"), kinds.mask(F.col("kinds")).alias("mask"), "country")
    return _finish(cands, fold(rows, ["country"], KINDS), "absorbed", 2, False)


# ------------------------------------------------------------------ G04
def _thin(rows: DataFrame, p: Params) -> DataFrame:
    """Density passes; only countries that stay crowded widen their spacing and go again."""
    alive, folds = cut(rows), []
    active = alive.select("country", "spacing", "target").distinct()
    while True:
        part = alive.join(active.select("country", F.col("spacing").alias("radius")), "country").where(F.col("kind").isNotNull())
        part = part.select(F.col("candidate_id").alias("id"), "rank", "lat", "lon", "radius",
                           F.col("extra").alias("foldable"), F.lit(0).alias("mask"), "country", "kind")
        new = cut(fold(part, ["country", "kind"], NEAREST))
        folds.append(new)
        alive = cut(alive.join(new.select(F.col("guest_id").alias("candidate_id")), "candidate_id", "left_anti"))
        left = alive.groupBy("country").count()
        active = cut(active.join(left, "country").where(
            (F.col("count") > F.col("target") * 1.5) & (F.col("spacing") < p.harvest_max_spacing_km)).select(
            "country", F.least(F.lit(p.harvest_max_spacing_km), F.col("spacing") * 1.25).alias("spacing"), "target"))
        if is_empty(active):
            return union(folds)


def density_rows(cands: DataFrame, countries: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Per candidate: rank, primary kind, whether it is a crawl extra, and the country's spacing."""
    inventory = cands.groupBy("country").agg(F.bit_count(F.bit_or(kinds.mask(F.col("kinds")))).alias("n_kinds"))
    facts = inventory.join(countries.select("country", "area_km2"), "country", "left")
    area = F.coalesce("area_km2", F.lit(p.default_area_km2))
    facts = facts.select("country", geo.harvest_spacing(area, F.col("n_kinds"), p).alias("spacing"),
                         geo.harvest_target(area, F.col("n_kinds")).alias("target"))
    kind = kinds.primary(F.col("kinds"))
    return (_fold_rows(cands, p).select("candidate_id", "country", "lat", "lon", "rank", kind.alias("kind"),
                                        (density_extra(p) & kind.isNotNull()).alias("extra"))
            .join(facts, "country"))


def cap_density(cands: DataFrame, countries: DataFrame, p: Params = PARAMS) -> Resolved:
    """Fold crawl extras of one kind that sit closer than the country's spacing.

    Cities and globally listed places never fold, and a kind's only place always stays.
    """
    return _finish(cands, _thin(density_rows(cands, countries, p), p), "density", 1, True)


# ------------------------------------------------------------------ G05
def orphan_sites(orphans: DataFrame, p: Params = PARAMS, min_weight: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Heavy assets nobody is near become site candidates, heaviest first.

    Returns the new candidates and the membership table (asset_id, leader_id).
    """
    heavy = orphans.withColumn("weight", lookup(TIER_WEIGHT, F.col("tier"))).where(F.col("weight") >= min_weight)
    heavy = cut(heavy)
    rows = number_rows(heavy, [F.col("weight").desc(), F.col("asset_id")]).select(
        F.col("asset_id").alias("id"), "rank", "lat", "lon", F.lit(float(p.catchment_km)).alias("radius"),
        F.lit(True).alias("foldable"), F.lit(0).alias("mask"))
    folds = cut(fold(rows, [], FIRST))
    member = heavy.join(folds.select(F.col("guest_id").alias("asset_id"), F.col("host_id").alias("leader_id")), "asset_id", "left")
    member = member.withColumn("leader_id", F.coalesce("leader_id", "asset_id"))
    groups = member.groupBy("leader_id").agg(
        kinds.tier_counts("tier").alias("tiers"), F.array_sort(F.collect_set("source")).alias("sources"))
    lead = heavy.join(groups.withColumnRenamed("leader_id", "asset_id"), "asset_id")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("asset_id")) if "name" in heavy.columns else F.col("asset_id")
    sites = lead.select(F.concat(F.lit("site:"), "asset_id").alias("candidate_id"), name.alias("name"), "country",
                        "lat", "lon", F.lit(True).alias("is_site"), "tiers", "sources")
    return complete(sites), member.select("asset_id", "leader_id")


# ------------------------------------------------------------------ G06, J04
def _absorb_in_order(pairs: DataFrame, least: float, scale: float) -> DataFrame:
    """Sites in order per host: settle everything up to the first site that would change its host, apply that one, go
    again. A host changes only where a site lifts one of its kinds, so rounds are few whatever the number of sites."""
    todo = cut(pairs)
    hosts = cut(pairs.groupBy("host_id").agg(kinds.max_vector("host_kinds").alias("held")))
    out = []
    while not is_empty(todo):
        sim = kinds.cosine(F.col("site_kinds"), F.col("held"))
        seen = todo.join(hosts, "host_id").withColumn("similarity", sim).withColumn("absorbed", F.col("similarity") >= least)
        lifted = F.exists(F.zip_with("site_kinds", "held", lambda v, h: v * scale > h), lambda x: x)
        seen = cut(seen.withColumn("_moves", F.col("absorbed") & lifted))
        first = seen.where("_moves").groupBy("host_id").agg(F.min("site_id").alias("_first"))
        step = cut(seen.join(first, "host_id", "left").withColumn(
            "_now", F.col("_first").isNull() | (F.col("site_id") <= F.col("_first"))))
        done = step.where("_now").select("site_id", "host_id", "km", "similarity", "absorbed")
        out.append(done)
        taught = step.where(F.col("site_id") == F.col("_first")).select("host_id", F.col("site_kinds").alias("_v"))
        hosts = cut(hosts.join(taught, "host_id", "left").select("host_id", F.when(
            F.col("_v").isNull(), F.col("held")).otherwise(kinds.longest(F.col("held"), F.transform("_v", lambda w: w * scale))).alias("held")))
        todo = cut(step.where(~F.col("_now")).select(*todo.columns))
    if not out:
        return todo.select("site_id", "host_id", "km", F.lit(0.0).alias("similarity"), F.lit(False).alias("absorbed"))
    return union(out)


def site_decisions(cands: DataFrame, p: Params = PARAMS, scale: float = 0.8) -> DataFrame:
    """Each site within a settlement's catchment, absorbed or retained, in site order per host."""
    sites, towns = cands.where("is_site"), cands.where(~F.col("is_site"))
    near = spatial.nearest(sites.select("candidate_id", "lat", "lon"),
                           spatial.as_right(towns.select("candidate_id", "lat", "lon"), host_id="candidate_id"),
                           p.catchment_km, "candidate_id", "host_id")
    pairs = (near.join(sites.select("candidate_id", F.col("kinds").alias("site_kinds")), "candidate_id")
             .join(towns.select(F.col("candidate_id").alias("host_id"), F.col("kinds").alias("host_kinds")), "host_id")
             .withColumnRenamed("candidate_id", "site_id"))
    pairs = cut(pairs)
    return _absorb_in_order(pairs, p.absorb_similarity, scale)


def absorb_sites(cands: DataFrame, p: Params = PARAMS) -> Resolved:
    """Fold sites into a nearby settlement when they are the same experience.

    The merged place takes the name order and pin of its stronger part, judged by what each
    held before merging; names list every absorbed site.
    """
    said = cut(site_decisions(cands, p))
    who = cands.select(F.col("candidate_id").alias("site_id"), F.col("name").alias("site"), "country",
                       F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), bulk("tiers", p).alias("_sbulk"))
    host = cands.select(F.col("candidate_id").alias("host_id"), F.col("name").alias("host"), bulk("tiers", p).alias("_hbulk"))
    rows = said.join(who, "site_id").join(host, "host_id")
    taken = rows.where("absorbed")
    folds = taken.select(F.col("site_id").alias("guest_id"), F.col("host_id").alias("root_id"))
    best = F.max_by(F.struct("site_id", "site", "_slat", "_slon", "_sbulk"), F.struct("_sbulk", "site_id"))
    lead = taken.groupBy("host_id", "_hbulk").agg(
        best.alias("_top"), F.array_sort(F.collect_list(F.struct("site_id", "site"))).alias("_all"))
    stronger = F.col("_top._sbulk") > F.col("_hbulk")
    rest = F.filter("_all", lambda s: ~(stronger & (s["site_id"] == F.col("_top.site_id"))))
    tail = F.array_join(F.transform(rest, lambda s: F.concat(F.lit(" (+"), s["site"], F.lit(")"))), "")
    lead = lead.select(F.col("host_id").alias("candidate_id"), stronger.alias("_wins"), F.col("_top.site").alias("_site"),
                       F.col("_top._slat").alias("_slat"), F.col("_top._slon").alias("_slon"), tail.alias("_tail"))
    kept = apply_folds(cands, folds, kinds_scale=0.8, population="keep").join(lead, "candidate_id", "left")
    wins = F.coalesce("_wins", F.lit(False))
    new = {
        "name": F.concat(F.when(wins, F.concat("_site", F.lit(" / "), "name")).otherwise(F.col("name")), F.coalesce("_tail", F.lit(""))),
        "lat": F.when(wins, F.col("_slat")).otherwise(F.col("lat")),
        "lon": F.when(wins, F.col("_slon")).otherwise(F.col("lon")),
    }
    kept = kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in cands.columns])
    log = rows.select("country", F.col("site_id").alias("guest_id"), "host_id", F.col("host").alias("kept"),
                      F.col("site").alias("folded"), F.when(F.col("absorbed"), "absorbed").otherwise("retained").alias("decision"),
                      F.bround("km", 0).alias("km"), F.bround("similarity", 2).alias("similarity"))
    return Resolved(kept, log)


# ------------------------------------------------------------------ reports
def close_pairs(cands: DataFrame, km: float = PARAMS.close_pair_km) -> DataFrame:
    """Unordered same-country pairs within ``km`` with both sides' kinds."""
    side = cands.select("candidate_id", "name", "country", "lat", "lon", kinds.mask(F.col("kinds")).alias("mask"))
    other = spatial.as_right(side, id_b="candidate_id", b="name", mask_b="mask")
    pairs = spatial.radius_join(side, other, km, ["country"]).where(F.col("candidate_id") < F.col("id_b"))
    return pairs.select("country", F.col("candidate_id").alias("id_a"), "id_b", F.col("name").alias("a"), "b",
                        F.col("mask").alias("mask_a"), "mask_b",
                        (F.col("mask").bitwiseAND(F.col("mask_b")) != 0).alias("same_kind"), "km")


FOLDING = ("absorbed", "agglomerated", "transliteration", "density")


def absorption_counts(log: DataFrame) -> DataFrame:
    """Folded records by country and decision."""
    return log.groupBy("country", "decision").agg(F.count(F.lit(1)).alias("n"))


def moved_ids(log: DataFrame, survivors: DataFrame) -> DataFrame:
    """Old id to surviving id, through chains of folds (J16): old_id, new_id."""
    folds = log.where(F.col("decision").isin(*FOLDING)).select("guest_id", "host_id")
    out = roots(folds).select(F.col("guest_id").alias("old_id"), F.col("root_id").alias("new_id"))
    return out.join(survivors.select(F.col("candidate_id").alias("old_id")), "old_id", "left_anti")
