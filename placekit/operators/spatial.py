"""Distance joins: a range predicate rewritten as an equi-join on cubes of space.

Left rows carry ``lat, lon``; right rows carry ``r_lat, r_lon``. Every join is exact: cubes
only propose pairs, the haversine test decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import geo
from placekit.functions.vocab import EARTH_KM
from placekit.plans.session import cut, is_empty, number_rows

# A cube with more right-hand rows than this is split (all-pairs join) or searched through
# finer cubes (nearest join).
HOT_CUBE_ROWS = 5_000
# Above this a nearest join first tries a quarter of the radius.
BUSY_CUBE_ROWS = 64
# A nearest join for several looks cell by cell from this many rows of a cube on, per one wanted.
BUSY_PER_NEAREST = 16
CELL_FLOOR = -7         # finest cell edge 8 m
LIST_ROOM = 32          # points a cell's list may hold, beside two for each wanted
FEW_ROWS = 16           # left rows for which a cell is not worth dividing


def _radius(km) -> Column:
    return F.lit(float(km)) if isinstance(km, (int, float)) else F.col(km)


def _classes(left: DataFrame, km) -> list[int] | None:
    """Cube classes in use: one for a fixed radius, else the few distinct ones of the column."""
    if isinstance(km, (int, float)):
        return None
    # radii map to powers of two, so this is at most about twenty integers
    rows = left.select(F.expr(geo.cube_class(km)).alias("c")).distinct().collect()
    return sorted(r["c"] for r in rows if r["c"] is not None)


def _keyed_right(right: DataFrame, km, classes: list[int] | None) -> DataFrame:
    if classes is None:
        return right.withColumn("_cube", F.expr(geo.cube_at("r_lat", "r_lon", geo.cube_class(km))))
    if not classes:
        return right.withColumn("_cube", F.lit(None).cast("bigint"))
    keys = ", ".join(geo.cube_at("r_lat", "r_lon", c) for c in classes)
    return right.withColumn("_cube", F.explode(F.expr(f"array({keys})")))


def hottest_cube(right: DataFrame, on: list[str]) -> int:
    """Rows in the fullest cube: one partial-aggregated count, one row to the driver."""
    row = right.groupBy("_cube", *on).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def radius_join(left: DataFrame, right: DataFrame, km, on: list[str] | None = None,
                hot_rows: int = HOT_CUBE_ROWS) -> DataFrame:
    """All pairs within ``km`` (a number or the name of a column of ``left``), with their distance.

    ``on`` names columns that must be equal on both sides. Full cubes are salted: their right
    rows are spread over several keys and the left rows that probe them are repeated per key,
    so no task owns a whole hot cube.
    """
    on = on or []
    classes = _classes(left, km)
    r = _keyed_right(right, km, classes)
    return _cube_join(left, r, km, on, hottest_cube(r, on) > hot_rows, hot_rows)


def _probe(left: DataFrame, km, cls) -> DataFrame:
    """Left rows once per cube their ball can touch, with positions ``_lx, _ly, _lz``.

    A cube edge is at least the ball's diameter, so each axis meets one or two slabs. The axes
    are opened one by one, which keeps the generated code of every step small enough to compile.
    """
    out = left.withColumns({f"_l{a}": F.expr(e) for a, e in zip("xyz", geo.xyz("lat", "lon"))})
    edge, num = f"pow(2.0D, {cls})", geo.number(km)
    for a in "xyz":
        ends = f"array_distinct(array(floor((_l{a} - {num}) / {edge}), floor((_l{a} + {num}) / {edge})))"
        out = out.withColumn(f"_i{a}", F.explode(F.expr(ends)))
    return out.withColumn("_cube", F.expr(geo.cube_key(cls, "_ix", "_iy", "_iz"))).drop("_ix", "_iy", "_iz")


def _cube_join(left: DataFrame, r: DataFrame, km, on: list[str], salted: bool, hot_rows: int) -> DataFrame:
    l = _probe(left.withColumn("_km", _radius(km)), km, geo.cube_class(km))
    keys = ["_cube", *on]
    if salted:
        hot = (r.groupBy(*keys).count().where(F.col("count") > hot_rows)
               .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts")))
        parts = F.coalesce(F.col("_parts"), F.lit(1))
        # by the row's own values, so a retried task salts a row as before
        spread = F.pmod(F.xxhash64(*[c for c, kind in r.dtypes if "map<" not in kind]), parts)
        r = r.join(hot, keys, "left").withColumn("_salt", spread).drop("_parts")
        l = l.join(hot, keys, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<bigint>"))).drop("_parts")
        keys = [*keys, "_salt"]
    # a chord test on ready coordinates settles most pairs before any trigonometry
    l = l.withColumn("_chord2", F.expr(f"pow({geo.chord(km)}, 2) * {1 + 1e-9!r}D + 1e-6D"))
    r = r.withColumns({f"_r{a}": F.expr(e) for a, e in zip("xyz", geo.xyz("r_lat", "r_lon"))})
    gap2 = " + ".join(f"(_l{a} - _r{a}) * (_l{a} - _r{a})" for a in "xyz")
    near = l.join(r, keys).where(f"{gap2} <= _chord2")
    return (near.withColumn("km", geo.tick(geo.haversine("lat", "lon", "r_lat", "r_lon")))
            .where(F.col("km") <= F.col("_km"))
            .drop("_cube", "_km", "_salt", "_chord2", *[f"_{s}{a}" for s in "lr" for a in "xyz"]))


def nearest_k(left: DataFrame, right: DataFrame, k: int, km, left_id: str, right_id: str,
              on: list[str] | None = None, hot_rows: int = HOT_CUBE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest right rows within ``km`` of each left row, as (left_id, right_id, km, nth, *keep).

    Ties go to the smaller right id; ``keep`` names columns of ``left`` to carry. When no cube is crowded this is the
    cube join plus a top-k; otherwise cells of left rows look for their points from coarse to fine.
    """
    on = on or []
    fixed = isinstance(km, (int, float))
    pts = right.select(right_id, "r_lat", "r_lon", *on)
    # copies at one position: only the first k ids can ever be among the k nearest
    if k == 1:
        pts = pts.groupBy("r_lat", "r_lon", *on).agg(F.min(right_id).alias(right_id))
    else:
        copies = W.partitionBy("r_lat", "r_lon", *on).orderBy(right_id)
        pts = pts.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    l = left.select(left_id, "lat", "lon", *on, *keep, _radius(km).alias("_r"))
    keyed = _keyed_right(pts, km, _classes(left, km))
    crowd = hottest_cube(keyed, on)
    if crowd > hot_rows or (k > 1 and crowd > BUSY_PER_NEAREST * k):
        return _search(l, pts, k, left_id, right_id, on, keep)
    if k == 1 and fixed and crowd > BUSY_CUBE_ROWS:
        # most rows have a neighbour close by; only the others look at the whole radius
        pts = cut(number_rows(pts, [F.col(right_id)], "_no"))
        l, many = l.select(left_id, "lat", "lon", *on, "_r"), pts.count()
        close = cut(_least(_cube_join(l, _keyed_right(pts, km / 4, None), km / 4, on, False, hot_rows), left_id, many))
        rest = l.join(close.select(left_id), left_id, "left_anti")
        far = _least(_cube_join(rest, _keyed_right(pts, km, None), km, on, False, hot_rows), left_id, many)
        found = close.unionByName(far).join(pts.select("_no", right_id), "_no")
        if keep:
            found = found.join(left.select(left_id, *keep), left_id)
        return found.select(left_id, right_id, "km", F.lit(1).alias("nth"), *keep)
    pairs = _cube_join(l, keyed, km if fixed else "_r", on, False, hot_rows)
    if k == 1:
        return _best(pairs, left_id, right_id, keep)
    top = W.partitionBy(left_id).orderBy("km", right_id)
    return (pairs.select(left_id, right_id, "km", *keep).withColumn("nth", F.row_number().over(top))
            .where(F.col("nth") <= k))


def _best(pairs: DataFrame, left_id: str, right_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(left_id).agg(F.min(F.struct("km", F.col(right_id))).alias("_b"), *[F.first(c).alias(c) for c in keep]).select(
        left_id, F.col(f"_b.{right_id}"), F.col("_b.km"), F.lit(1).alias("nth"), *keep)


def _least(pairs: DataFrame, left_id: str, many: int) -> DataFrame:
    """Distance and number ``_no`` (1 to ``many``) of the nearest right row of each left row.

    Millimetres and number make one integer, whose minimum is a hash aggregate; that of a struct sorts all pairs.
    """
    exact = "bigint" if (EARTH_KM * 4e6 * (many + 1)) < 2 ** 63 else "decimal(38, 0)"
    code = F.rint(F.col("km") * 1e6).cast(exact) * F.lit(many + 1).cast(exact) + F.col("_no")
    each, unit = F.col("_code"), F.lit(many + 1)
    return (pairs.select(left_id, code.alias("_code")).groupBy(left_id).agg(F.min("_code").alias("_code"))
            .select(left_id, (each % unit).cast("bigint").alias("_no"), (F.expr(f"_code div {many + 1}").cast("double") / 1e6).alias("km")))


def nearest(left: DataFrame, right: DataFrame, km, left_id: str, right_id: str,
            on: list[str] | None = None, hot_rows: int = HOT_CUBE_ROWS) -> DataFrame:
    """The single nearest right row within ``km`` (J02, J05, J06): (left_id, right_id, km)."""
    return nearest_k(left, right, 1, km, left_id, right_id, on, hot_rows).drop("nth")


def _cell_at(prefix: str, level: int) -> Column:
    """The cell of a position: three 21-bit slab numbers, which hold every edge down to ``CELL_FLOOR``."""
    slab = [f"cast(floor({prefix}{a} / {2.0 ** level!r}D) + {1 << 20} as bigint)" for a in "xyz"]
    return F.expr(f"shiftleft({slab[0]}, 42) + shiftleft({slab[1]}, 21) + {slab[2]}")


def _boxes(df: DataFrame, prefix: str, level: int, on: list[str], name: str, *aggs: Column) -> DataFrame:
    """Cells of one level with the box around their positions (_{name}x0, _{name}x1, ...) and the cell above them."""
    ends = [f(f"{prefix}{a}").alias(f"_{name}{a}{s}") for a in "xyz" for f, s in ((F.min, "0"), (F.max, "1"))]
    return df.groupBy(_cell_at(prefix, level + 1).alias(f"_{name}up"), _cell_at(prefix, level).alias(f"_{name}cell"), *on).agg(*ends, *aggs)


def _search(left: DataFrame, pts: DataFrame, k: int, left_id: str, right_id: str, on: list[str], keep: tuple[str, ...]) -> DataFrame:
    """A k-nearest join in which cells of left rows, not the rows, narrow down where their points are.

    From coarse to fine a cell keeps the boxes of points that are no farther than the distance within which boxes hold
    ``k`` points for any of its rows. A cell whose boxes hold few points is done: each of its rows meets the list of
    them once and picks. Only rows, cells and lists are shuffled, never pairs of rows. Distances are chords, which
    order pairs exactly as arcs do; the final haversine test is the exact one.
    """
    spots = cut(pts.groupBy("r_lat", "r_lon", *on).agg(F.array_sort(F.collect_list(right_id)).alias("_ids"))  # k at most
                .withColumns({f"_p{a}": F.expr(e) for a, e in zip("xyz", geo.xyz("r_lat", "r_lon"))}))
    # chord tests get a hair of slack, wider than the millimetre to which distances tie
    slack = 2e-6
    rows = cut(left.where("lat is not null and lon is not null and _r is not null")
               .withColumns({f"_q{a}": F.expr(e) for a, e in zip("xyz", geo.xyz("lat", "lon"))})
               .withColumn("_reach", F.expr(f"{geo.chord('_r')} * {1 + 1e-9!r}D + {slack!r}D")))
    room, out = 2 * k + LIST_ROOM, []
    top = rows.agg(F.max(F.expr(geo.cube_class("_r"))).alias("c")).first()["c"]
    level, open_ = int(top) if top is not None else CELL_FLOOR, None
    near, far = F.lit(0.0), F.lit(0.0)
    for a in "xyz":
        lo, hi, r_lo, r_hi = (F.col(f"_{n}{a}{s}") for n in "lr" for s in "01")
        gap, span = F.greatest(r_lo - hi, lo - r_hi, F.lit(0.0)), F.greatest(r_hi - lo, hi - r_lo)
        near, far = near + gap * gap, far + span * span
    while True:
        cells = _boxes(rows, "_q", level, on, "l", F.max("_reach").alias("_reach"), F.count(F.lit(1)).alias("_rows"))
        boxes = _boxes(spots, "_p", level, on, "r", F.sum(F.size("_ids")).alias("_n"), F.count(F.lit(1)).alias("_spots"))
        if open_ is None:
            # the edge is at least the widest radius, so neighbours hold all that is in reach
            steps = F.array(*[F.lit((x << 42) + (y << 21) + z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
            met = cells.withColumn("_step", F.explode(steps)).withColumn("_rcell", F.col("_lcell") + F.col("_step"))
            met = met.drop("_step").join(boxes, ["_rcell", *on]).withColumn("_bound", F.col("_reach"))
        else:
            met = cells.join(open_, ["_lup", *on]).join(boxes, ["_rup", *on])
        met = met.withColumn("_near", F.sqrt(near)).withColumn("_far", F.sqrt(far)).where(F.col("_near") <= F.least("_reach", "_bound"))
        one = W.partitionBy("_lcell", *on)
        filling = one.orderBy("_far", "_rcell").rowsBetween(W.unboundedPreceding, 0)
        met = met.withColumn("_full", F.when(F.sum("_n").over(filling) >= k, F.col("_far") + slack))
        met = met.withColumn("_bound", F.least("_bound", "_reach", F.min("_full").over(one))).where(F.col("_near") <= F.col("_bound"))
        met = cut(met.withColumn("_points", F.sum("_spots").over(one)).select(
            "_lcell", "_rcell", *on, "_bound", "_rows", "_points", *[f"_l{a}{s}" for a in "xyz" for s in "01"]))
        divide = (F.col("_points") > room) & ((F.col("_rows") > FEW_ROWS) | (F.col("_points") > 8 * room))
        done = met.where(~divide) if level > CELL_FLOOR else met
        if not is_empty(done):
            out.append(_pick(rows, spots, done, level, k, left_id, right_id, on, keep))
        open_ = met.where(divide).select(F.col("_lcell").alias("_lup"), F.col("_rcell").alias("_rup"), *on, "_bound")
        if level <= CELL_FLOOR or is_empty(open_):
            break
        level -= 1
    if not out:
        none = rows.limit(0).join(pts.select(right_id).limit(0), F.lit(False))
        return none.select(left_id, right_id, F.lit(0.0).alias("km"), F.lit(1).alias("nth"), *keep)
    return reduce(DataFrame.unionByName, out)


def _pick(rows: DataFrame, spots: DataFrame, done: DataFrame, level: int, k: int, left_id: str, right_id: str,
          on: list[str], keep: tuple[str, ...]) -> DataFrame:
    """The ``k`` nearest of each row whose cell is done, from its cell's list."""
    off = F.lit(0.0)
    for a in "xyz":
        gap = F.greatest(F.col(f"_p{a}") - F.col(f"_l{a}1"), F.col(f"_l{a}0") - F.col(f"_p{a}"), F.lit(0.0))
        off = off + gap * gap
    lists = (done.join(spots.withColumn("_rcell", _cell_at("_p", level)), ["_rcell", *on]).where(F.sqrt(off) <= F.col("_bound"))
             .groupBy("_lcell", *on).agg(F.collect_list(F.struct("_px", "_py", "_pz", "r_lat", "r_lon", "_ids")).alias("_list")))
    met = rows.withColumn("_lcell", _cell_at("_q", level)).join(lists, ["_lcell", *on])

    def gap2(p: Column) -> Column:
        return sum(((p[f"_p{a}"] - F.col(f"_q{a}")) * (p[f"_p{a}"] - F.col(f"_q{a}")) for a in "xyz"), F.lit(0.0))

    seen = F.transform("_list", lambda p: F.struct(gap2(p).alias("g"), p["r_lat"].alias("r_lat"), p["r_lon"].alias("r_lon"), p["_ids"].alias("ids")))
    # sort_array compares values itself, array_sort runs an expression for each comparison
    met = met.withColumn("_seen", F.sort_array(F.filter(seen, lambda p: p["g"] <= F.col("_reach") * F.col("_reach")))).drop("_list")
    # how far the k-th can be at most; the explode keeps it from being worked out again for each point
    full = F.aggregate("_seen", F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("g")), lambda s, p: F.when(s["n"] >= k, s).otherwise(
        F.struct((s["n"] + F.size(p["ids"])).alias("n"), p["g"].alias("g"))))
    met = met.withColumn("_most", F.explode(F.array(F.pow(F.sqrt(full["g"]) + 2e-6, 2))))
    first = F.filter("_seen", lambda p: p["g"] <= F.col("_most"))
    scored = F.transform(first, lambda p: F.struct(geo.tick(geo.haversine(F.col("lat"), F.col("lon"), p["r_lat"], p["r_lon"])).alias("km"), p["ids"].alias("ids")))
    within = F.filter(scored, lambda p: p["km"] <= F.col("_r"))
    each = F.flatten(F.transform(within, lambda p: F.transform(p["ids"], lambda i: F.struct(p["km"].alias("km"), i.alias("id")))))
    best = met.select(left_id, *keep, F.posexplode(F.slice(F.sort_array(each), 1, k)).alias("_nth", "_b"))
    return best.select(left_id, F.col("_b.id").alias(right_id), F.col("_b.km").alias("km"), (F.col("_nth") + 1).alias("nth"), *keep)


def as_right(df: DataFrame, **names: str) -> DataFrame:
    """Rename ``lat, lon`` to ``r_lat, r_lon`` (and others given as new=old) for the right side."""
    out = df.withColumnRenamed("lat", "r_lat").withColumnRenamed("lon", "r_lon")
    for new, old in names.items():
        out = out.withColumnRenamed(old, new)
    return out


def block_min(df: DataFrame, value: str, km, on: list[str]) -> DataFrame:
    """Smallest ``value`` among rows of the 27 cubes around each cube: (on, _block, value).

    Cube edge is at least ``km`` (a number or column name), so the block covers everything
    within ``km`` of its centre cube.
    """
    cls = _block_class(km)
    slabs = {f"_i{a}": F.expr(f"floor({e} / pow(2.0D, {cls}))") for a, e in zip("xyz", geo.xyz("lat", "lon"))}
    own = (df.select(*on, value, F.expr(cls).alias("_c"), *[e.alias(n) for n, e in slabs.items()])
           .groupBy(*on, "_c", *slabs).agg(F.min(value).alias(value)))
    for n in slabs:
        own = own.withColumn(n, F.explode(F.sequence(F.col(n) - 1, F.col(n) + 1)))
    return (own.withColumn("_block", F.expr(geo.cube_key("_c", "_ix", "_iy", "_iz")))
            .groupBy(*on, "_block").agg(F.min(value).alias(value)))


def block_of(km, shift: float = 0.0) -> Column:
    """The block cube of a row, matching :func:`block_min`; ``shift`` moves all cubes by a share of their edge."""
    return F.expr(geo.cube_at("lat", "lon", _block_class(km), shift))


def _block_class(km) -> str:
    return geo.cube_class(km / 2 if isinstance(km, (int, float)) else f"({km}) / 2")
