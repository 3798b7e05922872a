import math
import random

from pyspark.sql import functions as F

from placekit.operators import graph, spatial
from placekit.operators.scoring import order_statistic


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(s)))


def points(n, seed, tag):
    rnd, out = random.Random(seed), []
    for i in range(n):
        where = i % 4
        if where == 0:
            at = (rnd.uniform(-1, 1), rnd.choice([-1, 1]) * rnd.uniform(179.2, 180))
        elif where == 1:
            at = (rnd.uniform(88, 90), rnd.uniform(-180, 180))
        elif where == 2:
            at = (10 + rnd.uniform(0, 0.02), 20 + rnd.uniform(0, 0.02))
        else:
            at = (rnd.uniform(9, 11), rnd.uniform(19, 21))
        out.append((f"{tag}{i:03d}", *at))
    return out


A, B = points(80, 1, "a"), points(120, 2, "b")


def frames(spark):
    left = spark.createDataFrame(A, "a string, lat double, lon double")
    right = spark.createDataFrame(B, "b string, r_lat double, r_lon double")
    return left, right


def test_radius_join_is_exact_across_the_date_line_and_the_pole(spark):
    left, right = frames(spark)
    want = {(a[0], b[0]) for a in A for b in B if km(a[1:], b[1:]) <= 60}
    for hot in (10_000, 3):  # plain, and with salted cubes
        got = [(r.a, r.b) for r in spatial.radius_join(left, right, 60.0, hot_rows=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_radius_may_differ_per_row(spark):
    left, right = frames(spark)
    left = left.withColumn("reach", F.when(F.col("a") < "a040", 5.0).otherwise(90.0))
    want = {(a[0], b[0]) for a in A for b in B if km(a[1:], b[1:]) <= (5 if a[0] < "a040" else 90)}
    assert {(r.a, r.b) for r in spatial.radius_join(left, right, "reach").collect()} == want


def test_nearest_k_agrees_with_brute_force_on_every_path(spark):
    left, right = frames(spark)
    for k in (1, 3):
        want = set()
        for a in A:
            near = sorted((round(km(a[1:], b[1:]), 6), b[0]) for b in B if km(a[1:], b[1:]) <= 80)[:k]
            want |= {(a[0], b) for _, b in near}
        for hot in (10_000, 4):  # cube join, and the coarse-to-fine search
            got = {(r.a, r.b) for r in spatial.nearest_k(left, right, k, 80.0, "a", "b", hot_rows=hot).collect()}
            assert got == want


def test_copies_at_one_point_tie_to_the_smaller_id(spark):
    left = spark.createDataFrame([("q", 1.0, 1.0)], "a string, lat double, lon double")
    right = spark.createDataFrame([(f"c{i:04d}", 1.0, 1.01) for i in range(500)], "b string, r_lat double, r_lon double")
    assert [r.b for r in spatial.nearest_k(left, right, 3, 50.0, "a", "b", hot_rows=10).orderBy("nth").collect()] == ["c0000", "c0001", "c0002"]


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(999, x) for x in range(500, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_order_statistic_is_the_plain_index(spark):
    rnd = random.Random(9)
    rows = [("g", float(rnd.choice([1, 1, 1, 7, rnd.randrange(10**6)]))) for _ in range(777)] + [("h", 3.0)]
    got = {r.g: r.v for r in order_statistic(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.75, buckets=8).collect()}
    vals = sorted(v for g, v in rows if g == "g")
    assert got == {"g": vals[int(0.75 * (len(vals) - 1))], "h": 3.0}


def test_many_nearest_travel_as_rows_cells_and_lists_not_as_pairs(spark):
    """Crowded copies: the search joins every row with its cell's list once, whatever ``k`` is; before, its boxes met every row."""
    rnd = random.Random(3)
    spots = [(10 + rnd.uniform(0, 1), 20 + rnd.uniform(0, 1)) for _ in range(150)]
    right = [(f"b{i:04d}", *spots[i % 150]) for i in range(1500)]
    left = [(f"a{i:03d}", 10 + rnd.uniform(0, 1), 20 + rnd.uniform(0, 1), rnd.choice([2.0, 30.0, 80.0]), i % 3) for i in range(300)]
    l = spark.createDataFrame(left, "a string, lat double, lon double, reach double, tag int")
    r = spark.createDataFrame(right, "b string, r_lat double, r_lon double")
    got = spatial.nearest_k(l, r, 12, "reach", "a", "b", keep=("tag",))
    want = {(a, tag, b, n) for a, y, x, reach, tag in left for n, (_, b) in enumerate(sorted(
        (round(km((y, x), p[1:]), 6), p[0]) for p in right if round(km((y, x), p[1:]), 6) <= reach)[:12], 1)}
    assert {(x.a, x.tag, x.b, x.nth) for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("_list") > 0


def test_a_nearest_search_of_no_rows_is_empty(spark):
    left, right = frames(spark)
    got = spatial.nearest_k(left.limit(0), right, 3, 80.0, "a", "b", hot_rows=4)
    assert got.columns == ["a", "b", "km", "nth"] and got.count() == 0


def test_nearest_of_many_adds_up_by_hash_and_ties_to_the_smaller_id(spark):
    rnd = random.Random(5)
    spots = [(10 + rnd.randrange(40) / 100, 20 + rnd.randrange(40) / 100) for _ in range(200)]
    right = [(f"b{(i * 7919) % 200:03d}", *at) for i, at in enumerate(spots)]
    # also half way between two points, and some only the whole radius reaches
    left = [(f"a{i:03d}", 10 + rnd.randrange(80) / 200, 20 + rnd.randrange(200) / 200, f"t{i}") for i in range(120)]
    want = set()
    for a in left:
        best = min((round(km(a[1:3], b[1:]), 6), b[0]) for b in right)
        if best[0] <= 60:
            want.add((a[0], best[1], best[0], a[3]))
    l, r = spark.createDataFrame(left, "a string, lat double, lon double, t string"), spark.createDataFrame(right, "b string, r_lat double, r_lon double")
    got = spatial.nearest_k(l, r, 1, 60.0, "a", "b", keep=("t",))
    assert {(x.a, x.b, round(x.km, 6), x.t) for x in got.collect()} == want and any(w[2] > 15 for w in want)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    # numbers too large for 64 bits go on as decimals
    pairs = spark.createDataFrame([("a", 2.5, 7), ("a", 2.5, 3), ("a", 9.0, 1)], "a string, km double, _no bigint")
    assert [tuple(x) for x in spatial._least(pairs, "a", 10 ** 12).collect()] == [("a", 3, 2.5)]
