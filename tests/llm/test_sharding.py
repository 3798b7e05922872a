import random
import zlib
from collections import defaultdict

from placekit.llm import sharding

SCHEMA = "doc_id long, text string"


def test_bytes_are_near_equal_and_slots_have_no_gap(stored):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(0, 400)) for i in range(1500)] + [(5, "twice"), (5, "twice"), (None, None), (7, None), (8, "")]
    got = sharding.shard(stored(rows, SCHEMA, extra=True)).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.virtual_slot < sharding.SLOTS
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 0.001 * sum(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = defaultdict(set)
    for r in got:
        of[r.virtual_slot].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_reruns_agree_and_empty_table(stored):
    rows = [(i, f"text {i}") for i in range(200)]
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(stored(rows, SCHEMA, files=n)).collect()) for n in (1, 4))
    assert a == b
    assert sharding.shard(stored([], SCHEMA)).collect() == []


def test_rebalancing_edits_few_slots():
    rng = random.Random(2)
    weight = [rng.randrange(0, 1000) for _ in range(sharding.SLOTS)]
    first = sharding.first_map(8)
    second = sharding.rebalance(first, weight, 8)
    load = sharding._loads(second, weight, 8)
    assert max(load) - min(load) <= 2
    assert sum(a != b for a, b in zip(first, second, strict=True)) < sharding.SLOTS // 20
    assert sharding.rebalance(second, weight, 8) == second


def test_growing_moves_slots_to_the_new_shard_only():
    weight = [100 + s % 7 for s in range(sharding.SLOTS)]
    first = sharding.rebalance(sharding.first_map(8), weight, 8)
    grown = sharding.grow(first, weight, 8)
    assert all(a == b or b == 8 for a, b in zip(first, grown, strict=True))
    load = sharding._loads(grown, weight, 9)
    assert abs(load[8] - sum(load) / 9) < 0.02 * sum(load) / 9


def test_map_versions_are_stored(spark):
    weight, rows = [s % 5 for s in range(sharding.SLOTS)], [1] * sharding.SLOTS
    first = sharding.first_map(8)
    table = sharding.store_map(spark, [first, sharding.rebalance(first, weight, 8)], weight, rows)
    assert table.count() == 2 * sharding.SLOTS and {r.version for r in table.select("version").distinct().collect()} == {1, 2}
