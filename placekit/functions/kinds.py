"""Kind vectors.

A kind vector is ``array<double>`` of length twelve, aligned with A1..A12; a place "has" a
kind when its weight is above zero. Bitmasks use bit n-1 for An.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placekit.functions.vocab import (
    DOMINANT_LIMIT, KIND_CODES, KIND_DOMINANT, KIND_FLOOR, KIND_LIMIT, KINDS, TIER_NAMES,
)

N = len(KIND_CODES)


def codes() -> Column:
    return F.expr("array(" + ", ".join(f"'{c}'" for c in KIND_CODES) + ")")


def zero() -> Column:
    return F.expr("array(" + ", ".join(["0.0D"] * N) + ")")


def at(vec: Column, code: str) -> Column:
    return vec[KIND_CODES.index(code)]


def fixed(weights: dict[str, float]) -> Column:
    """Literal vector from ``{code: weight}``."""
    return F.expr(fixed_sql(weights))


def fixed_sql(weights: dict[str, float]) -> str:
    return "array(" + ", ".join(f"{float(weights.get(c, 0.0))!r}D" for c in KIND_CODES) + ")"


def longest(a: Column, b: Column) -> Column:
    """Element-wise maximum."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def max_vector(col: str) -> Column:
    """Aggregate: element-wise maximum over a group (twelve partial maxima, no collecting)."""
    return F.expr("array(" + ", ".join(f"coalesce(max({col}[{i}]), 0.0D)" for i in range(N)) + ")")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once; a lambda works out again what it names, for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ranked(vec: Column) -> Column:
    """Kinds with weight, strongest first, ties in code order: array<struct<neg,i,w,code>>."""
    pairs = F.zip_with(vec, codes(), lambda w, c: F.struct(w.alias("w"), c.alias("code")))
    pairs = F.transform(pairs, lambda p, i: F.struct((-p["w"]).alias("neg"), i.alias("i"),
                                                     p["w"].alias("w"), p["code"].alias("code")))
    return F.sort_array(F.filter(pairs, lambda p: p["w"] > 0))


def keep_top(vec: Column, limit: int = KIND_LIMIT, floor: float = KIND_FLOOR, digits: int = 3) -> Column:
    """Keep the strongest kinds above the floor, rounded half-even; the rest become zero."""
    best = F.slice(ranked(vec), 1, limit)
    kept = F.transform(F.filter(best, lambda p: p["w"] >= floor), lambda p: p["i"])
    return _once(kept, lambda k: F.transform(vec, lambda w, i: F.when(F.array_contains(k, i), F.bround(w, digits)).otherwise(0.0)))


def merge(vec: Column, extra: Column) -> Column:
    """Existing kinds and new ones by maximum, then top four above the floor."""
    return keep_top(longest(vec, extra))


def names(vec: Column) -> Column:
    """Codes present, strongest first."""
    return F.transform(ranked(vec), lambda p: p["code"])


def weights(vec: Column, digits: int = 2) -> Column:
    return F.transform(ranked(vec), lambda p: F.bround(p["w"], digits))


def dominant(vec: Column, threshold: float = KIND_DOMINANT, limit: int = DOMINANT_LIMIT) -> Column:
    """Codes at or above the threshold, strongest first, at most three."""
    return F.transform(F.slice(F.filter(ranked(vec), lambda p: p["w"] >= threshold), 1, limit),
                       lambda p: p["code"])


def primary(vec: Column) -> Column:
    """Strongest kind; null when the vector is empty."""
    return F.get(names(vec), F.lit(0))


def any_kind(vec: Column) -> Column:
    return F.array_max(vec) > 0


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, w: acc + w * w))


def unit(vec: Column) -> Column:
    """L2-normalised vector; an empty one stays zero."""
    return _once(norm(vec), lambda n: F.transform(vec, lambda w: F.when(n > 0, w / n).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side is empty."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def covered_mask(vec: Column, threshold: float = KIND_DOMINANT) -> Column:
    """Bitmask of kinds whose unit weight reaches the threshold."""
    return _mask(_once(norm(vec), lambda n: F.transform(vec, lambda w: F.when(n > 0, w / n >= threshold).otherwise(False))))


def mask(vec: Column) -> Column:
    return _mask(F.transform(vec, lambda w: w > 0))


def _mask(flags: Column) -> Column:
    bits = F.transform(flags, lambda f, i: F.when(f, F.pow(F.lit(2.0), i).cast("int")).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda acc, b: acc.bitwiseOR(b))


def mask_of(kind_codes: Column) -> Column:
    """Bitmask of an array of codes; codes that are no kind are ignored."""
    flags = F.transform(codes(), lambda c: F.array_contains(kind_codes, c))
    return F.when(kind_codes.isNull(), F.lit(0)).otherwise(_mask(flags))


def has(mask_col: Column, code: str) -> Column:
    return mask_col.bitwiseAND(F.lit(1 << KIND_CODES.index(code))) != 0


def has_any(mask_col: Column, wanted) -> Column:
    want = 0
    for c in wanted:
        want |= 1 << KIND_CODES.index(c)
    return mask_col.bitwiseAND(F.lit(want)) != 0


def decode(mask_col: Column) -> Column:
    """Codes of a bitmask in canonical order."""
    return F.filter(codes(), lambda c, i: mask_col.bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) != 0)


def month_mask(months: Column) -> Column:
    flags = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.array_contains(months, m))
    return F.when(months.isNull(), F.lit(0)).otherwise(_mask(flags))


def has_any_month(mask_col: Column, wanted) -> Column:
    want = 0
    for m in wanted:
        want |= 1 << (m - 1)
    return mask_col.bitwiseAND(F.lit(want)) != 0


def labels(kind_codes: Column) -> Column:
    from placekit.functions.vocab import lookup

    return F.transform(kind_codes, lambda c: F.coalesce(lookup(KINDS, c), c))


def kind_table(spark):
    """The twelve kinds as rows."""
    rows = [(i + 1, c, KINDS[c]) for i, c in enumerate(KIND_CODES)]
    return spark.createDataFrame(rows, "ord int, kind string, label string")


# ------------------------------------------------------------------ tier counts
# ``tiers`` is array<bigint> aligned with TIER_NAMES.
def tier(col: Column, name: str) -> Column:
    return col[TIER_NAMES.index(name)]


def tier_sum(col: str) -> Column:
    """Aggregate: element-wise sum of tier-count arrays."""
    return F.expr("array(" + ", ".join(f"coalesce(sum({col}[{i}]), 0L)" for i in range(len(TIER_NAMES))) + ")")


def tier_counts(tier_col: str, n_col: str = "1L") -> Column:
    """Aggregate rows of (tier, n) into a tier-count array."""
    return F.expr("array(" + ", ".join(f"coalesce(sum(case when {tier_col} = '{t}' then {n_col} end), 0L)" for t in TIER_NAMES) + ")")


def no_tiers() -> Column:
    return F.expr("array(" + ", ".join(["0L"] * len(TIER_NAMES)) + ")")


def tier_at(col: str, name: str) -> str:
    """SQL text of one tier's count."""
    return f"{col}[{TIER_NAMES.index(name)}]"


def add_tiers(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)
