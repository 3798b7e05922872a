"""Deriving kinds of place from landforms, tiers and setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.functions import kinds
from placekit.functions.vocab import (
    KIND_CODES, KIND_FLOOR, LANDFORM_KINDS, METROPOLIS_HEADS, QUARTER_COHERENCE, RELIEF_FLOOR_M,
    SOURCE_KINDS, TIER_KINDS, VILLAGE_HEADS,
)


def _strongest(signals: dict[str, list[str]]) -> Column:
    """Vector of the strongest signal per kind; 0 where nothing speaks. Signals are SQL text."""
    cells = [f"greatest(0.0D, {', '.join(signals[c])})" if signals.get(c) and len(signals[c]) else "0.0D" for c in KIND_CODES]
    return F.expr(f"array({', '.join(cells)})")


def _add(signals: dict[str, list[str]], code: str, when: str, weight: str) -> None:
    signals.setdefault(code, []).append(f"if({when}, {weight}, 0.0D)")


def _listed(signals: dict[str, list[str]], column: str, table: dict, floor: float) -> None:
    for token, weights in table.items():
        for code, strength in weights.items():
            if strength >= floor:
                _add(signals, code, f"array_contains({column}, '{token}')", f"{strength!r}D")


def from_landforms(forms: str = "landforms", floor: float = 0.0) -> Column:
    """Kinds a landform list column evidences, by maximum (A29); weaker than ``floor`` does not count."""
    signals: dict[str, list[str]] = {}
    _listed(signals, forms, LANDFORM_KINDS, floor)
    return _strongest(signals)


def qualifying_landforms(forms: str = "landforms") -> Column:
    """Only kinds that clear the model's floor: a river alone is not a lake."""
    return from_landforms(forms, KIND_FLOOR)


def from_sources(sources: str = "sources") -> Column:
    signals: dict[str, list[str]] = {}
    _listed(signals, sources, SOURCE_KINDS, 0.0)
    return _strongest(signals)


def kind_vector() -> Column:
    """The derived kind vector of a candidate row.

    Signals accumulate by maximum: three parks make a place no wilder than one, only surer.
    """
    signals: dict[str, list[str]] = {}
    _listed(signals, "landforms", LANDFORM_KINDS, 0.0)
    for tier, table in TIER_KINDS.items():
        n = kinds.tier_at("tiers", tier)
        for code, strength in table.items():
            _add(signals, code, f"{n} > 0", f"{strength!r}D * least(1.0D, 0.7D + 0.15D * least({n}, 3))")
    whs, craft = kinds.tier_at("tiers", "whs_cultural"), kinds.tier_at("tiers", "craft_cluster")
    quarter = f"not is_site and coherence >= {QUARTER_COHERENCE}D"
    _add(signals, "A4", f"relief_m >= {RELIEF_FLOOR_M}D", "least(0.95D, 0.5D + relief_m / 6000)")
    _add(signals, "A1", "historic_capital", "0.9D")
    _add(signals, "A12", f"not is_site and population >= {METROPOLIS_HEADS}D", "least(0.95D, 0.45D + 0.5D * least(population / 1e6D / 8.0D, 1.0D))")
    _add(signals, "A2", quarter, f"if({whs} > 0, 0.95D, 0.7D)")
    _add(signals, "A11", f"not is_site and population < {VILLAGE_HEADS}D and {craft} > 0", "0.9D")
    return _strongest(signals)


def derive(cands: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Set ``kinds`` from evidence; a candidate with no evidence is rural (site) or urban.

    ``keep_existing`` leaves vectors that already hold a kind alone.
    """
    out = cands.withColumn("_vec", kind_vector())
    fallback = F.when(F.col("is_site"), kinds.fixed({"A11": 0.5})).otherwise(kinds.fixed({"A12": 0.5}))
    out = out.withColumn("_vec", F.when(kinds.any_kind(F.col("_vec")), F.col("_vec")).otherwise(fallback))
    derived = kinds.keep_top(F.col("_vec"))
    if keep_existing:
        derived = F.when(kinds.any_kind(F.col("kinds")), F.col("kinds")).otherwise(derived)
    return out.withColumn("kinds", derived).drop("_vec")
