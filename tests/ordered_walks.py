"""Plain ordered walks, one row after another: what the distributed folds must equal."""

import numpy as np
import pandas as pd

from placekit.functions.vocab import CITY_RADIUS, CITY_RADIUS_MAX, CITY_RADIUS_MIN
from placekit.operators.folding import FIRST, KINDS, NEAREST
from placekit.operators.selection import arc_km


def walk(lat, lon, radius, foldable, mask, rule: str):
    """Hosts (-1 = kept) and distances for rows already in strength order."""
    n = len(lat)
    host, dist = np.full(n, -1), np.zeros(n)
    kept, m = np.empty(n, dtype=int), 0
    held = np.array(mask, dtype=np.int64)
    for i in range(n):
        if foldable[i] and m:
            hosts = kept[:m]
            km = arc_km(lat[i], lon[i], lat[hosts], lon[hosts])
            ok = km <= radius[i]
            if rule == KINDS:
                ok &= (mask[i] == 0) | (held[hosts] == 0) | ((held[hosts] & mask[i]) != 0)
            hits = np.flatnonzero(ok)
            if len(hits):
                j = hits[0] if rule == FIRST else hits[np.argmin(km[hits])]
                host[i], dist[i] = hosts[j], km[j]
                held[hosts[j]] |= mask[i]
                continue
        kept[m] = i
        m += 1
    return host, dist


def grow_cities(pdf: pd.DataFrame, share: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["population", "candidate_id"], ascending=[False, True])
    ids, lat, lon = (pdf[c].to_numpy() for c in ("candidate_id", "lat", "lon"))
    heads, harvest = pdf["population"].to_numpy().copy(), pdf["harvest"].to_numpy()
    free = np.ones(len(ids), dtype=bool)
    rows = []
    for i in range(len(ids)):
        if not free[i] or heads[i] <= 0:
            continue
        km = arc_km(lat[i], lon[i], lat, lon)
        around = np.flatnonzero(free & harvest & (km <= CITY_RADIUS_MAX))
        around = around[around != i]
        while len(around):
            reach = next((r for floor, r in CITY_RADIUS if heads[i] >= floor), CITY_RADIUS_MIN)
            take = (km[around] <= reach) & (heads[around] <= heads[i] * share)
            if not take.any():
                break
            got = around[take]
            heads[i] += heads[got].sum()
            free[got] = False
            rows.extend((ids[g], ids[i], km[g]) for g in got)
            around = around[~take]
    return pd.DataFrame(rows, columns=["guest_id", "host_id", "km"])


def thin_country(pdf: pd.DataFrame, p) -> pd.DataFrame:
    pdf = pdf.sort_values("rank").reset_index(drop=True)
    spacing, target = float(pdf["spacing"].iloc[0]), float(pdf["target"].iloc[0])
    alive, out = pdf, []
    while True:
        gone = []
        for _, part in alive.groupby("kind", dropna=True):
            lat, lon = part["lat"].to_numpy(), part["lon"].to_numpy()
            host, km = walk(lat, lon, np.full(len(part), spacing), part["extra"].to_numpy(),
                            np.zeros(len(part), dtype=np.int64), NEAREST)
            ids = part["candidate_id"].to_numpy()
            hit = host >= 0
            gone.extend(part.index[hit])
            out.extend(zip(ids[hit], ids[host[hit]], km[hit]))
        alive = alive.drop(index=gone)
        if not (len(alive) > target * 1.5 and spacing < p.harvest_max_spacing_km):
            return pd.DataFrame(out, columns=["guest_id", "host_id", "km"])
        spacing = min(p.harvest_max_spacing_km, spacing * 1.25)


def absorb_host(pdf: pd.DataFrame, least: float, scale: float) -> pd.DataFrame:
    pdf = pdf.sort_values("site_id")
    held = np.array(pdf["host_kinds"].iloc[0], dtype=float)
    sims, took = [], []
    for mine in pdf["site_kinds"]:
        v = np.array(mine, dtype=float)
        size = np.sqrt(v @ v) * np.sqrt(held @ held)
        sim = float(v @ held / size) if size > 0 else 0.0
        ok = sim >= least
        if ok:
            held = np.maximum(held, v * scale)
        sims.append(sim)
        took.append(ok)
    return pdf[["site_id", "host_id", "km"]].assign(similarity=sims, absorbed=took)
