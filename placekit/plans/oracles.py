"""SQL building blocks for checking queries in DuckDB, on top of the shared views."""

from __future__ import annotations

from placekit.functions.vocab import (
    KINDS, LANDFORM_KINDS, LANDFORM_SHARE, TIER_KINDS, TIERS, SOURCE_KINDS,
)
from placekit.plans import fixtures


def km(a: str, b: str, radius: str = "6371.0088") -> str:
    return (f"(round_even(2 * {radius} * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)"
            f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) * 1e6, 0) / 1e6)")


def values(name: str, columns: str, rows) -> str:
    def cell(x):
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    body = ", ".join("(" + ", ".join(cell(c) for c in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


def _kind_rows(table):
    return [(key, code, w) for key, kinds in table.items() for code, w in kinds.items()]


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "kindtab": ((), values("k", "ord, kind, label", [(i + 1, c, l) for i, (c, l) in enumerate(KINDS.items())])),
    "tw": ((), values("t", "tier, pillar, weight, cross_ok", TIERS)),
    "lshare": ((), values("t", "landform, share", list(LANDFORM_SHARE.items()))),
    "lkind": ((), values("t", "landform, kind, w", _kind_rows(LANDFORM_KINDS))),
    "tkind": ((), values("t", "tier, kind, w", _kind_rows(TIER_KINDS))),
    "skind": ((), values("t", "source, kind, w", _kind_rows(SOURCE_KINDS))),
    "near": (("asset", "cand"), f"""
SELECT asset_id, tier, source, candidate_id, km, lat, lon FROM (
  SELECT a.asset_id, a.tier, a.source, a.lat, a.lon, c.candidate_id, {km('a', 'c')} AS km,
    row_number() OVER (PARTITION BY a.asset_id ORDER BY {km('a', 'c')}, c.candidate_id) AS rn
  FROM asset a JOIN cand c ON c.lat BETWEEN a.lat - 0.6 AND a.lat + 0.6 AND c.lon BETWEEN a.lon - 1 AND a.lon + 1
  WHERE a.radius_km = 0 AND {km('a', 'c')} <= 60) WHERE rn = 1"""),
    "fan": (("asset", "cand"), f"""
SELECT asset_id, tier, source, candidate_id, km, nth FROM (
  SELECT a.asset_id, a.tier, a.source, c.candidate_id, {km('a', 'c')} AS km,
    row_number() OVER (PARTITION BY a.asset_id ORDER BY {km('a', 'c')}, c.candidate_id) AS nth
  FROM asset a JOIN cand c ON c.lat BETWEEN a.lat - 0.8 AND a.lat + 0.8 AND c.lon BETWEEN a.lon - 1.2 AND a.lon + 1.2
  WHERE a.radius_km > 0 AND {km('a', 'c')} <= a.radius_km) WHERE nth <= 40"""),
    "tn": (("near", "fan"), """
SELECT candidate_id, tier, count(*) AS n FROM (
  SELECT candidate_id, tier FROM near UNION ALL SELECT candidate_id, tier FROM fan) GROUP BY ALL"""),
    "tsum": (("tn", "tw"), """
SELECT candidate_id, pillar, sum(w * (1 - pow(0.95, n)) / (1 - 0.95)) AS s FROM (
  SELECT candidate_id, pillar, weight AS w, sum(n) AS n FROM tn JOIN tw USING (tier) GROUP BY ALL) GROUP BY ALL"""),
    "lfi": (("cand", "landform"), """
SELECT n, landform, count(DISTINCT candidate_id) AS instances FROM landform JOIN cand USING (candidate_id) GROUP BY ALL"""),
    "lfw": (("lfi", "lshare"), """
SELECT n, landform, instances, CASE WHEN instances <= 1 THEN least(w, 3.0) ELSE w END AS weight FROM (
  SELECT *, greatest(1.0, least(6.0, 1.0 + 1.6 * (-log2(share) - 2.0))) AS w FROM lfi JOIN lshare USING (landform))"""),
    "setting": (("landform", "cand", "lfw"), """
SELECT candidate_id, sum(w * (1 - pow(0.95, m)) / (1 - 0.95)) AS s FROM (
  SELECT candidate_id, round_even(weight, 3) AS w, count(*) AS m
  FROM landform JOIN cand USING (candidate_id) JOIN lfw USING (n, landform) GROUP BY ALL) GROUP BY ALL"""),
    "raw": (("cand", "attr", "tsum", "setting"), """
SELECT c.candidate_id, c.n,
  coalesce(h.s, 0) * (1 + 0.25 * coherence) AS h_raw,
  coalesce(t.s, 0) + coalesce(g.s, 0) + 1.5 * least(relief_m, 3000) / 1000 AS n_raw,
  coalesce(l.s, 0) AS l_raw
FROM cand c JOIN attr USING (candidate_id)
LEFT JOIN tsum h ON h.candidate_id = c.candidate_id AND h.pillar = 'H'
LEFT JOIN tsum t ON t.candidate_id = c.candidate_id AND t.pillar = 'N'
LEFT JOIN tsum l ON l.candidate_id = c.candidate_id AND l.pillar = 'L'
LEFT JOIN setting g ON g.candidate_id = c.candidate_id"""),
    "feas": (("attr",), """
SELECT candidate_id, CASE WHEN access = 'closed' THEN 0.0 ELSE least(1.0,
  CASE reach WHEN 'near' THEN 1.0 WHEN 'mid' THEN 0.9 WHEN 'far' THEN 0.7 ELSE 0.5 END::DOUBLE
  * CASE WHEN has_lodging THEN 1.0 ELSE 0.6 END::DOUBLE * CASE WHEN overtourism THEN 0.85 ELSE 1.0 END::DOUBLE
  * CASE WHEN access = 'restricted' THEN 0.8 ELSE 1.0 END::DOUBLE) END AS feasibility FROM attr"""),
    "scored": (("raw", "feas"), """
SELECT *, base * feasibility AS score FROM (
  SELECT candidate_id, n, h_raw, n_raw, l_raw, feasibility, h, nn, liv,
    sqrt(0.30 * h * h + 0.35 * nn * nn + 0.35 * liv * liv) AS base FROM (
    SELECT *, CASE WHEN max(h_raw) OVER w > 0 THEN h_raw / max(h_raw) OVER w ELSE 0 END AS h,
      CASE WHEN max(n_raw) OVER w > 0 THEN n_raw / max(n_raw) OVER w ELSE 0 END AS nn,
      CASE WHEN max(l_raw) OVER w > 0 THEN l_raw / max(l_raw) OVER w ELSE 0 END AS liv
    FROM raw JOIN feas USING (candidate_id) WINDOW w AS (PARTITION BY n)))"""),
    "kraw": (("cand", "attr", "landform", "tn", "lkind", "tkind"), """
SELECT candidate_id, kind, max(w) AS w FROM (
  SELECT candidate_id, kind, w FROM landform JOIN lkind USING (landform)
  UNION ALL SELECT candidate_id, kind, w * least(1.0, 0.7 + 0.15 * least(n, 3)) FROM tn JOIN tkind USING (tier)
  UNION ALL SELECT candidate_id, 'A4', least(0.95, 0.5 + relief_m / 6000) FROM attr WHERE relief_m >= 1500
  UNION ALL SELECT candidate_id, 'A1', 0.9 FROM attr WHERE historic_capital
  UNION ALL SELECT candidate_id, 'A12', least(0.95, 0.45 + 0.5 * least(population / 1e6 / 8.0, 1.0)) FROM cand WHERE NOT is_site AND population >= 1000000
  UNION ALL SELECT candidate_id, 'A2', CASE WHEN t.n > 0 THEN 0.95 ELSE 0.7 END
    FROM cand JOIN attr USING (candidate_id) LEFT JOIN tn t USING (candidate_id)
    WHERE NOT is_site AND coherence >= 0.6 AND coalesce(t.tier, 'whs_cultural') = 'whs_cultural'
  UNION ALL SELECT candidate_id, 'A2', 0.7 FROM cand JOIN attr USING (candidate_id) WHERE NOT is_site AND coherence >= 0.6
  UNION ALL SELECT candidate_id, 'A11', 0.9 FROM cand JOIN tn USING (candidate_id) WHERE NOT is_site AND population < 50000 AND tier = 'craft_cluster')
GROUP BY ALL"""),
    "kall": (("kraw", "cand"), """
SELECT * FROM kraw UNION ALL
SELECT candidate_id, CASE WHEN is_site THEN 'A11' ELSE 'A12' END, 0.5 FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM kraw)"""),
    "kv": (("kall", "kindtab"), """
SELECT candidate_id, kind, ord, round_even(w, 3) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY w DESC, ord) AS rn FROM kall JOIN kindtab USING (kind))
WHERE rn <= 4 AND w >= 0.30"""),
    "knorm": (("kv",), "SELECT candidate_id, sqrt(sum(w * w)) AS len FROM kv GROUP BY ALL"),
    "ccov": (("kv", "knorm", "cand", "country"), """
SELECT c.country, count(DISTINCT kind) AS kinds_covered FROM kv JOIN knorm USING (candidate_id) JOIN cand USING (candidate_id)
JOIN country c ON c.n = cand.n WHERE w / len >= 0.45 GROUP BY ALL"""),
    "cqual": (("cand", "country", "ccov", "tn", "tw"), """
SELECT f.country, area_km2, coalesce(kinds_covered, 0) AS kinds_covered, coalesce(g.n, 0)::BIGINT AS global_assets,
  2.5 * ln(1 + area_km2 / 50000.0) + 0.6 * coalesce(kinds_covered, 0) + 1.2 * ln(1 + coalesce(g.n, 0)) AS quality
FROM (SELECT DISTINCT c.* FROM country c JOIN cand ON cand.n = c.n) f LEFT JOIN ccov USING (country)
LEFT JOIN (SELECT cand.n AS cn, sum(tn.n) AS n FROM tn JOIN tw USING (tier) JOIN cand USING (candidate_id) WHERE cross_ok GROUP BY ALL) g ON g.cn = f.n"""),
    "quota": (("cqual",), """
SELECT *, greatest(1, least(40, CASE WHEN kinds_covered >= 6 THEN greatest(q0, 6) ELSE q0 END))::INT AS quota FROM (
  SELECT *, round_even(greatest(1, round_even(3000 * least(1.0, (count(*) OVER ()) / 195.0), 0)) * quality / sum(quality) OVER (), 0) AS q0 FROM cqual)"""),
    "top100": (("scored",), """
SELECT *, round_even(100.0 * score / top, 0)::INT AS score100 FROM (
  SELECT *, CASE WHEN max(score) OVER (PARTITION BY n) > 0 THEN max(score) OVER (PARTITION BY n) ELSE 1 END AS top FROM scored)
WHERE feasibility > 0 AND score >= 0.10 * top"""),
}


def sql(final: str, *needs: str) -> str:
    """Final SELECT with the views and blocks it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        deps = CTE[name][0] if name in CTE else fixtures._NEEDS[name]
        for d in deps:
            add(d)
        order.append(name)

    for n in needs:
        add(n)
    text = [f"{n} AS ({(CTE[n][1] if n in CTE else fixtures.VIEWS[n]).strip()})" for n in order]
    return ("WITH " + ",\n".join(text) + "\n" if text else "") + final.strip()
