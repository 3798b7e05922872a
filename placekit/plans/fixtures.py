"""Place-shaped views over the driver's tables.

Each view is SQL that Spark and DuckDB both run, so a query and its check start from the
same rows. Rows grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placekit.plans.session import spread

TABLES = ("nation", "customer", "supplier", "orders", "events")

VIEWS: dict[str, str] = {}

VIEWS["cand"] = """
WITH a AS (
  SELECT concat('c', c_custkey) AS candidate_id, c_custkey AS k, c_name AS name, c_nationkey AS n,
    (c_nationkey % 5) * 20 - 40 + CAST((c_custkey * 1237) % 4001 AS DOUBLE) / 1000 AS lat,
    CAST(floor(c_nationkey / 5) AS INT) * 30 - 60 + CAST((c_custkey * 2551) % 4001 AS DOUBLE) / 1000 AS lon,
    greatest(CAST(0 AS DOUBLE), c_acctbal) * 100 AS population,
    c_mktsegment = 'MACHINERY' AS is_site
  FROM customer)
SELECT * FROM a
UNION ALL
SELECT concat('s', s_suppkey), a.k, substr(a.name, 2), a.n, a.lat, a.lon, CAST(0 AS DOUBLE), false
FROM supplier JOIN a ON a.k = s_suppkey * 15"""

VIEWS["attr"] = """
SELECT candidate_id, CAST((k * 13) % 4000 AS DOUBLE) AS relief_m, CAST(k % 10 AS DOUBLE) / 10 AS coherence,
  CASE k % 4 WHEN 0 THEN 'near' WHEN 1 THEN 'mid' WHEN 2 THEN 'far' ELSE 'remote' END AS reach,
  k % 6 <> 0 AS has_lodging, k % 9 = 0 AS overtourism,
  CASE WHEN k % 31 = 0 THEN 'closed' WHEN k % 11 = 0 THEN 'restricted' ELSE 'open' END AS access,
  k % 17 = 0 AS historic_capital, CASE WHEN k % 3 = 0 THEN 'wdpa' WHEN k % 3 = 1 THEN 'osm' ELSE 'ghsl-ucdb' END AS source,
  concat('fam', k % 3, ':', k % 7) AS language, concat('r', k % 4) AS religion,
  concat('v', k % 5) AS vernacular, concat('q', k % 6) AS cuisine
FROM cand"""

VIEWS["landform"] = """
SELECT DISTINCT candidate_id, landform FROM cand JOIN (VALUES (0,'coast'),(1,'river'),(2,'lake'),(3,'forest'),(4,'mountain'),
  (5,'desert'),(6,'volcano'),(7,'geothermal'),(8,'glacier'),(9,'fjord'),(10,'canyon'),(11,'cave'),(12,'wetland'),(13,'steppe'),
  (14,'island'),(15,'waterfall'),(16,'saltflat'),(17,'rainforest'),(18,'tundra'),(19,'reef'),(20,'dunes'),(21,'gorge')) AS v(i, landform)
  ON v.i = k % 22 OR v.i = (k * 7 + 3) % 22"""

VIEWS["asset"] = """
SELECT concat('a', o_orderkey) AS asset_id, v.tier, concat('src', o_orderkey % 4) AS source, c.n,
  c.lat + CAST((o_orderkey * 53) % 2001 - 1000 AS DOUBLE) / 1000 AS lat,
  c.lon + CAST((o_orderkey * 97) % 2001 - 1000 AS DOUBLE) / 1000 AS lon,
  CASE v.tier WHEN 'cuisine_region' THEN CAST(80 AS DOUBLE) WHEN 'ich_unesco' THEN CAST(60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS radius_km
FROM orders JOIN cand c ON c.candidate_id = concat('c', o_custkey)
JOIN (VALUES (0,'whs_cultural'),(1,'whs_tentative'),(2,'national_top'),(3,'wikidata_multilingual'),(4,'national_other'),(5,'osm_heritage'),
  (6,'whs_natural'),(7,'wdpa_iucn_i_ii'),(8,'ramsar_geopark'),(9,'wdpa_iucn_iii_iv'),(10,'ich_unesco'),(11,'pilgrimage_major'),
  (12,'cuisine_region'),(13,'festival'),(14,'craft_cluster'),(15,'ich_national'),(16,'institution'),(17,'market')) AS v(i, tier)
  ON v.i = o_orderkey % 18"""

VIEWS["visit"] = """
SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN concat('gone', event_id % 5) ELSE concat('c', (event_id * 31) % 60) END AS place_id,
  event_type <> 'error' AS visited, ts AS marked_at, CASE WHEN event_id % 7 = 0 THEN concat('note ', event_id) END AS note,
  event_id % 2 AS side
FROM events"""

VIEWS["country"] = """
SELECT n_nationkey AS n, n_name AS country, concat('N', chr(65 + CAST(floor(n_nationkey / 5) AS INT)), chr(65 + n_nationkey % 5)) AS iso3,
  CAST(20000 + n_nationkey * 37000 AS DOUBLE) AS area_km2
FROM nation"""

VIEWS["admin_rect"] = """
SELECT concat(iso3, '-R', lpad(CAST(i * 4 + j + 1 AS VARCHAR(9)), 2, '0')) AS region_id, n, iso3,
  (n % 5) * 20 - 40 + i AS y0, (n % 5) * 20 - 39 + i AS y1,
  CAST(floor(n / 5) AS INT) * 30 - 60 + j AS x0, CAST(floor(n / 5) AS INT) * 30 - 59 + j AS x1
FROM country CROSS JOIN (VALUES (0),(1),(2),(3)) AS r(i) CROSS JOIN (VALUES (0),(1),(2),(3)) AS c(j)"""

VIEWS["passport"] = """
SELECT a.iso3 AS passport, b.iso3 AS destination, CASE WHEN a.n = b.n THEN '-1' ELSE v.req END AS requirement
FROM country a CROSS JOIN country b JOIN (VALUES (0,'90'),(1,'visa free'),(2,'visa on arrival'),(3,'e-visa'),(4,'eta'),
  (5,'visa required'),(6,'no admission'),(7,'30')) AS v(i, req) ON v.i = (a.n * 7 + b.n * 11) % 8
WHERE b.n <> 24"""

VIEWS["trip"] = """
SELECT o_custkey AS trip_id, concat('c', (o_orderkey * 17) % 150) AS place_id, o_orderkey AS stop_key,
  o_orderkey % 4 AS day, (o_orderkey * 13) % 10 AS position
FROM orders"""

VIEWS["pin"] = """
SELECT candidate_id AS place_id, name, iso3, country, cand.n AS n, lat, lon, CAST((k * 37) % 101 AS INT) AS score,
  CAST((k * 1237 + 77) % 4095 + 1 AS INT) AS kmask, CAST((k * 331) % 4096 AS INT) AS months,
  (k * 7) % 5 = 0 AS printed, CAST((k * 3) % 4 AS INT) AS whs, concat('src', k % 3) AS source
FROM cand JOIN country ON country.n = cand.n"""

_NEEDS = {
    "cand": (), "attr": ("cand",), "landform": ("cand",), "asset": ("cand",), "visit": (),
    "country": (), "admin_rect": ("country",), "passport": ("country",), "trip": (), "pin": ("cand", "country"),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def with_views(*names: str) -> str:
    """`WITH cand AS (...), ...` for the named views and what they need."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _closure(names))


class Views:
    """The views of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        key = f"table {name}"
        if key not in self._made:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            # every place view is computed from these, so they should use every core
            self._made[key] = spread(df) if name in ("customer", "orders", "events") else df
        return self._made[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            text = "\n".join(VIEWS[n] for n in _closure([name]))
            for t in TABLES:
                # names resolve while the statement is analysed, so later folders may reuse them
                if f"FROM {t}" in text:
                    self.table(t).createOrReplaceTempView(t)
            self._made[name] = self.spark.sql(f"{with_views(name)} SELECT * FROM {name}")
        return self._made[name]
