"""The entry contract, and a spread of registered queries against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = ("cap_per_country", "coverage_by_user_country", "trip_order", "point_in_region", "passport_summary", "build_number",
          "lww_visits", "transliteration_merge", "owner_partition", "top_per_country", "quotas", "id_stability")


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["country", "candidate_id", "name", "score100"] and df.count() > 0


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_its_sql(spark, name):
    ok, note, _ = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF, connect(SF))
    assert ok, note


def test_absorption_counts_equal_their_sql_where_customers_share_a_point(spark, tmp_path):
    """Keys 4,001 apart lie at one point; names two letters apart fold, whether a supplier is there or not."""
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "orders"):
        con.execute(f"COPY (FROM read_parquet('{SF}/{t}.parquet')) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT i * 4001 + 15 AS c_custkey, 'Customer#' || lpad(v.tail, 9, '0') AS c_name, 3::INTEGER AS c_nationkey, 10.0 * i AS c_acctbal,
        'FURNITURE' AS c_mktsegment FROM (VALUES (0, '15'), (1, '16'), (2, '977'), (3, '26'), (4, '2978')) AS v(i, tail)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)""")
    con.execute(f"COPY (SELECT 1::BIGINT AS s_suppkey, 'Supplier#1' AS s_name, 3::INTEGER AS s_nationkey, 0.0::DOUBLE AS s_acctbal) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    for t in ("nation", "customer", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    ok, note, _ = compare(spark, entry.queries()["absorption_counts"], entry.oracle_sql()["absorption_counts"], str(tmp_path), con)
    assert ok, note
    assert con.execute(entry.oracle_sql()["absorption_counts"]).fetchall()[0][2] > 1
