"""Every query against its DuckDB twin on the smallest tables."""

import pytest
from comparing import same

from tallyline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(name, spark, folder, duck):
    same(catalog.QUERIES[name](spark, folder), duck.sql(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, folder):
    assert catalog.QUERIES[name](spark, folder).count() > 0


def test_samples_are_exact_and_repeatable(spark, folder):
    one, two = (sorted(r[0] for r in catalog.QUERIES["smp_01_sample"](spark, folder).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 100
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert 0.1 * orders < catalog.QUERIES["smp_03_bernoulli"](spark, folder).count() < 0.3 * orders
    assert catalog.QUERIES["smp_02_shuffle"](spark, folder).distinct().count() == spark.read.parquet(f"{folder}/customer.parquet").count()


def test_dynamic_width_cuts_long_keys(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(9999, 0), (10000, 0), (10000, 1), (1234567, 2), (1234567, 24), (12, None)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    same(catalog.QUERIES["scf_10_dynamic_width"](spark, str(tmp_path)), con.sql(catalog.ORACLES["scf_10_dynamic_width"]))


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
