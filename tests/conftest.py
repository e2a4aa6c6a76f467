import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyline.session import session

    made = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false")
    made.conf.set("spark.sql.shuffle.partitions", "4")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test tables")
    return TESTDATA


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con
