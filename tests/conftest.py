import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(spark_df, duck_result) -> None:
    """Equal column names, and equal rows in any order."""
    left = [r.asDict() for r in spark_df.collect()]
    names = [d[0] for d in duck_result.description]
    right = [dict(zip(names, r, strict=True)) for r in duck_result.fetchall()]
    assert sorted(spark_df.columns) == sorted(names)

    def key(row):
        return [str(v) if not isinstance(v, float) else f"{v:.6g}" for _, v in sorted(row.items())]

    assert sorted(map(key, left)) == sorted(map(key, right))
