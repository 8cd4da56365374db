import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from heddle.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("checkpoint"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, tmp_path_factory):
    """Compares a query with its SQL on the smallest tables, as sets of rows."""

    def compare(name, query, sql):
        out = str(tmp_path_factory.mktemp("q") / name)
        query(spark, SF).write.parquet(out)
        got = duck.execute(f"SELECT * FROM '{out}/*.parquet'").df()
        want = duck.execute(sql).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)

        def rows(df):
            return sorted(map(repr, df[cols].itertuples(index=False, name=None)))

        assert rows(got) == rows(want)

    return compare
