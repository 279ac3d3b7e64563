import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    found = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Asserts that a registered query gives what its SQL gives in DuckDB over the same tables."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def plain(v):
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else "~" if v is None else str(v)

    def run(f, sql, sf_dir="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = f(spark, sf_dir)
        cols = sorted(found.columns)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in found.collect())
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        assert got == want

    return run
