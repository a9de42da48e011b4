import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from navloom.session import local_session, ready

    s = local_session(4, "4g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return ready(s)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with SQL: column names, types and rows as a bag."""

    def check(df, sql):
        got = df.toArrow()
        duck.sql(f"CREATE OR REPLACE TABLE expected AS {sql}")
        duck.register("got", got)
        kinds = lambda t: {r[0]: r[1] for r in duck.sql(f"DESCRIBE SELECT * FROM {t}").fetchall()}
        assert kinds("got") == kinds("expected")
        names = ", ".join(f'"{c}"' for c in sorted(df.columns))
        for a, b in (("got", "expected"), ("expected", "got")):
            rest = duck.sql(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall()
            assert not rest, f"in {a} only: {rest[:3]}"
        return got.num_rows

    return check
