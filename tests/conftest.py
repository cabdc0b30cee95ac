import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from iotrail.session import local_session, release  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            # Small test data must still spread over several chunks.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def con():
    import duckdb
    from check import TABLES

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection
