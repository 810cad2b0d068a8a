import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from subpanel.session import build_session
    session = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g",
                            spark_ui_showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def stages(spark, sf_dir):
    import __spark_entry__ as entry
    return entry.stages(spark, sf_dir)


def values(df, *columns):
    """Rows as tuples, sorted."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
