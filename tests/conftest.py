import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fieldmark.session import build_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", 8, spark__checkpoint__dir=shared,
                            spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    session.stop()


@pytest.fixture
def low_limit(spark):
    """Treat every key with more than 20 rows as hot."""
    from fieldmark.session import ROWS_PER_TASK_CONF

    spark.conf.set(ROWS_PER_TASK_CONF, "20")
    yield 20
    spark.conf.unset(ROWS_PER_TASK_CONF)
