import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from molspark.session import local_session, scratch_path  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "molspark-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    return lambda label: scratch_path(spark, label)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
