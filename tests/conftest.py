import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pairlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session(cores=4, shuffle_partitions=4, name="pairlens-tests", conf=conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from tuples and a DDL schema."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
