import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from changegate.session import clean_up, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session("8", shuffle_partitions=4, app="changegate-tests", shared=str(shared))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clean_up(session)
    session.stop()


@pytest.fixture()
def rows(spark):
    def make(schema, data):
        return spark.createDataFrame(data, schema)

    return make
