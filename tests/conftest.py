import pytest

from tagstream.session import make_session


@pytest.fixture(scope="session")
def spark():
    s = make_session("local[4]", "tests", shuffle_partitions=4, driver_memory="4g", **{"spark.sql.autoBroadcastJoinThreshold": "256k"})
    yield s
    s.stop()
