import pytest

from quillon.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "3g"})
    yield own
    own.stop()
