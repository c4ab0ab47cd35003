import pytest

from tests.fixtures import lake_raw
from tramline.feed import Feed
from tramline.operators import silver
from tramline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


def as_feed(raw):
    tables = silver.silver_tables({name: raw[name] for name in silver.TABLES})
    return Feed(
        **{name: silver.with_extra_fields(name, frame) for name, frame in tables.items()}
    )


@pytest.fixture(scope="session")
def lake(spark):
    return as_feed(lake_raw(spark))
