import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from playmetrics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def shuffle_partitions(spark):
    """Set the shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def change(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield change
    spark.conf.set("spark.sql.shuffle.partitions", before)
