import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from frostline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    # Plans in full, for the tests that look into them.
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    session.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield session
    session.stop()


@pytest.fixture
def lake(spark, tmp_path):
    """Empty tables in a folder of their own."""
    from uuid import uuid4

    from frostline.sources.lake import Lake

    tables = Lake(spark, f"test_{uuid4().hex}")
    tables.ensure_tables(str(tmp_path / "lake"))
    return tables
