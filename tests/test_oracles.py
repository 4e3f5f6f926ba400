"""Every driver query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from check_oracles import connect, differences

from rasterloom_checks.oracles import ORACLES
from rasterloom_checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert differences(spark, connection, FOLDER, name) is None
