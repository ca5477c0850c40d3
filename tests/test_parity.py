"""Every registered query of the engine against its SQL twin."""

import pytest

from arenaflow.plans import catalog
from tests import parity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    assert parity.compare(spark, db, SF, name, catalog.QUERIES[name], catalog.ORACLE.get(name)) == ""
