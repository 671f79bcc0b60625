"""Every registered query against its checking SQL, on the small tables."""

import pytest

from claridoc.plans import catalog
from claridoc.plans.check import checker, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return checker(FOLDER)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_check(spark, db, name):
    assert compare(spark, db, FOLDER, name) == ""


def test_every_query_is_checked():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as driver

    rows = driver.entry(spark).collect()
    assert len(rows) > 0
    assert all(r.total == 55 and r.passed + r.failed + r.needs_human + r.not_applicable == 55 for r in rows)
