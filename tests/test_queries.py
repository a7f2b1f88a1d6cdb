"""Every registered query that has an SQL twin gives the same rows; the others give rows."""

import pytest
from oracle import database, differences
from seriesloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
MODELS = "/root/testdata/sf0.01"  # enough rows to train on


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, db, name):
    assert differences(registry.QUERIES[name](spark, FOLDER), db.sql(registry.ORACLE[name])) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, MODELS).limit(1).count() == 1
