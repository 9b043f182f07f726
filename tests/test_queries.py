"""Registered queries against their SQL on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as contract
import check

SF_DIR = contract.SMOKE_DIR
# Full import runs are covered on small exports in test_warehouse.
NAMES = [n for n in contract.queries() if n not in ("import_twice", "stream_import", "reset_reload", "default_stamps")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, _, _ = check.compare(spark, con, SF_DIR, name)
    assert verdict.startswith("ok")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[0] == "history_id"
