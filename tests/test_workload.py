"""Every registered query next to its SQL at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as E
from tests.compare import ROOT, compare, engine

SF = f"{ROOT}/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no benchmark tables here")


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0
