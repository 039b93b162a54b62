"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import check
from trustlake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    check(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
