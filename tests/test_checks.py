"""Every query at the smallest scale against its expected result."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(ORACLES)
