"""The SQL-expressible operators against their oracles over the smallest tables."""

import os

import pytest

from isobar.llm.queries import ORACLES, QUERIES
from oracle import SF, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are absent")


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name])[:3] == []
