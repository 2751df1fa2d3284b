"""Every query against its oracle over the smallest tables."""

import os

import pytest

import __spark_entry__
from isobar.queries import ORACLES, QUERIES
from oracle import SF, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are absent")


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name])[:3] == []


@pytest.mark.parametrize("name", ["lambert_forward", "polar_forward", "mercator_forward", "grid_north_lambert", "unrotate_roundtrip", "nearest_corner"])
def test_every_position(spark, name):
    """The hard rows (seams, poles, the other hemisphere, ties) are there, and agree on a table that holds many of them."""
    sf = SF.replace("0.001", "0.01")
    out = QUERIES[name](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert differences(spark, QUERIES[name], ORACLES[name], sf)[:3] == []


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.where("not within").count() == 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
