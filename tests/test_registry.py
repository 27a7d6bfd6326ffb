from pathlib import Path

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from shelfline.plans import registry

SF = "/root/testdata/sf0.001"
CHECKED = [
    "strict_intervals", "sliced_intervals", "coalesced_price_history", "product_state_fold", "merge_deltas_history",
    "catalog_page", "search_many", "integrity_report", "price_series", "discovery_counts", "extract_observations",
]


def test_every_query_of_the_registry_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_oracle(spark, name):
    ok, text = compare(spark, connect(SF), name, queries()[name], oracle_sql()[name], SF)
    assert ok, text


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry(spark).count() == 60
