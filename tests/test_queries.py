"""Every query against its SQL; queries without SQL run and give rows."""

import pytest
from compare import assert_same

from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
