"""Each query of the library against its SQL, on whole tables."""

import pytest

from siltstone.catalog import SHOWN
from siltstone.catalog_sql import SQL
from tests.compare import assert_same


@pytest.mark.parametrize("name", [n for n in SHOWN if n in SQL])
def test_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    assert_same(SHOWN[name](spark, sf), SQL[name], sf)


def test_every_query_has_sql_or_a_test():
    assert set(SHOWN) - set(SQL) == {"text_rules", "text_nfkc"}  # the Unicode form has no SQL: see test_text
