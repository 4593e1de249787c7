"""Every registered query with SQL gives the SQL's rows."""

import pytest

from perceptra.plans.oracles import ORACLES
from perceptra.plans.queries import QUERIES

from .conftest import plain


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    rows = [dict(zip(expected.columns, r, strict=True)) for r in expected.fetchall()]
    assert plain([r.asDict() for r in found.collect()], columns) == plain(rows, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
