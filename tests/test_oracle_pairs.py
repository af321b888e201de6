"""Every registered query equals its DuckDB oracle (rows, columns, values) at sf0.001."""

import pytest

from tests.conftest import SF001
from tests.pairs import compare, duck

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_pair(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLES.get(name), SF001, con)
    if name in ORACLES:
        assert r["cols_ok"], r
        assert r["match"], r
    else:
        assert r["rows"] >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["isotype", "v_family", "n_seq", "mean_pll", "sd_pll", "min_pll", "max_pll"]
