"""Results do not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.pairs import _rows

QUERIES = entry.queries()


@pytest.mark.parametrize("name", ["F6_rank_within_sample", "F4_factorize_clonotypes", "E13_roc_curve", "E15_macro_roc",
                                  "J4_scores_all_modes", "E9_undersample", "S4_F2_keep_first_sequence"])
def test_same_result_for_3_and_8_partitions(spark, name):
    out = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.catalog.clearCache()
        df = QUERIES[name](spark, SF001)
        out.append(_rows(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]
