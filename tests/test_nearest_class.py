"""Sequences are dealt by group, vectors are made where they are compared."""

import random

from clonalyze.operators import corpus as CO
from clonalyze.operators import ml as ML


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vector_is_shuffled_for_the_nearest_class(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, "g" if i % 4 else None, "".join(rng.choices("ACDEFGHIKL", k=9)) + ("WYW", "RKR", "PQP")[i % 3] * 4) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id long, y int, v string, sequence string")
    out = ML.nearest_centroid(df, "y", ["v"], eval_size=0.3)
    lines = _plan(out).splitlines()
    dealt = [line for line in lines if "Exchange" in line]
    assert len(dealt) == 3 and sum("REPARTITION_BY_COL" in line for line in dealt) == 2
    assert not any(line.lstrip(" :+-").startswith("BroadcastExchange") for line in lines)
    got = out.collect()
    assert all(r.label == r.pred for r in got) and {r.seq_id for r in got} == {r.seq_id for r in CO.hash_split(
        df, "seq_id", [("eval", 0.3), ("train", 0.7)], salt="7").filter("split = 'eval'").collect()}
