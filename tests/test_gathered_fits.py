"""Fits read a small table in few tasks, evaluations read the rows once."""

import random

from pyspark.sql import functions as F

from clonalyze import session as S
from clonalyze.operators import metrics as M
from clonalyze.operators import ml as ML


def _rows(spark, n=120):
    rng = random.Random(1)
    return spark.createDataFrame([(i, i % 3, [(3.0 if d == i % 3 else 0.0) + rng.gauss(0, 1) for d in range(4)]) for i in range(n)],
                                 "seq_id long, label int, vec array<double>").repartition(6, "seq_id")


def test_partitions_follow_the_numbers_of_a_table(spark, monkeypatch):
    df = _rows(spark)
    few = S.gathered(df, 4)
    assert few.rdd.getNumPartitions() == 1 and few.exceptAll(df).isEmpty() and few.count() == 120
    S.release(few)
    monkeypatch.setattr(S, "TASK_VALUES", 240)
    assert S.gathered(df, 4).rdd.getNumPartitions() == 2
    monkeypatch.setattr(S, "TASK_VALUES", 1)
    assert S.gathered(df, 4).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_sweep_scores_every_count_from_one_table(spark):
    df = _rows(spark).coalesce(1)
    sweep = ML.sweep_k(df, "label", [2, 3, 5])
    plan = sweep._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Union" not in plan           # scored when it was swept, not again whenever it is read
    want = {k: M.adjusted_rand_index(ML.cluster(df, "bisecting", k), "label", "cluster").first().ari for k in (2, 3, 5)}
    assert {r.k: round(r.ari, 9) for r in sweep.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_counted_rows_give_the_same_metrics(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice([0, 1, 2, None]), rng.choice([0, 1, 3])) for _ in range(90)], "label int, pred int")
    counts = df.groupBy("label", "pred").agg(F.count("*").alias("n"))
    shown = [sorted(map(str, x.collect())) for x in (M.report(df), M.report(counts, count="n"))]
    assert shown[0] == shown[1]
    assert M.adjusted_rand_index(df, "label", "pred").first().ari == M.adjusted_rand_index(counts, "label", "pred", count="n").first().ari
