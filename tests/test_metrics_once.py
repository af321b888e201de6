"""Binary metrics read their rows once, whatever is computed from them."""

import math

from pyspark.sql import functions as F

from clonalyze.operators import metrics as M


def test_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(i % 2, i / 40) for i in range(40)], "label int, score double").repartition(2)
    df = df.withColumn("score", F.udf(look, "double").asNondeterministic()("score"))
    M.binary_metrics(df).collect()
    assert seen.value == 40


def test_null_labels_scores_and_classes(spark):
    rows = [("a", 1, 0.9, 1), ("a", 0, 0.9, 0), ("a", None, 0.4, 1), ("a", 0, 0.1, None), ("a", 1, 0.2, 0), ("a", 0, 0.1, 1), ("b", 1, None, 1), ("b", 0, 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, y int, s double, p int")
    got = {r.g: r for r in M.binary_metrics(df, "y", "s", "p", by=["g"]).collect()}
    # a: tp 1, fp 1, fn 1, tn 1; the row without a label is no positive for the curve and in no cell
    a = got["a"]
    assert (a.precision, a.recall, a.f1, a.mcc, a.accuracy) == (0.5, 0.5, 0.5, 0.0, 0.5)
    area = M.binary_summary(df, "y", "s", ["g"]).filter("g = 'a'").first()
    assert math.isclose(a.auc, area.auc) and math.isclose(a.aupr, area.aupr) and got["b"].accuracy == 1.0
