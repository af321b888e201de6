"""Hand-computed values for residue models and the pseudo-log-likelihood."""

import math

from pyspark.sql import functions as F

from clonalyze.operators.likelihood import pseudo_log_likelihood
from clonalyze.operators.models import ContextModel, residues


def test_residues_neighbours(spark):
    df = spark.createDataFrame([(1, "ACD")], "seq_id long, sequence string")
    rows = residues(df).orderBy("pos").collect()
    assert [(r.pos, r.aa, r.left, r.right) for r in rows] == [(0, "A", "^", "C"), (1, "C", "A", "D"), (2, "D", "C", "$")]


def test_window_and_empty(spark):
    df = spark.createDataFrame([(1, "ACDE", 1, 3), (2, "AC", 1, 1)], "seq_id long, sequence string, s int, e int")
    rows = residues(df, start="s", end="e", outer=True).orderBy("seq_id", "pos").collect()
    assert [(r.seq_id, r.pos, r.aa) for r in rows] == [(1, 1, "C"), (1, 2, "D"), (2, None, None)]


def test_pll_three_residues(spark):
    # training: ACD twice; contexts (^,C)->A, (A,D)->C, (C,$)->D each seen 2 times
    train = spark.createDataFrame([("ACD",), ("ACD",)], "sequence string")
    m = ContextModel().fit(train)
    df = spark.createDataFrame([(1, "ACD"), (2, "AC-")], "seq_id long, sequence string")
    pll = pseudo_log_likelihood(m.lookup(residues(df)), ["seq_id"]).orderBy("seq_id").collect()
    # P = (2 + 1) / (2 + 20) at every position of ACD
    assert pll[0].n_pos == 3 and math.isclose(pll[0].pll, math.log(3 / 22))
    # AC-: A in (^,C) seen -> 3/22; C in (A,-) unseen -> 1/20; '-' skipped
    assert pll[1].n_pos == 2 and math.isclose(pll[1].pll, (math.log(3 / 22) + math.log(1 / 20)) / 2)


def test_model_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([("ACDEFGHIK",), ("ACDKLMNPQ",)], "sequence string")
    t = ContextModel().fit(train).table()
    sums = t.groupBy("left", "right").agg(F.sum("prob").alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in sums)
