"""Scores of contigs: log tables that give gaps and stops nothing, and positions added once, against exploded residues."""

import math

from pyspark.sql import functions as F

from clonalyze.functions.regions import REGIONS
from clonalyze.operators.arrays import LogArray, sequence_scores
from clonalyze.operators.likelihood import pseudo_log_likelihood
from clonalyze.operators.models import ContextModel, residues
from clonalyze.plans import scoring as sc

MODES = ["cdr3_only", "v_gene_only", "full_VDJ", "cdr3_from_VDJ"]
ROWS = [(1, "IGH", "IGHV1-1", "ACD", "E", "FG", "HI", "KL", "MNPQ", "RST"), (2, "IGH", "IGHV1-2", "A", "C", "D", "E", "F", "G", "H"),
        (3, "IGK", "IGKV2-1", "A-D", "*", "XG", "HI", "Kx", "Mé", "Z-"), (4, "IGK", None, "ACD", None, "FG", "HI", "KL", "MN", None),
        (5, "IGH", "IGHV1-1", None, None, None, None, None, "--", None), (6, "IGL", "IGLV3-1", "", "", "", "", "", "", "")]
SCHEMA = "seq_id long, chain string, v_gene string, " + ", ".join(f"{r} string" for r in REGIONS)


def test_scores_equal_those_of_exploded_residues(spark):
    c = spark.createDataFrame(ROWS, SCHEMA)
    models = sc.fit_models(sc.chain_training(spark.createDataFrame(ROWS[:3], SCHEMA)))
    got = {(r.seq_id, r.model, r["mode"]): (r.n_pos, r.pll) for r in sc.score(c, MODES, models).collect()}
    res = sc._looked_up(c, MODES, models, ["seq_id"])
    ok = F.col("aa").isNotNull() & ~F.col("aa").isin("-", "*")
    want = {}
    for r in res.groupBy("seq_id", "mode").agg(F.count(F.when(ok, 1)).alias("n"), *[F.avg(F.when(ok, F.ln(f"_p_{m}"))).alias(m) for m in models]).collect():
        want |= {(r.seq_id, m, r["mode"]): (r.n, r[m]) for m in models}
    assert set(got) == set(want) and len(got) > 30
    for k, (n, x) in want.items():
        assert got[k][0] == n and (x is None) == (got[k][1] is None) and (x is None or math.isclose(x, got[k][1], rel_tol=1e-12)), k


def test_sequence_scores_of_odd_sequences(spark):
    m = ContextModel().fit(spark.createDataFrame([("ACXD",), ("A",), ("C-A",)], "sequence string"))
    df = spark.createDataFrame([(1, "ACXD"), (2, ""), (3, None), (4, "--"), (5, "xAé*C")], "seq_id long, sequence string")
    got = {r.seq_id: (r.n_pos, r.pll) for r in sequence_scores(df, m, ["seq_id"]).collect()}
    want = {r.seq_id: (r.n_pos, r.pll) for r in pseudo_log_likelihood(m.lookup(residues(df)), ["seq_id"]).collect()}
    assert got[2] == (0, None) and got[3] == (None, None) and got[4] == (0, None)
    assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], rel_tol=1e-12) for i in (1, 5))


def test_logs_are_read_from_the_table(spark):
    m = ContextModel().fit(spark.createDataFrame([("ACD",)], "sequence string"))
    t = LogArray(m)
    df = spark.createDataFrame([("A-CD",)], "s string").select(t.codes(F.col("s")).alias("y"))
    plan = df.select(t.over(F.col("y")).alias("l"))
    assert "ln(" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    logs = plan.first().l
    assert len(logs) == 4 and logs[1] == 0.0 and math.isclose(logs[3], math.log(2 / 21))
