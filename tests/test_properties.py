"""Property checks: splits disjoint and complete, ARI symmetric, probabilities per position sum to 1."""

import math

from pyspark.sql import functions as F

from clonalyze.operators import metrics as M
from clonalyze.operators.corpus import hash_split, nested_split
from clonalyze.operators.models import ContextModel, residues
from clonalyze.plans.scoring import heavy_training
from clonalyze.sources import fixtures as fx
from tests.conftest import SF001


def test_hash_split_complete_and_proportional(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    s = hash_split(df, "k")
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 20000 and set(counts) == {"train", "val", "test"}
    assert abs(counts["train"] / 20000 - 0.8) < 0.02 and abs(counts["val"] / 20000 - 0.1) < 0.02
    n = nested_split(df, "k", 0.1, 0.2, salt="s")
    assert n.filter(F.col("split").isNull()).count() == 0 and n.count() == 20000


def test_ari_symmetric(spark):
    m = fx.scored_multi(spark, SF001)
    a = M.adjusted_rand_index(m, "label", "cluster").first()["ari"]
    b = M.adjusted_rand_index(m, "cluster", "label").first()["ari"]
    assert math.isclose(a, b, abs_tol=1e-12)


def test_position_probabilities_sum_to_one(spark):
    c = fx.contigs(spark, SF001)
    model = ContextModel().fit(heavy_training(c))
    h = c.filter(F.col("chain") == "IGK").select("seq_id", F.col("cdr3").alias("sequence"))   # light chains: unseen contexts too
    m = model.matrix(residues(h, "sequence", keep=["seq_id"]))
    sums = m.select(F.aggregate("probs", F.lit(0.0), lambda acc, x: acc + x).alias("s")).collect()
    assert sums and all(math.isclose(r.s, 1.0) for r in sums)
