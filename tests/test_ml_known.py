"""Fitted jobs on hand-made separable data with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from clonalyze.operators import embed as E
from clonalyze.operators import graph as G
from clonalyze.operators import metrics as M
from clonalyze.operators import ml as ML
from clonalyze.operators.aggregates import best_by


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(0)
    rows = [(i, i % 3, [(4.0 if d == i % 3 else 0.0) + rng.gauss(0, 0.3) for d in range(4)]) for i in range(240)]
    return spark.createDataFrame(rows, "seq_id long, label int, vec array<double>").repartition(2).persist()


def test_classifiers_tell_blobs_apart(blobs):
    p = ML.compare_classifiers(blobs, eval_size=0.3, models=["svm", "random_forest", "naive_bayes", "logistic_regression"])
    rows = p.collect()
    for m in {r.model for r in rows}:
        own = [r for r in rows if r.model == m]
        assert sum(r.label == r.pred for r in own) / len(own) > 0.95, m
        assert all(abs(sum(r.prob) - 1) < 1e-6 and r.prob.index(max(r.prob)) == r.pred for r in own), m


def test_clusters_sweep_and_spectral_find_blobs(blobs):
    for method in ("kmeans", "bisecting"):
        assert M.adjusted_rand_index(ML.cluster(blobs, method, 3), "label", "cluster").first().ari > 0.95
    assert best_by(ML.sweep_k(blobs, "label", [2, 3, 6]), "ari", "k").first().k == 3
    edges = G.undirected(G.knn(blobs.withColumn("all", F.lit("x")), "all", "seq_id", "vec", 100))
    weights = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.exp(-F.col("distance")).alias("weight"))
    clusters = ML.spectral(weights, 3).withColumnRenamed("id", "seq_id")
    assert M.adjusted_rand_index(blobs.join(clusters, "seq_id"), "label", "cluster").first().ari > 0.4


def test_projection_keeps_blobs_apart(blobs):
    xy = blobs.join(ML.project_2d(blobs), "seq_id")
    assert M.adjusted_rand_index(ML.cluster(xy.select("seq_id", "label", F.array("x", "y").alias("vec")), "kmeans", 3), "label", "cluster").first().ari > 0.9


def _family(rng, motif):
    return "".join(rng.choices("ACDEFGHIKL", k=6)) + motif * 4 + "".join(rng.choices("ACDEFGHIKL", k=6))


def test_sequence_classifiers_find_motifs(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, "g" if i % 4 else None, _family(rng, "WYW" if i % 2 else "RKR")) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id long, y int, v string, sequence string")
    p = ML.sequence_classifier(df, "y", eval_size=0.3).collect()
    assert sum(r.label == r.pred for r in p) / len(p) > 0.95
    c = ML.nearest_centroid(df, "y", ["v"], eval_size=0.3).collect()
    assert len(c) == len(p) or len(c) > 50
    assert sum(r.label == r.pred for r in c) / len(c) > 0.95


def test_residue_classifier_reads_the_neighbour_without_joins(spark):
    rng = random.Random(2)
    rows = []
    for s in range(120):
        seq = "".join(rng.choices("ACDE", k=20))
        rows += [(s, i, c, int(i > 0 and seq[i - 1] == "A")) for i, c in enumerate(seq)]
    t = spark.createDataFrame(rows, "seq_id long, pos int, aa string, y int")
    p = ML.residue_classifier(t, window=1)
    assert M.binary_summary(p, "label", "score").first().auc > 0.99
    assert "Join" not in p._jdf.queryExecution().executedPlan().toString()


def test_kmer_vectors_put_like_sequences_together(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, "".join(rng.choices("WYF" if i % 2 else "RKH", k=40))) for i in range(120)]
    _, v = E.kmer_word2vec(spark.createDataFrame(rows, "seq_id long, label int, sequence string"), size=8)
    assert M.adjusted_rand_index(ML.cluster(v.select("seq_id", "label", "vec"), "kmeans", 2), "label", "cluster").first().ari > 0.9


def test_velocity_graph_weighs_its_edges_by_the_aligned_velocity(spark):
    from clonalyze.operators.evolution import velocity_aligned
    from clonalyze.operators.models import ContextModel
    from clonalyze.plans.graphs import sequence_nodes, velocity_graph
    from clonalyze.plans.scoring import heavy_training
    from clonalyze.sources import fixtures as fx

    folder = "/root/testdata/sf0.001"
    rep = fx.repertoire(spark, folder).filter("sample_id = 'src1'")
    model = ContextModel().fit(heavy_training(fx.contigs(spark, folder)))
    edges, nodes = velocity_graph(rep, model, k=3)
    v = {(r.src, r.dst): r.velocity for r in edges.collect()}
    seq = {r.seq_id: r.sequence for r in sequence_nodes(rep).collect()}
    some = sorted(v)[::7]
    direct = velocity_aligned(spark.createDataFrame([(a, b, seq[a], seq[b]) for a, b in some], "src long, dst long, seq_1 string, seq_2 string"), model, ["src", "dst"])
    assert len(v) > 50 and {(r.src, r.dst): r.velocity for r in direct.collect()} == {k: v[k] for k in some}
    out = {r.seq_id: r.mean_out for r in nodes.collect()}
    a = some[0][0]
    own = [x for (s, _), x in v.items() if s == a]
    assert abs(out[a] - sum(own) / len(own)) < 1e-9
