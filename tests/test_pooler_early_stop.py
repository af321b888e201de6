"""U2 pooler, M4 early stop, M5 RBF form and M17 rendering against numpy and known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clonalyze.operators import embed as E
from clonalyze.operators import ml as ML

SEQS = [(1, "ACDACD"), (2, "ACDEF"), (3, "AC"), (4, None), (5, ""), (6, "WWWWW"), (7, "ACDACD")]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "seq_id long, sequence string")


def _grams(s, k):
    return [s[i:i + k] for i in range(len(s) - k + 1)] if s else []


def _weights(k, a):
    every = [g for _, s in SEQS for g in _grams(s, k)]
    return {g: a / (a + every.count(g) / len(every)) for g in every}


def test_weights_are_inverse_frequencies(seqs):
    got = {r.kmer: r.weight for r in E.kmer_weights(seqs, k=3, a=0.01).collect()}
    assert got == pytest.approx(_weights(3, 0.01))
    assert E.kmer_weights(seqs.limit(0)).count() == 0


@pytest.mark.parametrize("table_bytes", [E.TABLE_BYTES, 0])       # table in every task, and joined
def test_weighted_pool_equals_numpy(spark, seqs, table_bytes):
    rng, w = random.Random(1), _weights(3, 0.01)
    vecs = {g: [rng.gauss(0, 1) for _ in range(4)] for g in w if g != "CDE"}       # one k-mer without a vector
    table = spark.createDataFrame([(g, w[g], v) for g, v in vecs.items()], "kmer string, weight double, vec array<double>")
    got = {r.seq_id: r.vec for r in E.weighted_pool(seqs, table, table_bytes=table_bytes).collect()}
    assert set(got) == {i for i, _ in SEQS}
    for i, s in SEQS:
        grams = _grams(s, 3)
        if not grams:
            assert got[i] is None
        else:
            want = sum((w[g] * np.array(vecs[g]) for g in grams if g in vecs), np.zeros(4)) / len(grams)
            assert got[i] == pytest.approx(list(want))


def test_common_axis_is_removed(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) + np.array([4.0, 2.0, 0, 0, 1.0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "seq_id long, vec array<double>").repartition(4)
    u = np.linalg.svd(x, full_matrices=False)[2][0]
    got = {r.seq_id: r.vec for r in E.remove_common(df).collect()}
    assert got.pop(999) is None
    assert np.allclose(np.array([got[i] for i in range(300)]), x - np.outer(x @ u, u))
    assert E.remove_common(df.limit(0)).count() == 0


def test_pooler_tells_rare_motifs_apart(spark):
    """Two classes differ by one motif within the same common repeat: the weights bring it out."""
    rng = random.Random(5)
    rows = [(i, "ACDE" * rng.randint(8, 12) + ("WYW" if i % 2 else "RKR")) for i in range(200)]
    df = spark.createDataFrame(rows, "seq_id long, sequence string")
    grams = sorted({g for _, s in rows for g in _grams(s, 3)})
    table = spark.createDataFrame([(g, [float(i == j) for j in range(len(grams))]) for i, g in enumerate(grams)], "kmer string, vec array<double>")
    vecs = {r.seq_id: np.array(r.vec) for r in E.pooler(df, table).collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vecs.items()}
    same = np.mean([unit[0] @ unit[i] for i in range(2, 100, 2)])
    other = np.mean([unit[0] @ unit[i] for i in range(1, 100, 2)])
    assert same > other + 0.5


def _features(spark, rows):
    df = spark.createDataFrame(rows, "seq_id long, label int, vec array<double>")
    return df, df.select("seq_id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))


def test_network_stops_before_the_last_round_when_it_overfits(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 1), [rng.gauss(0, 1) for _ in range(8)]) for i in range(240)]       # labels are noise
    _, train = _features(spark, rows)
    est = ML.classifiers(8, 2)["neural_network"].setLayers([8, 24, 2]).setMaxIter(400)
    model, history = ML.fit_early_stopped(est, train)
    assert 4 <= len(history) < 40 and sum(k for *_, k in history) == 1
    kept = next(n for n, _, k in history if k)
    losses = [x for _, x, _ in history]
    assert losses[kept] <= min(losses) + 1e-3 and len(history) == kept + 4
    watch = ML.hash_split(train, "seq_id", [("watch", 0.2), ("fit", 0.8)], salt="42:watch").filter("split = 'watch'")
    assert ML.log_loss(model.transform(watch)) == pytest.approx(losses[kept])           # the kept round's weights, not the last's


def test_network_learns_and_uses_all_rounds_it_needs(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [(3.0 if d == i % 3 else 0.0) + rng.gauss(0, 0.3) for d in range(4)]) for i in range(300)]
    df, train = _features(spark, rows)
    p = ML.compare_classifiers(df, eval_size=0.3, models=["neural_network"]).collect()
    assert sum(r.label == r.pred for r in p) / len(p) > 0.95
    assert ML.fit_early_stopped(ML.classifiers(4, 3)["neural_network"], train, held_out=0.0)[1] == []


def test_rbf_form_tells_rings_apart_where_a_line_cannot(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        t, r = rng.uniform(0, 2 * math.pi), (1.0 if i % 2 else 3.0) + rng.gauss(0, 0.15)
        rows.append((i, i % 2, [r * math.cos(t), r * math.sin(t)]))
    df, _ = _features(spark, rows)
    p = ML.compare_classifiers(df, eval_size=0.3, models=["svm", "svm_rbf"]).collect()
    right = {m: np.mean([r.label == r.pred for r in p if r.model == m]) for m in ("svm", "svm_rbf")}
    assert right["svm_rbf"] > 0.95 and right["svm"] < 0.8


def test_rendering_keeps_order_and_positive_residues(spark):
    t = spark.createDataFrame([(1, 2, "C", 0.9), (1, 1, "A", 0.2), (1, 3, "D", 0.5), (1, 10, "E", 0.51), (2, 1, "W", 0.1)],
                              "seq_id long, pos int, aa string, score double").repartition(3)
    assert {r.seq_id: (r.rendered, r.n_positive) for r in ML.render_positive(t).collect()} == {1: ("-C-E", 2), 2: ("-", 0)}
