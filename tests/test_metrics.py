"""Metrics against hand values and brute force."""

import itertools
import math
import random

from clonalyze.operators import metrics as M


def _ari_brute(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    same_a = [a[i] == a[j] for i, j in pairs]
    same_b = [b[i] == b[j] for i, j in pairs]
    n11 = sum(x and y for x, y in zip(same_a, same_b))
    sa, sb, n = sum(same_a), sum(same_b), len(pairs)
    exp = sa * sb / n
    mx = (sa + sb) / 2
    return 1.0 if mx == exp else (n11 - exp) / (mx - exp)


def test_ari_matches_pair_counting(spark):
    rng = random.Random(3)
    for _ in range(4):
        a = [rng.randint(0, 3) for _ in range(30)]
        b = [rng.randint(0, 2) for _ in range(30)]
        df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
        got = M.adjusted_rand_index(df, "a", "b").first()["ari"]
        assert math.isclose(got, _ari_brute(a, b), abs_tol=1e-12)


def test_ari_identical_is_one(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (3, 9)], "a int, b int")
    assert M.adjusted_rand_index(df, "a", "b").first()["ari"] == 1.0


def test_auc_is_mann_whitney_and_ap_step(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "label int, score double")
    r = M.binary_summary(df).first()
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    mw = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(r["auc"], mw, abs_tol=1e-12)
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        rec = tp / len(pos)
        ap += (rec - prev_r) * tp / (tp + fp)
        prev_r = rec
    assert math.isclose(r["aupr"], ap, abs_tol=1e-12)


def test_running_totals_independent_of_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 200).select(F.col("id").alias("s"), (F.col("id") % 3).alias("v"), (F.col("id") % 2).alias("g"))
    got = {r.s: r.cum_v for r in M.running_totals(df, F.col("s").desc(), ["v"], ["g"]).collect()}
    for s in range(200):
        assert got[s] == sum(x % 3 for x in range(s, 200) if x % 2 == s % 2)


def test_random_fourier_features_approximate_rbf(spark):
    from clonalyze.operators.ml import random_fourier_features

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.3, 0.1]), (3, [1.0, 0.5])], "id long, vec array<double>")
    z = {r.id: r.rff for r in random_fourier_features(df, "vec", dims=3000, gamma=0.5, seed=3).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, j, d2 in [(1, 2, 0.1), (1, 3, 1.25), (2, 3, 0.65)]:
        assert abs(dot(z[i], z[j]) - math.exp(-0.5 * d2)) < 0.08
