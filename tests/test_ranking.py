"""Distributed ranking against brute force, with a key holding a third of the rows."""

import random

from pyspark.sql import functions as F

from clonalyze.operators.dedupe import factorize, head_per, keep_first, rank_within


def _rows(n=6000, seed=4):
    rng = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", rng.randint(0, 50)) for i in range(n)]


def test_rank_within_matches_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, key string, v int").repartition(7)
    got = {r.id: r._rank for r in rank_within(df, "key", ["v", "id"]).collect()}
    assert len(got) == len(rows)                      # nothing lost
    by = {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by.setdefault(k, []).append(i)
    for k, ids in by.items():
        for rank, i in enumerate(ids, 1):
            assert got[i] == rank


def test_head_per_keep_first_factorize(spark):
    rows = _rows(3000, 9)
    df = spark.createDataFrame(rows, "id long, key string, v int")
    heads = {(r.key, r.id) for r in head_per(df, "key", 3, "id").collect()}
    want = set()
    for k in {r[1] for r in rows}:
        want |= {(k, i) for i in sorted(i for i, kk, _ in rows if kk == k)[:3]}
    assert heads == want
    firsts = {r.key: r.id for r in keep_first(df, ["key"], "v").collect()}
    for k in firsts:
        best = min((v, i) for i, kk, v in rows if kk == k)
        assert [v for i, kk, v in rows if i == firsts[k]][0] == best[0]
    codes = {r.key: r.key_code for r in factorize(df, "key", "id").select("key", "key_code").distinct().collect()}
    order = sorted({r[1] for r in rows}, key=lambda k: min(i for i, kk, _ in rows if kk == k))
    assert [codes[k] for k in order] == list(range(len(order)))
