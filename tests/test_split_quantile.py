import hashlib

import numpy as np

from clonalyze.operators.corpus import stratified_split
from clonalyze.plans.scoring import distribution


def test_stratified_split_takes_the_smallest_hashes_of_each_class(spark):
    data = [(i, c) for i in range(3000) for c in [None if i % 7 == 0 else "abc"[i % 3] if i % 10 else "rare" + str(i % 400)]]
    df = spark.createDataFrame(data, "id long, cls string")
    for size in (0.0, 0.13, 0.5, 1.0):
        got = {r["id"]: r["split"] for r in stratified_split(df.repartition(7), "cls", "id", size, "s").collect()}
        again = {r["id"]: r["split"] for r in stratified_split(df.repartition(2), "cls", "id", size, "s").collect()}
        assert got == again and len(got) == len(data)
        by = {}
        for i, c in data:
            by.setdefault(c, []).append((hashlib.md5(f"s:{i}".encode()).hexdigest()[:15], i))
        for ids in by.values():
            n = int(len(ids) * size + 0.5)
            assert {i for _, i in ids if got[i] == "eval"} == {i for _, i in sorted(ids)[:n]}


def test_stratified_split_keeps_repeated_keys_together(spark):
    df = spark.createDataFrame([(i // 10, "x", i) for i in range(500)], "id long, cls string, split int")
    rows = stratified_split(df, "cls", "id", 0.25).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and abs(sum(r["split"] == "eval" for r in rows) - 125) <= 10
    assert stratified_split(df.limit(0), "cls", "id").count() == 0


def test_quartiles_keep_the_stated_rank_error(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=60_000), rnd.exponential(size=40_000)])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "pll double, g int").repartition(9)
    for accuracy in (100, 10_000):
        for r in distribution(df, ["g"], quartiles=True, accuracy=accuracy).collect():
            own = np.sort(np.round(x[r["g"]::2], 6))
            for q, name in ((0.25, "q1_pll"), (0.5, "median_pll"), (0.75, "q3_pll")):
                lo, hi = np.searchsorted(own, r[name], "left"), np.searchsorted(own, r[name], "right")
                assert lo - len(own) / accuracy - 1 <= q * len(own) <= hi + len(own) / accuracy + 1
    small = spark.createDataFrame([(float(i), 0) for i in range(1, 9)], "pll double, g int")
    r = distribution(small, ["g"], quartiles=True).first()
    assert (r["q1_pll"], r["median_pll"], r["q3_pll"]) == (2.0, 4.0, 6.0)
