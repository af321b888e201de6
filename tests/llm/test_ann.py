import numpy as np
import pytest
from pyspark.sql import functions as F

from clonalyze.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, dim=16, centres=20, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in (c[i % centres] + 0.4 * rng.normal(size=dim)).astype(np.float32)], 0) for i in range(n)]


def brute(data, k=5, every=50):
    ok = {}
    for i, v, _ in data:
        if i is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, np.float32).astype(float))
    ids = sorted(ok)
    out = {}
    for q in ids:
        if q % every == 0:
            rest = [i for i in ids if i != q]
            s = [float(A.cosine(ok[q][None], ok[i][None])[0]) for i in rest]
            out[q] = sorted(zip([-x for x in s], rest, strict=True))[:k]
    return out


def got(df, **options):
    out = {}
    for r in A.search(df, F.col("vec_id") % 50 == 0, **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def exact(found, ref):
    assert found.keys() == {q for q in ref if ref[q]}
    for q, want in ref.items():
        if want:
            assert [(x[0], x[1]) for x in found[q]] == [(n + 1, i) for n, (_, i) in enumerate(want)], q
            assert [x[2] for x in found[q]] == pytest.approx([-s for s, _ in want], abs=1e-12)


def test_recall_with_many_leaves(rows, monkeypatch):
    monkeypatch.setattr(A, "LEAF_ROWS", 40)
    monkeypatch.setattr(A, "BLOCK", 64)
    data = vectors(3000, centres=60)
    found, ref = got(rows(SCHEMA, data)), brute(data)
    hit = sum(len({x[1] for x in found[q]} & {i for _, i in ref[q]}) for q in ref)
    assert hit / sum(map(len, ref.values())) >= 0.9
    assert all(x[2] == pytest.approx(float(A.cosine(np.array(data[q][1])[None], np.array(data[x[1]][1])[None])[0]), abs=1e-12) for q in found for x in found[q])


def test_small_tables_are_exact_with_ties_nulls_and_broken_vectors(rows):
    data = vectors(300, seed=3)
    data += [(1000, data[0][1], 1), (1001, data[0][1], 1), (1002, [2 * x for x in data[0][1]], 1), (1050, data[0][1], 1), (1050, data[0][1], 1)]
    data += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] + [1.0] * 15, 0), (2150, [None] + [1.0] * 15, 0),
             (2200, [float("inf")] * 16, 0), (2250, [], 0), (None, data[5][1], 0)]
    exact(got(rows(SCHEMA, data)), brute(data))


def test_hot_vector_is_one_entry(rows):
    same = [1.0, 2.0, 3.0, 4.0]
    data = [(i, same if i % 3 else [float(i), 1.0, 0.5, float(i % 7)], 0) for i in range(1500)]
    exact(got(rows(SCHEMA, data, 6)), brute(data))


def test_few_rows_and_empty_table(rows):
    assert got(rows(SCHEMA, [])) == {}
    assert got(rows(SCHEMA, [(0, [1.0, 0.0], 0)])) == {}
    exact(got(rows(SCHEMA, [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (50, [0.0, 1.0], 0)])), brute([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (50, [0.0, 1.0], 0)]))


def test_best_bin_first_visits_every_leaf_once_and_nearest_first():
    x = A.unit(np.random.default_rng(1).normal(size=(2000, 8)))
    tree = A.fit_tree(x, 50)
    assert tree.leaves > 20
    own = tree.leaf_of(x[:200])
    orders = [tree.leaf_order(u, tree.leaves) for u in x[:200]]
    assert all(sorted(o) == list(range(tree.leaves)) for o in orders)
    assert [o[0] for o in orders] == own.tolist()


def test_extreme_magnitudes():
    a = np.array([[1e-30, 2e-30], [1e30, 2e30]])
    assert A.cosine(a[0], a[1]) == pytest.approx(1) and np.allclose(A.unit(a)[0], A.unit(a)[1])
