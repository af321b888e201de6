import random
import re

import numpy as np
import pytest
import xxhash

from clonalyze.llm import simhash as S


def brute_fp(t, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, tau):
    fps = [int(f) for f in fps]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    rnd = random.Random(2)
    for n in [0, 1, 2, 3, 4, 50, 400]:
        t = " ".join(rnd.choice(["Über", "a", "B", "é", "dog\n", "cat\t"]) for _ in range(n))
        assert S.fingerprint(t.encode()) == brute_fp(t)
    assert S.fingerprint(None) == 0
    t = "w x y z " * 20_000
    assert S.fingerprint(t.encode()) == brute_fp(t)


def clustered(n, seed=0):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = rnd.getrandbits(64)
        out.add(centre)
        for _ in range(rnd.choice([0, 0, 1, 5, 40])):
            for _ in range(rnd.randrange(4)):
                centre ^= 1 << rnd.randrange(64)
            out.add(centre)
    return np.array(sorted(out), np.uint64)


def test_plan_keeps_the_pigeonhole_sum():
    sample = clustered(300)
    for rows in (100, 10 ** 6, 10 ** 10):
        for tau in (0, 1, 2, 3, 4):
            parts = S.plan(sample, rows, tau)
            near = [(int(a), int(b)) for a in sample[:60] for b in sample[:60] if (int(a) ^ int(b)).bit_count() <= tau]
            assert parts and all(any(((a ^ b) & m).bit_count() <= t for m, t in parts) for a, b in near)
            seen = 0
            for m, _ in parts:
                assert seen & m == 0
                seen |= m
    # more rows than a 21-bit bucket can part ask for wider partitions with unequal thresholds
    assert sorted(t for _, t in S.plan(sample, 10 ** 11, 2)) != [0, 0, 0]


@pytest.mark.parametrize("bucket", [2048, 4])
@pytest.mark.parametrize("tau", [2, 3])
def test_components_equal_brute_force(spark, monkeypatch, bucket, tau):
    fps = clustered(250, bucket + tau)
    monkeypatch.setattr(S, "BUCKET", bucket)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in S.components(S.near_links(df, tau)).collect()}
    own = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    ref = brute_components(fps, tau)
    assert len(set(own)) == len(set(ref))
    assert len(set(zip(own, ref, strict=True))) == len(set(ref))


def test_verify_passes_large_buckets_on(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "BUCKET", 10)
    fps = np.arange(25, dtype=np.uint64)
    batch = S._batch(np.full(25, 1 << 63), np.zeros(25, np.uint64), fps)
    out = pa.Table.from_batches(list(S._verify(2, iter([batch.slice(0, 7), batch.slice(7)]))))
    assert sorted(out.column("fp").to_pylist()) == list(range(25)) and out.column("mask").null_count == 0


def brute_rows(data, shingle, tau):
    fps = [brute_fp(t, shingle) for _, t in data]
    comp = brute_components(fps, tau)
    low = {}
    for (i, _), c in zip(data, comp, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted([(i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(data, fps, comp, strict=True)], key=repr)


def test_rows_with_nulls_empties_repeats(rows):
    text = " ".join(f"word{i}" for i in range(200))
    data = [(5, text), (3, text + " tail"), (9, text.upper()), (None, text), (4, None), (2, ""), (7, " \n"), (8, "one"), (8, "one"), (1, "two words"),
            (None, "alone"), (11, "x " * 30_000)]
    df = rows("doc_id long, text string", data)
    r = S.simhash_components(df)
    assert sorted([tuple(x) for x in r.collect()], key=repr) == brute_rows(data, 3, 2)


def test_dedup_keeps_one_of_each_group_and_all_columns(rows):
    text = " ".join(f"word{i}" for i in range(300))
    df = rows("doc_id long, text string, fp string, component_id int", [(5, text, "a", 1), (3, text, "b", 2), (6, "other", "c", 3)])
    r = S.simhash_dedup(df)
    assert r.columns == df.columns
    assert [tuple(x) for x in r.orderBy("doc_id").collect()] == [(3, text, "b", 2), (6, "other", "c", 3)]


def test_dedup_with_null_and_repeated_identifiers(rows):
    text, other = (" ".join(f"{x}{i}" for i in range(300)) for x in ("word", "other"))
    data = [(5, text, "a"), (None, text, "b"), (None, "a clean text alone", "c"),       # a null identifier near an identified row
            (7, text, "d"), (7, "another clean text", "e"),                             # an identifier that repeats with another text
            (None, other, "f"), (None, other, "g"),                                     # near copies that all lack one
            (8, "the same row twice", "h"), (8, "the same row twice", "i")]
    got = sorted(r["at"] for r in S.simhash_dedup(rows("doc_id long, text string, at string", data)).collect())
    assert len(got) == 5 and {"a", "c", "e"} < set(got) and len({"f", "g"} & set(got)) == 1 and len({"h", "i"} & set(got)) == 1


def test_empty_table(rows):
    df = rows("doc_id long, text string", [])
    assert S.simhash_components(df).columns == ["doc_id", "fingerprint", "component_id"]
    assert S.simhash_components(df).count() == 0 and S.simhash_dedup(df).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in S.components(links).collect()} == {0}
