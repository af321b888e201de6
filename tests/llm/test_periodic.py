import hashlib
import random
import zlib

import numpy as np
import pytest

from clonalyze.llm import entries
from clonalyze.llm import periodic as P


def brute(words):
    """All runs, from the definition: per period the stretches of agreeing words, smallest periods only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            if words[x] != words[x + q]:
                x += 1
                continue
            a = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            length = x + q - a
            seg = words[a:a + length]
            if length >= max(6, 4 * q) and not any(seg[r:] == seg[:-r] for r in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    return [tuple(r) for r in P.runs(P.word_numbers([w.encode() for w in words])).tolist()]


def test_random_words_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(1500):
        w = [rnd.choice("abc"[:rnd.randrange(1, 4)]) for _ in range(rnd.randrange(60))]
        if w and rnd.random() < 0.7:      # plant periods, nested ones too
            unit = w[:rnd.randrange(1, 8)]
            a = rnd.randrange(len(w))
            w = w[:a] + (unit * 12)[:rnd.randrange(50)] + w[a:]
        if rnd.random() < 0.3:
            w = w * rnd.randrange(1, 6)
        assert found(w) == brute(w), w


def test_known_words():
    assert found([]) == found(["a"]) == found(["a"] * 5) == []
    assert found(["a"] * 6) == [(0, 6, 1)]
    assert found("a b a b a b a".split()) == [] and found("a b a b a b a b".split()) == [(0, 8, 2)]
    assert found("x a b a b a b a b a y".split()) == [(1, 9, 2)]
    fib = ["a", "b"]
    while len(fib) < 200:
        fib = fib + fib[:len(fib) - (len(fib) * 3 // 8)]
    assert found(fib) == brute(fib)
    assert found(["a"] * 50_000) == [(0, 50_000, 1)]
    unit = [str(i) for i in range(5_000)]
    assert found(unit * 4) == [(0, 20_000, 5_000)]
    assert found([*unit * 4, "0", "2"]) == [(0, 20_001, 5_000)]


def test_collapsed_words():
    assert P.collapsed(11, np.array([[1, 9, 2]])).tolist() == [True] * 3 + [False] * 7 + [True]
    assert P.collapsed(3, np.zeros((0, 3), np.int64)).all()


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    rs = brute(words)
    best = min(rs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in rs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rs)
    return (doc_id, len(rs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    data = [(i, " ".join(rnd.choice(["é", "b c", "D", "x,"]) for _ in range(rnd.randrange(60)))) for i in range(400)]
    data += [(1000, None), (1001, ""), (1002, " \t\n\x0b\x0c\r"), (1003, "a\x0ba\x0ca\ra a\ta")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in entries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for i, t in data:
        assert got[i] == expected(i, t), (i, t)
    assert sum(r[1] > 0 for r in got.values()) > 20


def test_nulls_repeats_clashes_and_empty_table(rows):
    schema = "doc_id long, text string, _runs string, start int"
    same = (3, "a a a a a a a", "z", 1)
    out = P.periodic_runs(rows(schema, [(None, "a b a b a b a b", "z", 1), (None, None, None, None), same, same])).collect()
    got = sorted([(r["doc_id"], [tuple(x) for x in r["_runs"]], r["_collapsed"], r["start"]) for r in out], key=repr)
    assert got == sorted([(None, [(0, 8, 2)], "a b", 1), (None, [], "", None)] + [(3, [(0, 7, 1)], "a", 1)] * 2, key=repr)
    assert P.periodic_runs(rows(schema, [])).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_very_long_texts(rows, n):
    rnd = random.Random(n)
    words = [rnd.choice("abcdefgh") for _ in range(n)]
    words[1000:1000 + n // 2] = (words[:77] * n)[:n // 2]
    out = P.periodic_runs(rows("doc_id long, text string", [(1, " ".join(words)), (2, "w " * n)])).collect()
    got = {r["doc_id"]: [tuple(x) for x in r["_runs"]] for r in out}
    assert got[2] == [(0, n, 1)]
    assert max(got[1], key=lambda r: r[1])[2] == 77
