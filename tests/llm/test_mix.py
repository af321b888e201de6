import hashlib
import random
import re
from fractions import Fraction

import pytest

from clonalyze.llm.mix import mix, mixed


def row_hash(i, t):
    text = hashlib.md5((t or "").encode()).hexdigest()
    return int(hashlib.md5(f"{'' if i is None else i}:{text}".encode()).hexdigest()[:15], 16)


def brute(data, weights=(3, 1, 2)):
    """(doc_id, source, text) -> sorted (doc_id, size, source_size, target, copies) by sorting hashes."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), row_hash(i, t)) for i, s, t in data]
    total = {}
    for _, s, n, _ in sized:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, capped = Fraction(3, 2) * sum(total.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        level = (goal - sum(2 * total[s] for s in capped)) / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if 2 * total[s] <= w[s] * level}
        if not more:
            break
        capped |= more
    target = {s: Fraction(2 * total[s]) if s in capped else w[s] * level for s in order}
    out = []
    for s in order:
        own = [x for x in sized if x[1] == s]
        whole = target[s] // total[s] if total[s] else 0
        budget = target[s] - whole * total[s]
        before, chosen = 0, set()
        for h in sorted({x[3] for x in own}):
            n = sum(x[2] for x in own if x[3] == h)
            if before >= budget:
                break
            if before + n <= budget or before + n - budget < budget - before:
                chosen.add(h)
            before += n
        out += [(i, n, total[s], float(target[s]), int(whole + (h in chosen and budget > 0)) * n) for i, _, n, h in own]
    return sorted(out, key=repr)


def got(df):
    r = mix(df).selectExpr("doc_id", "_size", "_source_size", "_target", "_size * _copies").collect()
    return sorted([tuple(x) for x in r], key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and x[4] == y[4] and x[3] == pytest.approx(y[3])


def corpus(seed, n=300):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "a", "a", "b", "ä", None, "c"]), "w\t" * rnd.choice([0, 1, 5, 80, 900])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sorting(rows, seed):
    data = corpus(seed)
    close(got(rows("doc_id long, source string, text string", data)), brute(data))


def test_targets_are_met_within_a_document(rows):
    data = corpus(5, 800)
    r = got(rows("doc_id long, source string, text string", data))
    by = {}
    for x in r:
        t, taken = by.get((x[2], x[3]), (0, 0))
        by[x[2], x[3]] = (max(t, x[1]), taken + x[4])
        assert 0 <= x[4] <= 2 * x[1]
    for (_, target), (largest, taken) in by.items():
        assert abs(taken - target) <= largest


def test_nulls_empties_repeats(rows):
    data = [(1, None, None), (None, "s", "a b c"), (None, "s", "d"), (2, "s", ""), (3, "s", "x y"), (3, "s", "x y"), (4, "z", None), (5, None, "k " * 40_000)]
    close(got(rows("doc_id long, source string, text string", data)), brute(data))


def test_empty_table_and_no_words(rows):
    assert got(rows("doc_id long, source string, text string", [])) == []
    assert got(rows("doc_id long, source string, text string", [(1, "s", ""), (2, "t", None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixed_repeats_rows_and_keeps_columns(rows):
    data = [(i, "s" if i % 9 else "t", "a b c d", i, "x") for i in range(200)]
    df = rows("doc_id long, source string, text string, _size int, _copies string", data)
    copies = {r["doc_id"]: r["_copies"] for r in mix(df).collect()}
    out = mixed(df)
    assert out.columns == df.columns
    found = {}
    for r in out.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
        assert tuple(r) == data[r["doc_id"]]
    assert found == {k: v for k, v in copies.items() if v}
    assert max(found.values()) == 2


def test_rows_without_identifier_are_not_one_unit(rows):
    """A source of rows that share a null or repeated identifier meets its target within a document."""
    data = [(None, "s", f"a b c {i}") for i in range(400)] + [(7, "t", f"d e f {i}") for i in range(400)] + [(i, "z", "x y") for i in range(50)]
    r = got(rows("doc_id long, source string, text string", data))
    close(r, brute(data))
    for i, source_size in ((None, 1600), (7, 1600)):
        own = [x for x in r if x[0] == i and x[2] == source_size]
        assert abs(sum(x[4] for x in own) - own[0][3]) <= 4
