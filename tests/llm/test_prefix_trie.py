import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from clonalyze.llm import entries
from clonalyze.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(data):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    totals = {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(totals[x][0] for x in kids[k]) or 1
        saved = sum(totals[x][1] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        totals[k] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(rows, seqs):
    turns = [(c, t + 1, r, x) for c, s in seqs.items() for t, (r, x) in enumerate(s)]
    got = T.prefix_trie(rows("conv long, t long, role string, text string", turns), rows("conv long", [(c,) for c in seqs])).collect()
    return sorted([tuple(r[c] for c in COLUMNS) for r in got], key=repr)


@pytest.mark.parametrize("deepest", [1, 2, 3, 7, 8, 21])
def test_random_sequences_equal_brute_force(rows, deepest):
    rnd = random.Random(deepest)
    seqs = {rnd.randrange(-50, 10 ** 6): [(rnd.choice("ua"), rnd.choice(["", "é", "hi", "hi there"])) for _ in range(rnd.randrange(deepest + 1))] for _ in range(120)}
    longest = next(iter(seqs))
    seqs[longest] = (seqs[longest] + [("u", "x")] * deepest)[:deepest]
    assert trie(rows, seqs) == brute(seqs)


def test_turnless_only_single_and_empty(rows):
    assert trie(rows, {5: [], 3: []}) == brute({5: [], 3: []})
    assert trie(rows, {7: [("", "")]}) == brute({7: [("", "")]})
    assert trie(rows, {}) == []


def test_a_common_conversation(rows, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 16)      # many chunks of identifiers
    seqs = {i: [("u", "same"), ("a", "answer")] for i in range(300)} | {i: [("u", "same"), ("a", str(i))] for i in range(300, 332)} | {i: [("u", "z")] for i in range(900, 916)}
    assert trie(rows, seqs) == brute(seqs)


def test_role_and_text_do_not_run_together(rows):
    seqs = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("", "abc")], 4: [("ab", "c")]}
    assert trie(rows, seqs) == brute(seqs)


def query(spark, tmp_path, data, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = entries.op12_prefix_trie(spark, str(tmp_path)).collect()
    return sorted([tuple(r[c] for c in COLUMNS) for r in got], key=repr)


def test_query_on_nulls_ties_and_repeats(spark, tmp_path):
    rnd = random.Random(9)
    data = [(c, rnd.choice([None, 1, 2, 2, 3, 9]), rnd.choice([None, "u", "a"]), rnd.choice([None, "", "x", "y" * 5000]))
            for c in rnd.sample(range(-20, 90), 70) for _ in range(rnd.randrange(1, 15))]
    data += [(None, 1, "u", "x"), (0, None, None, None), (0, None, None, None), (12345678901, 1, "u", "x")]
    assert query(spark, tmp_path, data) == brute(rebuilt(data))


def test_query_with_clashing_names(spark, tmp_path):
    data = [(c, t, "u", f"x{t}", 1, 2, "q") for c in range(12) for t in range(9)]
    got = query(spark, tmp_path, data, "conv_id long, turn long, role string, text string, c int, t int, name string")
    assert got == brute(rebuilt([r[:4] for r in data]))


def test_query_on_an_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []
