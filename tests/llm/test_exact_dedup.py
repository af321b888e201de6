import hashlib
import random
import re

import pytest

from clonalyze.llm.exact_dedup import content_sort, exact_dedup, normalised_bytes


def brute(data):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    groups = {}
    for i, t in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = sorted(x for x in ids if x is not None)
        keep, sha = (known[0] if known else None), hashlib.sha256(t.encode()).hexdigest()
        order = known + [None] * (len(ids) - len(known))
        out += [(i, keep, len(ids), n == 0, sha) for n, i in enumerate(order)]
    return sorted(out, key=repr)


def got(df):
    r = content_sort(df, carry_text=False).select("doc_id", "_keep_id", "_group_size", "_kept", "_sha256").collect()
    return sorted([tuple(x) for x in r], key=repr)


def test_normalised_bytes_equals_pattern():
    rnd = random.Random(3)
    for _ in range(500):
        t = "".join(rnd.choices("ab \t\n\x0b\x0c\r\x1c é", k=rnd.randrange(12)))
        assert normalised_bytes(t.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()


def test_nulls_empties_ties_repeats(rows):
    data = [(3, "a b"), (1, "a  b"), (2, "a\tb "), (None, "a b"), (7, None), (6, ""), (8, " "), (9, "\n\n"), (5, "x"), (5, "x"),
            (None, "only null"), (None, "only null"), (4, "long " * 50_000), (10, "long\n" * 50_000)]
    assert got(rows("doc_id long, text string", data)) == brute(data)


def test_hot_text_over_many_partitions(rows):
    rnd = random.Random(1)
    data = [(i, "hot  text" if i % 2 else "hot text") if i % 3 else (i, f"t{rnd.randrange(200)}") for i in range(3000)]
    rnd.shuffle(data)
    assert got(rows("doc_id long, text string", data, 7)) == brute(data)


def test_empty_table(rows):
    assert got(rows("doc_id long, text string", [])) == []


def test_other_columns_pass_through(rows):
    df = rows("doc_id long, text string, _hash string, _kept int, text_sha256 string", [(2, "a", "h", 1, "s"), (1, " a", "g", 2, "r"), (1 << 40, "a", "f", 3, "q")])
    r = exact_dedup(df)
    assert r.columns == df.columns
    assert [tuple(x) for x in r.orderBy("doc_id").collect()] == [(1, " a", "g", 2, "r"), (2, "a", "h", 1, "s")]


@pytest.mark.parametrize("parts", [1, 5])
def test_same_result_at_any_partition_count(spark, rows, parts):
    data = [(i, f"w{i % 37}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        assert got(rows("doc_id long, text string", data, parts)) == brute(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
