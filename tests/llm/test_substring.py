import hashlib
import random

import numpy as np
import pytest

from clonalyze.llm import substring as D


def brute(docs, length):
    """(n_words, n_removed, sha256 of what stays) by document position, from the definition."""
    first = {}
    words = [(t or "").encode().split() for _, t in docs]
    order = [(1, 0) if i is None else (0, i) for i, _ in docs]
    for w, o in zip(words, order, strict=True):
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            first[key] = min(first.get(key, (2, 0)), o)
    out = []
    for w, o in zip(words, order, strict=True):
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < o:
                gone.update(range(s, s + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, docs, length=50, seed=10, parts=3):
    df = rows("doc_id long, text string", docs, parts)
    got = D.substring_dedup(df, length=length, seed=seed).collect()
    want = sorted([(repr(i), *r) for (i, _), r in zip(docs, brute(docs, length), strict=True)])
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    return got


def passages(rnd, n_docs, length):
    """Documents over shared passages, edited, cut and repeated, with clean ones between."""
    pool = [[f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(length // 2, 4 * length))] for _ in range(6)]
    docs = []
    for i in range(n_docs):
        w = [f"u{rnd.randrange(5000)}" for _ in range(rnd.randrange(3 * length))]
        for _ in range(rnd.randrange(4)):
            p = list(rnd.choice(pool))
            a = rnd.randrange(len(p))
            p = p[a:] if rnd.random() < 0.4 else p
            if rnd.random() < 0.5:
                p[rnd.randrange(len(p))] = "edit"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        if rnd.random() < 0.2 and docs:
            w = docs[rnd.randrange(len(docs))][1].split()
        docs.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("length,seed", [(50, 10), (8, 3), (5, 5), (4, 1)])
def test_random_passages_equal_brute_force(rows, length, seed):
    got = check(rows, passages(random.Random(length), 150, length), length, seed)
    assert sum(0 < r["n_removed"] < r["n_words"] for r in got) > 20


def test_periodic_and_few_word_texts(rows):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(60)]
    docs += [(100 + i, "a " * (40 + i)) for i in range(30)] + [(200 + i, "x y z " * (10 + i)) for i in range(20)]
    check(rows, docs, 12, 4)


def test_a_common_passage_in_many_surroundings(rows):
    rnd = random.Random(3)
    common = " ".join(f"p{i}" for i in range(70))
    docs = [(i, f"{' '.join(str(rnd.random()) for _ in range(rnd.randrange(80)))} {common} {' '.join(str(rnd.random()) for _ in range(rnd.randrange(80)))}") for i in range(300)]
    got = check(rows, docs)
    assert {r["n_removed"] for r in got} == {0, 70}
    spans = [x for r in got if r["doc_id"] for x in r["repeats"]]
    assert all(x["end"] - x["start"] <= 70 and x["src"] < 300 for x in spans)


def test_edges(rows):
    fifty = " ".join(str(i) for i in range(50))
    docs = [(1, None), (2, ""), (3, fifty), (4, fifty + " x"), (5, "x " + fifty.replace(" ", "\x0b")), (6, fifty[:-3]), (7, fifty), (8, " \t\n"), (9, fifty + " " + fifty),
            (None, fifty), (None, "a " * 60), (None, "a " * 60), (10, "b " * 60), (10, "b " * 60), (10, "b " * 61), (11, "b\n" * 59)]
    check(rows, docs)
    check(rows, docs, parts=1)


def test_all_null_identifiers_keep_everything(rows):
    docs = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "x a b c d e f g h")]
    assert {r["n_removed"] for r in check(rows, docs, 4, 2)} == {0}


def test_repeated_rows_clashing_names_and_empty_table(rows):
    schema = "doc_id long, text string, digest string, low long, id long"
    row = (3, "a b c d e f", "z", 1, 1)
    out = D.substring_dedup(rows(schema, [row, row, (4, "a b c d e f", "z", 0, 0)]), length=4, seed=2)
    assert sorted((r["doc_id"], r["n_removed"]) for r in out.collect()) == [(3, 0), (3, 0), (4, 6)]
    assert D.substring_dedup(rows(schema, [])).count() == 0


def test_text_identifiers_and_long_texts(rows):
    rnd = random.Random(5)
    words = [str(rnd.randrange(10 ** 6)) for _ in range(200_000)]
    docs = [("a", " ".join(words)), ("b", " ".join(words[50_000:150_000] + ["end"]))]
    got = {r["doc_id"]: r for r in D.substring_dedup(rows("doc_id string, text string", docs)).collect()}
    assert got["a"]["n_removed"] == 0 and got["b"]["n_removed"] == 100_000 and got["b"]["kept"] == "end"
    assert [tuple(x) for x in got["b"]["repeats"]] == [(0, 100_000, "a")]


def test_windows_of_equal_words_select_the_same_anchor():
    rnd = np.random.default_rng(2)
    for length, seed in ((50, 10), (7, 3), (6, 1)):
        h = rnd.integers(0, 6, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        g, at = D.selected(h, length, seed)
        seen = {}
        for s in range(len(at)):
            off = int(at[s]) - s
            assert 0 <= off <= length - seed
            assert seen.setdefault(tuple(h[s:s + length].tolist()), off) == off
            window = g[s:s + length - seed + 1]
            assert window[off] == window.min() and (window[off + 1:] > window[off]).all()
