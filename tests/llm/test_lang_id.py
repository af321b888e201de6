import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonalyze.llm import lang_id as G

WORDS = {
    "en": "the and that with have this from they will would there their what about which when make like time just know people".split(),
    "de": "und der die nicht das ist mit sich auch werden haben eine einer durch über können müssen schön straße zwischen weiß".split(),
    "fr": "les des une est pour dans que qui avec sur être avoir été très où même français leçon après déjà forêt cœur".split(),
}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        out.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randrange(1, 40))).capitalize() + ".", lang))
    return out


def counts(words_by_lang, order):
    out = {}
    for lang, words in words_by_lang.items():
        for w in words:
            p = G._START * (order - 1) + w + G._END
            for i in range(len(p) - order + 1):
                out[lang, p[i:i + order]] = out.get((lang, p[i:i + order]), 0) + 1
    return [(lg, g, n) for (lg, g), n in out.items()]


@pytest.mark.parametrize("order", [2, 4])
def test_probabilities_sum_to_one_in_every_context(order):
    got = counts(WORDS, order)
    m = G.build(got, order)
    for i, lang in enumerate(m.langs):
        letters = sorted({g[-1] for lg, g, _ in got if lg == lang})
        contexts = sorted({g[:-1] for lg, g, _ in got})[:40] + ["\x02" * (order - 1), "q" * (order - 1)]
        for c in contexts:
            codes = np.array([[ord(x) for x in c + ch] for ch in [*letters, "☃"]], np.uint64)
            assert np.exp(m.log_probs(codes)[:, i]).sum() == pytest.approx(1, abs=1e-5)


def test_kneser_ney_against_a_direct_bigram_computation():
    got = counts(WORDS, 2)
    m = G.build(got, 2)
    for i, lang in enumerate(m.langs):
        own = {g: n for lg, g, n in got if lg == lang}
        follow = {}
        for g in own:
            follow.setdefault(g[1], set()).add(g[0])
        uni = {c: len(s) for c, s in follow.items()}
        v = len(uni) + 1

        def discount(ns):
            one, two = sum(n == 1 for n in ns), sum(n == 2 for n in ns)
            return min(0.95, max(0.1, one / max(1, one + 2 * two)))

        d1, d2 = discount(list(uni.values())), discount(list(own.values()))
        total = sum(uni.values())
        for g in list(own)[:50] + ["zz"]:
            p1 = max(uni.get(g[1], 0) - d1, 0) / total + d1 * len(uni) / total / v
            ctx = sum(n for h, n in own.items() if h[0] == g[0])
            kinds = sum(h[0] == g[0] for h in own)
            p2 = max(own.get(g, 0) - d2, 0) / ctx + d2 * kinds / ctx * p1 if ctx else p1
            assert m.log_probs(np.array([[ord(g[0]), ord(g[1])]], np.uint64))[0, i] == pytest.approx(np.log(p2), abs=1e-5)


def test_words():
    assert G.words_of("Straße, été 12a_b ÀÉ!") == ["straße", "été", "a", "b", "àé"]
    assert G.words_of("日本 語² x½ ªº") == ["日本", "語", "x", "ªº"]
    assert G.words_of("123 +-") == []


def test_held_out_accuracy_nulls_and_names(rows):
    data = corpus(900, 1)
    extra = [(None, None, None), (9001, "", "en"), (9002, "12 34 !", "en"), (9003, None, "en"), (9004, (" ".join(WORDS["de"]) + " ") * 3000, None), (0, "the", "en"), (9005, "日本語", None)]
    df = rows("doc_id long, text string, lang string, score string", [(*d, "s") for d in data + extra])
    models = G.train(df.filter(~G.held_out(F.col("doc_id"))))
    out = G.predict(df, models)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "rejected"] and out.count() == len(data) + len(extra)
    held = out.filter(G.held_out(F.col("doc_id"))).filter("lang is not null and text rlike '[a-z]'").collect()
    assert len(held) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)
    special = {r["doc_id"]: r for r in out.filter("doc_id is null or doc_id > 9000").collect()}
    assert [special[i]["lang_pred"] for i in (None, 9001, 9002, 9003)] == ["und"] * 4 and special[9004]["lang_pred"] == "de"
    assert special[9001]["score"] == 0 and special[9005]["rejected"] and not special[9004]["rejected"]


def test_order_of_rows_and_other_columns_do_not_matter(rows):
    data = corpus(300, 2)
    a = G.train(rows("doc_id long, text string, lang string", data, 2))
    b = G.train(rows("doc_id long, text string, lang string", data[::-1], 5))
    assert all(np.array_equal(x[0], y[0]) and np.allclose(x[1], y[1]) for x, y in zip(a.grams, b.grams, strict=True))


def test_every_ngram_is_kept_and_shards_equal_the_direct_build(spark, monkeypatch):
    rnd = random.Random(3)
    words = {"en": WORDS["en"], "xx": ["".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(9)) for _ in range(23_000)]}     # over 200,000 4-grams
    got = counts(words, 4)
    ref = G.build(got, 4)
    at = list(range(0, len(got), 97))
    codes = np.array([[ord(x) for x in got[i][1]] for i in at] + [[ord(x) for x in "the☃"], [ord(x) for x in "\x02\x02qx"]], np.uint64)
    grams = spark.createDataFrame([(lg, g, n) for lg, g, n in got], "lang string, gram string, n long").repartition(4)
    m = G.build_shards(grams, 4)
    assert len(m.grams[3][0]) == len({g for _, g, _ in got}) > 200_000
    assert np.allclose(m.log_probs(codes), ref.log_probs(codes), atol=1e-4)
    monkeypatch.setattr(G, "CACHE_BYTES", 1 << 16)      # nothing fits: by row group
    for x in m.grams + m.contexts:
        x._forget()
    assert np.allclose(m.log_probs(codes), ref.log_probs(codes), atol=1e-4) and m.grams[3].whole is None


def test_training_keeps_more_than_200_000_ngrams(rows):
    rnd = random.Random(5)
    data = [(i, " ".join("".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(9)) for _ in range(250)), "xx") for i in range(100)]
    m = G.train(rows("doc_id long, text string, lang string", data))
    assert len(m.grams[3][0]) > 200_000


def test_without_training_rows(rows):
    df = rows("doc_id long, text string, lang string", [(1, "hello", None), (2, None, "en")])
    assert G.train(df) is None
    assert [r["lang_pred"] for r in G.predict(df, None).collect()] == ["und", "und"]
    assert G.predict(rows("doc_id long, text string, lang string", []), None).count() == 0


def test_memo_overflow_gives_the_same_scores(monkeypatch):
    m = G.build(counts(WORDS, 4), 4)

    class Shared:
        value = m

    texts = [" ".join(w) for w in WORDS.values()] * 3
    full = G._Scorer(Shared).entropies(texts)[0]
    monkeypatch.setattr(G, "_MEMO", 1 << 17)
    s = G._Scorer(Shared)
    s.known.update({f"x{i}": 0 for i in range((1 << 17) - 10)})
    assert np.allclose(s.entropies(texts)[0], full)


def test_every_language_is_learned_however_rare(rows):
    data = [(i, "the quick brown fox jumps over it", "en") for i in range(300)]
    data += [(1000 + i, "".join(chr(0x400 + 16 * i + j) for j in range(16)), f"r{i}") for i in range(25)]       # one row each
    data += [(None, "same text of one language", "same")] * 40      # all hashed alike
    m = G.train(rows("doc_id long, text string, lang string", data))
    assert set(m.langs) == {x[2] for x in data}


def test_long_texts_are_not_cut_inside_words(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(G, "_CHUNK", 10)
    text = "abcdefgh ijklmnopqrstuvwxyz abc def " * 3
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text])], names=["lang", "text"])
    cut = {g: n for b in G._count_grams(4)(iter([batch])) for g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)}
    monkeypatch.setattr(G, "_CHUNK", 1 << 20)
    whole = {g: n for b in G._count_grams(4)(iter([batch])) for g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)}
    assert cut == whole


def test_every_row_is_counted_and_calibrates(rows, monkeypatch):
    words = {"a": ["alpha", "beta", "gamma"], "b": ["uno", "dos", "tres"]}
    data = [(i, " ".join(words["ab"[i % 2]][(i // 7 + j) % 3] + "xyz"[(i >> j) % 3] for j in range(9)), "ab"[i % 2]) for i in range(400)]
    counted, judged, build, fit = [], [], G.build_shards, G.calibrate
    monkeypatch.setattr(G, "build_shards", lambda grams, order: counted.append(grams) or build(grams, order))
    monkeypatch.setattr(G, "calibrate", lambda models, parts: judged.append(parts) or fit(models, parts))
    m = G.train(rows("doc_id long, text string, lang string", data))
    letters = sum(len(w) + 1 for _, t, _ in data for w in t.split())
    assert counted[0].agg({"n": "sum"}).first()[0] == letters
    assert sum(r["n"] for part in judged[0] for r in part) == len(data)
    assert all(x > 0 for x in m.limits) and max(m.limits) < 10


def test_a_worker_counts_a_bounded_number_of_words_whatever_the_languages(monkeypatch):
    import pyarrow as pa
    langs = [f"l{i}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array([" ".join(chr(97 + i % 26) + chr(97 + j) for j in range(20)) for i in range(40)])], names=["lang", "text"])

    def total():
        out = {}
        for b in G._count_grams(3)(iter([batch])):
            for lang, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[lang, g] = out.get((lang, g), 0) + n
        return out

    held, seen = [], G._windows
    monkeypatch.setattr(G, "_windows", lambda words, order: held.append(len(words)) or seen(words, order))
    whole = total()
    assert held == [20] * 40        # one a language, at the end
    held.clear()
    monkeypatch.setattr(G, "_COUNTED", 50)
    assert total() == whole and sum(held) == 800

    def batches():
        yield batch
        raise AssertionError("everything was read before the first n-grams were handed on")

    assert next(G._count_grams(3)(batches())).num_rows


def test_calibration_is_one_python_stage(rows, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    data = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "ab"[i % 2]) for i in range(40)]
    df = rows("doc_id long, text string, lang string", data).select("lang", "text")
    m = G.build(counts({"a": ["uno", "dos"], "b": ["alpha", "beta"]}, 3), 3)
    calls, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    got = {r["lang"]: r for r in G._fit_sums(df, m)}
    assert len(calls) == 1 and got["a"]["n"] == got["b"]["n"] == 20
