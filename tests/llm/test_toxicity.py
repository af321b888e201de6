import random

import numpy as np
import pytest

from clonalyze.llm import toxicity as X

BAD = ["vile", "scum", "trash", "filth"]
GOOD = [f"word{i}" for i in range(300)]


def corpus(n, seed=0):
    """(doc_id, text, grade 0..3): the grade is how vile the text is."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        grade = rnd.choice([0, 0, 0, 1, 2, 3])
        words = rnd.choices(GOOD, k=rnd.randrange(5, 60))
        words += {0: [], 1: ["vile"], 2: ["scum", "vile"], 3: ["filth", "trash", "scum"]}[grade]
        rnd.shuffle(words)
        out.append((i, " ".join(words).capitalize() + ".", grade))
    return out


def test_fit_ordinal_has_shared_weights_and_ordered_thresholds():
    rnd = np.random.default_rng(1)
    x = [np.flatnonzero(rnd.random(4) < 0.4) for _ in range(3000)]
    linear = np.array([sum((1.0, 2.0, 0.0, -1.0)[j] for j in r) for r in x]) + rnd.logistic(size=len(x))
    grades = np.searchsorted([0.5, 2.0], linear)
    w, thetas = X.fit_ordinal(x, grades, 4, l2=0.1)
    assert np.allclose(w, [1, 2, 0, -1], atol=0.25) and np.allclose(thetas, [0.5, 2.0], atol=0.25)
    assert (np.diff(thetas) > 0).all()


def test_expected_severity_is_the_sum_over_thresholds():
    m = X.OrdinalModel({}, np.array([0.0, 1.0, 2.5]))
    severity, p, grade = m.score(np.array([-9.0, 0.5, 9.0]))
    above = 1 / (1 + np.exp(-(0.5 - m.thetas)))
    assert severity[1] == pytest.approx(above.sum()) and p[1] == pytest.approx(above[0])
    assert grade.tolist() == [0, 0, 3] and severity[0] < 0.01 and severity[2] > 2.9


def test_held_out_accuracy_and_grades(rows):
    train, test = corpus(1200, 1), [(10_000 + i, t, g) for i, t, g in corpus(300, 2)]
    df = rows("doc_id long, text string", [(i, t) for i, t, _ in train + test])
    grades = rows("doc_id long, grade int", [(i, g) for i, _, g in train])
    got = {r["doc_id"]: r for r in X.score(df, X.fit(df, grades)).collect()}
    truth = {i: g for i, _, g in test}
    assert np.mean([got[i]["toxic"] == (g > 0) for i, g in truth.items()]) > 0.98
    assert np.mean([got[i]["grade"] == g for i, g in truth.items()]) > 0.9
    mean = [np.mean([got[i]["severity"] for i, g in truth.items() if g == k]) for k in range(4)]
    assert mean == sorted(mean)


def test_binary_labels_are_split_into_levels(rows):
    data = corpus(1000, 3)
    df = rows("doc_id long, text string", [(i, t) for i, t, _ in data])
    model = X.fit(df, rows("doc_id long, grade int", [(i, int(g > 0)) for i, _, g in data]))
    assert len(model.thetas) > 1 and (np.diff(model.thetas) > 0).all()
    got = {r["doc_id"]: r for r in X.score(df, model).collect()}
    assert np.mean([got[i]["toxic"] == (g > 0) for i, _, g in data]) > 0.99
    assert np.mean([got[i]["severity"] for i, _, g in data if g == 3]) > np.mean([got[i]["severity"] for i, _, g in data if g == 1])


def test_copies_do_not_teach_their_other_words(rows):
    data = [(i, t, int(g > 0)) for i, t, g in corpus(600, 4)]
    copied = " ".join(f"rare{i}" for i in range(80)) + " vile"
    data += [(1000 + i, f"{copied} end{i % 5}", 1) for i in range(600)]
    df = rows("doc_id long, text string", [(i, t) for i, t, _ in data] + [(9999, " ".join(f"rare{i}" for i in range(0, 80, 9)) + " word1 word2")])
    got = X.score(df, X.fit(df, rows("doc_id long, grade int", [(i, g) for i, _, g in data]))).filter("doc_id = 9999").first()
    assert not got["toxic"]


def test_nulls_empties_repeats_and_names(rows):
    data = corpus(400, 5)
    df = rows("doc_id long, text string, toxic string", [(i, t, "x") for i, t, _ in data] + [(None, None, None), (401, "", "y"), (402, "vile " * 40_000, "z"), (0, "vile scum", "r")])
    grades = rows("doc_id long, grade int", [(i, g) for i, _, g in data] + [(None, 3), (7, None), (401, -1), (402, None), (3, 0), (3, 0)])
    model = X.fit(df, grades)
    out = X.score(df, model)
    assert out.columns == ["doc_id", "text", "severity", "p_toxic", "grade", "toxic"] and out.count() == 404
    got = {r["doc_id"]: r["toxic"] for r in out.filter("doc_id > 400 or doc_id is null").collect()}
    assert got == {None: False, 401: False, 402: True}
    kept = X.drop_toxic(df, model)
    assert kept.columns == df.columns and 0 < kept.count() < 404


def test_no_labels_find_nothing_toxic(rows):
    df = rows("doc_id long, text string", [(1, "vile"), (2, "fine")])
    for grades in ([], [(1, 0), (2, 0)], [(1, 2), (2, 2)]):
        assert X.score(df, X.fit(df, rows("doc_id long, grade int", grades))).filter("toxic").count() == 0
    empty = rows("doc_id long, text string", [])
    assert X.score(empty, X.fit(empty, rows("doc_id long, grade int", []))).count() == 0


def likelihood(w, thetas, x, grades, l2):
    """Penalised log-likelihood of the cumulative-link model, row by row from its definition."""
    total = -0.5 * l2 * float(w @ w)
    for r, g in zip(x, grades, strict=True):
        cum = [0.0, *(1 / (1 + np.exp(-(t - w[r].sum()))) for t in thetas), 1.0]
        total += np.log(cum[g + 1] - cum[g])
    return total


def test_fit_is_the_maximum_of_the_likelihood():
    """Coordinate search on the likelihood from its definition ends where the fit does."""
    rnd = np.random.default_rng(7)
    x = [np.flatnonzero(rnd.random(3) < 0.5) for _ in range(250)]
    grades = np.searchsorted([0.0, 1.5], np.array([r.sum() - 1.0 for r in x]) + rnd.logistic(size=len(x)))
    w, thetas = X.fit_ordinal(x, grades, 3, l2=1.0)
    best, step = np.concatenate([np.zeros(3), [-0.5, 1.0]]), 0.5
    value = likelihood(best[:3], best[3:], x, grades, 1.0)
    while step > 1e-3:
        moved = False
        for i in range(5):
            for s in (step, -step):
                new = best.copy()
                new[i] += s
                if new[3] < new[4] and (v := likelihood(new[:3], new[3:], x, grades, 1.0)) > value:
                    best, value, moved = new, v, True
        step = step if moved else step / 2
    assert np.allclose(w, best[:3], atol=0.03) and np.allclose(thetas, best[3:], atol=0.03)
    assert likelihood(w, thetas, x, grades, 1.0) == pytest.approx(value, abs=0.02)


def test_scores_equal_the_definition(rows):
    data = corpus(500, 11) + [(600, None, 0), (601, "", 0), (602, "vile " * 50_000, 1), (603, "Vile-scum é trash!", 3)]
    df = rows("doc_id long, text string", [(i, t) for i, t, _ in data])
    model = X.fit(df, rows("doc_id long, grade int", [(i, g) for i, _, g in data[:500]]))
    got = {r["doc_id"]: r for r in X.score(df, model).collect()}
    for i, t, _ in data:
        present = {f for word in X.doc_words(t) for f in X.word_features(word)}
        linear = sum(v for f, v in model.weights.items() if f in present)
        above = 1 / (1 + np.exp(-(linear - model.thetas)))
        assert got[i]["severity"] == pytest.approx(above.sum(), abs=1e-9) and got[i]["p_toxic"] == pytest.approx(above[0], abs=1e-9)
        assert got[i]["toxic"] == (above[0] >= 0.5) and got[i]["grade"] == int(np.argmax(-np.diff([1, *above, 0])))


def test_long_words_count_whole():
    a, b = "x" * 60 + "a", "x" * 60 + "b"
    assert X.word_features(a)[0] != X.word_features(b)[0] and X.word_features(a)[1:] == X.word_features(b)[1:]
