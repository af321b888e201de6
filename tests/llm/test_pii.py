import random
import re

import pytest

from clonalyze.llm import pii as D

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "card" and not (16 <= len(d) <= 19 and luhn(d))) or (
                    kind == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def check(rows, texts):
    got = {r["doc_id"]: r for r in D.annotate(rows("doc_id long, text string", list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["base"] == want, repr(t)
        for k in PATTERNS:
            assert got[i][f"n_{k}"] == sum(x.startswith(k + ":") for x in want.split(","))
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    return got


def test_random_texts_equal_the_patterns(rows):
    rnd = random.Random(6)
    alphabets = ["ab@.-_ 1", "0123456789. ", "0123456789 -", "+0123456789().- ", "a@b.c1+2-3 4é🙂\n"]
    texts = ["".join(rnd.choices(rnd.choice(alphabets), k=rnd.randrange(80))) for _ in range(1500)]
    check(rows, texts)


def test_planted_spans_and_edges(rows):
    texts = [None, "", "x", "mail a.b+c@d-e.co.uk now", "a@b.c@d.e", "a@b.c_x@d.e", "@a.b", "x@y", "ip 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004 0000.0.0.0255",
             "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111111111111112", "🙂é 4111111111111111 +49 (30) 1234-5678.", "+1 2", "+12345678", "+1 (988) 555-2485 9",
             "9" * 50, "é" * 3 + "a@b.c", "v 1.2.3.4"]
    check(rows, texts)


def test_hostile_long_texts_are_linear(rows):
    check(rows, ["a" * 200_000, "1" * 100_000, "a." * 50_000 + "@" + "b." * 50_000 + "c", "1." * 60_000, "+1" * 50_000, "1 " * 60_000 + "a@b.c " * 3000])


def test_nulls_repeats_and_empty_table(rows):
    df = rows("doc_id long, text string, kind string, rid long", [(None, "a@b.c", "k", 1), (None, None, "k", 1), (3, "a@b.c", "k", 1), (3, "a@b.c", "k", 1)])
    out = D.annotate(df).collect()
    assert sorted([(r["doc_id"], r["base"]) for r in out], key=repr) == sorted([(None, "email:0:5"), (None, ""), (3, "email:0:5"), (3, "email:0:5")], key=repr)
    assert D.annotate(rows("doc_id long, text string", [])).count() == 0


def corpus():
    rnd = random.Random(2)

    def phone():
        return f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"

    texts = []
    for _ in range(400):
        texts.append(rnd.choice([
            f"please call {phone()} today", f"my phone is {phone()}, thanks", f"write to joe{rnd.randrange(99)} [at] mail.example.com soon",
            f"contact +1 {phone()} or a{rnd.randrange(99)}@x.org", "card 4111 1111 1111 1111 and ip 10.0.0.1", f"password: ab{rnd.randrange(10 ** 9)}cdefgh",
            f"see table {rnd.randrange(100, 999)}-{rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}"]))
    return texts


def test_the_method_adds_spans_beside_the_base(rows):
    texts = corpus()
    got = check(rows, texts)
    added = {i: set(r["spans"].split(",")) - set(r["base"].split(",")) for i, r in got.items()}
    calls = [i for i, t in enumerate(texts) if t.startswith(("please call", "my phone"))]
    mails = [i for i, t in enumerate(texts) if "[at]" in t]
    tables = [i for i, t in enumerate(texts) if t.startswith("see table")]
    assert sum(any(s.startswith("phone") for s in added[i]) for i in calls) > 0.9 * len(calls)
    assert sum(any(s.startswith("email") for s in added[i]) for i in mails) > 0.9 * len(mails)
    assert sum(bool(added[i] - {""}) for i in tables) < 0.1 * len(tables)


def test_reliabilities_recover_a_planted_model(spark):
    rnd = random.Random(5)
    strong = {v: q for v, q in zip(D.VOTES, (0.95, 0.9, 0.85, 0.8, 0.6), strict=True)}
    counts = {}
    for _ in range(20_000):
        y = rnd.random() < 0.6
        key = tuple((1 if y else -1) * (1 if rnd.random() < strong[v] else -1) for v in D.VOTES)
        counts[key] = counts.get(key, 0) + 1
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], ", ".join(f"{v} int" for v in D.VOTES) + ", n long")
    prior, p = D._reliabilities(df, 40)
    assert prior == pytest.approx(0.6, abs=0.08)     # the expectation pulls it towards a half
    for v in D.VOTES:
        assert p[v][1][0] == pytest.approx(strong[v], abs=0.06)
    assert list(p) == D.VOTES


def test_main_path_runs_no_python(rows):
    df = D.annotate(rows("doc_id long, text string", [(1, "a@b.c")]))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_whole_secrets_in_any_case_and_short_ibans(rows):
    long = "Ab3" * 50
    texts = [f'TOKEN = "{"9233A8EC" * 3}"', f"password: {long} end", "iban NO93 8601 1117 947 is", "plain words"] * 8
    got = {r["doc_id"]: r["spans"] for r in D.annotate(rows("doc_id long, text string", list(enumerate(texts))), at_least=0.0).collect()}
    assert got[0] == f"secret:0:{len(texts[0])}"
    assert got[1] == f"secret:0:{len('password: ') + len(long)}"
    assert "iban:5:" in got[2] and got[3] == ""
