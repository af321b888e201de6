import glob
import math
import os
import shutil

import pytest

from clonalyze.functions.residues import ALPHABET
from clonalyze.operators import masked as U


def model_factory(log, fail="!"):
    def factory():
        import os

        import numpy as np

        def model(seqs, positions):
            if any(fail in s for s in seqs):
                raise ValueError("model failed")
            with open(os.path.join(log, f"{os.getpid()}"), "a") as f:
                f.write(f"{len(seqs)} {max(map(len, seqs))}\n")
            out = np.full((len(seqs), 20), 0.5 / 19)
            out[:, 0] = 0.5
            return out
        return model
    return factory


def calls(log):
    return [tuple(map(int, line.split())) for f in glob.glob(f"{log}/*") for line in open(f)]


def want(s):
    own = [math.log(0.5 if c == "A" else 0.5 / 19 if c in ALPHABET else 0.05) for c in s if c not in "-*"]
    return sum(own) / len(own) if own else None


def test_packing_keeps_the_budget():
    lengths = [5, 100, 7, 7, 300, 5, 6] * 9
    got = U.packed(lengths, 60)
    assert sorted(i for c in got for i in c) == list(range(len(lengths)))
    assert all(len(c) == 1 or max(lengths[i] for i in c) * len(c) <= 60 for c in got)
    assert len(got) < len(lengths) / 2


def test_packed_calls_failures_and_resume(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    os.mkdir(log)
    seqs = ["AAC" * (1 + i % 5) + "DEFG"[i % 4] for i in range(40)] + ["A-C*", "AXA", "", "A!C", None, "AAC"]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string").coalesce(2)
    got = {r["sequence"]: r for r in U.masked_likelihood(df, model_factory(log), out, budget=200, parts=3).collect()}
    assert set(got) == set(seqs) - {None}
    for s, r in got.items():
        if "!" in s:
            assert r["pll"] is None and "model failed" in r["error"]
        else:
            assert r["error"] is None and (r["pll"] is None if want(s) is None else r["pll"] == pytest.approx(want(s)))
    done = calls(log)
    variants = sum(sum(c not in "-*" for c in s) for s in got if "!" not in s)
    assert sum(n for n, _ in done) == variants and len(done) < variants / 4 and all(n * m <= 200 for n, m in done if n > 1)
    # a run that was killed in its second part: only what is missing is computed again
    shutil.rmtree(f"{out}/part-00001")
    shutil.rmtree(f"{out}/part-00002")
    os.mkdir(f"{out}/part-00001")
    again = {r["sequence"]: r["pll"] for r in U.masked_likelihood(df, model_factory(log), out, budget=200, parts=3).collect()}
    assert again == {s: r["pll"] for s, r in got.items()}
    assert 0 < len(calls(log)) - len(done) <= len(done)
    before = len(calls(log))
    U.masked_likelihood(df, model_factory(log), out, budget=200, parts=3).count()
    assert len(calls(log)) == before
