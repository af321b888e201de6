"""An external per-sequence model behind mapInPandas; failures isolated per sequence."""

import math

from pyspark.sql import functions as F

from clonalyze.functions.residues import ALPHABET
from clonalyze.operators.likelihood import pseudo_log_likelihood
from clonalyze.operators.models import ExternalProvider, residues


def test_external_provider_scores_and_isolates_failures(spark):
    # defined inside the test so the Python workers receive it by value
    def dummy_factory():
        import pandas as pd

        alphabet = ALPHABET

        def model(seqs):
            out = []
            for s in seqs:
                if "W" in s:
                    raise ValueError("model failed")
                out.append(pd.DataFrame({a: [0.5 if a == "A" else 0.5 / 19] * len(s) for a in alphabet}))
            return out
        return model

    df = spark.createDataFrame([(1, "AAC"), (2, "AWC"), (3, "AAC")], "seq_id long, sequence string")
    p = ExternalProvider(dummy_factory, "dummy")
    probs = p.matrices(df, "sequence")
    assert probs.select("sequence").distinct().count() == 2          # distinct sequences only
    res = residues(df, "sequence", keep=["seq_id", "sequence"])
    scored = p.lookup(res, probs.filter(F.col("error").isNull()), "sequence")
    errors = probs.filter(F.col("error").isNotNull()).select("sequence", "error")
    scored = scored.join(errors, "sequence", "left")
    got = {r.seq_id: r.pll for r in pseudo_log_likelihood(scored, ["seq_id"]).collect()}
    want = (2 * math.log(0.5) + math.log(0.5 / 19)) / 3
    assert math.isclose(got[1], want) and math.isclose(got[3], want)
    assert got[2] is None                                              # failed, not dropped
