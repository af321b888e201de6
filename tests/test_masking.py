"""md5 of residues only, shares compared as hex text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clonalyze.operators import corpus as CO


@pytest.mark.parametrize("key", [7, None])
def test_masking_hashes_residues_only(spark, key):
    ids = [0, *[5 + i % 20 for i in range(60)], 3, 2, 1, 1]
    df = spark.createDataFrame([(key, ids)], "seq_id long, ids array<int>")
    hashes = CO.token_hashes(F.col("ids"), CO.hash_key(F.col("seq_id")))
    got = df.select(CO.masked_lm(F.col("ids"), F.col("seq_id"), 0.5).alias("m"), hashes.alias("h")).first()
    masked, labels = [], []
    for i, x in enumerate(ids):
        h = hashlib.md5((f"{key}:{i}" if key is not None else str(i)).encode()).hexdigest()
        u = [int(h[8 * k:8 * k + 8], 16) / 16 ** 8 for k in range(3)]
        hit = x >= 5 and u[0] < 0.5
        labels.append(x if hit else -100)
        masked.append(x if not hit else 4 if u[1] < 0.8 else 5 + int(u[2] * 20) if u[1] < 0.9 else x)
        assert got.h[i] == (h if x >= 5 else None)
    assert list(got.m.masked_ids) == masked and list(got.m.mlm_labels) == labels
    assert df.select(CO.masked_lm(F.col("ids"), F.col("seq_id"), 1.0).alias("m")).first().m.mlm_labels[1] == 5
