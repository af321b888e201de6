"""Session helpers and sink semantics."""

import os
import tempfile

from clonalyze.session import ensure_checkpoint_dir, size_for_input
from clonalyze.sources import sinks as K


def test_checkpoint_dir_is_set_and_kept(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and ensure_checkpoint_dir(spark) == d


def test_size_for_input_keeps_explicit_setting(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert size_for_input(spark, 10 ** 15) == int(before)          # tests set 8 explicitly
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_dynamic_partition_overwrite(spark):
    out = tempfile.mkdtemp(prefix="clonalyze-sink-", dir="/tmp") + "/scores"
    a = spark.createDataFrame([(1, "m1", 0.1), (2, "m2", 0.2)], "seq_id long, model string, pll double")
    K.write(a, out, ["model"])
    b = spark.createDataFrame([(3, "m2", 0.3)], "seq_id long, model string, pll double")
    K.write(b, out, ["model"])                                      # replaces model=m2 only
    got = sorted((r.model, r.seq_id) for r in spark.read.parquet(out).collect())
    assert got == [("m1", 1), ("m2", 3)]
    assert sorted(p for p in os.listdir(out) if p.startswith("model=")) == ["model=m1", "model=m2"]
