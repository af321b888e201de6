"""Residues are gathered by sequence where its letters were dealt, not shuffled one by one."""

from pyspark.sql import functions as F

from clonalyze.plans.catalog import corpus as QC
from clonalyze.sources import fixtures as fx
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_gathered_where_the_sequence_was_dealt(spark):
    plan = _plan(QC.ENTRIES["H13_H14_H16_label_arrays"][0](spark, SF001))
    assert plan.count("Exchange hashpartitioning(seq_id") == 1
    assert plan.index("ObjectHashAggregate") < plan.index("explode(sequence(1") < plan.index("Exchange hashpartitioning(seq_id")
    t = fx.token_labels(spark, SF001, together=True)
    assert t.exceptAll(fx.token_labels(spark, SF001)).isEmpty() and t.count() == fx.token_labels(spark, SF001).count()


def test_partitions_of_gathered_sequences_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fx, "TOGETHER_SEQUENCES", 8)
    t = fx.token_labels(spark, SF001, together=True)
    most = t.select("seq_id", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().agg(F.max("count")).first()[0]
    assert most <= 40
