"""The stand-in views use every residue of every document, at all scales; null keys keep their rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from clonalyze.functions.regions import REGIONS
from clonalyze.operators import dedupe as D
from clonalyze.operators import joins as J
from clonalyze.operators import metrics as M
from clonalyze.operators import ml as ML
from clonalyze.operators.aggregates import histogram
from clonalyze.sources import fixtures as fx


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_letters_of_the_view_equal_the_documents(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    got = {r.d: r.n for r in fx.contigs(spark, folder).groupBy(fx.document_of("seq_id").alias("d"))
           .agg(F.sum(F.length(F.concat_ws("", *REGIONS))).alias("n")).collect()}
    want = dict(duckdb.sql(f"""SELECT doc_id, n FROM (SELECT doc_id, length(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g')) AS n
      FROM '{folder}/documents.parquet') WHERE n > 0""").fetchall())
    assert got == want


def test_windows_join_to_the_residues(spark):
    folder = "/root/testdata/sf0.001"
    rows = {}
    for r in fx.contigs(spark, folder).select("seq_id", F.concat_ws("", *REGIONS).alias("s")).collect():
        rows.setdefault(r.seq_id // fx.WINDOW_IDS, []).append((r.seq_id, r.s))
    text = dict(duckdb.sql(f"SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') FROM '{folder}/documents.parquet'").fetchall())
    assert {d: "".join(s for _, s in sorted(x)) for d, x in rows.items()} == {d: t for d, t in text.items() if t}


NULLABLE = [(i, c) for i, c in enumerate(["a", None, None, "b", "a", None, "a"])]


def test_null_classes_are_ranked_and_kept(spark):
    df = spark.createDataFrame(NULLABLE, "seq_id long, cls string")
    want = {(0, "a"), (4, "a"), (1, None), (2, None), (3, "b")}
    assert {tuple(r) for r in D.head_per(df, "cls", 2).collect()} == want
    assert {tuple(r)[:2] for r in D.rank_within(df, "cls", "seq_id").filter("_rank <= 2").collect()} == want
    assert {tuple(r) for r in D.undersample(df, "cls").collect()} == {(0, "a"), (1, None), (3, "b")}
    assert sorted(r["count"] for r in ML.oversample(df, "cls", "seq_id").groupBy("cls").count().collect()) == [3, 3, 3]
    totals = M.running_totals(df.withColumn("one", F.lit(1)), F.col("seq_id"), ["one"], ["cls"])
    assert {(r.cls, r.cum_one) for r in totals.collect()} == {("a", 1), ("a", 2), ("a", 3), (None, 1), (None, 2), (None, 3), ("b", 1)}
    assert {tuple(r) for r in D.keep_first(df, "cls").collect()} == {(0, "a"), (1, None), (3, "b")}


def test_null_keys_match(spark):
    obs = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "seq_id long, k string")
    meta = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v long")
    assert {(r.seq_id, r.v) for r in J.enrich(obs, meta, ["k"]).collect()} == {(1, 10), (2, 20), (3, None)}
    assert {(r.seq_id, r.v) for r in J.attach_germline(meta, obs, ["k"], "left").collect()} == {(1, 10), (2, 20)}
    rep = spark.createDataFrame([("s", None, 5)], "sample_id string, barcode string, seq_id long")
    emb = spark.createDataFrame([("s", None, 7)], "sample_id string, barcode string, seq_id long")
    assert [(r.seq_id_x, r.seq_id_y) for r in J.attach_repertoire(emb, rep).collect()] == [(7, 5)]


def test_bins_of_a_tenth(spark):
    df = spark.createDataFrame([("m", x) for x in (0.3, 0.6, 0.7, 0.05, 1.0, -0.1)], "model string, x double")
    got = {r.bin: r.bin_start for r in histogram(df, "x", 0.1).collect()}
    assert got == {3: 0.3, 6: 0.6, 7: 0.7, 0: 0.0, 10: 1.0, -1: -0.1}
