"""File sources, sinks and the incremental scoring stream, on files written to a scratch folder."""

import gzip
import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from clonalyze.plans.scoring import heavy_training
from clonalyze.operators.models import ContextModel
from clonalyze.schemas import CONTIG_COLUMNS
from clonalyze.sources import files as S
from clonalyze.sources import fixtures as fx
from clonalyze.sources import sinks as K
from clonalyze.streaming import score_stream as K1
from tests.conftest import SF001


def _scratch():
    return tempfile.mkdtemp(prefix="clonalyze-test-", dir="/tmp")


def _write_samples(spark, root, samples):
    c = fx.with_consensus(fx.contigs(spark, SF001)).toPandas()
    for s in samples:
        os.makedirs(f"{root}/{s}", exist_ok=True)
        c[c.sample_id == s][CONTIG_COLUMNS].to_csv(f"{root}/{s}/filtered_contig_annotations.csv", index=False)
    return c


def test_read_contigs_glob(spark):
    root = _scratch()
    c = _write_samples(spark, root, ["src0", "src1", "src2"])
    df = S.read_contigs(spark, root)
    got = sorted((r.sample_id, r.contig_id) for r in df.select("sample_id", "contig_id").collect())
    want = sorted(zip(c[c.sample_id.isin(["src0", "src1", "src2"])].sample_id, c[c.sample_id.isin(["src0", "src1", "src2"])].contig_id))
    assert got == want
    assert df.filter(F.col("d_gene").isNull()).count() > 0   # empty fields stay null


def test_sequences_corpus_jsonl_parquet_wide(spark):
    d = _scratch()
    pd.DataFrame({"sequence": ["ACD", None, "EFG"], "x": [1, 2, 3]}).to_csv(f"{d}/seqs.csv", index=False)
    assert sorted([r.sequence for r in S.read_sequences(spark, f"{d}/seqs.csv").collect()], key=str) == ["ACD", "EFG", None]
    with open(f"{d}/corpus.txt", "w") as f:
        f.write("AAA CCC  DDD\nEEE\n")
    assert sorted(r.sequence for r in S.read_corpus(spark, f"{d}/corpus.txt").collect()) == ["AAA", "CCC", "DDD", "EEE"]
    with open(f"{d}/lab.jsonl", "w") as f:
        for s, l in [("ACD", 1), ("EF", 0)]:
            f.write(json.dumps({"sequence": s, "label": l}) + "\n")
    assert S.read_labelled(spark, f"{d}/lab.jsonl").count() == 2
    pd.DataFrame({"sequence": ["AC"], "paratope_labels": [["N", "P"]]}).to_parquet(f"{d}/para.parquet")
    assert S.read_token_labels(spark, f"{d}/para.parquet").first().paratope_labels == ["N", "P"]
    wide = pd.DataFrame({"barcode": ["a", "b"], **{f"dim_{i}": [float(i), float(-i)] for i in range(12)}})
    with gzip.open(f"{d}/emb.csv.gz", "wt") as f:
        wide.to_csv(f, index=False)
    v = {r.barcode: r.vec for r in S.read_wide_embeddings(spark, f"{d}/emb.csv.gz").collect()}
    assert v["a"] == [float(i) for i in range(12)]          # dim_10 after dim_9


def test_read_oas_skips_metadata_and_header(spark):
    d = _scratch()
    header = [f"f{i}" for i in range(1, 48)]
    header[13] = "sequence_alignment_aa"
    row = [""] * 47
    row[13], row[34], row[36], row[40], row[44], row[46] = "QVQLVQ", "A" * 25, "GFTF", "ISG", "W" * 11, "ARDY"
    with gzip.open(f"{d}/unit.csv.gz", "wt") as f:
        f.write('"{""Run"": ""X""}"\n')
        f.write(",".join(header) + "\n")
        f.write(",".join(row) + "\n")
    df = S.read_oas(spark, [f"{d}/unit.csv.gz"])
    rows = df.collect()
    assert len(rows) == 1 and rows[0].sequence_alignment_aa == "QVQLVQ" and rows[0].cdr3 == "ARDY"


def _oas_unit(path, n, first):
    header = [f"f{i}" for i in range(1, 48)]
    header[13] = "sequence_alignment_aa"
    with gzip.open(path, "wt") as f:
        f.write('"{""Run"": ""X""}"\n' + ",".join(header) + "\n")
        for i in range(n):
            row = [""] * 47
            row[13], row[34], row[36], row[40], row[44], row[46] = "QVQ" + "ACDEFGHIKL"[(first + i) % 10] * (1 + i), "A" * 25, "GFTFSS", "ISGSGG", "W" * 11, "ARDYWG"
            f.write(",".join(row) + "\n")


def test_files_to_split_corpus(spark):
    """J15 from gz units to split text; ids and splits don't depend on the folder or the file layout."""
    from clonalyze.operators.corpus import build_corpus, write_corpus

    d, e = _scratch(), _scratch()
    for folder in (d, e):
        _oas_unit(f"{folder}/u1.csv.gz", 60, 0)
        _oas_unit(f"{folder}/u2.csv.gz", 40, 3)
    one = build_corpus(S.ingest_oas(spark, [f"{d}/u1.csv.gz", f"{d}/u2.csv.gz"]))
    rows = {r.seq_id: (r.sequence_alignment_aa, r.split) for r in one.collect()}
    other = build_corpus(S.ingest_oas(spark, [f"{e}/u2.csv.gz", f"{e}/u1.csv.gz"]).repartition(7))
    assert rows == {r.seq_id: (r.sequence_alignment_aa, r.split) for r in other.collect()} and len(rows) > 0
    write_corpus(one, f"{d}/corpus")
    text = spark.read.text(f"{d}/corpus")
    assert sorted((r.value, r.split) for r in text.collect()) == sorted(rows.values())


def test_equal_rows_of_a_file_have_their_own_ids(spark):
    d = _scratch()
    pd.DataFrame({"sequence": ["ACD"] * 3 + ["EFG"]}).to_csv(f"{d}/s.csv", index=False)
    ids = [r.seq_id for r in S.read_sequences(spark, f"{d}/s.csv").collect()]
    assert len(set(ids)) == 4 and set(ids) == {r.seq_id for r in S.read_sequences(spark, f"{d}/s.csv").repartition(3).collect()}


def test_probability_and_consensus_files(spark):
    d = _scratch()
    probs = spark.createDataFrame([("m", 1, 0, "A", 0.5), ("k", 1, 0, "C", 0.25)], "model string, seq_id long, pos int, aa string, prob double")
    K.write_probs(probs, probs.select("model", "seq_id", F.ln("prob").alias("pll")), f"{d}/p")
    assert spark.read.parquet(f"{d}/p/residue_probs").filter("model = 'k'").first().aa == "C"
    assert spark.read.parquet(f"{d}/p/likelihoods").count() == 2
    os.makedirs(f"{d}/c1")
    pd.DataFrame([["IGH", "IGHV1-2", "A", "B", "C", "D", "E", "F", "G"]], columns=["chain", "v_gene", "fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]).to_csv(
        f"{d}/c1/consensus_annotations.csv", index=False)
    r = S.read_consensus(spark, [f"{d}/c1/consensus_annotations.csv"]).first()
    assert r.source == "c1" and r.v_gene == "IGHV1-2" and r.seq_id is not None


def test_square_matrix_refuses_large_groups(spark):
    import pytest
    pairs = spark.createDataFrame([(str(i), "g", 0.1) for i in range(20)], "src string, dst string, velocity double")
    with pytest.raises(ValueError):
        K.square_matrix(pairs, most=10)


def test_sinks_pending_and_matrix(spark):
    d = _scratch()
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.1)], "seq_id long, model string, pll double")
    K.write(df, f"{d}/out", ["model"])
    done = spark.read.parquet(f"{d}/out")
    todo = spark.createDataFrame([(1, "a"), (3, "a")], "seq_id long, model string")
    assert [r.seq_id for r in K.pending(todo, done, ["seq_id", "model"]).collect()] == [3]
    pairs = spark.createDataFrame([("x", "germline", 0.2), ("germline", "x", -0.2)], "src string, dst string, velocity double")
    m = K.square_matrix(pairs).collect()
    assert [r.src for r in m] == ["germline", "x"] and m[1]["germline"] == 0.2 and m[0]["x"] == -0.2


def test_stream_equals_batch_and_is_incremental(spark):
    root, out, ckpt, mpath = _scratch(), _scratch() + "/out", _scratch() + "/ckpt", _scratch() + "/model"
    _write_samples(spark, root, ["src0", "src1"])
    model = ContextModel().fit(heavy_training(fx.contigs(spark, SF001)))
    K1.save_model(model, mpath)
    K1.score_stream(spark, root, out, ckpt, mpath)
    first = spark.read.parquet(out).count()
    _write_samples(spark, root, ["src2"])
    K1.score_stream(spark, root, out, ckpt, mpath)
    K1.score_stream(spark, root, out, ckpt, mpath)           # nothing new: no duplicates
    got = spark.read.parquet(out)
    batch = K1.score_batch(S.read_contigs(spark, root), K1.load_model(spark, mpath), ["full_VDJ", "cdr3_from_VDJ"])
    assert got.count() == batch.count() > first > 0
    K1.score_stream(spark, root, out, _scratch() + "/ckpt2", mpath, name="second")     # another model is not "done"
    again = spark.read.parquet(out)
    assert again.filter("model = 'second'").count() == got.filter("model = 'context'").count() == batch.count()
    got = again.filter("model = 'context'")
    a = {(r.sample_id, r.contig_id, r.mode): r.pll for r in got.collect()}
    b = {(r.sample_id, r.contig_id, r.mode): r.pll for r in batch.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a if a[k] is not None)


def test_equal_rows_of_a_file_are_numbered_across_its_splits(spark, tmp_path):
    """Ids don't depend on the splits, and no task holds all equal rows."""
    (tmp_path / "a.csv").write_text("sequence\n" + "AAAA\n" * 3000 + "".join(f"C{i}\n" for i in range(500)) + "AAAA\n" * 500 + '""\n' * 700)
    key, ids = "spark.sql.files.maxPartitionBytes", []
    old, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("2k", "64m"):
            spark.conf.set(key, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            df = S.read_sequences(spark, str(tmp_path / "a.csv"))
            rows = [(r["sequence"], r["seq_id"]) for r in df.select("sequence", "seq_id").collect()]
            assert len(rows) == 4700 == len({i for _, i in rows})
            ids.append(sorted(rows, key=repr))
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert ids[0] == ids[1]
