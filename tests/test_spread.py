"""Work that has to spread: inputs of one row group, alignments in a band, models rounded once."""

import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clonalyze.operators import evolution as E
from clonalyze.operators.models import ContextModel, residues
from clonalyze.session import spread
from clonalyze.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACDEFGHIKL") for _ in range(3000)) for _ in range(3000)]
    docs = pd.DataFrame({"doc_id": range(3000), "text": texts, "lang": "en", "source": "a", "n_chars": 3000})
    pq.write_table(pa.Table.from_pandas(docs), tmp_path / "documents.parquet")
    w = fx.windows(spark, str(tmp_path))
    assert w.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert w.agg(F.sum(F.length("aa"))).first()[0] == 3000 * 3000
    few = spark.createDataFrame([(1,), (2,)], "id int")
    assert spread(few, "id") is few


def test_an_alignment_in_its_band_is_that_of_the_whole_matrix():
    rng = random.Random(2)
    pairs = []
    for n in range(1500):
        a = [rng.choice("ACD" if n % 2 else "ACDEFGHIKL") for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(b) + 1)
            b[p:p + rng.choice((0, 1, 1, 1, 2))] = [rng.choice("ACDEF") for _ in range(rng.choice((0, 1, 1, 1, 3)))]
        pairs.append(("".join(a), "".join(b)))
    got = E._aligned(pairs)
    for (a, b), (p1, p2, s) in zip(pairs, got):
        row, q1, q2, score = E._align_block([(a, b)], max(len(a), len(b)))
        assert (p1, p2, s) == (q1.tolist(), q2.tolist(), score[0]), (a, b)
    assert E._widths([("ACDEFGHIKL" * 12, "ACDEFGHIKL" * 5 + "W" + "CDEFGHIKL" + "ACDEFGHIKL" * 6)]).tolist() == [0]


def test_pairs_are_aligned_without_a_shuffle(spark):
    model = ContextModel().fit(spark.createDataFrame([("ACDEFG",), ("ACDEGG",)], "sequence string"))
    rows = [(1, "ACDEFG", "ACDEGG"), (2, "ACDEFG", "ACEFG"), (3, None, "ACD"), (3, "ACDEFG", "ACDEGG"), (None, "", "A")]
    v = E.velocity_aligned(spark.createDataFrame(rows, "k long, seq_1 string, seq_2 string"), model, ["k"])
    assert "Exchange" not in _plan(v)
    got = v.collect()
    assert sorted((r.k or 0, r.n_mismatch) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    assert len({r.velocity for r in got if r.n_mismatch}) == 1


def test_edges_of_the_germline_go_by_label_alone(spark):
    from clonalyze.plans.clonal import lineage_pairs

    nodes = spark.createDataFrame([("a", i, s) for i, s in ((1, "AC"), (2, "AD"), (3, "AE"))] + [("b", 1, "C"), ("b", None, "D")],
                                  "sample_clonotype string, label int, network_sequences string")
    edges = spark.createDataFrame([("a", 1, 2), ("a", 3, 1), ("a", 2, 3), ("b", 1, 1), ("b", None, 1)], "sample_clonotype string, i int, j int")
    assert [tuple(r) for r in lineage_pairs(nodes, edges).collect()] == [("a", 1, 2, "AC", "AD")]
    assert [tuple(r) for r in lineage_pairs(nodes, edges, reverse=True).collect()] == [("a", 2, 1, "AD", "AC")]


def test_the_matrix_is_rounded_once_a_context(spark):
    seqs = spark.createDataFrame([(1, "ACDEFG"), (2, "ACDEGG"), (3, "WCDWGG")], "seq_id long, sequence string")
    model, res = ContextModel().fit(seqs.limit(2)), residues(seqs, "sequence")
    whole = {(r.seq_id, r.pos): [round(x, 3) for x in r.probs] for r in model.matrix(res).collect()}
    assert {(r.seq_id, r.pos): r.probs for r in model.matrix(res, digits=3).collect()} == whole


def test_equal_surroundings_are_one_training_row(spark, monkeypatch):
    from clonalyze.operators import ml as ML

    rng, seen, keep = random.Random(4), [], ML.cut_lineage
    monkeypatch.setattr(ML, "cut_lineage", lambda df: seen.append(keep(df)) or seen[-1])
    rows = []
    for s in range(200):
        seq = "".join(rng.choices("AC", k=20))
        rows += [(s, i, c, int(i > 0 and seq[i - 1] == "A")) for i, c in enumerate(seq)]
    p = ML.residue_classifier(spark.createDataFrame(rows, "seq_id long, pos int, aa string, y int"), window=1)
    assert all((r.score > 0.5) == bool(r.label) and 0 <= r.score <= 1 for r in p.collect())
    assert len(seen) == 1 and seen[0].count() <= 3 * 3 * 2 * 2


def test_a_query_is_sent_to_bins_and_not_to_every_cell(spark, monkeypatch):
    import numpy as np

    from clonalyze.operators import graph as G

    x = np.random.default_rng(5).normal(size=(1500, 6))
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, vec array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    exact = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:5]}
    monkeypatch.setattr(G, "BLOCK_ROWS", 256)
    for recall, least in ((1, 1.0), (0.9, 0.85)):
        e = G.knn(df, "g", "id", "vec", 5, recall=recall, cell_rows=16)
        assert sum((r.src, r.dst) in exact for r in e.collect()) >= least * len(exact)
    twice = df.unionByName(df)
    assert {(r.src, r.dst) for r in G.knn(twice, "g", "id", "vec", 5, recall=1, cell_rows=16).collect()} == exact
    sent = [G._cells(np.eye(G.MAX_BITS, 6), x.mean(0), np.zeros(G.MAX_BITS + 1, int), np.full(G.MAX_BITS + 1, np.finfo(float).max),
                     [pa.RecordBatch.from_pydict({"grp": ["g"] * 9, "id": list(range(9)), "vec": x[:9].tolist(), "bits": [6] * 9})])]
    assert sum(b.num_rows for g in sent for b in g) == 9
