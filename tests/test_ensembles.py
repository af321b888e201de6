"""models' vectors and probabilities of the same rows, without a table a model."""

from pyspark.sql import functions as F

from clonalyze.operators import embed as E
from clonalyze.plans.catalog.vectors import ENTRIES
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vector_columns_give_the_means_of_vector_tables(spark):
    rows = [(1, [1.0, 2.0], [3.0, 6.0]), (2, [1.0, 0.0], None), (3, None, None), (None, [2.0, 2.0], [0.0, 1.0]), (1, [5.0, 1.0], [3.0, 3.0])]
    df = spark.createDataFrame(rows, "seq_id long, a array<double>, b array<double>")
    one = {r.seq_id: r.vec for r in E.ensemble_vectors(df, ["seq_id"], ["a", "b"], dims=2).collect()}
    tables = [df.select("seq_id", F.col(c).alias("vec")) for c in ("a", "b")]
    many = {r.seq_id: r.vec for r in E.ensemble_vectors([t.filter("vec is not null") for t in tables], ["seq_id"]).collect()}
    assert one == {1: [3.0, 3.0], 2: [1.0, 0.0], 3: None, None: [1.0, 1.5]}
    assert {k: [round(x, 12) for x in v] for k, v in many.items()} == {k: v for k, v in one.items() if v}


def test_the_ensemble_of_vectors_reads_the_contigs_once(spark):
    plan = _plan(ENTRIES["E19_ensemble_vectors"][0](spark, SF001))
    assert plan.count("posexplode(regexp_extract_all") == 1 and plan.count("Exchange hashpartitioning(seq_id") == 1
    assert "Union" not in plan and "ObjectHashAggregate" not in plan


def test_neighbours_are_read_from_the_letter_array(spark):
    from clonalyze.operators.models import residues

    df = spark.createDataFrame([(1, "ACD", 1, 3), (2, "", 0, 0), (3, None, 0, 1), (4, "W", 0, 1), (5, "A\U0001d538C", 0, 3)], "seq_id long, s string, lo int, hi int")
    res = residues(df, "s", start="lo", end="hi", outer=True)
    assert "substring" not in _plan(res)
    got = sorted((r.seq_id, r.pos if r.pos is not None else -1, r.aa, r.left, r.right) for r in res.collect())
    assert got == [(1, 1, "C", "A", "D"), (1, 2, "D", "C", "$"), (2, -1, None, None, None), (3, -1, None, None, None), (4, 0, "W", "^", "$"),
                   (5, 0, "A", "^", "\U0001d538"), (5, 1, "\U0001d538", "A", "C"), (5, 2, "C", "\U0001d538", "$")]


def test_a_profile_holds_probabilities_by_residue(spark):
    from clonalyze.operators.models import ProfileModel, residues

    train = spark.createDataFrame([("f", "AC"), ("f", "AD"), (None, "W")], "v_family string, sequence string")
    model = ProfileModel("v_family").fit(train)
    rows = [("f", 0, "A"), ("f", 0, "-"), ("f", 1, "C"), ("f", 9, "A"), (None, 0, "W"), ("f", 0, None), ("f", 0, ""), ("f", 0, "AC")]
    out = model.lookup(spark.createDataFrame(rows, "v_family string, pos int, aa string"))
    assert "_m#" not in _plan(out).split("BroadcastExchange")[0]
    got = {(r.v_family, r.pos, r.aa): r.prob for r in out.collect()}
    want = [3 / 22, 1 / 22, 2 / 22, 1 / 20, 2 / 21, None, 1 / 22, 1 / 22]
    assert got == dict(zip(rows, want))
    assert residues(train, "sequence", keep=["v_family"]).count() == 5


def test_the_ensemble_of_probabilities_derives_the_chains_once(spark):
    plan = _plan(ENTRIES["E19_ensemble_probs"][0](spark, SF001))
    assert "regexp_extract_all" not in plan
