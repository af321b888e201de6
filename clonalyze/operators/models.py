"""Residue models fitted by Spark, and the provider interface.

A *probability provider* turns a residue table ``(keys..., pos, aa, left, right)``
into the same table plus ``prob`` = P(residue at pos | model). Two models are
fitted from the data itself:

* ``ContextModel`` (J3): P(aa | left neighbour, right neighbour[, chain]) with
  add-one smoothing - the table analogue of masking one residue and predicting it
  from its surroundings.
* ``ProfileModel`` (J2): P(aa | group, position) with add-one smoothing, group
  being e.g. the V-gene family.

Both model tables have a size fixed by the alphabet (and the number of chains or
groups), never by the number of sequences, so they are broadcast to the residue
side: the big residue table is never shuffled for the lookup.

An external model (a protein language model) plugs in through
``ExternalProvider``: distinct sequences go through ``mapInPandas`` in Arrow
batches and come back as long probability rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.residues import ALPHABET, SKIP_CHARS
from clonalyze.session import materialize

START, END = "^", "$"
# Proven size bounds of the model tables (rows), used to justify broadcasting.
BROADCAST_ROWS = 100_000
CONTEXT_ROWS_PER_CHAIN = (len(ALPHABET) + 1) ** 2 * len(ALPHABET)


def residues(df: DataFrame, seq: str | Column = "sequence", keep: Sequence[str] = ("seq_id",),
             start: str | Column | None = None, end: str | Column | None = None, outer: bool = False) -> DataFrame:
    """H9: one row per residue in the 0-based half-open window [start, end).

    Each row carries its neighbours in the *whole* sequence (``^`` / ``$`` at the
    ends), so a context model sees the same surroundings whatever the window.
    With ``outer=True`` an empty window still gives one row (null ``pos``/``aa``),
    so a score over it comes out null instead of the sequence disappearing.
    The window is cut from the letter array before the explode (no wasted rows),
    and everything is built-in expressions (whole-stage codegen, no lambdas).
    """
    s = F.col(seq) if isinstance(seq, str) else seq
    lo = F.lit(0) if start is None else (F.col(start) if isinstance(start, str) else start)
    hi = F.length(s) if end is None else (F.col(end) if isinstance(end, str) else end)
    window = F.when(hi > lo, F.slice(F.split(s, ""), lo + 1, hi - lo)).otherwise(F.array().cast("array<string>"))
    # posexplode_outer either way: a plain posexplode makes Catalyst infer
    # size(window) > 0 and push it under the projections (deriving the window twice)
    x = df.select(*keep, F.split(s, "").alias("_a"), F.length(s).alias("_n"), lo.cast("int").alias("_lo"), window.alias("_w"))
    x = x.select(*keep, "_a", "_n", "_lo", F.posexplode_outer("_w").alias("_p", "aa"))
    if not outer:
        x = x.filter(F.col("_p").isNotNull())
    pos = (F.col("_lo") + F.col("_p")).cast("int")
    # neighbours are elements of the letter array; a substring would walk the sequence for every residue
    return x.select(
        *keep, pos.alias("pos"), "aa",
        F.when(F.col("aa").isNull(), None).when(pos > 0, F.get("_a", pos - 1)).otherwise(F.lit(START)).alias("left"),
        F.when(F.col("aa").isNull(), None).when(pos < F.col("_n") - 1, F.get("_a", pos + 1)).otherwise(F.lit(END)).alias("right"))


def scorable(res: DataFrame) -> DataFrame:
    """Skip gap / stop characters (``-`` and ``*``) when scoring."""
    return res.filter(~F.col("aa").isin(*SKIP_CHARS))


def alphabet_column() -> Column:
    return F.array(*[F.lit(a) for a in ALPHABET])


class ContextModel:
    """P(aa | left, right[, by]) = (n(l, aa, r) + 1) / (n(l, ., r) + 20)."""

    name = "context"

    def __init__(self, by: Sequence[str] = ()):
        self.by = list(by)
        self.counts: DataFrame | None = None

    def fit(self, training: DataFrame, seq: str = "sequence") -> ContextModel:
        """Count (by, left, aa, right) over every residue; partial aggregation keeps the shuffle tiny."""
        res = scorable(residues(training.filter(F.col(seq).isNotNull()), seq, keep=self.by))
        res = res.filter(F.col("aa").isin(*ALPHABET))
        # bounded by the alphabet (and the values of ``by``); kept, as every lookup starts from it
        self.counts = materialize(res.groupBy(*self.by, "left", "right", "aa").agg(F.count("*").alias("n")))
        return self

    def release(self) -> None:
        """Drop the kept counts at the end of a job."""
        self.counts.unpersist()

    def table(self) -> DataFrame:
        """Full model for every observed context: (by, left, right, aa, n, total, prob), 20 rows per context."""
        ctx = self.counts.groupBy(*self.by, "left", "right").agg(
            F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("_m"), F.sum("n").alias("total"))
        full = ctx.select(*self.by, "left", "right", "_m", "total", F.explode(alphabet_column()).alias("aa"))
        n = F.coalesce(F.element_at("_m", F.col("aa")), F.lit(0)).cast("long")
        return full.select(*self.by, "left", "right", "aa", n.alias("n"), "total",
                           ((n + 1) / (F.col("total") + len(ALPHABET))).alias("prob"))

    def lookup_table(self) -> DataFrame:
        """(by, left, right, aa, prob) for the 20 residues of every observed context.

        Built in one pass over the count table: each context's counts become a
        small map (at most 20 entries), so zero counts need no second join.
        """
        ctx = self.counts.groupBy(*self.by, "left", "right").agg(
            F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("_m"), F.sum("n").alias("_total"))
        full = ctx.select(*self.by, "left", "right", "_m", "_total", F.explode(alphabet_column()).alias("aa"))
        n = F.coalesce(F.element_at("_m", F.col("aa")), F.lit(0))
        return full.select(*self.by, "left", "right", "aa", ((n + 1) / (F.col("_total") + len(ALPHABET))).alias("_prob"))

    def matrix(self, res: DataFrame, digits: int | None = None) -> DataFrame:
        """The whole probability vector (20 residues, alphabetical) at every
        residue position: one broadcast join on the context, no pivot shuffle.

        With ``digits`` the numbers are rounded, once a context, not at every position."""
        t = self.lookup_table().groupBy(*self.by, "left", "right").agg(
            F.array_sort(F.collect_list(F.struct("aa", "_prob"))).alias("_v"))
        def shown(p: Column) -> Column:
            return p if digits is None else F.round(p, digits)

        t = t.select(*self.by, "left", "right", F.transform("_v", lambda x: shown(x["_prob"])).alias("_probs"))
        out = res.join(F.broadcast(t), [*self.by, "left", "right"], "left")
        uniform = F.array_repeat(shown(F.lit(1.0 / len(ALPHABET))), len(ALPHABET))
        return out.withColumn("probs", F.when(F.col("aa").isNotNull(), F.coalesce("_probs", uniform))).drop("_probs")

    def lookup(self, res: DataFrame, aa: str = "aa") -> DataFrame:
        """Attach prob of residue ``aa`` under the context of each row (unseen context -> 1/20).

        The lookup table is bounded by chains x 21 x 21 x 20 rows: broadcast, so
        the residue table is never shuffled for it.
        """
        t = self.lookup_table().withColumnRenamed("aa", aa)
        out = res.join(F.broadcast(t), [*self.by, "left", "right", aa], "left")
        prob = F.when(F.col(aa).isNotNull(), F.coalesce(F.col("_prob"), F.lit(1.0 / len(ALPHABET))))
        return out.withColumn("prob", prob.cast("double")).drop("_prob")


class ProfileModel:
    """P(aa | group, pos) = (n(group, pos, aa) + 1) / (n(group, pos) + 20)."""

    name = "profile"

    def __init__(self, group: str = "v_family"):
        self.group = group
        self.counts: DataFrame | None = None

    def fit(self, training: DataFrame, seq: str = "sequence") -> ProfileModel:
        res = scorable(residues(training.filter(F.col(seq).isNotNull()), seq, keep=[self.group]))
        res = res.filter(F.col("aa").isin(*ALPHABET))
        self.counts = materialize(res.groupBy(self.group, "pos", "aa").agg(F.count("*").alias("n")))
        return self

    def release(self) -> None:
        """Drop the kept counts at the end of a job."""
        self.counts.unpersist()

    def lookup(self, res: DataFrame, aa: str = "aa") -> DataFrame:
        """Attach P(aa | group, pos); an unseen (group, position) gives 1/20.

        The table has groups x positions x 20 rows (positions bounded by the
        sequence length, groups by the gene nomenclature), but nothing enforces that
        bound: it is broadcast up to ``BROADCAST_ROWS`` counted rows and joined by
        shuffle beyond. The join key is null-safe on the group.
        """
        g = self.group
        ctx = self.counts.groupBy(g, "pos").agg(F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("_m"),
                                                F.sum("n").alias("_total"))
        # by residue (1..20, 0 for any other) the probability, divided once a position of a group
        total = F.col("_total") + len(ALPHABET)
        probs = F.array(1 / total, *[(F.coalesce(F.element_at("_m", F.lit(a)), F.lit(0)) + 1) / total for a in ALPHABET])
        t = ctx.select(F.col(g).alias("_g"), F.col("pos").alias("_pos"), probs.alias("_probs"))
        if self.counts.select(g, "pos").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            t = F.broadcast(t)
        out = res.join(t, res[g].eqNullSafe(t["_g"]) & (res["pos"] == t["_pos"]), "left")
        slot = F.when(F.length(aa) == 1, F.position(F.col(aa), F.lit(ALPHABET))).otherwise(0)
        prob = F.when(F.col(aa).isNotNull(), F.coalesce(F.get("_probs", slot), F.lit(1.0 / len(ALPHABET))))
        return out.withColumn("prob", prob.cast("double")).drop("_g", "_pos", "_probs")


class ExternalProvider:
    """Wrap a per-batch probability function behind ``mapInPandas``.

    ``fn(sequences: list[str]) -> list[pandas.DataFrame]`` returns, per sequence,
    a (positions x residues) probability frame. The model is created once per
    Python worker by ``factory`` and reused for every Arrow batch; a failing
    sequence yields null probabilities and an ``error`` text, never a dropped row.
    Only distinct sequences are sent to the model.
    """

    name = "external"

    def __init__(self, factory: Callable[[], Callable[[list[str]], list[pd.DataFrame]]], name: str = "external"):
        self.factory = factory
        self.name = name

    def matrices(self, seqs: DataFrame, seq: str = "sequence") -> DataFrame:
        """Distinct sequences -> long (sequence, pos, aa, prob, error)."""
        factory = self.factory

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = factory()
            for b in batches:
                rows = []
                for s in b[seq].tolist():
                    try:
                        m = model([s])[0]
                        for pos in range(m.shape[0]):
                            for aa in ALPHABET:
                                rows.append((s, pos, aa, float(m.iloc[pos][aa]), None))
                    except Exception as e:  # U3: isolate the failure to this sequence
                        rows.append((s, None, None, None, repr(e)))
                yield pd.DataFrame(rows, columns=[seq, "pos", "aa", "prob", "error"])

        distinct = seqs.select(seq).filter(F.col(seq).isNotNull()).distinct()
        return distinct.mapInPandas(run, schema=f"{seq} string, pos int, aa string, prob double, error string")

    def lookup(self, res: DataFrame, probs: DataFrame, seq: str = "sequence", aa: str = "aa") -> DataFrame:
        p = probs.select(F.col(seq).alias("_s"), F.col("pos").alias("_p"), F.col("aa").alias("_a"), "prob")
        return res.join(p, (res[seq] == p["_s"]) & (res["pos"] == p["_p"]) & (res[aa] == p["_a"]), "left").drop("_s", "_p", "_a")


def softmax(logits: DataFrame, keys: Sequence[str], token: str = "aa", value: str = "logit") -> DataFrame:
    """exp(x - max) / sum over the tokens of each (keys) position."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return logits.withColumn("prob", e / F.sum(e).over(w))


def canonical(probs: DataFrame, token: str = "aa", renormalise: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Keep the 20 residues; by default do not re-normalise (as the scoring code does)."""
    out = probs.filter(F.col(token).isin(*ALPHABET))
    if renormalise:
        from pyspark.sql.window import Window

        out = out.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(*keys)))
    return out
