"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector shared by all ordered
thresholds theta_0 < theta_1 < ... Features are the presence of hashed lower-case words and
word beginnings. The expected severity is the sum of P(grade > k) over the thresholds.

The classifier is fitted on a bounded sample of labelled rows: ``train_rows`` documents
(chosen by hash of the identifier, near copies thinned by a two-value minhash so that a
group of copies doesn't teach its incidental words) and ``features`` features, those whose
document frequencies differ most significantly between clean and toxic rows. Scoring
covers every row and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.llm.common import Memo, bounded_batches, passed_through, plain_names, staged

TRAIN_ROWS = 20_000
FEATURES = 2048
LEVELS = 3              # severity levels that a 0/1 label's positive rows are split into
STEMS = (4, 5, 6)       # lengths of word beginnings
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word: the word and its beginnings."""
    got = ["w" + word] + ["^" + word[:k] for k in STEMS if len(word) > k]
    return [xxhash.xxh32_intdigest(g, 1) >> 1 for g in got]


def doc_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class OrdinalModel:
    """Weights by hashed feature and the ordered thresholds."""

    weights: dict[int, float]
    thetas: np.ndarray

    def score(self, linear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, P(grade >= 1), most probable grade."""
        above = 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thetas[None, :], -40, 40)))
        probs = -np.diff(np.concatenate([np.ones((len(linear), 1)), above, np.zeros((len(linear), 1))], axis=1), axis=1)
        return above.sum(1), above[:, 0], probs.argmax(1)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, l2: float = 2.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood of the cumulative-link model; rows are sorted feature positions."""
    k = max(1, int(grades.max(initial=0)))
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    share = np.array([(grades <= j).mean() for j in range(k)]).clip(0.01, 0.99)
    theta0 = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(k) * 1e-3)
    # theta_j = first + sum of exp(steps): stays ordered
    par = np.concatenate([np.zeros(n_features), theta0[:1], np.log(np.diff(theta0).clip(1e-3))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    n = max(1, len(rows))
    for step in range(1, rounds + 1):
        w, first, steps = par[:n_features], par[n_features], np.exp(par[n_features + 1:].clip(-20, 20))
        theta = first + np.concatenate([[0.0], np.cumsum(steps)])
        lin = np.bincount(at, w[col], minlength=len(rows))
        cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - lin[:, None], -40, 40)))
        cum = np.concatenate([np.zeros((len(rows), 1)), cum, np.ones((len(rows), 1))], axis=1)
        hi, lo = cum[np.arange(len(rows)), grades + 1], cum[np.arange(len(rows)), grades]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p         # of log p by the upper and lower threshold
        dlin = -(dhi - dlo)
        gw = np.bincount(col, dlin[at], minlength=n_features) - l2 * w
        gt = np.bincount(grades, dhi, minlength=k + 1)[:k] - np.bincount(grades, dlo, minlength=k + 1)[1:k + 1]
        tail = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([gw, [tail[0]], tail[1:] * steps]) / n
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        par = par + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    first, steps = par[n_features], np.exp(par[n_features + 1:].clip(-20, 20))
    return par[:n_features], first + np.concatenate([[0.0], np.cumsum(steps)])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grade, feats, key = [], [], []
        for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = doc_words(t)
            hashes = [xxhash.xxh32_intdigest(w, 2) for w in words]
            key.append(f"{g} {min(hashes, default=0)} {max(hashes, default=0)}")
            feats.append(sorted({f for w in words for f in word_features(w)}))
            grade.append(g)
        yield pa.RecordBatch.from_arrays([pa.array(grade, pa.int32()), pa.array(feats, pa.list_(pa.int32())), pa.array(key)],
                                         names=["grade", "features", "sketch"])


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
        train_rows: int = TRAIN_ROWS, features: int = FEATURES, levels: int = LEVELS) -> OrdinalModel:
    """Fit on ``docs`` whose identifier has an integer grade >= 0 in ``grades``.

    Of several grades of one identifier the largest counts; null or negative grades and
    identifiers are left out. If grades are only 0 and 1, the rows of grade 1 are split into
    ``levels`` severities by how many toxic-leaning features they hold, so that thresholds are
    ordered levels. Without two different grades the model finds nothing toxic.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = (grades.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{grade_col}`").cast("int").alias("grade"))
                .filter("_id is not null and grade >= 0").groupBy("_id").agg(F.max("grade").alias("grade")))
    n = labelled.count()
    share = min(1.0, train_rows / max(1, n))
    chosen = labelled.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # about train_rows rows of two integers: a bounded broadcast
    pool = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("grade", "_text")
    rows = staged(pool.mapInArrow(_sketched, "grade int, features array<int>, sketch string"), "toxicity-rows")
    rows = staged(rows.groupBy("sketch").agg(F.min_by(F.struct("grade", "features"), F.hash("features")).alias("r")).select("r.*"), "toxicity-train")
    size = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = size.get(True, 0), size.get(False, 0)
    if not n_pos or not n_neg:
        return OrdinalModel({}, np.array([40.0]))
    toxic = (F.col("grade") > 0).cast("int")
    df = rows.select(toxic.alias("toxic"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    rate_a, rate_b = F.col("a") / F.lit(float(n_pos)), (F.col("n") - F.col("a")) / F.lit(float(n_neg))
    pooled = F.col("n") / F.lit(float(n_pos + n_neg))
    z = (rate_a - rate_b) / F.sqrt(pooled * (1 - pooled + 1e-9) * F.lit(1 / n_pos + 1 / n_neg))
    best = (df.filter("n >= 3").select("f", z.alias("z")).filter(F.abs("z") > 3).orderBy(F.abs("z").desc(), "f").limit(features).collect())
    if not best:
        return OrdinalModel({}, np.array([40.0]))
    names = np.array([r["f"] for r in best])
    lean = np.array([r["z"] for r in best])
    pos = {int(f): i for i, f in enumerate(names)}
    picked = rows.select("grade", F.array_intersect("features", F.array(*[F.lit(int(f)) for f in names])).alias("f")).collect()
    grade = np.array([r["grade"] for r in picked])
    x = [np.array([pos[f] for f in r["f"]], np.int64) for r in picked]
    if grade.max() == 1 and levels > 1:
        strength = np.array([(lean[r] > 0).sum() if len(r) else 0 for r in x])
        cuts = np.quantile(strength[grade == 1], np.arange(1, levels) / levels)
        grade = np.where(grade == 1, 1 + np.searchsorted(np.unique(cuts), strength, side="left"), 0)
    else:
        grade = np.searchsorted(np.unique(grade), grade)
    w, thetas = fit_ordinal(x, grade, len(names))
    return OrdinalModel({int(f): float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, thetas)


def score(df: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``df`` plus ``severity`` (expected grade), ``p_toxic`` (P(grade >= 1)), ``grade`` and ``toxic``.

    ``toxic`` is P(grade >= 1) >= ``reject_at``. Null and empty texts have no features and get
    the model's base rate. Repeated rows score alike; an empty table gives an empty result.
    Columns of these names are replaced, all others pass through.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)      # at most FEATURES weights
    memo: list[Memo] = []

    def linear(text: str | None) -> float:
        if not memo:
            memo.append(Memo())
        known, weights, out = memo[0], shared.value.weights, set()
        for w in doc_words(text):
            got = known.young.get(w)
            if got is None:
                got = known.get(w)
                if got is None:
                    got = tuple(f for f in word_features(w) if f in weights)
                    known.put(w, got)
            if got:
                out.update(got)
        return sum(weights[f] for f in sorted(out))

    def compute(texts: pa.Array) -> list[pa.Array]:
        severity, p, grade = shared.value.score(np.array([linear(t) for t in texts.to_pylist()], float))
        return [pa.array(severity), pa.array(p), pa.array(grade.astype(np.int32)), pa.array(p >= reject_at)]

    return passed_through(df, [text_col], compute, [("severity", "double"), ("p_toxic", "double"), ("grade", "int"), ("toxic", "boolean")])


def drop_toxic(df: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The rows of ``df`` that the model doesn't reject."""
    own, pos = plain_names(df)
    kept = score(own, model, pos[text_col], reject_at).filter(~F.col("toxic"))
    return kept.select(*[F.col(pos[c]).alias(c) for c in df.columns])
