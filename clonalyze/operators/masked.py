"""U4: masked scoring by an external model, in packed calls and resumable parts.

A sequence of n residues has n masked variants. The variants of many sequences are packed into one model call up to
a budget of tokens, shorter ones with shorter ones, so that padding stays small. The distinct sequences are dealt into parts by
hash; a part is written before the next begins, and a run that starts again skips the parts that are finished.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.functions.residues import ALPHABET, SKIP_CHARS

#: (sequences, masked 0-based positions) -> probabilities of the 20 residues at each masked position
MaskedModel = Callable[[list[str], list[int]], np.ndarray]

_SCHEMA = "sequence string, n_pos long, pll double, error string"


def packed(lengths: list[int], budget: int) -> list[list[int]]:
    """Indexes of variants packed into calls: in order of length, longest times count within ``budget`` (one variant at least)."""
    calls: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if calls and lengths[i] * (len(calls[-1]) + 1) <= budget:
            calls[-1].append(i)
        else:
            calls.append([i])
    return calls


def _scores(model: MaskedModel, seqs: list[str], budget: int) -> list[tuple]:
    """(sequence, positions, mean log probability, error) of every sequence."""
    variants = [(n, p) for n, s in enumerate(seqs) for p, c in enumerate(s) if c not in SKIP_CHARS]
    logs: dict[int, list[float]] = {n: [] for n in range(len(seqs))}
    errors: dict[int, str] = {}

    def call(own: list[tuple[int, int]]) -> None:
        probs = model([seqs[n] for n, _ in own], [p for _, p in own])
        for (n, p), row in zip(own, probs, strict=True):
            a = ALPHABET.find(seqs[n][p])
            logs[n].append(math.log(row[a]) if a >= 0 else math.log(1 / len(ALPHABET)))

    for chosen in packed([len(seqs[n]) for n, _ in variants], budget):
        own = [variants[i] for i in chosen]
        try:
            call(own)
        except Exception:       # U3: the failure is that of a sequence; the others of the call are scored one by one
            for n in dict.fromkeys(n for n, _ in own):
                try:
                    call([v for v in own if v[0] == n])
                except Exception as e:
                    errors[n] = repr(e)
    return [(s, len(logs[n]), None, errors[n]) if n in errors else (s, len(logs[n]), sum(logs[n]) / len(logs[n]) if logs[n] else None, None)
            for n, s in enumerate(seqs)]


def _finished(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def masked_likelihood(seqs: DataFrame, factory: Callable[[], MaskedModel], out: str, seq: str = "sequence", budget: int = 4096, parts: int = 16) -> DataFrame:
    """(sequence, n_pos, pll, error) of every distinct sequence, from ``out``, a folder that all nodes share.

    ``factory`` makes the model once per Python worker. A call holds at most ``budget`` tokens (or one variant), across sequences of an
    Arrow batch. Gaps and stops aren't scored; a sequence that the model fails on has a null score and the error. Null sequences take no part. ``out`` belongs
    to one set of sequences, model and ``parts``: parts that it already holds are not computed again.
    """
    spark = seqs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield pd.DataFrame(_scores(model, b["sequence"].tolist(), budget), columns=["sequence", "n_pos", "pll", "error"]).astype({"pll": float})

    own = seqs.select(F.col(seq).alias("sequence")).filter("sequence is not null").distinct()
    paths = [f"{out.rstrip('/')}/part-{i:05d}" for i in range(parts)]
    for i, path in enumerate(paths):        # one job a part; its rows spread over all tasks
        if not _finished(spark, path):
            own.filter(F.pmod(F.xxhash64("sequence"), F.lit(parts)) == i).mapInPandas(run, _SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(_SCHEMA).parquet(*paths)
