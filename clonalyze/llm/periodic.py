"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least``
words long, that no neighbouring word extends keeping the period. The dictionary names the
factors of 1, 2, 4, ... words: a factor's name is the rank of the pair of names of its halves.
At every length, positions whose factor occurs again within twice that length propose a period,
the distance of the two; neighbouring positions with one distance are an arithmetic
progression of occurrences. A progression is extended both ways as long as words a period
apart agree, kept if it is long enough, and told apart from others by start and period.

No run is missed: inside a run of period q and at least 3q words, every factor of 2^k >= q words
occurs again at exactly q (at less, q wouldn't be the smallest period). Positions whose factor
occurs once drop out, so a text without repeats costs little more than its first names.

A text is worked on inside its row, with memory in proportion to that text; rows are never
grouped or shuffled, so groups of copies and hot keys don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clonalyze.llm.common import passed_through

LEAST = 6       # words in a run
TIMES = 4       # periods in a run


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers, from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(ids)
    at, key, width = np.arange(n), ids, 1
    found: set[tuple[int, int, int]] = set()
    # a width names the periods above half of it; nothing to find once these don't fit into the text
    while len(at) and times * (width // 2 + 1) <= n:
        order = np.argsort(key, kind="stable")
        k, p = key[order], at[order]
        same = k[1:] == k[:-1]
        found.update(_progressions(ids, p[:-1][same], np.diff(p)[same], width, least, times))
        # names of the factors that occur more than once; the others can't repeat when they grow
        again = np.append(same, False) | np.append(False, same)
        rank = np.append(0, np.cumsum(~same))
        name = np.full(n, -1)
        name[p[again]] = rank[again]
        at = np.flatnonzero(name >= 0)
        at = at[at + width < n]
        at = at[name[at + width] >= 0]
        key = name[at] * (rank[-1] + 1) + name[at + width]
        width *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _progressions(ids: np.ndarray, at: np.ndarray, gap: np.ndarray, width: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, period, length) of the runs that successors at ``gap`` words propose."""
    near = gap <= 2 * width
    at, gap = at[near], gap[near]
    if not len(at):
        return
    order = np.argsort(at)
    at, gap = at[order], gap[order]
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(gap) != 0)) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    q = gap[first]
    # words at[first] .. at[last] + width - 1 agree with those q later
    whole = at[last] - at[first] + width + q >= np.maximum(least, times * q)
    n = len(ids)
    for a, z, q in zip(at[first[whole]].tolist(), (at[last[whole]] + width).tolist(), q[whole].tolist(), strict=True):
        while a > 0 and ids[a - 1] == ids[a - 1 + q]:
            a -= 1
        while z + q < n and ids[z] == ids[z + q]:
            z += 1
        yield a, q, z + q - a


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``df`` plus ``_n_words``, ``_runs`` (array of start, length, period by start, then period) and ``_collapsed``.

    Words are maximal runs outside white space (0x20, 0x09-0x0D), numbered from 0; ``_collapsed``
    joins the words that stay by one space. ``edit(identifier, words)``, if given, replaces the
    words of a text before the search. Null and empty texts have no words, no runs and an empty
    ``_collapsed``; null and repeated identifiers and repeated rows are rows like any other; runs
    that tie in start are told apart by period; an empty table gives an empty result. All columns of ``df``
    pass through, an added name replaces one of ``df``.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def compute(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        sizes, found, left = [], [], []
        for key, raw in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
            words = (raw or b"").split()
            if edit:
                words = edit(key, words)
            got = runs(word_numbers(words), least, times)
            if len(got):
                stay = collapsed(len(words), got)
                left.append(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]))
            else:
                left.append(b" ".join(words))
            sizes.append(len(words))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in got.tolist()])
        return [pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())]

    return passed_through(df, [id_col, text_col], compute, [
        ("_n_words", "bigint"), ("_runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("_collapsed", "string")])
