"""Residue models as arrays: a sequence is scored inside its row, without exploding it.

A context model has a number for every (left, residue, right), so many as its alphabet allows; that table goes into the
plan as one constant array, and a lookup is an index. A profile model has an array per group, joined to the
sequences by group. Scores of windows are sums over slices of one array of log probabilities a sequence; only
positions whose surroundings differ in a window (its ends) are looked up anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.functions.residues import ALPHABET, SKIP_CHARS
from clonalyze.operators.models import BROADCAST_ROWS, END, START, ContextModel, ProfileModel

UNSEEN = 1.0 / len(ALPHABET)
LOG_UNSEEN = float(np.log(UNSEEN))
_WIDTH = len(ALPHABET) + 1      # residues, and all others
SYMBOLS = ALPHABET + SKIP_CHARS
_SLOTS = len(SYMBOLS) + 1


def letters(seq: Column) -> Column:
    """The characters of a sequence (null: null)."""
    return F.when(seq.isNotNull(), F.filter(F.split(seq, ""), lambda c: c != ""))


class ContextArray:
    """P(residue | left, right[, by]) of a fitted ``ContextModel``, or any other number by context, as arrays."""

    def __init__(self, rows: list[tuple], by: str | None = None, unseen: float = UNSEEN):
        """``rows``: (by value or None, left, right, residue, value); bounded by the alphabet and the values of ``by``."""
        self.by = by
        self.symbols = "".join(sorted({x for r in rows for x in r[1:3]} - {START, END}))
        self.size = len(self.symbols) + 3
        tables: dict = {}
        for b, left, right, aa, value in rows:
            t = tables.setdefault(b, [unseen] * (self.size * self.size * _WIDTH))
            t[(self._of(left) * self.size + self._of(right)) * _WIDTH + ALPHABET.index(aa) + 1] = value
        self.lists = tables
        self.unseen = unseen

    @classmethod
    def of(cls, model: ContextModel) -> ContextArray:
        if len(model.by) > 1:
            raise ValueError("at most one column tells context models apart")
        by = model.by[0] if model.by else None
        return cls([(r[by] if by else None, r["left"], r["right"], r["aa"], float(r["_prob"])) for r in model.lookup_table().collect()], by)

    def numbers(self) -> ContextNumbers:
        """The table of a model without ``by`` for use inside a task."""
        flat = self.lists.get(None, [self.unseen] * (self.size * self.size * _WIDTH))
        return ContextNumbers(self.symbols, np.array(flat, float))

    def _of(self, symbol: str) -> int:
        return {START: self.size - 2, END: self.size - 1}.get(symbol, self.symbols.find(symbol) + 1)


def points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


class ContextNumbers:
    """A ``ContextArray`` in a task: the numbers of all positions of a batch of sequences at once."""

    def __init__(self, symbols: str, flat: np.ndarray):
        self.known = np.array([ord(c) for c in symbols], np.uint32)       # sorted
        self.size = len(symbols) + 3
        self.flat = flat

    def around(self, chars: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For every position of sequences laid end to end, where the numbers between its neighbours begin."""
        at = np.searchsorted(self.known, chars)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == chars[hit]
        codes = np.where(hit, at + 1, 0)
        left, right = np.empty_like(codes), np.empty_like(codes)
        left[1:], right[:-1] = codes[:-1], codes[1:]
        ends = np.cumsum(lens)[lens > 0]
        left[ends - lens[lens > 0]], right[ends - 1] = self.size - 2, self.size - 1
        return (left * self.size + right) * _WIDTH

    def value(self, around: np.ndarray, residue: np.ndarray) -> np.ndarray:
        """The numbers of residue characters in given surroundings."""
        return self.flat[around + _RESIDUE[np.minimum(residue, len(_RESIDUE) - 1)]]


class ContextColumns:
    """A number by (left, residue, right) as a constant array in the plan; the first twenty symbols are the residues."""

    def __init__(self, rows: list[tuple], unseen: float):
        """``rows``: (left, right, residue, value), bounded by the alphabet."""
        self.symbols = ALPHABET + "".join(sorted({x for r in rows for x in r[:2]} - {START, END} - set(ALPHABET)))
        self.size = len(self.symbols) + 3
        flat = np.full((self.size, self.size, _WIDTH), unseen)
        for left, right, aa, value in rows:
            flat[self._of(left), self._of(right), ALPHABET.index(aa) + 1] = value
        # one string literal, folded to one array constant
        self.table = F.split(F.lit(",".join(map(repr, flat.ravel().tolist()))), ",").cast("array<double>")

    def _of(self, symbol: str) -> int:
        return {START: self.size - 2, END: self.size - 1}.get(symbol, self.symbols.find(symbol) + 1)

    def code(self, char: Column) -> Column:
        """The number of a character's symbol, 0 for one that the model doesn't know."""
        return F.position(char, F.lit(self.symbols))

    def codes(self, chars: Column) -> Column:
        """Symbol numbers of an array of characters, between those of the start and the end."""
        return F.concat(F.array(F.lit(self.size - 2)), F.transform(chars, self.code), F.array(F.lit(self.size - 1)))

    def beside(self, text: str, n: str, i: Column) -> Column:
        """The surroundings of position ``i`` of a text of ``n`` letters, where few positions are asked for."""
        left = F.when(i > 0, self.code(F.col(text).substr(i, F.lit(1)))).otherwise(F.lit(self.size - 2))
        right = F.when(i < F.col(n) - 1, self.code(F.col(text).substr(i + 2, F.lit(1)))).otherwise(F.lit(self.size - 1))
        return (left * self.size + right) * _WIDTH

    def around(self, codes: Column, i: Column) -> Column:
        """The surroundings of position ``i``; ``codes`` is a column of ``codes``."""
        return (F.get(codes, i) * self.size + F.get(codes, i + 2)) * _WIDTH

    def value(self, around: Column, char: Column) -> Column:
        """The number of a residue character in given surroundings."""
        return F.get(self.table, around + F.position(char, F.lit(ALPHABET)))

    def own(self, codes: Column, i: Column) -> Column:
        """The number of the residue at position ``i`` itself."""
        code = F.get(codes, i + 1)
        slot = code if len(self.symbols) == len(ALPHABET) else F.when(code < _WIDTH, code).otherwise(F.lit(0))
        return F.get(self.table, self.around(codes, i) + slot)


_RESIDUE = np.zeros(129, np.int64)      # by code point: 1..20, 0 for anything else
_RESIDUE[[ord(a) for a in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


def profile_arrays(model: ProfileModel) -> DataFrame:
    """(group, _profile): by position an array of P(residue), other residues first; positions never seen are null."""
    g = model.group
    at = model.counts.groupBy(g, "pos").agg(F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("_m"), F.sum("n").alias("_t"))
    total = F.col("_t") + len(ALPHABET)
    probs = F.array(1 / total, *[(F.coalesce(F.element_at("_m", F.lit(a)), F.lit(0)) + 1) / total for a in ALPHABET])
    by_pos = at.select(g, "pos", probs.alias("_v"))
    last = by_pos.groupBy(g).agg(F.max("pos").alias("_last"))
    grid = last.select(F.col(g).alias("_g"), F.explode(F.sequence(F.lit(0), "_last")).alias("_pos"))
    full = grid.join(by_pos, grid["_g"].eqNullSafe(by_pos[g]) & (F.col("_pos") == F.col("pos")), "left")
    return full.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias("_profile"))


def with_profile(df: DataFrame, model: ProfileModel, use: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` plus ``_profile`` of its group; broadcast up to ``BROADCAST_ROWS`` counted positions. ``use`` turns the numbers
    of a position into others, once a position."""
    t = profile_arrays(model)
    if use:
        t = t.select("_g", F.transform("_profile", use).alias("_profile"))
    if model.counts.select(model.group, "pos").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        t = F.broadcast(t)
    return df.join(t, df[model.group].eqNullSafe(t["_g"]), "left").drop("_g")


def total(logs: Column) -> Column:
    """Sum of the numbers of an array, nulls left out; an empty one gives 0."""
    return F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


class LogArray:
    """Log probabilities of a fitted ``ContextModel``, by (left, right, character), as constant arrays.

    A character has one symbol number whether it is looked up or stands beside: 1..20 for the residues, then gaps and
    stops, then all other characters of the model, 0 for any other. Gaps and stops have log 0, so sums pass over them.
    """

    def __init__(self, model: ContextModel):
        if len(model.by) > 1:
            raise ValueError("at most one column tells context models apart")
        self.by = model.by[0] if model.by else None
        rows = [(r[self.by] if self.by else None, r["left"], r["right"], r["aa"], float(np.log(r["_prob"]))) for r in model.lookup_table().collect()]
        others = {x for r in rows for x in r[1:3]} - {START, END} - set(SYMBOLS)
        self.symbols = SYMBOLS + "".join(sorted(others))
        self.size = len(self.symbols) + 3
        self.start, self.end = self.size - 2, self.size - 1
        blank = np.full((self.size, self.size, _SLOTS), LOG_UNSEEN)
        blank[:, :, len(ALPHABET) + 1:] = 0.0
        tables: dict = {}
        for b, left, right, aa, value in rows:
            t = tables.setdefault(b, blank.copy())
            t[self._of(left), self._of(right), ALPHABET.index(aa) + 1] = value
        # one string literal a table; folded to one array constant
        self.tables = {b: F.split(F.lit(",".join(map(repr, t.ravel().tolist()))), ",").cast("array<double>") for b, t in tables.items()}

    def _of(self, symbol: str) -> int:
        return {START: self.start, END: self.end}.get(symbol, self.symbols.find(symbol) + 1)

    def codes(self, seq: Column) -> Column:
        """Symbol numbers of the characters, between those of the start and the end (null: null)."""
        own = F.transform(letters(seq), lambda c: F.position(c, F.lit(self.symbols)))
        return F.concat(F.array(F.lit(self.start)), own, F.array(F.lit(self.end)))

    def value(self, left: Column, right: Column, code: Column) -> Column:
        """The log of a symbol between two others."""
        slot = code if len(self.symbols) == len(SYMBOLS) else F.when(code < _SLOTS, code).otherwise(F.lit(0))
        at = (left * self.size + right) * _SLOTS + slot
        out = unseen_log(code)
        if self.by is None:
            return F.get(self.tables[None], at) if self.tables else out
        for b, t in self.tables.items():
            out = F.when(F.col(self.by).eqNullSafe(F.lit(b)), F.get(t, at)).otherwise(out)
        return out

    def over(self, codes: Column) -> Column:
        """The logs of all positions; ``codes`` is a column of ``codes``."""
        return F.transform(F.slice(codes, F.lit(2), F.size(codes) - 2), lambda c, i: self.value(F.get(codes, i), F.get(codes, i + 2), c))


def unseen_log(code: Column) -> Column:
    """The log of a symbol where the model has seen nothing."""
    return F.when(code.between(len(ALPHABET) + 1, _SLOTS - 1), F.lit(0.0)).otherwise(F.lit(LOG_UNSEEN))


def symbol_codes(seq: Column) -> Column:
    """1..20 for the residues, then gaps and stops, 0 for anything else."""
    return F.transform(letters(seq), lambda c: F.position(c, F.lit(SYMBOLS)))


def with_profile_logs(df: DataFrame, model: ProfileModel) -> DataFrame:
    """``with_profile`` with the log of every probability, and 0 for gaps and stops."""
    skipped = F.array(*[F.lit(0.0) for _ in SKIP_CHARS])
    return with_profile(df, model, lambda probs: F.concat(F.transform(probs, F.ln), skipped))


def profile_logs(codes: Column) -> Column:
    """The logs of ``symbol_codes`` whose first position is the profile's first."""
    return F.transform(codes, lambda c, i: F.coalesce(F.get(F.get("_profile", i), c), unseen_log(c)))


def added(logs: Column, start: Column, end: Column) -> Column:
    """Sum of an array without nulls over the 0-based half-open window."""
    return F.when(end > start, F.aggregate(F.slice(logs, start + 1, end - start), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def sequence_scores(df: DataFrame, model: ContextModel, keep: list[str], seq: str = "sequence") -> DataFrame:
    """E1 inside the row: ``keep``, n_pos and the mean log probability of the residues (null without any)."""
    t = LogArray(model)
    coded = df.select(*keep, *model.by, t.codes(F.col(seq)).alias("_y"), scored_length(F.col(seq)).alias("n_pos"))
    logs = coded.select(*keep, "n_pos", t.over(F.col("_y")).alias("_l"))
    return logs.select(*keep, "n_pos", F.when(F.col("n_pos") > 0, total(F.col("_l")) / F.col("n_pos")).alias("pll"))


def scored_length(text: Column) -> Column:
    """Number of characters of a text that are no gaps or stops."""
    return F.length(F.translate(text, SKIP_CHARS, "")).cast("long")
