"""Residue-level column expressions: tokens, labels, vectors (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 20 canonical amino acids in alphabetical order.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
# Residue-model vocabulary (ids 0-4 special tokens, 5-24 residues).
SPECIAL_TOKENS = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "<mask>": 4}
TOKEN_IDS = {aa: 5 + i for i, aa in enumerate(ALPHABET)}
# Characters skipped when scoring a sequence.
SKIP_CHARS = "-*"
# Fixed value: ignore marker for token labels.
IGNORE = -100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def residue_array(c) -> Column:
    """H9: one letter per element; empty strings give an empty array."""
    c = _c(c)
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def tokenize(c, max_len: int = 150) -> Column:
    """``<s>`` + residue ids + ``</s>``, unknown -> 3, truncated then padded to max_len.

    Returns a struct (input_ids, attention_mask, special_tokens_mask).
    """
    vocab = F.create_map(*[x for aa, i in TOKEN_IDS.items() for x in (F.lit(aa), F.lit(i))])
    ids = F.transform(residue_array(c), lambda r: F.coalesce(F.try_element_at(vocab, r), F.lit(SPECIAL_TOKENS["<unk>"])))
    body = F.slice(ids, 1, max_len - 2)
    full = F.concat(F.array(F.lit(0)), body, F.array(F.lit(2)))
    n = F.size(full)
    pad = F.array_repeat(F.lit(1), F.greatest(F.lit(max_len) - n, F.lit(0)))
    return F.struct(
        F.concat(full, pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0)))).alias("attention_mask"),
        F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n - 2), F.array(F.lit(1)),
                 F.array_repeat(F.lit(1), F.greatest(F.lit(max_len) - n, F.lit(0)))).alias("special_tokens_mask"),
    )


def encode_labels(c) -> Column:
    """N/P labels -> 0/1."""
    return F.transform(_c(c), lambda x: F.when(x == "P", 1).otherwise(0))


def pad_labels(c, max_len: int = 150) -> Column:
    """``[-100] + labels + [-100] * pads`` to ``max_len``."""
    c = F.slice(_c(c), 1, max_len - 2)
    return F.concat(F.array(F.lit(IGNORE)), c,
                    F.array_repeat(F.lit(IGNORE), F.greatest(F.lit(max_len - 1) - F.size(c), F.lit(0))))


def mask_render(residues, preds) -> Column:
    """Residue where predicted positive, ``-`` elsewhere, as one string."""
    return F.array_join(F.zip_with(_c(residues), _c(preds), lambda r, p: F.when(p == 1, r).otherwise(F.lit("-"))), "")


def binary_class(p) -> Column:
    """H12 (binary): round half to even."""
    return F.bround(_c(p), 0).cast("int")


def argmax(c) -> Column:
    """H12 (multi-class): 0-based index of the first maximum."""
    c = _c(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def normalise(c, lo, hi, cap: bool = True) -> Column:
    """(x - lo) / (hi - lo), optionally capped at 1; zero range -> null."""
    v = F.try_divide(_c(c) - lo, F.nullif(hi - lo, F.lit(0)))
    return F.least(v, F.lit(1.0)) if cap else v


def euclid(a, b) -> Column:
    """Euclidean distance of two double arrays."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def fill_vector(c, value: float = 0.0) -> Column:
    """Nulls and NaNs in an array -> value."""
    return F.transform(_c(c), lambda x: F.coalesce(F.nanvl(x, F.lit(value)), F.lit(value)))


def vector_complete(c) -> Column:
    """B4 for arrays: no null / NaN element."""
    return ~F.exists(_c(c), lambda x: x.isNull() | F.isnan(x))


def softmax_array(c) -> Column:
    """H10 (array form): exp(x - max) / sum over one logit vector."""
    c = _c(c)
    e = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)
