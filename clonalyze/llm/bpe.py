"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The vocabulary's byte strings are mapped to Latin-1, one character a byte, for an
Aho-Corasick automaton. A piece of text is encoded from left to right with the longest
matching token; a token may follow another only if the two are *compatible*, that is,
if byte pair merging of their concatenation would end in exactly these two. Where no
compatible token is left, the encoder drops the last token and tries its next shorter
prefix; positions shown to lead nowhere are not visited again, so the work is linear in
the length of the piece. Compatibility of adjacent tokens is memoised. The result is
the exact merge order encoding of the rank file.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonalyze.llm.common import Memo, bounded_batches

MEMO_BYTES = 48       # longest piece that a worker remembers

# Characters for which re and the Unicode classes of the pattern agree.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_UNUSUAL = re.compile(f"[^\\t\\n\\r\x20-\x7e{_LETTERS}]")


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of usual characters only, for the faster ``re``; None if it has other classes."""
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}"):
            chars = _LETTERS if part == r"\p{L}" else "0-9"
            part = chars if inside else f"[{chars}]"
        elif part in (r"\p", r"\P"):
            return None
        elif part in "[]":
            inside = part == "["
        out += part
    return re.compile(out)


class BytePairCodec:
    """Encoder and decoder for one rank file (token bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.plain = _plain_pattern(pattern)
        self.halves: dict[int, tuple[int, int]] = {}     # of a merged token: the two that its last merge joins
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}         # longest proper prefix that is a token
        self.pair_memo = Memo()
        self.piece_memo = Memo()
        self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self.halves:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        top = max(self.tokens, default=-1) + 1
        lengths = np.array([len(self.tokens.get(r, b"")) for r in range(top)], np.int64)
        self.table = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(top)), np.uint8)
        self.reach = int(lengths.max(initial=1))
        self.length, self.start = lengths, np.cumsum(lengths) - lengths

    def _learn_merges(self) -> None:
        """The last merge of every token; tokens that merging never makes stay out."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            for k in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if (left is not None and right is not None and max(left, right) < rank
                        and self._usable(token[:k]) and self._usable(token[k:]) and self._joinable(left, right)):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self.shorter = {rank: next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if self._usable(t[:k])), None)
                        for t, rank in self.ranks.items()}

    def _usable(self, token: bytes) -> bool:
        rank = self.ranks.get(token)
        return rank is not None and (len(token) == 1 or rank in self.halves)

    def compatible(self, left: int, right: int) -> bool:
        known = self.pair_memo.get((left, right))
        if known is None:
            self.pair_memo.put((left, right), known := self._joinable(left, right))
        return known

    def _joinable(self, left: int, right: int) -> bool:
        """Would merging leave the two tokens as they are?

        Merges are undone from the latest to the earliest along the seam; the seam breaks
        if a pair that touches there has a merge that comes before the one undone last.
        Among equal ranks the leftmost merge comes first.
        """
        before = float("inf")       # merges from this rank on come too late to break the seam
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < before:
                return False
            l_half, r_half = self.halves.get(left), self.halves.get(right)
            if l_half is None and r_half is None:
                return True
            if r_half is None or (l_half is not None and left > right):
                before, left = left, l_half[1]
            else:
                before, right = right + 1, r_half[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        chars, known, long = piece.decode("latin-1"), self.pair_memo.young, self.automaton.iter_long
        found = [rank for _, (_, rank) in long(chars)]      # longest matches all the way
        last = found[0]
        for good, token in enumerate(found[1:], 1):
            fits = known.get((last, token))
            if not (self.compatible(last, token) if fits is None else fits):
                break
            last = token
        else:
            return found
        out, token, tokens, shorter = found[:good], found[good], self.tokens, self.shorter
        n, at = len(piece), sum(len(tokens[r]) for r in out)
        dead = set()                # positions from which no way leads on
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + len(tokens[token])
                if end not in dead:
                    fits = True if last is None else known.get((last, token))
                    if self.compatible(last, token) if fits is None else fits:
                        out.append(token)
                        at = end
                        if at < n:
                            token = next(long(chars[at:at + self.reach]))[1][1]
                        break
                token = shorter[token]
                if token is None:
                    dead.add(at)
                    token = out.pop()
                    at -= len(tokens[token])
                    break
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo = self.piece_memo
        pieces = (self.pieces if self.plain is None or _UNUSUAL.search(text) else self.plain).findall(text)
        parts = list(map(memo.young.get, pieces))
        if None in parts:
            for i, got in enumerate(parts):
                if got is None:
                    piece = pieces[i]
                    got = memo.get(piece)
                    if got is None:
                        raw = piece.encode("utf-8")
                        ids = self.encode_piece(raw)
                        got = struct.pack(f"<{len(ids)}I", *ids)
                        if len(raw) <= MEMO_BYTES:
                            memo.put(piece, got)
                    parts[i] = got
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        ranks = np.frombuffer(ids, "<u4")
        parts = []
        for at in range(0, len(ranks), 1 << 16):
            r = ranks[at:at + (1 << 16)]
            n = self.length[r]
            ends = np.cumsum(n)
            parts.append(self.table[np.repeat(self.start[r] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


def read_ranks(path: str) -> bytes:
    """The rank file's content (a vocabulary, some MB at most whatever the corpus)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(content: bytes, pattern: str) -> BytePairCodec:
    """One codec per vocabulary and worker process."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(parse_ranks(content), pattern)
    return _CODECS[key]


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``df`` without ``text_col``, plus what its whole text encodes to.

    Adds ``n_tokens``, ``ids`` (array of long, if ``with_ids``), ``ids_sha256`` (of the ids
    as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the bytes that
    the ids decode to). Null and empty texts give no ids. Every row stands for itself, so
    repeated rows, ties and other nulls have no effect. Columns of these names in ``df``
    are replaced.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_ranks(rank_file))
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"] if with_ids else ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in df.columns if c != text_col and c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_bpe_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(len(kept)).to_pylist()]
            cols = {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids])}
            if with_ids:
                ends = np.cumsum([0] + [len(i) // 4 for i in ids])
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *[cols[x] for x in new]], names=kept + new)

    kinds = {"n_tokens": "bigint", "ids": "array<bigint>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{x} {kinds[x]}" for x in new])
    return src.mapInArrow(rows, schema)
