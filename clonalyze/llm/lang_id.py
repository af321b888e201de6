"""Language identification with interpolated Kneser-Ney character language models.

One model per language over the characters of lower-case words (a word is padded with
start marks and one end mark). All models share sorted hash arrays, one per n-gram order:
64-bit hashes of the n-grams, and for each the interpolated log probability in every
language; a second array per order holds the interpolation weights of the contexts, for
n-grams that no language has seen. A text goes to the language of the lowest cross-entropy
per character; it is rejected if that is above what texts of the language reach under models
of the other half of the texts.

Every n-gram of every row is kept, and discounts, continuation counts and context
totals come from all of them, in Spark. The arrays are written to the shared folder, sorted
by hash; tasks read them from there, whole while they are small and by row group above that.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonalyze.llm.common import bounded_batches, passed_through, shared_path, staged
from clonalyze.llm.warc import open_store

ORDER = 4
CACHE_BYTES = 48 << 20      # of one array that a worker holds; larger ones are read by row group
GROUP_BYTES = 4 << 20       # of a row group, about
UNKNOWN = "und"
_START, _END = "\x02", "\x03"
_PLAIN = re.compile("[a-zß-öø-ɏ]+")
_UNUSUAL = re.compile("[^\x00-\x7e -©«-±´¶-¸»-ɏ]")
_LETTERS = regex.compile(r"\p{L}+")
_CHUNK = 1 << 20        # characters worked on at once
_BLANK = re.compile(r"\s")
_MEMO = 1 << 18         # words whose scores a worker remembers
_COUNTED = 150_000      # different words that a worker counts before it hands n-grams on


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case."""
    low = text.lower()
    return (_LETTERS if _UNUSUAL.search(low) else _PLAIN).findall(low)


def _windows(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Code points of all windows of the padded words, (n, order); the word of each; the padded string."""
    padded = "".join(_START * (order - 1) + w + _END for w in words)
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), lens)
    starts = np.cumsum(lens + order - 1) - (lens + order - 1)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
    return codes[at[:, None] + np.arange(order)[None, :]], word, padded


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points; rows of different lengths have different seeds."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), 0x9E3779B97F4A7C15 * (codes.shape[1] + 1) & (2 ** 64 - 1), np.uint64)
        for j in range(codes.shape[1]):
            h = (h ^ codes[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return h


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in the sorted array and whether it is there."""
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    return at, (keys[at] == h if len(keys) else np.zeros(len(h), bool))


class Shards:
    """Hashes, and an array of one number a language for each, in Parquet files in the shared folder.

    Any number of rows: a worker holds at most about ``CACHE_BYTES`` of them.
    """

    def __init__(self, files: list[str], column: str, width: int, kind: str = "float32"):
        self.files, self.column, self.width, self.kind = files, column, width, kind
        self._forget()

    def _forget(self) -> None:
        self.groups: list[tuple] | None = None      # (file, its metadata, row group, least, greatest hash)
        self.whole: tuple[np.ndarray, np.ndarray] | None = None
        self.held: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.bytes = 0

    def __getstate__(self):
        return {x: getattr(self, x) for x in ("files", "column", "width", "kind")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _open(self) -> None:
        self.groups, rows = [], 0
        for f in self.files:
            store, path = open_store(f)
            with store.open_input_file(path) as raw:
                meta = pq.ParquetFile(raw).metadata
            for i in range(meta.num_row_groups):
                known = meta.row_group(i).column(0).statistics
                least, most = (known.min, known.max) if known is not None and known.has_min_max else (-(1 << 63), (1 << 63) - 1)
                self.groups.append((f, meta, i, least, most))
            rows += meta.num_rows
        if rows * (8 + self.width * np.dtype(self.kind).itemsize) <= CACHE_BYTES:
            self.whole = self._all()

    def _read(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        f, meta, i, _, _ = self.groups[at]
        store, path = open_store(f)
        with store.open_input_file(path) as raw:
            t = pq.ParquetFile(raw, metadata=meta).read_row_group(i, columns=["h", self.column])
        table = np.frombuffer(b"".join(t.column(self.column).to_pylist()), self.kind).reshape(-1, self.width)
        return t.column("h").to_numpy(), table

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._read(i) for i in range(len(self.groups))]
        keys = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in parts]])
        o = np.argsort(keys, kind="stable")
        return keys[o], np.concatenate([np.zeros((0, self.width), self.kind), *[x[1] for x in parts]])[o]

    def __getitem__(self, i: int) -> np.ndarray:
        """All hashes, sorted (0), or all numbers (1)."""
        if i > 1:
            raise IndexError(i)
        if self.groups is None:
            self._open()
        return (self.whole or self._all())[i]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.groups is None:
            self._open()
        h = h.view(np.int64)
        if self.whole is not None:
            at, hit = _find(self.whole[0], h)
            return self.whole[1][at[hit]], hit
        asked, back = np.unique(h, return_inverse=True)
        there, values = np.zeros(len(asked), bool), np.zeros((len(asked), self.width), self.kind)
        for g, (_, _, _, least, most) in enumerate(self.groups):
            a, z = np.searchsorted(asked, least, "left"), np.searchsorted(asked, most, "right")
            if a == z:
                continue
            if g not in self.held:
                self.held[g] = self._read(g)
                self.bytes += sum(x.nbytes for x in self.held[g])
                while self.bytes > CACHE_BYTES and len(self.held) > 1:
                    self.bytes -= sum(x.nbytes for x in self.held.popitem(last=False)[1])
            self.held.move_to_end(g)
            keys, table = self.held[g]
            at, hit = _find(keys, asked[a:z])
            there[a:z] |= hit
            values[a:z][hit] = table[at[hit]]
        hit = there[back]
        return values[back[hit]], hit


def _look_up(arrays: tuple[np.ndarray, np.ndarray] | Shards, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the hashes that are there, and which those are."""
    if isinstance(arrays, Shards):
        return arrays.look_up(h)
    at, hit = _find(arrays[0], h)
    return arrays[1][at[hit]], hit


@dataclass
class LanguageModels:
    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray] | Shards]     # by order from 1: sorted hashes, log probabilities (n, langs)
    contexts: list[tuple[np.ndarray, np.ndarray] | Shards]  # by order from 1: sorted hashes, log interpolation weights
    floor: np.ndarray                               # log of the uniform distribution
    sharpness: float = 1.0
    limits: np.ndarray | None = None                # cross-entropy above which a language is rejected

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last code point of each row given the others, in every language."""
        out = np.zeros((len(codes), len(self.langs)), np.float64)
        open_ = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            own = codes[open_, self.order - k:]
            values, hit = _look_up(self.grams[k - 1], gram_hash(own))
            out[open_[hit]] += values
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            values, hit = _look_up(self.contexts[k - 1], gram_hash(own[:, :-1]))
            out[open_[hit]] += values
        out[open_] += self.floor
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        codes, word, _ = _windows(words, self.order)
        probs = self.log_probs(codes)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.add.reduceat(probs, starts, axis=0)


def build(counts: list[tuple[str, str, int]], order: int) -> LanguageModels:
    """Models from (language, n-gram of the highest order, count)."""
    langs = sorted({c[0] for c in counts})
    at = {x: i for i, x in enumerate(langs)}
    lang = np.array([at[c[0]] for c in counts])
    codes = np.frombuffer("".join(c[1] for c in counts).encode("utf-32-le"), np.uint32).reshape(-1, order).astype(np.uint64)
    n = np.array([c[2] for c in counts], np.float64)
    return _interpolated(langs, order, lang, codes, n)


def _interpolated(langs: list[str], order: int, lang: np.ndarray, codes: np.ndarray, n: np.ndarray) -> LanguageModels:
    # counts by order: the highest as they are, lower ones by the number of different characters before them
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(lang, codes, n)]
    for _ in range(order - 1):
        l, c, _n = levels[0]
        short = c[:, 1:]
        key = gram_hash(short)
        o = np.lexsort((key, l))
        first = np.concatenate([[True], (key[o][1:] != key[o][:-1]) | (l[o][1:] != l[o][:-1])])
        starts = np.flatnonzero(first)
        levels.insert(0, (l[o][starts], short[o][starts], np.diff(np.append(starts, len(o))).astype(np.float64)))
    k_langs = len(langs)
    vocabulary = np.array([len(np.unique(levels[0][1][levels[0][0] == i])) + 1 for i in range(k_langs)], float)
    floor = -np.log(vocabulary)
    models = LanguageModels(langs, order, [], [], floor)
    for k, (l, c, n_k) in enumerate(levels, 1):
        ones, twos = (np.array([(n_k[l == i] == x).sum() for i in range(k_langs)], float) for x in (1, 2))
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        ctx = gram_hash(c[:, :-1])
        ctx_keys, ctx_at = np.unique(ctx, return_inverse=True)
        cell = ctx_at * k_langs + l
        size = len(ctx_keys) * k_langs
        total = np.bincount(cell, n_k, size).reshape(-1, k_langs)
        kinds = np.bincount(cell, minlength=size).reshape(-1, k_langs)
        weight = np.where(total > 0, discount[None, :] * kinds / np.maximum(total, 1), 1.0)
        key = gram_hash(c)
        keys, key_first, key_at = np.unique(key, return_index=True, return_inverse=True)
        seen = np.zeros((len(keys), k_langs))
        seen[key_at, l] = np.maximum(n_k - discount[l], 0) / total[ctx_at, l]
        own_ctx = ctx_at[key_first]
        # the models so far give the lower order, also for n-grams that a language hasn't seen
        lower_model = LanguageModels(langs, k - 1, models.grams, models.contexts, floor)
        lower = np.exp(lower_model.log_probs(c[key_first][:, 1:])) if k > 1 else np.exp(np.tile(floor, (len(keys), 1)))
        models.grams.append((keys, np.log(seen + weight[own_ctx] * lower).astype(np.float32)))
        models.contexts.append((ctx_keys, np.log(weight).astype(np.float32)))
    return models


def held_out(id_col: Column) -> Column:
    """CRC-32 of the identifier as text (null: of the empty string) modulo 4 is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count_grams(order: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush(lang: str, counter: Counter) -> pa.RecordBatch:
            codes, word, padded = _windows(list(counter), order)
            n = np.fromiter(counter.values(), np.int64, len(counter))[word]
            _, first, at = np.unique(gram_hash(codes), return_index=True, return_inverse=True)
            sums = np.bincount(at, n, len(first)).astype(np.int64)
            chars = codes[first].astype(np.uint32)
            text = chars.tobytes().decode("utf-32-le")
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array([text[i:i + order] for i in range(0, len(text), order)]),
                                               pa.array(sums)], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                own = held.setdefault(lang, Counter())
                at = 0
                while at < len(text):       # in chunks that end before white space, so that no word is cut
                    end = m.start() if (m := _BLANK.search(text, at + _CHUNK)) else len(text)
                    own.update(words_of(text[at:end]))
                    at = end
                    if sum(map(len, held.values())) > _COUNTED:      # of all languages
                        most = max(held, key=lambda x: len(held[x]))
                        yield flush(most, held[most])
                        held[most].clear()
        for lang, own in held.items():
            if own:
                yield flush(lang, own)

    return rows


def _codes(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), length).astype(np.uint64)


def _dense(own: pa.ListArray, langs: list[str], field: str) -> np.ndarray:
    """(rows, languages): the field's number of each language in the row's list, 0 without."""
    out = np.zeros((len(own), len(langs)))
    each = own.flatten()
    row = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False))
    lang = pc.index_in(each.field("lang"), value_set=pa.array(langs)).to_numpy(zero_copy_only=False)
    out[row, lang] = each.field(field).to_numpy(zero_copy_only=False)
    return out


def _packed(table: np.ndarray, kind: str) -> pa.Array:
    table = np.ascontiguousarray(table, kind)
    return pa.array([r.tobytes() for r in table], pa.binary())


def _context_rows(k: int, langs: list[str], discount: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, kinds = (_dense(b.column(1), langs, x) for x in ("total", "kinds"))
        weight = np.where(total > 0, discount[None, :] * kinds / np.maximum(total, 1), 1.0)
        h = gram_hash(_codes(b.column(0).to_pylist(), k - 1))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _packed(np.log(weight), "float32"), _packed(total, "float64")], names=["h", "weight", "total"])


def _gram_rows(k: int, langs: list[str], discount: np.ndarray, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower, weights, totals = shared.value
    most, held, n = max(4096, (1 << 20) // len(langs)), [], 0

    def flush() -> pa.RecordBatch:
        codes = _codes([x for b in held for x in b.column(0).to_pylist()], k)
        counts = np.concatenate([_dense(b.column(1), langs, "n") for b in held])
        ctx = gram_hash(codes[:, :-1])
        total, weight = _look_up(totals, ctx)[0], np.exp(_look_up(weights, ctx)[0].astype(np.float64))     # every context is there
        seen = np.maximum(counts - discount[None, :], 0) / np.maximum(total, 1)
        below = np.exp(lower.log_probs(codes[:, 1:]) if k > 1 else np.tile(lower.floor, (len(codes), 1)))
        return pa.RecordBatch.from_arrays([pa.array(gram_hash(codes).view(np.int64)), _packed(np.log(seen + weight * below), "float32")], names=["h", "value"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most:       # many look-ups at once: a row group of a large model is read once for all
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _written(df: DataFrame, name: str) -> list[str]:
    """Files of ``df``, each sorted by ``h``, in the shared folder."""
    path = shared_path(df.sparkSession, name)
    (df.repartition(F.shiftrightunsigned("h", 52)).sortWithinPartitions("h")
     .write.option("parquet.block.size", GROUP_BYTES).parquet(path))
    return list(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())


def build_shards(grams: DataFrame, order: int) -> LanguageModels | None:
    """Like ``build``, from a table (lang, gram, n) of any size; the arrays are ``Shards``."""
    spark = grams.sparkSession
    levels = [grams]
    for k in range(order - 1, 0, -1):       # lower orders count the different characters before an n-gram
        short = levels[0].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, staged(short, f"lang-grams-{k}"))
    models, langs = None, []
    for k, level in enumerate(levels, 1):
        stats = {r["lang"]: r for r in level.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("ones"),
                                                                F.count_if(F.col("n") == 2).alias("twos")).collect()}     # a row per language
        if models is None:
            if not stats:
                return None
            langs = sorted(stats)
            models = LanguageModels(langs, order, [], [], -np.log(np.array([stats[x]["kinds"] + 1.0 for x in langs])))
        ones, twos = (np.array([stats[x][c] for x in langs], float) for c in ("ones", "twos"))
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        sums = level.groupBy("lang", F.substring("gram", 1, k - 1).alias("c")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        by_context = sums.groupBy("c").agg(F.collect_list(F.struct("lang", "total", "kinds")).alias("own"))     # at most a struct per language
        files = _written(by_context.mapInArrow(partial(_context_rows, k, langs, discount), "h bigint, weight binary, total binary"), f"lang-contexts-{k}")
        weights, totals = Shards(files, "weight", len(langs)), Shards(files, "total", len(langs), "float64")
        shared = spark.sparkContext.broadcast((LanguageModels(langs, k - 1, list(models.grams), list(models.contexts), models.floor), weights, totals))
        by_gram = level.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("own"))
        files = _written(by_gram.mapInArrow(partial(_gram_rows, k, langs, discount, shared), "h bigint, value binary"), f"lang-probabilities-{k}")
        models.grams.append(Shards(files, "value", len(langs)))
        models.contexts.append(weights)
    return models


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          order: int = ORDER) -> LanguageModels | None:
    """Models from every row of ``docs`` with text and language; None without such rows.

    Every row is counted, and every row calibrates the rejection limits and the scores: the texts are halved by hash, and
    each half is scored by models of the other, so no row is judged by its own counts. Copies of a text are in
    one half. Rows of a language that the other half doesn't have don't calibrate.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    half = F.pmod(F.xxhash64(F.lit("calibration"), F.col(f"`{text_col}`")), F.lit(2)).cast("string")
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), half.alias("_half")).filter("lang is not null and text is not null")
    counted = rows.select(F.concat("_half", "lang").alias("lang"), "text").mapInArrow(_count_grams(order), "lang string, gram string, n bigint")
    own = F.expr("substring(lang, 2)").alias("lang")
    halves = staged(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(F.substring("lang", 1, 1).alias("_half"), own, "gram", "n"), "lang-halves")
    models = build_shards(staged(halves.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams"), order)
    if models is None:
        return None
    parts = []
    for h in "01":
        other = build_shards(halves.filter(F.col("_half") != h).drop("_half"), order)
        if other is not None:
            judged = rows.filter((F.col("_half") == h) & F.col("lang").isin(other.langs)).select("lang", "text")
            parts.append(_fit_sums(judged, other))
    calibrate(models, parts)
    return models


SHARPNESS = (0.5, 1, 2, 4, 8, 16, 32)


def _fit_sums(rows: DataFrame, models: LanguageModels) -> list:
    """A row a language: number, sum and sum of squares of its texts' own cross-entropies, and their log likelihood at every sharpness.

    Texts (lang, text) are scored and summed in one Python stage: a second one would hold a second worker a task.
    """
    scorer = _Scorer(rows.sparkSession.sparkContext.broadcast(models))
    langs = models.langs

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, chars = scorer.entropies(b.column("text").to_pylist())
            h, there = h[chars > 0], pa.array(chars > 0)
            if not len(h):
                continue
            truth = pc.index_in(b.column("lang").filter(there), value_set=pa.array(langs)).to_numpy(zero_copy_only=False)
            own = h[np.arange(len(h)), truth]
            cols = [np.ones(len(h)), own, own ** 2]
            for sharp in SHARPNESS:
                z = (h.min(1)[:, None] - h) * sharp
                p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
                cols.append(np.log(np.maximum(p[np.arange(len(h)), truth], 1e-9)))
            there = np.unique(truth)
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in there]), *(pa.array(np.bincount(truth, c, len(langs))[there]) for c in cols)], names=["lang", *names])

    names = ["n", "h", "hh", *(f"l{i}" for i in range(len(SHARPNESS)))]
    found = rows.mapInArrow(sums, "lang string, " + ", ".join(f"{c} double" for c in names))
    return found.groupBy("lang").agg(*(F.sum(c).alias(c) for c in names)).collect()


def calibrate(models: LanguageModels, parts: list[list]) -> None:
    """Rejection limits (mean plus four deviations of a language's own texts) and the scores' sharpness, from ``_fit_sums``."""
    rows = [r for part in parts for r in part]
    limits = np.full(len(models.langs), np.inf)
    for i, lang in enumerate(models.langs):
        n, h, hh = (sum(r[c] for r in rows if r["lang"] == lang) for c in ("n", "h", "hh"))
        if n >= 5:
            limits[i] = h / n + 4 * max(0.0, hh / n - (h / n) ** 2) ** 0.5 + 1e-6
    if rows:
        likelihood = [sum(r[f"l{i}"] for r in rows) for i in range(len(SHARPNESS))]
        models.sharpness = float(max(zip(likelihood, SHARPNESS))[1])
    models.limits = limits


class _Scorer:
    """Cross-entropies of texts in a worker; word scores are remembered."""

    def __init__(self, shared):
        self.shared = shared
        self.known: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {"shared": self.shared, "known": {}, "table": None}

    def _sum(self, words: list[str]) -> np.ndarray:
        models = self.shared.value
        if self.table is None:
            self.table = np.zeros((_MEMO, len(models.langs)))
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > _MEMO:
            known.clear()
            new = list(set(words))
        for at in range(0, len(new), 1 << 14):
            part = new[at:at + (1 << 14)]
            base = len(known)
            self.table[base:base + len(part)] = models.word_scores(part)
            known.update(zip(part, range(base, base + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) nats a character, and the number of characters (0: no letter)."""
        k = len(self.shared.value.langs)
        total, chars = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        held: list[str] = []
        spans: list[tuple[int, int]] = []

        def flush():
            if not held:
                return
            rows = self.table_rows(held)
            lens = np.fromiter(map(len, held), np.int64, len(held)) + 1
            starts = np.cumsum([0] + [n for _, n in spans[:-1]])
            sums, counts = np.add.reduceat(rows, starts, axis=0), np.add.reduceat(lens, starts)
            for j, (i, _) in enumerate(spans):
                total[i] += sums[j]
                chars[i] += counts[j]
            held.clear()
            spans.clear()

        for i, t in enumerate(texts):
            text = t or ""
            at = 0
            while at < len(text):
                to = min(len(text), at + _CHUNK)
                while to < len(text) and text[to].isalpha() and to - at < 2 * _CHUNK:
                    to += 1         # a word isn't cut
                words = words_of(text[at:to])
                if words:
                    held.extend(words)
                    spans.append((i, len(words)))
                if len(held) > 150_000:
                    flush()
                at = to
        flush()
        return -total / np.maximum(chars, 1)[:, None], chars

    def table_rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.shared.value.langs)))
        for at in range(0, len(words), 1 << 17):        # never more new words than the memo holds
            rows = self._sum(words[at:at + (1 << 17)])
            out[at:at + len(rows)] = self.table[rows]
        return out


def predict(df: DataFrame, models: LanguageModels | None, text_col: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    ``lang_pred`` is the language of the lowest cross-entropy (ties: the first by code point);
    ``und`` with score 0 for texts that are null or have no letter, and for all texts if there
    is no model. ``rejected`` marks texts above the calibrated limit of their language, and
    ``und``. Repeated rows get equal results; an empty table gives an empty one.
    """
    added = [("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("rejected", "boolean")]
    if models is None:
        null = F.lit(None).cast("double")
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in dict(added)], F.lit(UNKNOWN).alias("lang_pred"),
                         F.lit(0.0).alias("score"), null.alias("cross_entropy"), F.lit(True).alias("rejected"))
    scorer = _Scorer(df.sparkSession.sparkContext.broadcast(models))

    def compute(texts: pa.Array) -> list[pa.Array]:
        m = scorer.shared.value
        h, chars = scorer.entropies(texts.to_pylist())
        best = h.argmin(1)
        own = h[np.arange(len(h)), best]
        z = np.exp(-(h - own[:, None]) * m.sharpness)
        some = chars > 0
        limit = m.limits[best] if m.limits is not None else np.full(len(h), np.inf)
        return [pa.array([m.langs[i] if s else UNKNOWN for i, s in zip(best, some, strict=True)]),
                pa.array(np.where(some, 1 / z.sum(1), 0.0)), pa.array(own, mask=~some), pa.array(~some | (own > limit))]

    return passed_through(df, [text_col], compute, added)
