import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from clonalyze.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = bpe.read_ranks(FILE)
    ranks = bpe.parse_ranks(raw)
    return bpe.codec(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_equals_the_library_on_random_texts(both):
    codec, ref = both
    rnd = random.Random(4)
    plain = [chr(i) for i in range(32, 127)] + ["\n", "\t", "\r", "é", "ß", "ñ"]
    odd = plain + list("日本語русский🙂‍ \u0085 \x1c\x1f\x00²½ªµ٣ⅷ_́İ�")
    for n in range(4000):
        text = "".join(rnd.choices([plain, odd, list("ab "), list("aaaA\n  ")][n % 4], k=rnd.choice([0, 1, 3, 20, 200])))
        assert ids(codec, text) == ref.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "ab" * 3000, "éa" * 2000, "!?" * 3000, "1234567890" * 500, "\n " * 2000])
def test_long_pieces(both, text):
    codec, ref = both
    assert ids(codec, text) == ref.encode_ordinary(text)


def test_very_long_piece_is_linear(both):
    text = "xyzzy" * 200_000
    assert both[0].decode(both[0].encode(text)) == text.encode()


def test_every_token_is_its_own_encoding_by_merges(both):
    codec, _ = both
    rnd = random.Random(1)
    for rank in rnd.sample(sorted(codec.halves), 3000):
        left, right = codec.halves[rank]
        assert codec.tokens[left] + codec.tokens[right] == codec.tokens[rank] and max(left, right) < rank


def test_small_vocabulary_with_an_unreachable_token():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 258}
    codec = bpe.BytePairCodec(ranks, P.PATTERN)
    ref = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["abc", "abcabc", "xyz", "xyzab", "bcab", "aabcc xyz abc", "bcbc"]:
        assert ids(codec, text) == ref.encode_ordinary(text), text


def test_columns_nulls_repeats(rows, both):
    _, ref = both
    data = [(1, "Hello world", "a"), (1, "Hello world", "b"), (None, None, None), (2, "", "c"), (3, "naïve 🙂\r\n", "d")]
    df = rows("doc_id long, text string, n_tokens string", data)
    out = bpe.encode(df, FILE, P.PATTERN).collect()
    assert len(out) == 5
    for r, (_, text, _) in zip(sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"])), [data[2], data[0], data[1], data[3], data[4]], strict=True):
        expect = ref.encode_ordinary(text or "")
        assert r["ids"] == expect and r["n_tokens"] == len(expect)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expect, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(rows):
    out = bpe.encode(rows("doc_id long, text string", []), FILE, P.PATTERN, with_ids=False)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
