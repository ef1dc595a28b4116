from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from govspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    signs = "  \n\t '''stmdrvlexyzé12²!.,-_　漢́😀ABſK"
    out = ["", "a", "'s", "'ll", "'l", "'lla", "''s", " 's", "\n's", "  's", "x're'r've'v'll'", "a  b", "a \n b\n\nc  ", " ", " \n", "<|endoftext|>"]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    out += ["".join(rng.choice("'srvle ") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    return out + ["a" * 5000, "ab'" * 3000, "".join(rng.choice("abcdefg") for _ in range(20000)), " " * 3000 + "x"]


def test_against_the_library(truth):
    rows = texts()
    ranks = bpe.Ranks(PATH)
    ids, at = bpe.encode_batch(pa.array(rows), ranks)
    for i, text in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == truth.encode_ordinary(text), text
    data, cuts = bpe.decode_batch(ids, at, ranks)
    assert [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] == [t.encode() for t in rows]


def test_operators(spark, truth):
    rows = [(1, "It's 2024,\n  naïve 😀", "old"), (2, None, None), (3, "", "x"), (1, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [r.tokens for r in out] == [truth.encode_ordinary(t or "") for _, t, _ in rows]
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for _, t, _ in rows]
    both = bpe.encode_verified(df, PATH, kept=("doc_id", "tokens")).toDF("doc_id", "old", "n_tokens", "tokens", "decoded_sha256").collect()
    assert [(r.doc_id, r.old, r.tokens, r.n_tokens) for r in both] == [(r.doc_id, o[2], r.tokens, len(r.tokens)) for r, o in zip(out, rows)]
    assert [r.tokens for r in both] == [r.tokens for r in out]
    assert [r.decoded_sha256 for r in both] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows]
    first = out[0]
    assert [first.text.encode()[a:b] for a, b in zip(first.token_starts, [*first.token_starts[1:], None])] == [truth.decode_single_token_bytes(t) for t in first.tokens]
    digests = {r.decoded_sha256: (r.n_tokens, r.ids_sha256) for r in bpe.round_trip_digests(df, PATH).collect()}
    for _, text, _ in rows:
        ids = truth.encode_ordinary(text or "")
        assert digests[hashlib.sha256((text or "").encode()).hexdigest()] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH).columns == ["doc_id", "text", "tokens", "token_starts"]
    assert bpe.encode(df, PATH).collect() == bpe.round_trip_digests(df, PATH).collect() == bpe.encode_verified(df, PATH).collect() == []
