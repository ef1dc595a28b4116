from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from govspark.llm import perfect_hash, tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Whole texts, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = tokenizer_alignment.byte_of_character()

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, widths):
        ends = np.cumsum(widths).tolist()
        return [(i, e - w, e) for i, w, e in zip(ids, widths, ends)]

    rows = []
    for text in texts:
        row = {"a": [], "b": [], "groups": "", "n_groups": 0, "links": []}
        rows.append(row)
        if not text:
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba, bb = [bytes(of[c] for c in a.id_to_token(i)) for i in ia], [piece(i) for i in ib]
        if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            continue
        sa, sb = spans(ia, list(map(len, ba))), spans(ib, list(map(len, bb)))
        ends = sorted({e for *_, e in sa} & {e for *_, e in sb})
        begins = [0, *ends]
        written = ["|".join(",".join(str(i) for i, s, e in side if s >= x and e <= y) for side in (sa, sb)) for x, y in zip(begins, ends)]
        links, at = [], 0
        for i, s, e in sa:
            while at < len(sb) and sb[at][2] <= s:
                at += 1
            k = at
            while k < len(sb) and sb[k][1] < e:
                links.append((i, sb[k][0]))
                k += 1
        row |= {"a": ia, "b": ib, "groups": ";".join(written), "n_groups": len(ends), "links": links}
    counts = Counter(link for row in rows for link in row["links"])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = [
        (len(r["a"]), len(r["b"]), r["n_groups"], len(r["links"]), sum(counts[p] == best[p[1]] for p in r["links"]), sum(counts[p] for p in r["links"]), r["groups"])
        for r in rows
    ]
    return out, counts


def texts():
    rng = random.Random(3)
    signs = "  \n\t  'stmd re lexyzé12²!.,-_　漢́😀ABſK\x00\x1c"
    out = [None, "", "a", " ", "  ", "\n ", "<|endoftext|> <s></s>", "a▁b", "it's  two\n three  ", "�", "tab\t x\t\t  y \n z", "thé  a", "x  y"]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    words = ["the", "Reoush", "ntiontion", "straße", "que", "of.", "and,", "naïve"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    return out + ["very" * 4000, "long words " * 3000, out[-1], out[-1]]


def check(rows, expected):
    for row, (*numbers, groups) in zip(rows, expected):
        assert [row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum] == numbers
        assert row.groups == groups
        assert row.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("how", [{}, {"pass_pairs": 150, "shard_pairs": 40}])
def test_against_whole_texts(spark, how):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, groups string").repartition(5, F.col("doc_id") % 5)
    expected, counts = brute(rows)
    alignment = tokenizer_alignment.Alignment(df, A, B, **how)
    assert (len(alignment.runs) > 3) == bool(how)
    assert {(r.a, r.b): r.n for r in alignment.pairs.collect()} == counts
    found = alignment.documents(groups=True).orderBy("key").collect()
    check(found, expected)


def test_many_tasks_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "FAN_IN", 2)
    monkeypatch.setattr(tokenizer_alignment, "SLICE", 16)
    rows = texts()[8:120]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(9)
    expected, counts = brute(rows)
    alignment = tokenizer_alignment.Alignment(df, A, B)
    assert {(r.a, r.b): r.n for r in alignment.pairs.collect()} == counts
    check(alignment.documents(groups=True).orderBy("key").collect(), expected)


def test_keys_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("k", "one two", 1), (None, "one two", 2), ("k", "one two", 3), (None, None, 4)], "doc_id string, text string, n_a int")
    found = tokenizer_alignment.align(df, A, B).collect()
    assert sorted((r.doc_id or "", r.n_a) for r in found) == [("", 0), ("", 2), ("k", 2), ("k", 2)]
    assert {r.count_sum for r in found if r.n_a} == {6} and found[0].n_best == 2
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert tokenizer_alignment.align(nothing, A, B).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [r.n_links for r in tokenizer_alignment.align(blank, A, B).collect()] == [0, 0]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 31, 50_000))
    number = perfect_hash.shard_number(keys) % 7
    shards = [perfect_hash.build(keys[number == i]) for i in range(7)]
    whole, some = perfect_hash.PerfectHash(shards), perfect_hash.PerfectHash(shards[2:5], 2, 7)
    assert sorted(whole.slots(keys)) == list(range(len(keys)))
    inside = (number >= 2) & (number < 5)
    assert sorted(some.slots(keys)[inside]) == list(range(inside.sum()))
    assert (some.slots(keys)[~inside] == -1).all() and (whole.slots(np.setdiff1d(rng.integers(0, 1 << 31, 999), keys)) == -1).all()
    assert (perfect_hash.PerfectHash([perfect_hash.build(keys[:0])]).slots(keys) == -1).all()
