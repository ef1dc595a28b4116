from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from govspark.llm.language_model import _discounts, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["</s>"]


def brute(rows):
    pairs, counts = Counter(), Counter()
    for _, text, train in rows:
        if train:
            ws = tokens(text)
            counts.update(ws)
            pairs.update(zip(["<s>", *ws[:-1]], ws))
    before, after = Counter(), defaultdict(list)
    for (v, w), c in pairs.items():
        before[w] += 1
        after[v].append(c)
    of = Counter(pairs.values())
    low = Counter(before.values())
    d2 = (0, *_discounts(*(of[i] for i in (1, 2, 3, 4))))
    d1 = (0, *_discounts(*(low[i] for i in (1, 2, 3, 4))))
    n, v_size, kinds = sum(counts.values()), len(counts), sum(before.values())
    spare = sum(d1[min(c, 3)] for c in before.values()) / kinds

    def alone(w):
        return (before[w] - d1[min(before[w], 3)]) / kinds + spare / (v_size + 1)

    def p(v, w):
        if v not in after:
            return alone(w)
        total, c = sum(after[v]), pairs[v, w]
        return (c - d2[min(c, 3)]) / total + sum(d2[min(x, 3)] for x in after[v]) / total * alone(w)

    assert abs(sum(alone(w) for w in counts) + spare / (v_size + 1) - 1) < 1e-9
    out = {}
    for key, text, _ in rows:
        ws = tokens(text)
        own = sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ws[:-1]], ws))
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v_size + 1))) for w in ws)
        out[key] = (len(ws), sum(counts[w] > 0 for w in ws), n, base, own)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["The", "of", "é", "longer-word", "x"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 45])]) for _ in range(rng.randint(0, 60))), i % 4 != 0) for i in range(80)]
    rows += [(100, None, True), (101, "", False), (102, "never seen words", False), (104, "\n", True), (105, "w1 w2 " * 300, True)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, train boolean, c int")
    truth = brute(rows)
    got = score(df, F.col("train")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, own = truth[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(own)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score(df, F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = score(df, F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
