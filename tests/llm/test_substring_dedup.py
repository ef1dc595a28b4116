from __future__ import annotations

import hashlib
import random
import re

import pytest

from govspark.llm.substring_dedup import cut, repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = []
    for d, t in rows:
        w = words[d]
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in cut(df, texts=False, **kw).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 40]))] + ["é"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for d in rng.sample(range(1000), 40):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)
        rows.append((d, text))
        if rng.random() < 0.2:
            rows.append((d + 1000, text))
    return rows + [(5000, None), (5001, ""), (5002, "  \n"), (-3, rows[0][1])]


def periodic(seed):
    rng = random.Random(seed)
    rows = []
    for d in rng.sample(range(500), 30):
        words = []
        for _ in range(rng.randint(1, 4)):
            cycle = [rng.choice("abc") for _ in range(rng.choice([1, 2, 2, 3, 5, 13]))]
            words += (cycle * 80)[: rng.choice([3, 12, 13, 14, 30, 61, 80, 150])] + [rng.choice("abxy") for _ in range(rng.randint(0, 3))]
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_periods_against_brute_force(spark, seed):
    rows = periodic(seed)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_small_width_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (2, "x b c d e y"), (3, "a b c d e f")]
    assert result(spark, rows, width=4, seed=2) == brute(rows, 4)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 1, "a"), (2, "new words " + text, 2, "b")], "doc_id long, text string, doc int, spans string")
    spans = [tuple(r) for r in repeated_spans(df).collect()]
    assert spans == [(2, 2, 32, 1)]
    out = cut(df, carry=("doc", "spans"))
    assert {r.doc_id: (r.kept, r.doc, r.spans) for r in out.collect()} == {1: (text, 1, "a"), 2: ("new words", 2, "b")}
