from __future__ import annotations

import random
import re

import pytest

from govspark.llm.components import components
from govspark.llm.jaccard_join import keep_first, similarity_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=80):
    sets = {d: grams(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d, _ in rows)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for family in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120]))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[i], "new"]])
                words = words or ["x"]
            rows.append((len(rows) * 7 % 211, " ".join(words) if rng.random() < 0.8 else "\n".join(words).lower()))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, None), (904, "one two"), (905, "One TWO"), (906, "É x"), (907, "é x")]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similarity_components(df).collect())) == brute(rows)


def test_chain_of_links_repeated_rows_and_extra_columns(spark):
    words = [f"w{i}" for i in range(160)]
    rows = [(50 - i, " ".join(words[i : i + 100])) for i in range(0, 50, 5)]
    rows += rows[:2]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gram string, n int")
    assert sorted(map(tuple, similarity_components(df).collect())) == brute(rows)
    assert [tuple(r)[0] for r in keep_first(df).collect()] == [5]
    assert keep_first(df).columns == df.columns


def test_empty_table(spark):
    assert similarity_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 100 for i in range(100, 161)} | {200 + i: 200 for i in range(30)}
