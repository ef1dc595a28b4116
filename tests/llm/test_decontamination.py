from __future__ import annotations

import random
import re

from govspark.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(d.UPPER, d.LOWER)


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width):
    phrases = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - width + 1)):
            if w:
                phrases.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for k in {len(p) for p in phrases}:
            for i in range(len(w) - k + 1):
                if (p := tuple(w[i : i + k])) in phrases:
                    hit.update(range(i, i + k))
                    found |= phrases[p]
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def check(spark, docs, items, width):
    found = d.contamination(
        spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, term string"),
        spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int"), width=width,
    )
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()]
    assert sorted(rows, key=str) == brute(docs, items, width)


def test_against_brute_force(spark):
    rng = random.Random(3)
    for vocabulary, width in ((["a", "B", "É", "9"], 3), ([f"w{i}" for i in range(60)], 4)):
        make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!'"]) for _ in range(n))
        items = [(i, make(rng.randint(0, 9))) for i in range(12)] + [(50, None), (51, "..."), (52, "a"), (53, "A")]
        docs = [(i, make(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "")) for i in range(25)]
        docs += [(100, None), (101, ""), (102, "?!"), (0, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (None, "?")]
        check(spark, docs, items, width)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")], 2)
    check(spark, [(1, "a b")], [], 2)


def test_proximity(spark):
    docs = d.plain_docs(spark.createDataFrame([(1, "x rare b c d"), (2, "b y rare z d c"), (3, "b c d")], "doc_id long, text string"), "doc_id", "text")
    anchored = spark.createDataFrame([("rare b c d", ["rare", "b", "c", "d"], "rare", 0)], "phrase string, terms array<string>, term string, offset int")
    index = d.build_index(docs, anchored.select("term"), 6)
    assert [tuple(r) for r in d.exact_matches(index, anchored).collect()] == [(1, "rare b c d", 1, 4)]
    assert sorted(r.doc for r in d.proximity_matches(index, anchored, least=4, slack=2).collect()) == [1, 2]
