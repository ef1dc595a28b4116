from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from govspark.llm import spelling

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, least=5, count=3, slip=97):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, factor=2):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= factor * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return rows


def vocabulary():
    rng = random.Random(7)
    words = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdé×ÿ") for _ in range(rng.randint(2, 9)))
        for _ in range(rng.randint(1, 12)):
            words[word] = rng.choice([3, 4, 8, 16, 40, 90])
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + rng.choice("abcdé×ÿ") + word[at:], word[:at] + word[at + 1 :], word[:at] + "z" + word[at + 1 :]]) or "a"
    words |= {"aaaaaaa": 5, "aaaaaa": 9, "x" * 5000: 3, "x" * 4999 + "y": 7, "x" * 4999: 30, "漢字漢字": 3, "漢字漢": 6}
    return words


@pytest.mark.parametrize("how", [{}, {"pass_bytes": 2048, "shard_words": 16}])
def test_groups_against_all_pairs(spark, how):
    words = vocabulary()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = spelling.groups(df, **how).collect()
    assert len(found) == len(words)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == brute_groups(words)


def test_passes_hold_their_bytes():
    sizes = {5: (3, 4), 6: (1, 100), 9: (7, 2)}
    runs = spelling._passes(sizes, 600)
    assert sorted(x for held in runs for x in held) == sorted(set(x for held in runs for x in held))
    covered = Counter((length, i) for held in runs for length, begin, end in held for i in range(begin, end))
    assert covered == Counter((length, i) for length, (shards, _) in sizes.items() for i in range(shards))
    used = [sum((end - begin) * sizes[length][1] * 64 for length, begin, end in held) for held in runs]
    assert all(u <= 600 or len(held) == 1 and held[0][2] - held[0][1] == 1 for u, held in zip(used, runs))


def test_filters_hold_every_word(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(20_000)})
    sizes = {8: (4, spelling.blocks_of(len(words), 4))}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    filters = spelling._load(spelling._build_filters(df, sizes), [(8, 0, 4)], sizes)
    (_, _, codes), = spelling.by_length(pa.array(words))
    assert len(filters.passing(8, spelling._sums(codes))) == len(words)
    strange = list({"".join(rng.choice("ijklmnop") for _ in range(8)) for _ in range(20_000)})
    (_, _, codes), = spelling.by_length(pa.array(strange))
    assert len(filters.passing(8, spelling._sums(codes))) < 40


def test_vocabulary_against_brute_force(spark):
    rng = random.Random(2)
    words = ["Straße", "étude", "ÉTUDE", "reading", "readings", "Reading", "aaaaaa", "tiny", "x" * 70, "naïveté", "÷×÷×÷"]
    rows = [(i, rng.choice([" ", "\n", "-", "漢", "Ā", "1"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(3, rows[3][1]), (None, "étude étude étude"), (400, None), (401, ""), (402, "longword" * 4000 + " ende ende"), (403, "Ã©tude")]
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    for slip in (None, 97, 3):
        found = spelling.vocabulary(df, least_count=1, slip=slip).collect()
        assert {r.word: r.n for r in found} == brute_words(rows, count=1, slip=slip)
    found = spelling.vocabulary(df, slip=97).collect()
    assert {r.word: r.n for r in found} == brute_words(rows)


def test_checksums():
    texts = ["abcde " + "y" * 47 + " " + "y" * 48 + " " + "y" * 49 + " éa", "z" * 500, ""]
    runs = spelling.letter_runs(pa.array(texts))
    prefixes = np.array([zlib.crc32(f"{i}:".encode()) for i in range(3)], np.uint32)
    expected = [zlib.crc32(f"{i}:{w}".encode()) for i, t in enumerate(texts) for w in t.split()]
    assert spelling.checksums(prefixes, runs).tolist() == expected
    assert runs.lengths.tolist() == [5, 47, 48, 49, 2, 500]


def test_query_and_empty_table(spark, sf_dir):
    from govspark.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    found = queries.QUERIES["op12_spelling_variants"](spark, sf_dir).collect()
    assert {r.word: r.n for r in found} == words
    sample = sorted(words)[::40]
    best = {r.word: r for r in found}
    for w in sample:
        others = [v for v in words if abs(len(v) - len(w)) <= 1 and is_near(w, v)]
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form = top if top and words[top] >= 2 * words[w] else None
        assert (best[w].n_near, best[w].form, best[w].form_n) == (len(others), form, words.get(form))
        assert best[w].root == (w if form is None else best[form].root)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.groups(spelling.vocabulary(nothing)).collect() == []
