"""Phrase mining against counting every phrase by hand, for partitions of every shape."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintel.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, f long, phrase string, run long, key long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_force(rows, least, depth, top):
    count, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(depth, len(words) - i) + 1):
                    count[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {q for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if (q := p[i : i + m]) and 100 * a >= 100 * f[q]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * size[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, text, p, k) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, text.decode(), -a, f[p[:k]], f[p[k:]], size[lang], -score))
    return sorted(out)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocab = ["The", "of", "and", "a", "to"] * 6 + ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    stock = [" ".join(rng.choice(vocab) for _ in range(rng.randint(2, 7))) for _ in range(12)]
    texts = [None, "", " \t ", ".,;", "one", "One. one! ONE", "x " * 300, "a\x0bb\x0cc d\re", "no​break here　now", "very-long " * 5]
    while len(texts) < n:
        parts = [rng.choice(stock) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))]
        texts.append(rng.choice([" ", "\t", ", ", ".\n", "! "]).join(parts))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    return [(i % 90, t, rng.choice(["en", "en", "de", "", None, "und"]), 1, "x", 2, 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least,budget,run_words,depth,top", [(3, 1 << 20, 1 << 20, 5, 2000), (3, 25, 300, 5, 2000), (2, 4, 100, 4, 2000), (4, 1, 500, 5, 7), (5, 100, 1 << 20, 2, 40), (2, 60, 200, 3, 15)])
def test_phrases_match_brute_force(spark, least, budget, run_words, depth, top):
    rows = corpus(seed=least)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = col.collocations(docs, least, depth, top, budget, run_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_force([(r[2], r[1]) for r in rows], least, depth, top)


def test_no_rows_where_nothing_is_frequent(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert col.collocations(empty).count() == 0
    assert col.collocations(spark.createDataFrame([(1, None, None, 0, "", 0, 0), (2, "a b", "en", 0, "", 0, 0)], SCHEMA)).count() == 0
    assert [tuple(r) for r in col.collocations(spark.createDataFrame([(1, "A b", None, 0, "", 0, 0)] * 100, SCHEMA)).collect()] == [("und", 1, "a b", 100, 100, 100, 200, 2000)]


def test_ties_go_by_code_point_and_the_cut_to_the_shortest_first_part(spark):
    texts = ["zz q", "é é", "zz é", "b b b", "~ ~"] * 4
    docs = [(i, t, "en", 0, "", 0, 0) for i, t in enumerate(texts)]
    got = sorted(map(tuple, col.collocations(spark.createDataFrame(docs, SCHEMA), 2, 3, 100).collect()))
    assert got == brute_force([(d[2], d[1]) for d in docs], 2, 3, 100)


def test_large_counts_stay_exact(spark, monkeypatch):
    big = 3 * 10**14
    phrases = spark.createDataFrame([("en", [1], big + 7), ("en", [2], big + 9), ("en", [1, 2], big - 1)], "lang string, phrase array<long>, f long")
    words = spark.createDataFrame([(1, "p"), (2, "q")], "h long, word string")
    sizes = spark.createDataFrame([("en", 10**15 + 1)], "lang string, n long")
    monkeypatch.setattr(col, "frequent_phrases", lambda *a: (phrases, words, sizes))
    (row,) = col.collocations(None).collect()
    assert row.score == 1000 * (big - 1) * (10**15 + 1) // ((big + 7) * (big + 9))


def test_front_coding_is_a_round_trip():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 4, (500, 5)), axis=0)
    shared, entries = col.front_code(rows)
    assert len(entries) < rows.size // 2 and (col.front_decode(shared, entries, 5) == rows).all()


def test_groups_stay_within_the_budget():
    totals = np.random.default_rng(2).integers(1, 90, 400)
    bins = col.pack(totals, 100)
    assert max(np.bincount(bins, totals)) <= 100
    assert (np.bincount(col.pack(np.array([300, 5, 5]), 100)) == [1, 2]).all()


def test_order_of_rows_with_many_bits():
    rows = np.random.default_rng(3).integers(0, 3, (200, 5)) * 10**8
    assert (rows[col.order_rows(list(rows.T), 2 * 10**8)] == np.array(sorted(rows.tolist()))).all()
