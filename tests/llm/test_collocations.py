import re
from collections import Counter

import numpy as np
import pytest
from pagewright.llm import collocations
from pagewright.llm.trie import Trie

UPPER = {c: c + 32 for c in range(65, 91)}


def want(rows, least=100, most=2000):
    """rows: (lang, text)"""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    by_lang = {}
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] < 100 * a:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, own in by_lang.items() for rank, (s, a, p, x, y) in enumerate(sorted(own)[:most], 1))


def got(df, most=2000):
    return sorted(tuple(r) for r in collocations.collocations(df, most).collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = want([(r.lang, r.text) for r in docs.collect()])
    assert rows and got(docs) == rows


ROWS = [
    ("en", "Red apple pie and cream, " * 120 + "red apple tree. " * 30),
    ("en", "a a a a a a; " * 60), ("en", "x\ty\x00z  été o " * 110), (None, "red apple " * 105), ("und", "red apple\nred\rapple " * 10),
    ("", "one two three four five six seven " * 100), ("en", None), ("en", ""), ("en", ".,;:!?\n\x0b\x0c\r"), ("en", "Red apple pie and cream, " * 120),
]


def test_edges(spark):
    docs = spark.createDataFrame([(k, *r, k, "q") for k, r in enumerate(ROWS)], "doc_id long, lang string, text string, n int, phrase string")
    assert got(docs) == want(ROWS)
    assert got(docs, 2) == want(ROWS, most=2)
    assert got(docs.limit(0)) == []


def test_many_small_tries_and_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_PHRASES", 5)
    monkeypatch.setattr(collocations, "MOST_WORDS", 4)
    monkeypatch.setattr(collocations, "HELD_KEYS", 8)
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert got(docs) == want(ROWS)


def test_scores_beyond_64_bits(spark):
    a, b = 10**13, 3 * 10**13
    phrases = spark.createDataFrame([("en", "u", 1, a), ("en", "v", 1, b), ("en", "u v", 2, a - 7)], "lang string, phrase string, length int, a long")
    totals = spark.createDataFrame([("en", 10**15 + 1)], "lang string, n long")
    row = collocations.scored(phrases, totals).first()
    assert row.score == 1000 * (a - 7) * (10**15 + 1) // (a * b) and (row.l, row.r) == (a, b)


@pytest.mark.parametrize("seed", range(5))
def test_trie_against_windows(seed):
    rng = np.random.default_rng(seed)
    words, depth = int(rng.integers(1, 60)), int(rng.integers(2, 6))
    text = rng.integers(0, words + 1, 5000).astype(np.int32)
    windows = np.lib.stride_tricks.sliding_window_view(text, depth)
    phrases = np.unique(np.concatenate([windows[(windows > 0).all(1)][::3], rng.integers(1, words + 1, (50, depth)).astype(np.int32)]), axis=0)
    phrases = rng.permutation(phrases)
    at, row = Trie(phrases, words).ends_at(text)
    place = {tuple(p): k for k, p in enumerate(phrases.tolist(), 1)}
    expected = [(i, place[tuple(w)]) for i, w in enumerate(windows.tolist()) if tuple(w) in place]
    assert list(zip(at.tolist(), row.tolist())) == expected
    assert not len(Trie(phrases, words).ends_at(text[: depth - 1])[0])
