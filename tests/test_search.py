"""Tiers against a plain version on hand-made documents."""

import math
import random
import re
import time

from pagewright.operators import search, tiers

DOCS = [
    (1, "Rent", "Monthly rent for the flat. The amount due is 900.", ["home"]),
    (2, "Rent and utilities", "Water and power.", ["home", "rent"]),
    (3, "Invoice", "The smart island resort: amount, due soon. Amount due. amount but due", ["bills"]),
    (4, "Amount due notice", "", ["bills", "late"]),
    (5, "Überweisung", "Die Gebühr für die Überweisung ist hoch, Gebühr für.", ["bank"]),
    (6, "Empty", "", []),
    (7, "a-b", "x1 y2 z3 (x1, y2)", ["late fee"]),
]
ASKED = ["rent", "amount due", "art is", "late", "gebühr für", "x1 y2", "rent late", "a", "  ", "unknown words", "smart island resort amount"]


def tokens(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if len(t) >= 2]


def plain(query):
    words = tokens(query)
    terms = list(dict.fromkeys(words))
    out = {}
    if len(query.strip()) < 2 or not terms:
        return out
    for d, title, text, tags in DOCS:
        own, body = tokens(title), tokens(text)
        m = sum(t in own for t in terms)
        n = len(re.findall("[^A-Za-z0-9]+".join(map(re.escape, words)), text, re.I)) if len(words) > 1 else 0
        by_tag = [t for t in terms if t in {x for g in tags for x in tokens(g)}]
        if own == words:
            out[d] = "exact_title"
        elif m == len(terms):
            out[d] = "partial_title"
        elif n:
            out[d] = ("phrase", round(n / max(1, len(body)), 6))
        elif any(t in body for t in terms):
            out[d] = "content"
        elif by_tag:
            out[d] = ("tag", round(len(by_tag) / len(terms), 6))
        elif m:
            out[d] = ("partial_title", round(m / len(terms) * 0.5, 6))
    return out


def test_tiers(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string, tags array<string>")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    got = {}
    for r in tiers.ranked(docs, asked).collect():
        got.setdefault(r.qid, {})[r.doc_id] = (r.kind, r.score, r.rk)
    for q, text in enumerate(ASKED):
        want = plain(text)
        assert set(got.get(q, {})) == set(want), text
        for d, kind in want.items():
            assert got[q][d][0] == (kind if isinstance(kind, str) else kind[0]), (text, d)
            assert isinstance(kind, str) or abs(got[q][d][1] - kind[1]) < 1e-6
        places = sorted((tiers.PRIORITY[k], -s, d) for d, (k, s, _) in got.get(q, {}).items())
        assert [d for *_, d in places] == [d for d, _ in sorted(got.get(q, {}).items(), key=lambda x: x[1][2])]
    assert got[1][3][0] == "phrase" and got[2][3][0] == "phrase"


def test_results_are_cut_and_ghosts_dropped(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "same words here", ["x"]) for i in range(60)], "doc_id long, title string, text string, tags array<string>")
    asked = spark.createDataFrame([(1, "words")], "qid long, query string")
    assert sorted(r.doc_id for r in tiers.ranked(docs, asked).collect()) == list(range(50))
    alive = docs.where("doc_id >= 5").select("doc_id")
    assert sorted(r.doc_id for r in tiers.ranked(docs, asked, alive).collect()) == list(range(5, 55))


def scored(docs, text, most):
    """The whole search in plain Python, for (id, title, text, tags)."""
    n, lengths = len(docs), [len(tokens(t)) for _, _, t, _ in docs]
    mean = sum(x for x in lengths if x) / sum(x > 0 for x in lengths)
    words = tokens(text)
    terms, out = list(dict.fromkeys(words)), []
    for (d, title, body, tags), size in zip(docs, lengths):
        own, body_words = tokens(title), tokens(body)
        m, by_tag = sum(t in own for t in terms), [t for t in terms if t in {x for g in tags for x in tokens(g)}]
        occ = len(re.findall("[^A-Za-z0-9]+".join(words), body, re.I)) if len(words) > 1 else 0
        bm25 = sum(math.log1p((n - 0.5) / 1.5) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size / mean)) for c in map(body_words.count, terms) if c)
        if own == words:
            out.append((0, -1 / (1 + len(own)), d))
        elif m == len(terms):
            out.append((1, -m / len(own), d))
        elif occ:
            out.append((2, -occ / max(1, size), d))
        elif bm25:
            out.append((3, -bm25, d))
        elif by_tag:
            out.append((4, -len(by_tag) / len(terms), d))
        elif m:
            out.append((1, -m / len(terms) * 0.5, d))
    return [(d, k, round(-s, 6)) for k, s, d in sorted((k, round(s, 6), d) for k, s, d in out)][:most]


def test_ranked_equals_the_plain_search(spark, monkeypatch):
    """Also with copies, titles that the text lacks, several blocks of queries and steps of few documents."""
    rng = random.Random(5)
    pool = ["aa", "bb", "cc", "dd", "é", "éa", "zug", "für", "x1", "smart", "island"] + [f"w{k}" for k in range(40)]
    say = lambda most: " ".join(rng.choice(pool) for _ in range(rng.randint(0, most)))
    docs = [(k, say(3), say(30), [rng.choice(pool), "tag"]) for k in range(150)]
    docs += [(1000 - k, docs[7][1], docs[7][2], docs[7][3]) for k in range(60)] + [(2000 + k, "w1 w2", "", ["only"]) for k in range(5)]
    asked = [say(6) for _ in range(120)] + ["only", "w1 w2", "w2 w1", "tag only", "rt isl", "nothing here", docs[7][1], docs[7][2]]
    monkeypatch.setattr(tiers, "RANKED", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        table = spark.createDataFrame(docs, "doc_id long, title string, text string, tags array<string>")
        for most in (1, 6):
            got = {}
            for r in tiers.ranked(table, spark.createDataFrame(list(enumerate(asked)), "qid long, query string"), most=most).orderBy("qid", "rk").collect():
                got.setdefault(r.qid, []).append((r.doc_id, tiers.PRIORITY[r.kind], r.score))
            for q, text in enumerate(asked):
                want = scored(docs, text, most) if tokens(text) and len(text.strip()) >= 2 else []
                assert [x[:2] for x in got.get(q, [])] == [x[:2] for x in want], text
                assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got.get(q, []), want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_queries_over_many_documents(spark):
    """Terms that nearly all have are compared in the tasks: no row for each query, document and term."""
    docs = spark.range(6000).selectExpr("id doc_id", "'t' || id title", "array_join(transform(sequence(1, 60), k -> 'w' || (id * k * 7919) % 83), ' ') text", "array('tag') tags")
    asked = spark.range(3000).selectExpr("id qid", "array_join(transform(sequence(1, 12), k -> 'w' || (id * k * 104729) % 83), ' ') query")
    began = time.time()
    found = tiers.ranked(docs, asked, most=6)
    assert found.count() == 18_000 and time.time() - began < 60
    every = tiers.tiers(docs, tiers.normalised(asked).select("key").limit(5))
    for df in (found, every):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
