import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pagewright.llm import variants

RUN, UPPER = re.compile("[A-Za-zÀ-ÿ]+"), {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def want(rows):
    counts = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else 0) for w, n in words.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.group_variants(df).collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = want([(r.doc_id, r.text) for r in docs.collect()])
    assert rows and got(docs) == rows


def test_edges(spark):
    long = "abcdefgh" * 40
    rows = [
        (1, "Letters " * 150 + "leters " * 25 + "letrs lettersx " * 5),
        (2, "ÀÉtage× " * 30 + "Àétage× " * 6 + "etageØĀx " * 9),
        (3, f"{long} " * 6 + f"{long}x " * 40 + f"a{long} " * 200),
        (4, None), (5, ""), (5, "1 2 ă _"), (None, "notouch " * 50 + "notouchs " * 7), (None, "notouch"),
        (6, "samely " * 5 + "sameli " * 5 + "samelx " * 5), (6, "samely " * 5),
        *((k, "hundred\x00words hundreds-words’hundred " * 3) for k in range(100, 700)),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    expected = want(rows)
    assert any(r[1] and r[2] != r[1] for r in expected) or any(r[1] for r in expected)
    assert got(docs) == expected
    assert got(docs.limit(0)) == []


def test_chain_of_forms(spark):
    docs = spark.createDataFrame([(None, "abcdef " * 2000 + "abcdefg " * 300 + "abcdefgh " * 50 + "abcdefghi " * 10)], "doc_id long, text string")
    rows = {r.word: r for r in variants.group_variants(docs).collect()}
    assert rows["abcdefghi"].form == "abcdefgh" and rows["abcdefghi"].root == "abcdef" and rows["abcdef"].form is None


@pytest.mark.parametrize("length", [6, 19, 20, 21, 40])
def test_neighbourhood_is_full(length):
    rng = np.random.default_rng(length)
    symbols = rng.integers(0, variants.SYMBOLS, (3, length)).astype(np.uint64)
    codes = variants.neighbourhood(symbols)
    for row, have in zip(symbols.tolist(), codes):
        have = set(have.tolist())
        edits = [row] + [row[:i] + row[i + 1 :] for i in range(length)]
        edits += [row[:i] + [s] + row[i + 1 :] for i in range(length) for s in range(variants.SYMBOLS)]
        edits += [row[:i] + [s] + row[i:] for i in range(length + 1) for s in range(variants.SYMBOLS)]
        assert have == {int(variants._code(np.array([e], np.uint64))[0]) for e in edits}


def test_crcs():
    texts = ["a", "letters", "x" * 64, "y" * 65, "z" * 300, "été"]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends = variants.runs_of(data, np.array([0, len(data)]))
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(starts))], np.uint32)
    assert variants.run_crcs(data, starts, ends, before).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]


def test_words_that_reduce_alike(spark):
    """Many words with one reduced spelling are all compared."""
    alike = [chr(c) for c in range(97, 123) if variants._SYMBOL[c] == variants._SYMBOL[97]]
    words = ["".join(alike[(k >> i) % len(alike)] for i in range(6)) + alike[0] for k in range(0, 64)]
    docs = spark.createDataFrame([(None, " ".join(sorted(set(words)) * 5))], "doc_id long, text string")
    assert got(docs) == want([(None, " ".join(sorted(set(words)) * 5))])


def test_no_side_of_a_join_is_broadcast(spark):
    """A neighbourhood has some hundred times the rows that Spark expects of it, so a small estimate says nothing."""
    from pagewright.llm.marks import marks_of
    from pagewright.llm.storage import Workspace

    rows = [(k, " ".join([w] * 6)) for k, w in enumerate(["abcdefgh", "abcdefgi", "bcdefgh", "zyxwvut"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    work = Workspace(spark, "test")
    coded = work.keep(variants.vocabulary(docs).mapInArrow(variants._with_codes, "word string, n long, code long"), "words")
    pairs = variants.near_pairs(coded, marks_of(coded, "code"))
    for df in (pairs, variants.group_variants(docs)):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert rows and "SortMergeJoin" in plan and "Broadcast" not in plan
