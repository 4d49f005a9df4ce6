import hashlib

import pytest
from brute import leaks
from pagewright.llm import decontaminate


def want(rows, items):
    out = []
    for d, t in rows:
        n, hit, found = leaks(t, items)
        out.append((d, n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in decontaminate.digest(df).collect()), key=str)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 3000])
def test_whole_table(spark, sf_dir, block_bytes):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert any(x[-1] for x in want(rows, [tuple(r) for r in items.collect()]))
    assert got(decontaminate.scan(docs, items, block_bytes=block_bytes)) == want(rows, [tuple(r) for r in items.collect()])


def test_edges(spark):
    items = [(1, "One two, three"), (2, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (None, "zz"), (3, None), (4, "..."), (11, "ÉT é"), (5, "a")]
    rows = [(1, "x one-TWO three one two three. y"), (2, None), (3, ""), (4, "b c d e f g h i j k, l m"), (4, "b c d e f g h i j k, l m"), (None, "a b c d e f g h i j k l"), (5, "b c d e f g h i j"), (6, "Ét É ÉT é"), (7, "a " * 50_000)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id long")
    good = [i for i in items if i[0] is not None and i[1]]
    assert got(decontaminate.scan(docs, bench)) == want(rows, good)
    spans = {r.doc_id: r.spans for r in decontaminate.scan(docs, bench).collect()}
    assert [tuple(s) for s in spans[1]] == [(2, 29)]
    assert decontaminate.scan(docs, bench.limit(0)).where("size(item_ids) > 0").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
