import random

from brute import components, patterned
from pagewright.llm import ngram_join, prefixjoin, storage

SCHEMA = "doc_id long, text string, tokens string, node long"


def rows_of(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(ngram_join.join_components(docs)) == {(d, n, c) for d, (n, c) in want.items()}


def test_families(spark, monkeypatch):
    """Families around an original with large buckets, chains, and passages that many texts share."""
    monkeypatch.setattr(ngram_join, "WHOLE", 6)
    monkeypatch.setattr(prefixjoin, "LEAD", 2)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for family in range(6):
        base = [word() for _ in range(60)] + passage * (family % 2)
        for _ in range(25):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            rows.append(own)
    chain = [word() for _ in range(80)]
    for step in range(15):
        rows.append(chain[step : step + 60])
    rows += [passage + [word() for _ in range(3)] for _ in range(20)]
    rng.shuffle(rows)
    rows = [(i, " ".join(r), "x", 1) for i, r in enumerate(rows)]
    want = components([r[:2] for r in rows])
    got = ngram_join.join_components(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got) == {(d, n, c) for d, (n, c) in want.items()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "ONE  two\n"), (6, "one two three"), (6, "one two three"), (None, "one two"), (7, "É a b c d e"), (8, "é a b c d e"), (9, "a " * 30_000)]
    got = ngram_join.join_components(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))
    found = sorted((tuple(r) for r in got.drop("text_hash").collect()), key=str)
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, 4), (7, 2, 7), (8, 2, 8), (9, 1, 9)], key=str)
    assert ngram_join.join_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, "x y"), (5, "x y"), (None, "x y"), (None, "lone"), (6, "")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, text_hash string")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs.select("doc_id", "text")).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (3, ""), (4, None), (5, "x y"), (None, "lone"), (6, "")], key=str)


def test_keep_one_with_clashing_columns(spark):
    names = ["key_id", "text_hash", "marked", "row", "gone", "n", "node"]
    docs = spark.createDataFrame([(k, "a b c d e f", *names) for k in (1, 2)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    assert [tuple(r) for r in ngram_join.keep_one(docs).collect()] == [(1, "a b c d e f", *names)]


def test_groups_in_large_buckets(spark, monkeypatch):
    """Groups (equal prefixes and sizes) of several unlinked nodes, whose links lie in buckets above WHOLE."""
    monkeypatch.setattr(ngram_join, "WHOLE", 6)
    monkeypatch.setattr(prefixjoin, "LEAD", 2)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    tails = [rng.sample(common, 7) for _ in range(30)]
    rows = [" ".join(common * 500)]
    for group in range(16):
        # the first node of each group links with those of all others, the rest with a few
        for tail in [tails[0], *rng.sample(tails[1:], 4)]:
            rows.append(" ".join(["r", "s", f"a{group}", *tail]))
    rows = [(i, r, "x", 1) for i, r in enumerate(rows)]
    want = components([r[:2] for r in rows], 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    for dealt in (docs.coalesce(1), docs.repartition(3, "doc_id")):
        got = ngram_join.join_components(dealt, 1)
        assert rows_of(got) == {(d, n, c) for d, (n, c) in want.items()}


def test_long_patterned_words_are_told_apart(spark):
    texts = [f"{w} one two three four" for n in (128, 256, 1024, 4096) for w in patterned(n)] + [patterned(2048)[0], patterned(2048)[1], patterned(2048)[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(ngram_join.join_components(docs)) == {(d, n, c) for d, (n, c) in components(list(enumerate(texts))).items()}
    docs = docs.selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == list(range(len(texts) - 1))


def test_tables_are_freed(spark, sf_dir, tmp_path, monkeypatch):
    """When the documents to drop are known, only their table is left of what was written."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert ngram_join.keep_one(spark.read.parquet(f"{sf_dir}/documents.parquet")).count()
    assert [p.name for p in tmp_path.glob("*/*")] == ["found"]
