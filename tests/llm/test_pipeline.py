"""The stages against plain versions of them, stage by stage on the input each one had."""

import corpus_pipeline as C
from brute import components, dedup_lines, leaks
from pagewright.llm import quality


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = pairs(docs)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == list(C.COLUMNS)
        kept[name] = pairs(docs)
    judged = quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in judged.collect() if r.predicted}
    assert kept["quality_classifier"] == [r for r in start if r[0] in good]
    before = dict(kept["quality_classifier"])
    assert kept["line_dedup"] == sorted((d, t) for d, t in dedup_lines(kept["quality_classifier"]) if t.split() or t == before[d])
    own = components(kept["line_dedup"])
    assert kept["ngram_jaccard_join"] == [r for r in kept["line_dedup"] if own[r[0]][1] == r[0]]
    assert kept["benchmark_decontamination"] == [r for r in kept["ngram_jaccard_join"] if not leaks(r[1], items)[1]]
    sizes = [len(kept[name]) for name in kept]
    assert len(start) > sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    packed = C.run(spark, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in kept["benchmark_decontamination"]}


def tables(spark, path, rows, labels=((1, 1, 0), (2, 0, 0)), items=()):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_edges(spark, tmp_path):
    """Nulls, empty and repeated rows go through every stage; what is no duplicate or leak is packed once."""
    own = [" ".join(f"w{d}x{i}" for i in range(30)) for d in range(8)]
    rows = [(d, own[d], "en", "a", len(own[d])) for d in range(6)] + [(2, own[2], "en", "a", 1), (6, own[0], "en", None, None), (7, None, None, None, None), (8, "", "en", "a", 0), (None, own[6], "en", "a", 1), (9, own[7], "en", "a", 1)]
    tables(spark, str(tmp_path), rows, [(d, 1, 0) for d in range(6)], [(1, own[7]), (2, None), (3, "")])
    got = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, 7, 8, None}
    starts = [(r.doc_id, r.start) for r in got]
    assert len(starts) == len(set(starts))
    assert [r.doc_tokens for r in got if r.doc_id in (7, 8)] == [1, 1]


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [], [])
    assert C.run(spark, str(tmp_path)).count() == 0
