import math
import zlib

from pagewright.llm import quality as Q


def test_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    tested = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(p == q for p, q in tested) >= 0.97 * len(tested) and {p for p, _ in tested} == {0, 1}


def test_column_equals_rules(spark):
    """The compiled column against the rules applied one by one in Python."""
    model = Q.RuleModel(0.25, ((((0, True, 0.5),), 1.5), (((0, False, 0.5), (3, True, 2.0)), -2.0), (((12, False, 4.0),), 0.75)))
    texts = ["", "one two three", "| a | b |\n!!", "Line.\nLine.", "word " * 40]
    rows = Q.with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).withColumn("score", model.column()).collect()
    for r in rows:
        z = 0.25
        for rule, weight in model.rules:
            if all((r.stats[k] <= b) if below else (r.stats[k] > b) for k, below, b in rule):
                z += weight
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "b c", "a"), (2, "x " * 100_000, "a"), (2, "x", "a")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(2, 1), (2, 0), (1, None), (None, 0), (1, 7)], "doc_id long, quality int")
    assert [r.predicted for r in Q.classify(docs, none).collect()] == [1] * 5
    assert Q.classify(docs, one).where("score is null or held_out is null").count() == 0
    assert Q.classify(docs.limit(0), none).count() == 0
