import random

import numpy as np
from brute import dedup_lines, patterned
from pagewright.llm import line_dedup, prefixjoin, queries, sketch, storage, textnum


def same(df, rows):
    got = line_dedup.dedup(df)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(dedup_lines(rows), key=str)
    return got


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = same(docs, rows)
    assert got.where("n_removed > 0").count() > 0 and set(docs.columns) < set(got.columns)


def test_families(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "WHOLE", 5)
    monkeypatch.setattr(prefixjoin, "LEAD", 2)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("abcdef") + rng.choice("xyz")
    bases = [[word() for _ in range(rng.choice([6, 12, 40, 200]))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            own = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = word()
            lines.append(" ".join(own))
        rows.append((d, "\n".join(lines)))
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_edges(spark):
    line = "one two three four five six"
    rows = [(1, None), (2, ""), (2, ""), (3, "\n\n"), (4, f"{line}\nshort one\n"), (5, f"short one\n{line.upper()}\n\n{line}"), (5, f"x\n{line}"), (6, f"{line}\r\n{line} seven"), (6, f"{line}\r\n{line} seven"), (None, line), (7, " ".join(f"w{i}" for i in range(30_000)))]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, node string, line int")
    same(docs, rows)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_short_lines(spark, sf_dir, tmp_path):
    """In the query every line with a word takes part, however few distinct words it has."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    top = max(d for d, _ in rows)
    for d in range(top + 1, top + 60):
        rows.append((d, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 4)))))
    rows += [(top + 100, "one\n\none\nOne  ONE"), (top + 101, "a b a b " * 200 + "\nx y z q\nx y z q w"), (top + 102, "a b a b " * 200), (None, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.text) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(dedup_lines(rows, 1), key=str)
    assert (top + 100, "one\n") in got and (top + 102, "") in got


def test_clashing_columns(spark):
    names = ["doc", "text_hash", "gone", "marked", "row", "line", "node", "n_lines"]
    line = "one two three four five six"
    rows = [(k, f"{line}\nown {k}", *(f"{n}{k}" for n in names)) for k in range(3)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    found = sorted(got.select("doc_id", "text", *names[:-1], "n_lines", "n_removed").collect())
    assert [tuple(r) for r in found] == [(k, f"{line}\nown {k}" if k == 0 else f"own {k}", *(f"{n}{k}" for n in names[:-1]), 2, int(k > 0)) for k in range(3)]


def test_long_patterned_words_are_told_apart(spark):
    rows = [(n, "\n".join(f"{w} one two three four" for w in patterned(n))) for n in (128, 1024, 4096)] + [(9999, "\n".join(patterned(1024)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(docs, rows).where("n_removed > 0").count()
    got = line_dedup.dedup(docs, least=1)
    assert got.where("n_removed > 0").count() == 0


def test_tables_are_freed(spark, sf_dir, tmp_path, monkeypatch):
    """When the lines to remove are known, only their table is left of what was written."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert line_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).count()
    assert [p.name for p in tmp_path.glob("*/*")] == ["removed"]


def test_one_python_worker_a_task_and_one_reading_for_sets(spark, monkeypatch):
    """Each Python node of a task has a worker of its own beside the JVM, and every reading of the texts costs as much as the first."""
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(90)}" for _ in range(20)] for _ in range(8)]
    rows = []
    for d in range(80):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 3, 5])):
            own[rng.randrange(len(own))] = f"w{rng.randrange(90)}"
        rows.append((d, " ".join(own)))
    plans, read, keep, sets = {}, [], storage.Workspace.keep, line_dedup._node_sets

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(storage.Workspace, "keep", kept)
    monkeypatch.setattr(line_dedup, "_node_sets", lambda *args: read.append(1) or sets(*args))
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert plans["firsts"].count("ArrowEvalPython") == 1 and "shadowed_left" in plans
    assert len(read) == 1


def test_flags_are_counters_above_none(spark):
    keys = spark.range(5000).selectExpr("id * 7919 as key").repartition(3)
    hashes = lambda batch: [textnum.mix(batch["key"].to_numpy().view("u8"))]
    flags = sketch.flags(keys, hashes, 16)
    assert flags.nbytes == 1 << 13 and (np.unpackbits(flags) == (sketch.levels(keys, hashes, 16) > 0)).all()
    assert not sketch.flags(keys.limit(0), hashes, 16).any()
