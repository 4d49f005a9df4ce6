"""Limits that the given tables do not reach."""

from pagewright.operators import archives
from pagewright.plans import catalog
from pagewright.streaming import live


def test_build_plan(spark):
    rows = [("a", 1, 40), ("a", 2, 60), ("b", 1, 90), ("b", 2, 20), ("b", 3, 5), ("c", 1, 1), ("c", 2, 1), ("c", 3, 1), ("c", 4, 1)]
    entries = spark.createDataFrame(rows, "archive string, entry_no long, size long")
    plan = archives.build_plan(entries, 3, 100).orderBy("archive", "entry_no").collect()
    assert [(r.archive, r.entry_no, r.running) for r in plan] == [("a", 1, 40), ("a", 2, 100), ("b", 1, 90), ("b", 2, 110), ("b", 3, 115), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3), ("c", 4, 4)]
    assert [(r.taken, r.reason) for r in plan] == [(True, None)] * 2 + [(False, "too many bytes")] * 3 + [(False, "too many sources")] * 4
    assert archives.build_plan(entries).where("not taken").count() == 0


def said(spark, path, n):
    spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(n)], "conv_id long, turn int, role string, text string").write.parquet(path)


def test_stream_transcripts_keep_200(spark, tmp_path):
    said(spark, f"{tmp_path}/conversations.parquet", 230)
    got = sorted((r.turn, r.rk) for r in catalog.QUERIES["stream_transcripts"](spark, str(tmp_path)).collect())
    assert got == [(t, 230 - t) for t in range(30, 230)]


def test_transcripts_over_batches_and_a_restart(spark, tmp_path):
    """State outlives the query; a batch only brings its own messages; late ones find their place."""
    kind = "conv_id long, turn int, role string, text string"
    batches = [
        [(1, t, "user", f"m{t}") for t in range(100, 200)] + [(2, 5, "assistant", "hello"), (3, None, "user", "no turn")],
        [(1, t, "assistant", "x") for t in range(200, 330)] + [(2, 4, "user", "  ")],
        [(1, 7, "user", "the first question"), (2, 9, "user", None), (2, 6, "user", "what is it")],
    ]

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = live.live_transcripts(stream, f"{tmp_path}/at", f"{tmp_path}/state")
        query.awaitTermination()
        view = live.current_view(spark, f"{tmp_path}/at")
        turns = {}
        for r in live.transcripts_of(view).orderBy("conv_id", "rk").collect():
            turns.setdefault(r.conv_id, []).append(r.turn)
        return turns, {r.conv_id: (r.title, r.n_messages, r.last_turn) for r in live.conversations_of(view).collect()}, [p.numInputRows for p in query.recentProgress if p.numInputRows]

    for k in (0, 1):
        spark.createDataFrame(batches[k], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    turns, known, read = run()
    assert turns[1] == list(range(329, 129, -1)) and known[1] == ("m100", 230, 329) and known[2] == ("Conversation", 2, 5) and known[3] == ("Conversation", 1, None)
    assert sorted(read) == [102, 131]
    spark.createDataFrame(batches[2], kind).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    turns, known, read = run()
    assert read == [3]
    assert len(turns[1]) == 200 and turns[1][0] == 329 and known[1] == ("the first question", 231, 329)
    assert turns[2] == [9, 6, 5, 4] and known[2] == ("what is it", 4, 9)


def test_files_that_are_dropped_are_read_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one")
    (source / "b.exe").write_text("two")
    (source / "c.md").write_text("  ")

    def run():
        live.drop_folder(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        read = lambda kind: spark.read.parquet(f"{tmp_path}/out/{kind}").collect()
        return sorted(r.text for r in read("texts")), sorted(r.path[-5:] for r in read("rejected"))

    assert run() == (["one"], sorted(["/c.md", "b.exe"]))
    (source / "d.txt").write_text("three")
    assert run() == (["one", "three"], sorted(["/c.md", "b.exe"]))
