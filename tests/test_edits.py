"""Edits, names, layout and transcripts on hand-made rows."""

from pagewright.operators import archives, layout, library, transcripts
from pagewright.sources import incoming
from pyspark.sql import functions as F


def test_recognition_touches_only_pages_that_wait(spark):
    pages = spark.createDataFrame([(1, 0, "old", "image", "pending"), (1, 1, "keep", "image", "failed"), (1, 2, "done", "image", "completed"), (1, 3, "w", "text", "completed")], "doc_id long, page_index int, text string, kind string, ocr_status string")
    results = spark.createDataFrame([(1, 0, "new", True), (1, 1, None, False), (1, 2, "no", True), (1, 3, "no", True)], "doc_id long, page_index int, new_text string, ok boolean")
    got = library.apply_recognition(pages, results).orderBy("page_index").collect()
    assert [(r.text, r.ocr_status, r.tried) for r in got] == [("new", "completed", True), ("keep", "failed", True), ("done", "completed", False), ("w", "completed", False)]


def test_document_edits(spark):
    docs = spark.sql("select 1L doc_id, 'A' title, true is_favorite, array('x') tags, timestamp '2026-01-01' updated_at union all select 2L, 'B', false, array('y'), timestamp '2026-01-01'")
    renames = spark.sql("select 1L doc_id, timestamp '2026-02-01' ts, 'A' new_title union all select 2L, timestamp '2026-02-01', 'early' union all select 2L, timestamp '2026-03-01', 'late'")
    toggles = spark.sql("select 1L doc_id union all select 2L union all select 2L")
    got = library.edit_documents(docs, renames, toggles, spark.sql("select 1L doc_id, timestamp '2026-01-05' ts, array('z') new_tags limit 0")).orderBy("doc_id").collect()
    assert [(r.title, r.is_favorite, str(r.updated_at)[:10]) for r in got] == [("A", False, "2026-01-01"), ("late", False, "2026-03-01")]


def test_unique_names(spark):
    names = ["Invoice.pdf", "invoice.pdf", "Invoice (2).pdf", "invoice.PDF", "a", "A", ".env", ".env", "x.tar.gz", "X.tar.gz"]
    rows = [("z", i, n) for i, n in enumerate(names)]
    got = archives.unique_names(spark.createDataFrame(rows, "archive string, entry_no long, name string")).orderBy("entry_no").collect()
    taken, want = set(), []
    for n in names:
        dot = n.rfind(".")
        stem, ext = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        c, k = n, 2
        while c.lower() in taken:
            c, k = f"{stem} ({k}){ext}", k + 1
        taken.add(c.lower())
        want.append(c)
    assert [r.unique for r in got] == want


def test_merge_plan_is_cut(spark):
    rows = [("a", s, p) for s in range(3) for p in range(4)] + [("b", 0, p) for p in range(9)] + [("c", 0, 0), ("c", 1, 0)]
    got = archives.merge_plan(spark.createDataFrame(rows, "bundle string, source_no long, page_no long"), 10).collect()
    assert len([r for r in got if r.bundle == "a"]) == 10 and all(r.truncated for r in got if r.bundle == "a")
    assert not [r for r in got if r.bundle == "b"] and [r.truncated for r in got if r.bundle == "c"] == [False, False]


def test_files_are_read_as_utf8(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\n")
    (tmp_path / "b.txt").write_bytes(b"caf\xff")
    (tmp_path / "c.txt").write_bytes(b" \n ")
    got = {r.path[-5:]: r for r in incoming.imported_texts(incoming.files(spark, str(tmp_path))).collect()}
    assert got["a.txt"].text == "one\n" and got["b.txt"].text == "caf�"
    assert got["c.txt"].text is None and got["c.txt"].reason


def test_picture_imports_are_cut(spark):
    rows = [("x", i, f"p{i}.png") for i in range(40)] + [("x", 99, "n.exe"), ("y", 1, "a.pdf"), ("y", 2, "b.JPG")]
    got = {r.batch: r for r in incoming.picture_imports(spark.createDataFrame(rows, "batch string, file_no long, name string")).collect()}
    assert (got["x"].taken, got["x"].truncated, got["x"].rejected) == (30, True, "n.exe")
    assert (got["y"].taken, got["y"].truncated, got["y"].rejected) == (1, False, "a.pdf")


def boxes(spark, rows):
    each = [(1, 0, b, 0, e, None, t, float(x), float(y), float(x + 30), float(y + h)) for b, e, t, x, y, h in rows]
    return spark.createDataFrame(each, "doc_id long, page_index long, block_no long, line_no long, element_no int, line_text string, text string, l double, t double, r double, b double")


def test_layout(spark):
    rows = [(0, 0, "Account", 0, 0, 10), (0, 1, "number", 40, 0, 10), (1, 0, "12345", 300, 2, 10), (2, 0, "Total", 0, 13, 10), (3, 0, "9.50", 300, 9, 10), (4, 0, "Next", 0, 60, 10)]
    text = layout.compose(layout.rows(layout.lines(boxes(spark, rows)))).first().text
    assert text == "Account number 12345\nTotal 9.50\n\nNext"
    turned = boxes(spark, [(0, 1, "first", 10, 0, 10), (0, 0, "second", 90, 0, 10)])
    assert layout.lines(turned).first().text == "first second"
    bare = turned.limit(1).withColumns({"element_no": F.lit(None).cast("int"), "line_text": F.lit(" as  it is ")})
    assert layout.lines(bare).first().text == "as it is"


def test_turns_and_keys(spark):
    q = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "conv_id long, seq long, question string")
    a = spark.createDataFrame([(1, 1, "yes")], "conv_id long, seq long, answer string")
    got = transcripts.turns(q, a).orderBy("seq").collect()
    assert [(r.role, r.text, r.error is None) for r in got] == [("user", "a", True), ("assistant", "yes", True), ("user", "b", True), ("assistant", "", False)]
    m = spark.createDataFrame([(1, None), (None, 7), (None, None)], "conv_id long, document_id long")
    assert sorted(r.key for r in transcripts.keyed(m).collect()) == ["1", "legacy:7", "legacy:library"]
