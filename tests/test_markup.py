"""Markup against small cases and against a plain scan of random lines."""

import random
import re

from pagewright.operators import markup, tiers
from pyspark.sql import functions as F


START = re.compile(r"#{1,3}\s+|\s*\d{1,3}[.)]\s+|\s*[-*•]\s+|\s*>\s?")
IMAGE = re.compile(r"\s*!\[[^\]]*\]\([^)\s]+\)\s*$")


def scan(line):
    """(text, marker, bold, italic) of the parts of a line, one character at a time."""
    lead = IMAGE.match(line) or START.match(line)
    out, bold, italic = [(lead.group(), True, False, False)] if lead and lead.group() else [], False, False
    i = lead.end() if lead else 0
    while i < len(line):
        n = 2 if line.startswith("**", i) else 1
        if n == 2:
            marker = bold or "**" in line[i + 2 :]
        else:
            marker = line[i] in "*_" and (italic or line[i] in line[i + 1 :])
        out.append((line[i : i + n], marker, bold, italic))
        bold, italic, i = bold != (marker and n == 2), italic != (marker and n == 1), i + n
    return out


def kind(line):
    if IMAGE.match(line):
        return "image"
    for name, pattern in {"heading1": r"#\s+", "heading2": r"##\s+", "heading3": r"###\s+", "numbered": r"\s*\d{1,3}[.)]\s+", "bullet": r"\s*[-*•]\s+", "quote": r"\s*>"}.items():
        if re.match(pattern, line):
            return name
    return "paragraph"


def tokens(text):
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        for part, *flags in [("\n", False, False, False)] * (k > 0) + scan(line):
            flags = (*flags, "paragraph" if part == "\n" else kind(line))
            start, at = at, at + len(part)
            if out and out[-1][2:] == flags:
                start = out.pop()[0]
            out.append((start, at, *flags))
    return out


def strip(text):
    plain, offsets = "", []
    for start, stop, marker, *_ in tokens(text):
        offsets += [len(plain)] * (stop - start) if marker else range(len(plain), len(plain) + stop - start)
        plain += "" if marker else text[start:stop]
    return plain, [*offsets, len(plain)]


def runs(line):
    out = []
    for part, marker, bold, italic in scan(line):
        if marker:
            out.append(None)
        elif out and out[-1]:
            out[-1] = (out[-1][0] + part, bold, italic)
        else:
            out.append((part, bold, italic))
    return [x for x in out if x]


def test_cases_by_hand(spark):
    cases = {
        "plain": [("plain", False, False)],
        "a **b** c": [("a ", False, False), ("b", True, False), (" c", False, False)],
        "**open": [("**open", False, False)],
        "*x* and _y_": [("x", False, True), (" and ", False, False), ("y", False, True)],
        "a_b": [("a_b", False, False)],
        "***both***": [("both", True, True)],
        "**a *b** c*": [("a ", True, False), ("b", True, True), (" c", False, True)],
        "x *": [("x *", False, False)],
    }
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(cases)], "doc_id long, page_index int, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in markup.spans(pages).collect()}
    for i, (line, want) in enumerate(cases.items()):
        assert runs(line) == want and got[i] == want, line
    text = "# **T**\n- x\n\n![Image](a.jpg)\ny"
    row = pages.limit(1).select(markup.tokens(F.lit(text)).alias("t")).first().t
    assert [(text[t.start : t.stop], t.marker, t.bold, t.block) for t in row] == [
        ("# **", True, False, "heading1"), ("T", False, True, "heading1"), ("**", True, True, "heading1"), ("\n", False, False, "paragraph"), ("- ", True, False, "bullet"),
        ("x", False, False, "bullet"), ("\n\n", False, False, "paragraph"), ("![Image](a.jpg)", True, False, "image"), ("\ny", False, False, "paragraph"),
    ]


def test_random_texts_against_the_plain_scan(spark):
    rng = random.Random(3)
    pieces = ["**", "*", "_", "# ", "- ", "> ", "1. ", "word", " ", "\n", "![a](b.jpg)", "##", "é", "\U0001f600"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["* _a* " * 300, "x" * 3000 + "\n" * 200 + "**b** " * 100, "\n"]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)] + [(-1, 0, None)], "doc_id long, page_index int, text string")
    rows = {r.doc_id: r for r in pages.select("doc_id", markup.tokens(F.col("text")).alias("t"), markup.stripped(F.col("text")).alias("s")).collect()}
    assert rows[-1].t is None and rows[-1].s is None
    for i, text in enumerate(texts):
        assert [tuple(t) for t in rows[i].t] == tokens(text), text
        assert (rows[i].s.text, rows[i].s.offsets) == strip(text), text
    lines = {}
    for r in markup.spans(pages).collect():
        lines.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    for i, text in enumerate(texts):
        assert lines.get(i, []) == [runs(x.rstrip()) for x in text.split("\n") if x.rstrip()], text


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, 0, "*a* b")], "doc_id long, page_index int, text string")
    for df in (markup.token_rows(pages), markup.spans(pages), pages.select(markup.stripped(F.col("text")))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_columns_follow_the_scan(spark):
    texts = ["# Head **b**\n- item *x*\n![Image](p.jpg)\n> quote_a_b\n2) two\nplain", "no marks", "", "**Total**: 5_000_"]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_index int, text string")
    got = {r.doc_id: r.s for r in pages.select("doc_id", markup.stripped(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(texts):
        plain, offsets = strip(t)
        assert (got[i].text, got[i].offsets) == (plain, offsets)
    lines = {(r.doc_id, r.line_no): r for r in markup.spans(pages).collect()}
    assert lines[0, 0].kind == "heading1" and [tuple(s) for s in lines[0, 0].spans] == [("Head ", False, False), ("b", True, False)]
    assert lines[0, 2].kind == "image" and lines[0, 2].image_name == "p.jpg" and lines[0, 2].spans == []
    assert lines[0, 4].number == 2 and (2, 0) not in lines
    plain = {r.doc_id: r.text for r in markup.plain_text(pages).collect()}
    assert plain[0] == "Head b\nitem x\n\nquoteab\ntwo\nplain"
    assert pages.select(markup.inline_text(F.col("text")).alias("t")).first().t == "Head b item x quoteab two plain"


def test_blocks_round_trip(spark):
    texts = ["![Image](a.jpg)\n![Image](b.jpg)", "x\n\n![Image](a.jpg)\ny\nz", "", "only text\n"]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_index int, text string")
    parts = markup.text_and_images(pages)
    first = [(r.kind, r.value) for r in parts.where("doc_id = 0").orderBy("block_no").collect()]
    assert first == [("text", ""), ("image", "a.jpg"), ("text", ""), ("image", "b.jpg"), ("text", "")]
    back = {r.doc_id: r.text for r in markup.serialised(parts).collect()}
    assert [back[i] for i in range(4)] == ["![Image](a.jpg)\n![Image](b.jpg)", "x\n\n![Image](a.jpg)\ny\nz", "", "only text\n"]


def test_snippets_highlight_what_was_asked(spark):
    page = "start " * 20 + "the **Total amount**\ndue is 5 " + "end " * 30
    pages = spark.createDataFrame([(1, 0, page), (1, 1, "nothing"), (1, 2, "amount first, then total")], "doc_id long, page_index int, text string")
    asked = spark.createDataFrame([(7, "total amount due"), (8, "amount"), (9, "a")], "qid long, query string")
    hits = spark.createDataFrame([(7, 1), (8, 1), (9, 1)], "qid long, doc_id long")
    rows = tiers.snippets(tiers.places(hits, asked, pages)).orderBy("qid", "page_index").collect()
    marked = [(r.qid, r.page_index, r.snippet[r.highlight_start : r.highlight_start + r.highlight_length]) for r in rows]
    assert marked == [(7, 0, "Total amount due"), (7, 2, "amount"), (8, 0, "amount"), (8, 2, "amount")]
    assert rows[0].snippet.startswith("…") and rows[0].snippet.endswith("…") and "*" not in rows[0].snippet and not rows[1].snippet.startswith("…")
