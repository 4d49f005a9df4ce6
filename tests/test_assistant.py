"""A small library of written-out documents: what questions, facts, routes and explanations come to, as worked out by hand."""

import pytest
from pagewright.operators import answers, dialogue, facts, passages, questions, summaries

BILL = """Account number: NW-4471902
Account holder: Mary Jones
Supply address: 14 Mill Lane
Invoice date: 12/03/2026
Payment due: 2 April 2026
Total payable: £248.60
Questions? billing@northwind.example or +44 20 7946 0958"""
LEASE = "This agreement is made between Anna Smith and Peter Brown for the flat in Leeds. The tenant shall pay a deposit of £1,200.00 before moving in. It starts on 1 May 2026 and ends on 30 April 2027."
REPORT = "# Project report\n## Costs\nThe **build** cost was *lower* than planned this year.\n- first point\n1. second point\n> a quoted line of the review\n![Image](a.jpg)\n## Plan\nWe continue with the second phase in autumn."
LIBRARY = [("Electricity bill", [BILL, "Total payable: £248.60\nSecond page of the electricity bill."], 3), ("Rental agreement", [LEASE], 2), ("Project report", [REPORT], 1), ("Passport", [""], 4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "\n".join(p), ["x"], day) for i, (t, p, day) in enumerate(LIBRARY)]
    return spark.createDataFrame(rows, "doc_id long, title string, text string, tags array<string>, day int").selectExpr("*", "timestamp '2026-01-01' + make_interval(0, 0, 0, day) as updated_at")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, k, p) for i, (_, ps, _) in enumerate(LIBRARY) for k, p in enumerate(ps)], "doc_id long, page_index int, text string")


def asked(spark, *texts):
    return questions.analysis(spark.createDataFrame(list(enumerate(texts)), "qid long, question string"))


def test_facts(pages):
    got = {}
    for r in facts.top(pages.where("doc_id < 2")).orderBy("rk").collect():
        got.setdefault((r.doc_id, r.intent), []).append(r.value)
    assert got[0, "date"] == ["12/03/2026", "2 April 2026"] and got[1, "date"] == ["1 May 2026", "30 April 2027"]
    assert got[0, "amount"] == ["£248.60"] and got[1, "amount"] == ["£1,200.00"]
    assert got[0, "person"] == ["Mary Jones"] and got[1, "person"] == ["Anna Smith", "Peter Brown"]
    assert "billing@northwind.example" in got[0, "contact"] and "NW-4471902" in got[0, "identifier"] and got[0, "place"] == ["14 Mill Lane"]


def test_routes(spark, docs):
    texts = ["What is the total payable?", "Summarise the rental agreement", "Summarise my latest document", "Find all dates", "List the names in the rental agreement", "Explain this document", "Explain: the tenant shall pay", "explain", "?", "Summarise the zebra contract of mars"]
    q = asked(spark, *texts)
    got = {r.qid: (r.route, r.target) for r in dialogue.routed(q, dialogue.targets(docs, q)).collect()}
    assert got[0][0] == "retrieve" and got[1] == ("summarise", 1) and got[2] == ("summarise_latest", None) and got[3] == ("find_in_library", None)
    assert got[5][0] == "explain_latest" and got[6][0] == "explain_passage" and got[7][0] == "nothing_to_explain" and got[8][0] == "unclear"
    assert got[4][1] == 1 and got[9][0] in ("ask_which_document", "summarise")


def test_findings(spark, docs, pages):
    scopes = spark.createDataFrame([("bill", 0, 1), ("both", 0, 1), ("both", 1, 2), ("none", 3, 1)], "scope string, doc_id long, place int")
    values = dialogue.scope_values(pages, scopes, 15)
    names = spark.createDataFrame([("bill", "Electricity bill"), ("both", "your documents"), ("none", "Passport")], "scope string, name string")
    wanted = spark.createDataFrame([(1, "bill", "amount"), (2, "both", "date"), (3, "both", "person"), (4, "none", "date")], "qid long, scope string, intent string")
    got = {r.qid: r for r in dialogue.findings(wanted, values, names).collect()}
    assert got[1].text == "I found one amount in Electricity bill:\n• £248.60" and got[1].confidence == "strong"
    assert got[2].text.startswith("I found four dates in your documents:\n• 12/03/2026\n• 2 April 2026\n• 1 May 2026")
    assert got[3].confidence == "partial" and got[3].n == 3
    assert (got[4].kind, got[4].text, got[4].confidence) == ("no_match", "I could not find any dates in Passport.", None)
    digest = {r.qid: r for r in dialogue.digests(spark.createDataFrame([(1, "bill"), (4, "none")], "qid long, scope string"), values, names).collect()}
    assert digest[1].text.startswith("Here is what stands out in Electricity bill:\n\nDates\n• 12/03/2026\n• 2 April 2026\n\nAmounts\n• £248.60\n\nNames\n• Mary Jones")
    assert digest[4].kind == "no_match"


def test_answers_and_citations(spark, docs, pages):
    q = asked(spark, "What is the total payable?", "What deposit shall the tenant pay?", "Where do zebras live?")
    cand = answers.priors(docs, q)
    chosen = answers.select(answers.rank(q, pages, cand))
    best = {r.qid: r for r in chosen.where("rk = 1").collect()}
    assert best[0].text == "Total payable: £248.60" and best[0].shaped and "deposit" in best[1].text and 2 not in best
    cited = dialogue.cited_documents(chosen).collect()
    assert {r.qid: r.documents[0] for r in cited} == {0: 0, 1: 1}
    merged = spark.createDataFrame([(1, 1, 0, 0, 0.5, ["a"]), (1, 2, 0, 0, 1.5, ["b", "a"]), (1, 3, 0, 1, -1.0, ["c"])], "qid long, place int, doc_id long, page_index int, relevance double, terms array<string>")
    rows = {r.page_index: (r.place, r.terms, r.relevance) for r in dialogue.page_citations(merged).collect()}
    assert rows == {0: (1, ["a", "b"], 1.0), 1: (3, ["c"], 0.0)}


def test_scope_and_fallback(spark, docs, pages):
    q = asked(spark, "What is the total payable?").selectExpr("*", "1L as scope_doc_id")
    assert [(r.doc_id, r.prior) for r in dialogue.scoped_priors(docs, q).collect()] == [(1, 1.0)]
    none = asked(spark, "When does the zebra arrive?", "Where is it?", "What is the total payable?")
    left = {r.qid for r in answers.fallbacks(none, answers.select(answers.rank(none, pages, answers.priors(docs, none)))).collect()}
    assert 0 in left and 2 not in left


def test_explanations(docs, pages):
    topics = summaries.outlines(docs, pages, summaries.scores(passages.passages(pages)))
    counts = facts.top(pages, 20).groupBy("doc_id", "intent").count().withColumnRenamed("count", "n")
    got = {r.doc_id: r.text for r in dialogue.explained(topics, counts, docs.select("doc_id", "title")).collect()}
    assert got[2].startswith("“Project report” covers Costs and Plan.")
    assert got[1].startswith("“Rental agreement” is about “This agreement is made between Anna Smith and Peter Brown") and "It records two dates, one amount and two names." in got[1]
    assert got.get(3) is None


def test_suggestions(docs):
    got = {r.doc_id: r.questions for r in dialogue.suggested(docs).collect()}
    assert got[0] == ["Summarise this document", "Find important dates", "Find amounts", "Find names"] and got[2][0] == "Summarise this document" and 3 not in got
    assert dialogue.suggested_for_library(docs).first().questions == ["Summarize my latest document", "What is the Electricity bill about?", "Find all important dates", "Who is mentioned in my documents?"]


def test_related_leaves_the_same_text_out(spark, docs, pages):
    q = asked(spark, "The tenant shall pay a deposit of £1,200.00 before moving in.", "Total payable")
    rows = dialogue.related(docs, pages, q).collect()
    assert not [r for r in rows if r.qid == 0 and "tenant shall pay" in r.text] and [r for r in rows if r.qid == 1]
    assert dialogue.recorded(pages.where("doc_id = 0 and page_index = 0")).where("intent = 'date'").first()["values"] == "12/03/2026, 2 April 2026"


def test_control_characters_move_nothing(spark):
    texts = ["A \x01 broken scan line, paid on 2024-01-02 by Jane Doe", "\x02\x01Second one here.\x01 Call +44 20 7946 0958 now\x02. Third\x00 is at x@y.example", "\x01" * 40]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_index int, text string")
    found = sorted((r.doc_id, r.kind, r.value) for r in facts.located(pages).collect())
    assert [f for f in found if f[1] in ("date", "name", "email")] == [(0, "date", "2024-01-02"), (0, "name", "Jane Doe"), (1, "email", "x@y.example")]
    clean = str.maketrans("\x01\x02", "  ")
    assert all(texts[r.doc_id].translate(clean)[r.start : r.start + len(r.value)] == r.value for r in facts.located(pages).collect())
    cut = passages.passages(pages).collect()
    assert len(cut) >= 3 and all(texts[r.doc_id].translate(clean)[r.start : r.stop] == r.text for r in cut)
