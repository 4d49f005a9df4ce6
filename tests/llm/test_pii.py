import hashlib
import re

import pytest
from pyspark.sql import functions as F
from pagewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def check(rows, got):
    want = {}
    for d, t in rows:
        own = base(t)
        want.setdefault(d, []).append((*(sum(x.startswith(f"{k}:") for x in own) for k in PATTERNS), hashlib.sha256(",".join(own).encode()).hexdigest(), own))
    assert len(rows) == len(got)
    for r in got:
        *digest, own = want[r.doc_id].pop()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == digest
        assert [x for x in r.spans.split(",") if x and not x.startswith("id:")] == own


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert any(base(t) for _, t in rows)
    check(rows, pii.report(pii.extract(docs)).collect())


TEXTS = [
    None, "", "a@b.c_x@d.e.f a@@b.c @x.y a@b a@b..c", "🙂 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3.45.6", "4111 1111 1111 1111 4111-1111-1111-1111-4111 41111111111111112222222 79927398713",
    "+1 (377) 555-0271 +123 +12345678901234567 ++1 234 567 8901-", "é@x.de x.é@y.z 😀a@b.co,c@d.co", "a.b.c@" * 3000, "1.1.1." * 5000, "9" * 20_000, "1 " * 20_000, "x" * 60_000, "a@b" + ".c" * 20_000, "+1" * 5000, "4111111111111111\n+1 377 555 0271\t1.1.1.1 a@b.co",
]


@pytest.mark.parametrize("text", range(len(TEXTS)))
def test_edges(spark, text):
    docs = spark.createDataFrame([(7, TEXTS[text], "x")], "doc_id long, text string, base string")
    check([(7, TEXTS[text])], pii.report(pii.extract(docs)).collect())


def test_contexts(spark):
    """A context that introduces emails and phones introduces a code as well; other codes stay out."""
    rows = [(i, f"word your contact is user{i}@mail.example thanks") for i in range(6)] + [(10 + i, f"other words your contact is +1 377 555 02{i}1 thanks") for i in range(4)]
    rows += [(20, "now your contact is QX-48291-77 thanks"), (21, "year 20481977 was fine"), (21, "year 20481977 was fine"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(pii.extract(docs)).collect()
    check(rows, got)
    assert {r.doc_id: r.spans for r in got if "id:" in r.spans} == {20: "id:20:31"}
    assert pii.report(pii.extract(docs.limit(0))).count() == 0


def test_zero_parts(spark):
    """Parts of an address may be zero."""
    rows = [(1, "0.0.0.0 10.0.0.1 8.8.00.4 1.2.3.0 127.0.0.1"), (2, "000.0.00.0256 0.0.0.256 0255.000.0.010"), (3, ".".join(["0" * 4000] * 4)), (4, ".".join(["0" * 4000] * 3 + ["0" * 4000 + "300"]))]
    got = pii.report(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    check(rows, got)
    assert {r.doc_id: r.n_ip for r in got} == {1: 5, 2: 1, 3: 1, 4: 0}


def test_many_codes_in_one_text(spark):
    """A text of very many codes and addresses takes seconds, and its spans are those of short texts."""
    import time

    words = [f"{k}.1.0.{k % 256}" if k % 3 == 0 and k < 256 else f"10.0.{k % 256}.7" if k % 3 == 0 else f"c{k:07d}" for k in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    began = time.time()
    row = pii.base_spans(docs).select("base.start", "base.stop", F.size("codes").alias("n")).first()
    assert time.time() - began < 60
    at, want = 0, []
    for k, w in enumerate(words):
        if k % 3 == 0:
            want.append((at, at + len(w)))
        at += len(w) + 1
    assert list(zip(row.start, row.stop)) == want and row.n == sum(k % 3 > 0 for k in range(100_000))
