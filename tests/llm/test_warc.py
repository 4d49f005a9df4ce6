import gzip
import hashlib
import io

import pytest
from pagewright.llm import warc
from pagewright.llm.storage import Workspace


def want(rows):
    """rows: (page_id, url, html)"""
    rows, least = [(i, (h or "").encode()) for i, _, h in rows], {}
    for i, h in rows:
        if len(h) >= 100 and i is not None:
            least[h] = min(least.get(h, i), i)
    out = []
    for i, h in rows:
        first = least.get(h)
        revisit = first is not None and (i is None or i > first)
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)


PAGES = [
    (1, "https://a.example/", "<p>" + "x" * 200), (3, "https://a.example/b", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (None, "u", "<p>" + "x" * 200),
    (4, "u", None), (5, "u", ""), (6, "u", "y" * 99), (7, "u", "y" * 99), (8, "u\r\nX: y", "z" * 100), (8, "v", "z" * 100), (9, "w", "z" * 100), (8, "u\r\nX: y", "z" * 100),
    (10, "u", "€é\x00\r\n\r\n" * 9000), (12, "u", "€é\x00\r\n\r\n" * 9000), (10, "u", "€é\x00\r\n\r\n" * 9000), (11, "u", "WARC/1.1\r\n\r\n" * 700),
    (None, "u", "no id " * 3000), (None, "u", "no id " * 3000), (13, "u", "q" * 3_000_000),
]


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(pages) == want([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_edges(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, kind int")
    assert got(pages) == want(PAGES)
    assert got(pages.limit(0)) == []


def test_few_hot_payloads_and_many_shared_ones(spark, monkeypatch):
    pages = [(k, "u", "hot " * 40) for k in range(300)] + [(1000 + k, "u", f"shared {k // 2} " * 20) for k in range(300)]
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    assert got(spark.createDataFrame(pages, "page_id long, url string, html string")) == want(pages)


def test_payloads_and_segments(spark):
    """What is read back is what was written, in files of another size too, and from one place or two."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    work = Workspace(spark, "test")
    whole, cut = warc.write(pages, work, "small", segment_bytes=100, chunk_bytes=37)
    rows = warc.payloads(warc.read(spark, whole, cut)).collect()
    assert all(r.problem is None for r in rows) and len(rows) == len(PAGES)
    assert max(r.n_segments for r in rows) > 10_000
    payloads = sorted(bytes(r.payload) for r in rows if r.record_type == "response")
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert all(r.payload is None and r.refers_to in {x.record_id for x in rows} for r in revisits)
    assert payloads == sorted((h or "").encode() for _, (i, _, h) in zip(range(99), PAGES) if not (i in (2, 3, 9, 12) or i is None and h.startswith("<p>")))
    apart = warc.payloads(warc.read(spark, whole), warc.read(spark, cut)).collect()
    assert sorted(map(str, apart)) == sorted(map(str, rows))


def _archive(records):
    return b"".join(r + b"\r\n" for _, r in records)


def _problems(spark, tmp_path, content):
    (tmp_path / "a.warc").write_bytes(content)
    return {r.record_id: (r.problem, r.payload) for r in warc.payloads(warc.read(spark, f"file://{tmp_path}")).collect()}


def test_faults_are_named(spark, tmp_path):
    html = b"0123456789" * 100
    digest = hashlib.sha256(html).hexdigest()
    good = list(warc.records_of(1, "u", html, digest, None, 0, 300))
    own = warc.record_id(1, 0, digest)
    assert len(good) > 3
    assert _problems(spark, tmp_path, _archive(good[::-1])) == {own: (None, html)}
    assert _problems(spark, tmp_path, _archive(good[:1] + good[2:]))[own][0] == "segment missing or repeated"
    assert _problems(spark, tmp_path, _archive(good + good[1:2]))[own][0] == "segment missing or repeated"
    assert _problems(spark, tmp_path, _archive(good[:-1]))[own][0] == "last segment missing"
    wrong = good[-1][1].replace(b"Segment-Total-Length: 1", b"Segment-Total-Length: 2")
    assert _problems(spark, tmp_path, _archive([*good[:-1], ("", wrong)]))[own][0] == "total length"
    (_, one), = warc.records_of(2, "u", html, digest, None, 0, 10**6)
    broken = one.replace(b"\r\n3e8\r\n", b"\r\n3e9\r\n")
    assert broken != one and _problems(spark, tmp_path, _archive([("", broken)]))[warc.record_id(2, 0, digest)][0] == "chunk length"
    other = one.replace(b"\r\n0123", b"\r\n9123")
    assert _problems(spark, tmp_path, _archive([("", other)]))[warc.record_id(2, 0, digest)][0] == "payload digest"
    assert _problems(spark, tmp_path, _archive([("", one)])[:-50])[warc.record_id(2, 0, digest)][0] == "ends too early"
    assert [p for p, _ in _problems(spark, tmp_path, gzip.compress(one)[:-20]).values()] == ["compression: EOFError"]
    assert [p for p, _ in _problems(spark, tmp_path, b"no archive").values()] == ["no record"]
    # several members, as tools write them; other records are no pages
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    found = _problems(spark, tmp_path, gzip.compress(info) + gzip.compress(one + b"\r\n"))
    assert found == {warc.record_id(2, 0, digest): (None, html)}


def test_chunks():
    assert warc.dechunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000 and warc.dechunked(b"0\r\n\r\n") == b""
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\nab\r\n0\r\n\r\n", b"-3\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    assert [b for _, b, _ in warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"))] == [b"abc"]
