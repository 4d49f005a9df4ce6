import re

from pagewright.llm import html_extract as H


def article_of(html):
    """For this table's pages only: the article element's text by plain patterns."""
    import html as h

    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"<(/?(?:p|h1|br|div))\b[^>]*>", " ", inner)
    return re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", inner))).strip()


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: (r.url, article_of(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text) for r in H.extract(pages).collect()}
    assert got == want
    assert H.extract(pages).where("n_chars <> length(text)").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="nav-menu"><a href=/>Home</a> <a href=/b>Blog</a></div><div class="cookie-notice">We use cookies.</div>
<div class="main"><h2>A &amp; B</h2><p>First <b>para</b>graph of
   some length, long enough to count as content here.<p>Of.</p><div class="ad-slot">Buy</div><form><label>Name</label><input></form>
<script>var x = "<p>no</p>";</script><ul><li>one<li>two</ul><p>Last paragraph of the text, also rather long &eacute;.</p></div>
<aside>Side</aside><section class="comments"><p>I read this and liked it a lot, a long comment by a reader.</p></section><footer>Foot</footer>"""


def test_parts():
    assert H.main_text(PAGE) == "A & B First paragraph of some length, long enough to count as content here. Of. one two Last paragraph of the text, also rather long é."
    assert H.main_text("<body><p>Only this.</p></body>") == "Only this."
    assert H.main_text("plain text") == "plain text"
    for nothing in (None, "", " ", "<nav>a</nav>", "<script>x</script>", "<!-- x -->", "<"):
        assert H.main_text(nothing) in ("", "<")
    assert H.main_text("<article><p>x" + " y" * 50_000) == "x" + " y" * 50_000
    assert H.main_text("<div>" * 2000 + "deep") == "deep"


def test_edges(spark):
    rows = [(1, None, None, "q"), (2, "u", "", "q"), (2, "u", "<p>a</p>", "q"), (2, "u", "<p>a</p>", "q"), (None, "v", "<p>b</p>", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(str, (tuple(r) for r in H.extract(pages).collect())))
    assert got == sorted(map(str, [(1, None, "", 0), (2, "u", "", 0), (2, "u", "a", 1), (2, "u", "a", 1), (None, "v", "b", 1)]))
    assert H.extract(pages.limit(0)).count() == 0


def test_uneven_parts():
    """An article in uneven sections, divs or sibling articles keeps all of them, short lines too."""
    long = "A sentence of the article that is long enough to count as content here, number"
    first, second = ([f"{long} {k}." for k in r] for r in (range(13), range(13, 20)))
    want = " ".join([*first, "Short.", *second])
    menu, foot = '<ul class="menu"><li><a href=/>Home</a></ul>', "<footer>Foot</footer>"
    for tag in ("section", "div", "article"):
        a, b = ("".join(f"<p>{x}</p>" for x in part) for part in (first, ["Short.", *second]))
        page = f"<body>{menu}<div><{tag}>{a}</{tag}><{tag}>{b}</{tag}></div><div><a href=/x>More</a> <a href=/y>Other</a></div>{foot}"
        assert H.main_text(page) == want, tag
    assert H.main_text(f"<body><div><div>{a}</div>{b}</div>{foot}") == want
