import html as html_lib
import re
import time

import pytest

from sablework.llm import templates

SF = "/root/testdata/sf0.001"


def article(source):
    """The marked article of the generated pages, by plain means."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    blocks = (" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = templates.op3_templates(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_joined_templates_give_the_same(spark, monkeypatch):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(templates.op3_templates(spark, SF))
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", -1)
    assert key(templates.op3_templates(spark, SF)) == want


PAGE = "<html><body><div class=top><span>Big Site Daily</span></div><ul class=x><li><a href=1>Home</a><li><a href=2>About us</a></ul><div id=c><h1>{t}</h1><p>{a}<p>{b}</div><div class=end>All rights kept</div></body></html>"


def test_template_text_goes_where_no_article_is_marked(spark):
    rows = [(i, f"http://site.example/{i}", PAGE.format(t=f"Title {i}", a=f"First of {i}", b=f"Second of {i}")) for i in range(12)]
    out = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {i: f"Title {i}\nFirst of {i}\nSecond of {i}" for i in range(12)}


CASES = [
    ("<nav>m</nav><article><h1>T</h1><p>a &amp; b&nbsp; c<br>d</article><footer>f</footer>", "T\na & b c\nd"),
    ("<article><p>x <b>y</b>z<div class='ad-box'>buy</div><p>w</article><p>out", "x yz\nw"),
    ("<main><p>kept<section class=comments><p>first!</section></main>", "kept"),
    ("<article><header>h</header>a<aside>s</aside><form>f</form><script>1<2</script><style>p</style>b<!-- c --></article>", "a\nb"),
    ("<p>one<p>two<ul><li>i<li>j</ul>", "one\ntwo\ni\nj"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<div", "<div"), ("<article>cut <b>off", "cut off"), ("<script>never closed", ""),
    ("<div hidden>x</div><div role=navigation>y</div><div aria-hidden=true>z</div>k", "k"), ("<article class='post'>a</article><article class='comment'>b</article>", "a"),
    ("<p title='a>b'>q</p>", "q"), ("a&lt;b &#233; &unknown;", "a<b é &unknown;"), ("<article></article>", ""),
]


def test_markup(spark):
    rows = [(i, None if i % 2 else "http://[bad", h, "x", "y") for i, (h, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, token string")
    out = {r.page_id: r for r in templates.extract(df).collect()}
    assert [out[i].text for i in range(len(CASES))] == [t for _, t in CASES]
    assert templates.extract(df.where("false")).count() == 0
    twice = templates.extract(df.union(df).union(df)).collect()
    assert len(twice) == 3 * len(CASES)


def test_very_long_page(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<article>" + "<p>word word" * 50_000 + "</article>")], "page_id bigint, url string, html string")
    assert templates.extract(df).first().text.count("\n") == 49_999


def texts_of(spark, sources):
    rows = [(i, f"http://site.example/{i}", h) for i, h in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return [r.text for r in sorted(templates.extract(df).collect(), key=lambda r: r.page_id)]


def test_template_text_goes_inside_a_marked_article_too(spark):
    page = "<body><article><h1>Title {i}</h1><div class=zz>Tell your friends</div><p>First of {i}, <a href=x>see {i}</a>.<ul class=q><li><a href={i}>More {i}</a></ul></article>"
    for n in (2, 3, 12):
        assert texts_of(spark, [page.format(i=i) for i in range(n)]) == [f"Title {i}\nFirst of {i}, see {i}." for i in range(n)]
    assert texts_of(spark, ["<article><h1>Same</h1><p>text</article>"] * 6) == ["Same\ntext"] * 6


def test_names_remove_no_article(spark):
    cases = [
        '<div class="container no-sidebar"><article>a {i}</article></div>', '<div class="sidebar"><article>a {i}</article></div>',
        '<div class="post-header"><h1>a {i}</h1></div>', '<div id="legal-news">a {i}</div>', '<section class="related-work">a {i}</section>',
        '<body class="has-header content-with-ads"><div class=header>a {i}</div>', "<div class=content-with-ads>a {i}</div>",
    ]
    for n in (1, 6):
        for case in cases[:3] if n > 1 else cases:
            assert texts_of(spark, [case.format(i=i) for i in range(n)]) == [f"a {i}" for i in range(n)], case


def test_repeated_pages_have_a_template_too(spark):
    """Each page once, twice or three times gives the same texts: repeated pages don't cancel each other."""
    pages = [(i, f"http://site.example/{i}", PAGE.format(t=f"Title {i}", a=f"First of {i}", b=f"Second of {i}")) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    want = {(i, f"Title {i}\nFirst of {i}\nSecond of {i}") for i in range(12)}
    for times, given in ((1, df), (2, df.union(df)), (3, df.union(df).union(df))):
        out = templates.extract(given).collect()
        assert len(out) == 12 * times and {(r.page_id, r.text) for r in out} == want


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<!", "<div>", "<b><hr>", "<div class=ad>", "</p>", "<p><object><b>", "<!--"])
def test_broken_markup_takes_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        page = templates.Page("<p>" + piece * n + "</p>" * n + "x")
        page.text(*templates.NO_TEMPLATE)
        return time.process_time() - began

    seconds(100)
    assert seconds(2_000_000 // len(piece) // 4) < 12


def test_template_decides(spark, monkeypatch):
    """Without the template's tokens the shared line inside the marked article would stay."""
    page = "<body><article><h1>Title {i}</h1><div class=zz>Tell your friends</div><p>First of {i}.</article>"
    sources = [page.format(i=i) for i in range(6)]
    assert texts_of(spark, sources) == [f"Title {i}\nFirst of {i}." for i in range(6)]
    nothing = templates.templates
    monkeypatch.setattr(templates, "templates", lambda counted: nothing(counted).where("false"))
    assert texts_of(spark, sources) == [f"Title {i}\nTell your friends\nFirst of {i}." for i in range(6)]
