"""Wrappers: parsing, alignment, choice of the article, and extraction against a plain reading of the article element."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.llm import wrappers as W

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


class Article(HTMLParser):
    """Blocks of the article element, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "footer", "b", "br"):
            self.now += " " * (tag == "br")
            if tag not in ("b", "br"):
                self.flush()
        self.inside = tag == "article" or self.inside and tag != "footer"

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.now += data * self.inside

    def flush(self):
        text = " ".join(self.now.split())
        self.blocks += [text] * bool(text)
        self.now = ""


def brute(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return "\n".join(parser.blocks)


def texts(spark, rows):
    return {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize("limit", [W.BROADCAST_BYTES, 0])
def test_all_pages_of_the_table(spark, monkeypatch, limit):
    monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(W, "HELD_NODES", 50)
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in W.extract(df).collect()}
    want = {r.page_id: (r.url, brute(r.html)) for r in df.collect()}
    assert {k: (v.url, v.text) for k, v in got.items()} == want
    assert all(v.n_chars == len(v.text) for v in got.values())


SHELL = """<!doctype html><html><head><title>T {i}</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body class="no-sidebar">
<div id="cookie-notice"><p>We use cookies.</p></div><header><div>Site name</div></header><nav><ul>{menu}</ul></nav>
<div class="layout"><div class="post-content"><h1>Title {i}</h1>{body}<div class="ad-slot">Buy now {i}</div><p>Share this with friends</p></div>
<aside>Popular {i}</aside><section class="comments"><h3>Comments</h3><div>Reader {i} says no</div></section></div>
<form action="/s"><input name="q"><p>Search me</p></form><footer>Copyright {i}</footer></body></html>"""


def test_a_host_without_article_elements(spark):
    rows, want = [], {}
    for i in range(6):
        parts = [f"Paragraph {i}.{j} has quite some words that nobody else has" for j in range(1 + i % 4)]
        body = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((i, f"http://plain.example/{i}", SHELL.format(i=i, menu="".join(f"<li><a href='/{j}'>m{j}</a>" for j in range(2 + i % 3)), body=body)))
        want[i] = "\n".join([f"Title {i}", *parts])
    got = texts(spark, rows)
    for i, text in want.items():
        assert got[i].removesuffix("\nShare this with friends") == text


def test_without_any_names_the_template_goes_by_alignment(spark):
    page = "<html><body><div><div>Constant banner of all</div><div><h1>Head {0}</h1><div>Text {0} which is long and differs from page to page {0}</div><div>Advertise with us</div></div><div>All rights reserved</div></div></body></html>"
    got = texts(spark, [(i, f"https://x.example:80/{i}", page.format(i)) for i in range(5)])
    assert got == {i: f"Head {i}\nText {i} which is long and differs from page to page {i}" for i in range(5)}


def test_repetitions_and_options_are_found_at_mismatches():
    trees = [W.parsed(f"<body><div>a</div><div>b{i}</div><dl>{'<dt>x<dd>y' * i}</dl>{'<h2>q</h2>' * (i == 2)}<p>t</p></body>") for i in (1, 2, 3)]
    out = trees[0]
    for t in trees[1:]:
        out = W.merged(out, t)
    assert out.pattern() == "<><body><div>= <div># <dl>(<dt>= <dd>=)+ (<h2>=)? <p>="
    back = W.Node.unpacked(out.packed())
    assert back.pattern() == out.pattern() and back.packed() == out.packed()


def test_order_is_given_up_for_long_sequences():
    tags = [f"section class=k{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    a = W.parsed("".join(f"<{t}>x</section>" for t in tags))
    b = W.parsed("".join(f"<{t}>x</section>" for t in reversed(tags)))
    out = W.merged(a, b)
    assert out.loose and len(out.kids) == 60 and all(k.optional and k.repeated for k in out.kids)
    assert len(W.merged(out, W.parsed("<section class=ka>y</section><p>z")).kids) <= 62


def test_blocks_references_and_white_space():
    page = "<article><header><h1>A &amp; B</h1></header>one\n two<br>three&nbsp;four<p>caf&eacute; &#x41;&lt;b&gt; <b>bo</b>ld<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>tail<!-- no --><hr>end &am"
    assert W.main_text(W.parsed(page), None) == "A & B\none two three four\ncafé A<b> bold\nx\ny\n1\n2\ntail\nend &am"


def test_what_is_out_inside_an_article():
    page = """<body><main><article>Good text here<div class="share-buttons">Share</div><p>more <span class="ad">bad <span>worse</span></span>good<button>Click</button> end</p>
    <div hidden>no</div><div style="display: none">no</div><div role="complementary">no</div><footer>no</footer><div class="entry-content">yes</div><!-- c --><script>no</script><template><p>no</p></template>
    <ol class=commentlist><li>no</ol></article><div>Not the article</div></main></body>"""
    assert W.main_text(W.parsed(page), None) == "Good text here\nmore good end\nyes"


def test_copies_on_a_host_keep_their_text(spark):
    page = "<body><div>menu</div><div><h1>Same</h1><p>The same article everywhere, at some length</p></div></body>"
    got = texts(spark, [(i, "http://c.example/", page) for i in range(9)])
    assert set(got.values()) == {"Same\nThe same article everywhere, at some length"} or all("same article" in t for t in got.values())


def test_pages_of_another_layout_on_the_host(spark):
    named = "<body><nav>menu</nav><article><p>Named text {0} of some length</p></article></body>"
    plain = "<body><div class='footer'>foot</div><div><p>Only this page is made otherwise, and it is read by its own</p></div></body>"
    got = texts(spark, [(i, "http://d.example/", named.format(i)) for i in range(5)] + [(9, "http://d.example/", plain)])
    assert got[9] == "Only this page is made otherwise, and it is read by its own" and got[3] == "Named text 3 of some length"


def test_edge_cases(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    deep = "<div>" * 3000 + "<article>deep text</article>" + "</div>" * 3000
    rows = [(1, None, None), (None, "http://h/", ""), (3, "no url", "<article>three"), (3, "http://h/", "<article>again"), (4, "http://u@H.example:8/x", long), (5, "http://h2/", deep), (6, "http://h/", "<nav>only a menu</nav>"), (7, "http://h/", "<article>cut <p"), (8, "http://h/", '<div class="a>broken'), (9, "http://h/", "no tags at all")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("host", "text", "expression", "of", "n_chars")})
    got = sorted(((r.page_id, r.url, r.text) for r in W.extract(df).collect()), key=repr)
    assert [t for i, u, t in got if i == 4] == ["\n".join(["word & word"] * 20000)]
    assert [t for i, u, t in got if i == 3] == ["again", "three"] and [t for i, u, t in got if i in (1, None, 6)] == ["", "", ""]
    assert [t for i, u, t in got if i == 5] == ["deep text"] and [t for i, u, t in got if i == 7] == ["cut"] and [t for i, u, t in got if i == 9] == ["no tags at all"]
    assert W.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_hosts(spark):
    urls = ["http://WWW.A.example:80/x", "//b.example/y", "https://u:p@c.example?q", "mailto:x@y", "", None, "http:///z"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(W.host_of()).collect()
    assert [r[0] for r in got] == ["www.a.example", "b.example", "c.example", None, None, None, None]
