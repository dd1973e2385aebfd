import html
import re

from quillon.llm.html_extract import Wrapper, deep, dumps, extract, infer_wrappers, loads, merge, parse, skeleton

SCHEMA = "page_id bigint, url string, html string, host string, text string"


def texts(spark, rows, **options):
    df = spark.createDataFrame([(*r, "h", None) for r in rows], SCHEMA).repartition(2)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(df, **options).collect()}


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div class="ad">Buy</div><div class="cookie-notice">Cookies</div><article><h1>Title &amp; more</h1><p><b>Bold\n text<br><p>A&nbsp;&lt;b&gt; <i>c</i>d &eacute;</p>'
    '<form><input name="x">Search</form><ul><li>one<li>two</ul><aside>Side</aside><div class="comments"><p>Nice!</p></div></article><section id="comments"><p>Me too</p></section><footer>&copy; F</footer></body></html>'
)
TEXT = "Title & more\nBold text\nA <b> cd é\none\ntwo"


def test_article_only(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("<aside>Side</aside>", "")), (3, None, PAGE), (4, "odd", ""), (5, "http://b.example", None), (6, "http://b.example", "plain &amp; simple"), (None, "http://a.example/1", PAGE), (1, "http://a.example/1", PAGE)]
    for options in ({}, {"broadcast_bytes": 0}):
        got = texts(spark, rows, **options)
        assert got == {1: (TEXT, len(TEXT)), 2: (TEXT, len(TEXT)), 3: (TEXT, len(TEXT)), None: (TEXT, len(TEXT)), 4: ("", 0), 5: ("", 0), 6: ("plain & simple", 14)}
    assert texts(spark, []) == {}


def test_wrapper_is_union_free():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<h1>t</h1><ul><li><b>a</b></li></ul>", "<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x<p>y"]
    w = skeleton(parse(pages[0]))
    for p in pages[1:]:
        w = merge(w, skeleton(parse(p)))
    assert w == ["", "", [["h1", "?", [["#", "", []]]], ["ul", "?", [["li", "+", [["#", "?", []], ["b", "?", [["#", "", []]]]]]]], ["dl", "?", [["()", "+", [["dt", "", [["#", "", []]]], ["dd", "", [["#", "", []]]]]]]], ["p", "*", [["#", "", []]]]]]
    assert [Wrapper(w).text(p) for p in pages] == ["a\nb\nx", "t\na", "a\nb\nc\nd\nx\ny"]


def test_one_wrapper_a_host(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<article>{'<p>x</p>' * (1 + i % 4)}{'<h2>y</h2>' * (i % 2)}</article>", None, None) for i in range(60)]
    got = infer_wrappers(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r["host"] for r in got) == ["h0.example", "h1.example", "h2.example"]


def test_wrapper_decides_where_no_article_is(spark):
    page = "<body><div><a>Home</a><a>About</a></div><div><p>{}</p><p>{}</p></div><div>All rights reserved</div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(f"first {i}", f"then {i}")) for i in range(6)]
    copies = [(i, f"http://b.example/{i}", page.format("the same", "on all")) for i in range(6, 9)]
    marked = [(i, f"http://c.example/{i}", f"<article><h1>Kept</h1><p>{i}</p></article>") for i in range(9, 12)]
    for options in ({}, {"broadcast_bytes": 0}):
        got = texts(spark, rows + copies + marked, **options)
        assert all(got[i][0] == f"first {i}\nthen {i}" for i in range(6))
        assert all(got[i][0] == "HomeAbout\nthe same\non all\nAll rights reserved" for i in range(6, 9))
        assert all(got[i][0] == f"Kept\n{i}" for i in range(9, 12))


def test_given_pages_as_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, own in zip(sorted(extract(pages).collect(), key=lambda r: r["page_id"]), pages.orderBy("page_id").collect(), strict=True):
        a = own["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", a))
        assert r["text"] == "\n".join(x for x in blocks if x)


def test_very_long_and_broken_pages(spark):
    long = "<article><p>" + "word " * 300_000 + "</article><p>after"
    got = texts(spark, [(1, "http://a", long), (2, "http://a", "<<<p<a href='x>y"), (3, "http://a", "<article><p>x<!-- y")])
    assert got[1][0] == ("word " * 300_000).strip() and got[3][0] == "x"


def test_deep_pages(spark):
    n = 100_000
    rows = [(1, "http://a", "<article>" + "<div>" * n + "x" + "</div>" * n + "<p>y</article>z"), (2, "http://a", "<article><p>" + "<b>" * n + "bold</p></i>" + "</u>" * n + "<p>more</article>"), (3, "http://a", "<article><p>plain</article>"), (4, "http://b", "<i><div>" + "<b>" * n + "</i>" * n + "end")]
    assert texts(spark, rows) == {1: ("x\ny", 3), 2: ("bold\nmore", 9), 3: ("plain", 5), 4: ("end", 3)}
    deep()
    w = merge(skeleton(parse(rows[0][2])), skeleton(parse(rows[1][2])))
    assert dumps(loads(dumps(w))) == dumps(w)


def test_odd_attributes(spark):
    pages = {
        "<article><p data-x=it's>Hello</p><p>World it's</p><p>z</p></article>": "Hello\nWorld it's\nz",
        '<article><p title="5" tall">in</p><p a=\'b>c\' d="e>f" / g=h/>out</p></article>': "in\nout",
        '<article><p title="never closed>one</p><p>two</p></article>': "one\ntwo",
        "<article><p =x == a= >one</p><p/class=nav>menu</p><p data-y='class=nav'>two</p><br/></article>": "one\ntwo",
        "<article><p>a < b <3 c<p>d</article >after": "a < b <3 c\nd",
        "<article><script>x</scripty></script ><p>t</p></article>": "t",
    }
    got = texts(spark, [(k, f"http://{k}", p) for k, p in enumerate(pages)])
    assert [got[k][0] for k in range(len(pages))] == list(pages.values())


def test_long_child_lists():
    a, b = (["x" + str(k * m % 997) for k in range(3000)] for m in (1, 7))
    w = merge(*(skeleton(parse("".join(f"<{t}></{t}>" for t in x))) for x in (a, b)))
    assert w[0] == "" and len(w[2]) >= 3000
