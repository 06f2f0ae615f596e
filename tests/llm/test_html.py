"""Main text of pages: roles, templates, references, and odd input."""

from stemma.llm.html_template import article, extract, read, token

SCHEMA = "page_id long, url string, html string, text string"


def main(html, template=()):
    return "\n".join(article(read(html), set(template)))


def test_roles_and_references():
    page = """<html><head><title>t</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use</p></div><header><h1>Site</h1></header>
    <nav><ul><li>Menu</li></ul></nav><main><aside>side</aside><article><header><h1>A &amp;&nbsp;B</h1></header><p>One <b>bo</b>ld
     line<br>next</p><div class="ad-slot">buy</div><form><p>mail</p></form><ul><li>x<li>y</ul><p>caf&eacute; &#x2014; &lt;i&gt;</article>
    <section id="comments"><article class="comment"><p>first!</p></article></section></main><footer>f</footer><script>var a="<p>no</p>";</script></body></html>"""
    assert main(page) == "A & B\nOne bold line next\nx\ny\ncafé — <i>"


def test_without_an_article_the_template_decides():
    page = "<body><div><p>Standing words</p></div><div><p>Real text here</p></div><div><a href='/'>all</a> <a href='/x'>links</a></div></body>"
    assert main(page, [token("body/div/p", "Standing words")]) == "Real text here"


def test_odd_markup():
    assert main("") == "" and read(None) == []
    assert main("<article>a < b and <unknown>c</unknown> &bogus; <p>d") == "a < b and\nc\n&bogus;\nd"
    assert main("<article></p></div>text<!-- no --></article>") == "text"
    assert main("plain text") == "plain text"


def test_hosts_templates_and_edges(spark):
    body = lambda i: f"<body><div class='wrap'><p>Standing line of the site</p></div><div class='wrap'><p>Own words {i} of page {i * i}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body(i), "clash") for i in range(6)] + [(90, None, "<p>solo</p>", ""), (91, "nonsense", None, ""), (92, "http://h.example/0", "", ""), (3, "http://h.example/3", body(3), "clash")]
    rows += [(93, "http://one.example/", "<article>" + "<p>long text</p>" * 20000 + "</article>", "")]
    got = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"Own words {i} of page {i * i}" for i in range(6))
    assert by[90].text == "solo" and by[91].text == by[92].text == "" and by[91].n_chars == 0
    assert by[93].text == "\n".join(["long text"] * 20000) and by[93].n_chars == len(by[93].text)
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_an_article_stay(spark):
    page = "<body><nav>menu</nav><article><h1>T</h1><p>Same text</p></article></body>"
    got = extract(spark.createDataFrame([(i, "http://h.example/", page, "") for i in range(5)], SCHEMA)).collect()
    assert {r.text for r in got} == {"T\nSame text"}
