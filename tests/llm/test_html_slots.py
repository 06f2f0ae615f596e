"""What stands inside article elements on a host's pages, and heads that are never closed."""

from stemma.llm.html_template import article, extract, read

SCHEMA = "page_id long, url string, html string"


def test_the_template_judges_slots_inside_articles(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>Own words {i} of a page that is long enough, {i * i}</p><div><p>Follow us on all networks</p></div></article></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(5)] + [(9, "http://h.example/9", page(3))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Title {i}\nOwn words {i} of a page that is long enough, {i * i}" for i in range(5)) and got[9] == got[3]


def test_near_copies_of_an_article_stay(spark):
    page = lambda i: f"<body><article><h1>T</h1><p>The same long text of the article on every page</p><p>printing {i}</p></article></body>"
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(5)], SCHEMA)).collect()}
    assert all(got[i] == f"T\nThe same long text of the article on every page\nprinting {i}" for i in range(5))


def test_lists_of_links_inside_articles_go():
    text = article(read("<article><h1><a href='/'>Title</a></h1><p>words</p><ul><li><a href='/a'>one</a><li><a href='/b'>two</a></ul></article>"), set())
    assert text == ["Title", "words"]


def test_an_open_head_ends_where_the_body_begins():
    assert article(read("<html><head><title>t</title><body><p>text</p>"), set()) == ["text"]
    assert article(read("<head><meta charset='x'><script>1</script><p>text</p>"), set()) == ["text"]
    assert article(read("<head><title>t</title>bare text"), set()) == ["bare text"]
    assert article(read("<head><title>t</title></head><body>text</body>"), set()) == ["text"]
