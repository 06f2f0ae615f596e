"""Names and forms around articles only vote: planted pages of many shapes, and the vote against a plain count."""

import random

import pytest

from stemma.llm.html_template import CLEAR, HARD, Page, article, extract, heard, named, read

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


#: Layouts by name; {x} is the article, {s} other text of the page, {n} a menu.
WRAPPED = {
    "no-sidebar": '{n}<div class="site no-sidebar">{x}</div><footer>{s}</footer>',
    "ad-free": '{n}<article class="ad-free">{x}</article><aside>{s}</aside>',
    "share-enabled": '{n}<div class="entry share-enabled">{x}</div><div class="sidebar">{s}</div>',
    "form around everything": '<form id="aspnetForm" method="post">{n}<div id="holder">{x}</div><footer>{s}</footer></form>',
    "form around an article": "<form><article>{x}</article></form>{n}",
    "form, article and box": '<form>{n}<article>{x}</article><div class="widget">{s}</div></form>',
    "with-sidebar": '<div class="layout with-sidebar">{n}<div class="column">{x}</div><div class="sidebar-box"><p>{s}</p></div></div>',
    "no-comments": '{n}<div class="post no-comments">{x}</div>',
    "newsletter-content": '{n}<div class="newsletter-content">{x}</div><div class="cookie-notice">{s}</div>',
    "sidebar around everything": '<div class="sidebar-page"><div class="sidebar">{n}<div>{x}</div></div></div>',
    "comments after": '{n}<main>{x}</main><div id="comments"><h3>Comments</h3><div class="comment-body">{s}</div><div class="comment-body">{s}</div></div>',
    "comments as articles": '{n}<div class="text">{x}</div><section class="post-comments"><article class="comment">{s}</article></section>',
    "long comments": '{n}<article>{x}</article><div class="comments-area">{s} {s} {s} {s} {s} {s} {s} {s}</div>',
}
INSIDE = (
    '<h1>{h}</h1><p>{a}</p><h2 id="comments-on-the-treaty">Comments on {k}</h2><p class="newsletter-quote">{b}</p><p>The stock {k} <span class="share-price">rose to 12 dollars</span> on Monday</p>'
    '<ul class="share"><li><a href="/f">F</a><li><a href="/t">T</a></ul><div class="ad-slot">buy {k}</div>'
)


def planted(name, n, rng):
    """Pages of a layout on one host, and their articles."""
    pages, want = [], []
    for i in range(n):
        h, a, b, k, s = words(rng, 4), words(rng, 70), words(rng, 50), words(rng, 1), words(rng, 25)
        x = INSIDE.format(h=h, a=a, b=b, k=k)
        menu = "<nav><a href='/'>Home</a> <a href='/a'>About</a></nav>"
        pages.append(f"<html><head><title>{h}</title></head><body>{WRAPPED[name].format(x=x, s=s, n=menu)}<script>1</script></body></html>")
        want.append([h, a, f"Comments on {k}", b, f"The stock {k} rose to 12 dollars on Monday"])
    return pages, want


@pytest.mark.parametrize("n", (1, 2, 6))
def test_planted_pages(spark, n):
    rng, rows, want = random.Random(n), [], {}
    for k, name in enumerate(WRAPPED):
        pages, texts = planted(name, n, rng)
        rows += [(k * 100 + i, f"https://h{k}.example/{i}", p) for i, p in enumerate(pages)]
        want |= {k * 100 + i: t for i, t in enumerate(texts)}
    got = {r.page_id: r.text.split("\n") for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    hit = sum(len(" ".join(b).split()) for i in want for b in [[x for x in got[i] if x in want[i]]])
    given, asked = (sum(len(" ".join(t).split()) for t in x.values()) for x in (got, want))
    print(f"pages a host {n}: precision {hit / given:.4f}, recall {hit / asked:.4f} of {asked} words")
    assert got == want


def test_names():
    sure = ("comments", "post-comments", "comment-body", "ad-slot", "side-bar", "nav__item", "cookie-notice-bar sidebar".split()[1])
    assert [named(x, frozenset()) for x in sure] == [2] * len(sure)
    assert all(named(x, frozenset()) < 1 for x in ("no-sidebar", "with-comments", "ad-free", "share-enabled", "newsletter-quote", "share-price", "popular-science", "comments-on-the-treaty", "adventure", "", "-"))


def plainly(blocks, own):
    """The vote by its words: every element in turn, everything counted anew."""
    said = [dict(tuple(map(int, x.split(":"))) for x in b[1].split(",")) if b[1] else {} for b in blocks]
    fallen = set()
    against = lambda i: [v for k, v in said[i].items() if k not in fallen]
    like = lambda some: 2 * any(blocks[i][2] > 2 for i in some) + any("h1" == blocks[i][0].split("/")[-1].split(".")[0] for i in some)
    for k in sorted({k for marks in said for k, v in marks.items() if v < HARD}):
        within = [i for i in range(len(blocks)) if k in said[i] and own[i] and HARD not in said[i].values() and not any(j < k and j not in fallen for j in said[i])]
        without = [i for i in range(len(blocks)) if own[i] and not against(i)]
        a, b = (sum(own[i] for i in x) for x in (within, without))
        if a > b and (like(without) <= like(within) or 10 * b < a):
            fallen.add(k)
    return [max(against(i), default=CLEAR) for i in range(len(blocks))]


def test_votes_against_a_plain_count():
    rng = random.Random(8)
    names = ["", "sidebar", "comments", "share-price", "related", "post", "content", "no-ads", "newsletter-box", "entry"]
    tags = ["div", "section", "article", "form", "p", "h1", "ul", "aside", "td", "span"]

    def element(depth):
        inner = "".join(element(depth - 1) for _ in range(rng.randrange(1, 4))) if depth else words(rng, rng.choice([1, 5, 30, 90]))
        tag = rng.choice(tags)
        return f'<{tag} class="{rng.choice(names)}">{inner}</{tag}>'

    for _ in range(300):
        blocks = Page(f"<body>{element(3)}{element(3)}</body>").blocks
        own = [len(b[3]) * rng.choice([0, 1, 1, 1]) for b in blocks]
        assert heard(blocks, own) == plainly(blocks, own)


def test_many_marks_take_no_longer():
    page = "<body><article><h1>T</h1><p>text of it</p></article>" + "<div class='comment'><p>said</p></div>" * 20_000 + "<div class='comments'>" * 3000 + "deep" + "</div>" * 3000 + "</body>"
    assert article(read(page), set()) == ["T", "text of it"]
