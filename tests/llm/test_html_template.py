"""Template deduction against a plain one over whole occurrence vectors, and pages whose article is known."""

import random
from collections import Counter, defaultdict

import pytest

from stemma.llm.html_template import Page, extract, parsed, templates, token
from stemma.session import Scratch

SCHEMA = "page_id long, url string, html string"


def plain_template(pages, least=3, share=0.5):
    """Texts of the valid equivalence classes of one host's pages, from every token's count on every page."""
    vectors = defaultdict(lambda: [0] * len(pages))
    for i, html in enumerate(pages):
        page = Page(html)
        for path, n in page.paths.items():
            vectors[path, None][i] = n
        for (path, text), n in Counter((b[0], b[3]) for b in page.blocks).items():
            vectors[path, text][i] = n
    classes = defaultdict(list)
    for key, v in vectors.items():
        on = sum(n > 0 for n in v)
        if on >= least and on >= share * len(pages):
            classes[tuple(v)].append(key)
    valid, more = {}, True
    while more:
        frame = {path for keys in valid.values() for path, _ in keys}
        nested = lambda keys: all(any(p == f or p.startswith(f + "/") for f in frame) for p, _ in keys)  # noqa: B023, E731
        more = {}
        for v, keys in classes.items():
            on, times, elements = sum(n > 0 for n in v), sum(v), any(text is None for _, text in keys)
            if v not in valid and (elements and times == on or nested(keys) and (elements or times % on == 0)):
                more[v] = keys
        valid |= more
    return {token(path, text) for keys in valid.values() for path, text in keys if text is not None}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def site(rng, n):
    """Pages of one host in random markup, with standing texts, lists, and texts that only some pages have."""
    standing = [words(rng, 4) for _ in range(6)]
    boxes = [rng.choice(["div", "section", "td", "p"]) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [f"<{t}>{s}</{t}>" for t, s in zip(boxes, standing) if rng.random() < 0.9]
        parts += [f"<div class='x'><p>{words(rng, 12)}</p><p>{rng.choice(standing)}</p></div>" for _ in range(rng.randrange(1, 4))]
        rng.shuffle(parts)
        out.append(f"<html><body><div id='page'>{''.join(parts)}<ul>{''.join(f'<li>{x}' for x in standing[: rng.randrange(1, 5)])}</ul></div></body></html>")
    return out


def test_templates_against_plain_vectors(spark):
    rng = random.Random(11)
    hosts = {f"h{i}.example": site(rng, n) for i, n in enumerate((1, 2, 3, 4, 5, 8, 13))}
    rows = [(k * 100 + i, f"http://{h}/{i}", html, h) for k, (h, pages) in enumerate(hosts.items()) for i, html in enumerate(pages)]
    scratch = Scratch(spark)
    source = scratch.cut(parsed(spark.createDataFrame(rows, SCHEMA + ", host string")))
    got = {r.host: set(r.template) for r in templates(source, scratch, 3, 0.5).collect()}
    for h, pages in hosts.items():
        assert got.get(h, set()) == plain_template(pages)
    assert sum(map(len, got.values())) > 20


NAV = "<nav><ul><li><a href='/'>Home</a><li><a href='/a'>About</a></ul></nav>"
LAYOUTS = {
    "semantic": "<body>{nav}<main><article><h1>{h}</h1><p>{a}</p><p>{b}</p><p>Follow us on every network there is</p></article></main><footer>(c) us</footer></body>",
    "plain boxes": "<body><div>Welcome to the site of the company</div><div><a href='/'>Home</a> <a href='/x'>More</a></div><div><h2>{h}</h2><p>{a}</p><p>{b}</p></div><div>All rights are reserved by the company</div></body>",
    "marked around": "<body>{nav}<div class='related-content'><article><h1>{h}</h1><p>{a}</p><p>{b}</p></article></div></body>",
    "word of the subject": "<body>{nav}<div class='popular-science'><h1>{h}</h1><p>{a}</p><p>{b}</p></div><div class='sidebar'><p>{side}</p></div></body>",
    "comments": "<body><h1>{h}</h1><p>{a}</p><p>{b}</p><section id='comments'><article class='comment'><p>{side}</p></article></section><aside>{side}</aside></body>",
    "teasers beside": "<body><article><h1>{h}</h1><p>{a}</p><p>{b}</p></article><div class='related'><article><p>{side}</p></article></div><form><p>{side}</p></form></body>",
    "named container": "<body><div class='post-content'><h1>{h}</h1><p>{a}</p><p>{b}</p></div><div class='cookie-notice'>We use some</div><div><p>{side}</p></div></body>",
}


@pytest.mark.parametrize("pages", (1, 6))
def test_planted_articles_come_out_whole(spark, pages):
    rng, rows, want = random.Random(pages), [], {}
    for k, (name, layout) in enumerate(LAYOUTS.items()):
        if name == "plain boxes" and pages < 3:
            continue  # a host of one page has no template
        for i in range(pages):
            h, a, b, side = words(rng, 5), words(rng, 40), words(rng, 60), words(rng, 25)
            rows.append((k * 10 + i, f"https://{name.replace(' ', '')}.example/{i}", layout.format(nav=NAV, h=h, a=a, b=b, side=side)))
            want[k * 10 + i] = [h, a, b] + (["Follow us on every network there is"] if name == "semantic" and pages < 3 else [])
    got = {r.page_id: r.text.split("\n") for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_deep_nesting_is_read(spark):
    rows = [(i, f"http://deep.example/{i}", "<div>" * 5000 + f"<p>text {i}</p>" + "</div>" * 5000 + "</b>" * 5000) for i in range(4)]
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: f"text {i}" for i in range(4)}
