"""Hand-made cases of the operators: the edges that the tables do not contain."""

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import catalog as C
from stemma.operators import embed as M
from stemma.operators import etl as E
from stemma.operators import logs as L
from stemma.operators import reader as R
from stemma.operators import search as S
from stemma.operators.publish import write_sitemap, write_topics
from stemma.operators.vectors import load_vectors
from stemma.session import Scratch
from stemma.streaming import jobs as J


def one(spark, rows, schema, f):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f).collect()]


def test_phrases_need_neighbours_in_one_column(spark):
    docs = [(1, "the Lord's day", "a", "w"), (2, "lord of s and s", "a", "w"), (3, "s", "lord", "w")]
    p = spark.createDataFrame(docs, "id long, text string, author string, work string")
    q = spark.createDataFrame([(1, "lord's"), (2, "LORD s"), (3, "?!"), (4, None)], "query_id long, query string")
    got = {(r.query_id, r.id) for r in S.bm25_search(q, S.store_index(p, Scratch(spark))).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 3)}


def test_fusion_keeps_the_order_of_signals_in_ties(spark):
    h = lambda *ids: spark.createDataFrame([(1, i + 1, d) for i, d in enumerate(ids)], "query_id long, rank int, id long")
    got = S.rrf_fuse({"vector": h(9, 8), "fts": h(7, 9)}, {"vector": 1.0, "fts": 1.0})
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(9, 1), (7, 2), (8, 3)] or [r.id for r in got.orderBy("rank").collect()] == [9, 7, 8]
    tied = S.rrf_fuse({"vector": h(1), "fts": h(2)}, {"vector": 1.0, "fts": 1.0})
    assert [r.id for r in tied.orderBy("rank").collect()] == [1, 2]


def floored(spark, out, ranked, writings, work, author, floor, window, work_cap=3, author_cap=6):
    rows = [(1, i + 1, p, work[p], author[p], "writing" if p in writings else "commentary") for i, p in enumerate(ranked)]
    placed = spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(out)], "query_id long, id long, place int")
    got = S.writing_floor(spark.createDataFrame(rows, "query_id long, rank int, id long, work_id long, author_id long, kind string"), placed, Scratch(spark), floor, window, work_cap, author_cap)
    rows = got.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, len(out) + 1))
    return [r.id for r in rows]


def test_floor_exchanges_and_replaces(spark):
    work, author = {i: i for i in range(200)}, {i: i for i in range(200)}
    ranked = list(range(1, 11)) + [101, 102, 103]
    w = {101, 102, 103}
    assert floored(spark, ranked[:10], ranked, w, work, author, 2, 5) == [1, 2, 3, 101, 102, 6, 7, 8, 9, 10]
    whole = floored(spark, ranked, ranked, w, work, author, 2, 5)
    assert sorted(whole) == sorted(ranked) and whole[:5] == [1, 2, 3, 101, 102]
    assert floored(spark, [101, 102, 1], ranked, w, work, author, 2, 3) == [101, 102, 1]
    assert floored(spark, [1, 2], [1, 2], w, work, author, 2, 5) == [1, 2]
    capped = dict(author) | {101: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert 101 not in floored(spark, [1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7, 101, 102], {101, 102}, work, capped, 1, 7)


def test_floor_by_page_caps_and_limits(spark):
    work, author = {p: p for p in range(200)}, {p: p for p in range(200)}
    ranked = list(range(1, 101))
    out = floored(spark, ranked, ranked, {40, 61, 83}, work, author, 2, 15)
    assert [p for p in out[:15] if p in {40, 61}] == [40, 61] and out[:13] == ranked[:13] and sorted(out) == ranked
    assert (out[39], out[60]) == (14, 15)
    one = dict(work) | {101: 7, 102: 7, 103: 7}
    capped = floored(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 101, 102, 103], {101, 102, 103}, one, author, 2, 15, 1, 10)
    assert len({101, 102, 103} & set(capped)) == 1 and len(capped) == 5
    pool = list(range(1, 11)) + [101, 102, 103]
    assert all(len(set(floored(spark, pool[:n], pool, {101, 102, 103}, work, author, 2, 15))) == n for n in (1, 2, 3))


def test_caps_equal_the_greedy_list(spark):
    import random

    rng = random.Random(5)
    rows = [(1, i, i, w := rng.randrange(8), w % 3) for i in range(60)]
    got = [r.id for r in S.diversify(spark.createDataFrame(rows, "query_id long, rank int, id long, work_id long, author_id long"), 3, 6, 12).orderBy("place").collect()]
    works, authors, want = {}, {}, []
    for _, _, i, w, a in rows:
        if works.get(w, 0) < 3 and authors.get(a, 0) < 6 and len(want) < 12:
            works[w], authors[a] = works.get(w, 0) + 1, authors.get(a, 0) + 1
            want.append(i)
    assert got == want


def test_vectors_of_odd_width_and_zero_queries(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])], "passage_id long, embedding array<float>")
    assert {r.passage_id: r.unit for r in load_vectors(v, 2).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 4: [0.0, 0.0]}
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert {(r.query_id, r.id) for r in S.vector_topk(q, v, 2, 1).collect()} == {(2, 1)}


def windows(spark, sizes, at, budget, most, mode):
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate(sizes)], "work_id long, id long, size long")
    rows = R.read_windows(p, spark.createDataFrame([(9, 1, at)], "anchor_id long, work_id long, at int"), mode, budget, most).collect()
    return [(r.lo, r.hi) for r in rows]


def test_windows_hold_their_anchor(spark):
    assert windows(spark, [100] * 10, 4, 300, 60, "both") == [(3, 5)]
    assert windows(spark, [100] * 10, 4, 300, 60, "forward") == [(4, 6)]
    assert windows(spark, [100] * 10, 4, 300, 60, "backward") == [(2, 4)]
    assert windows(spark, [999], 7, 10, 60, "both") == [(0, 0)]
    assert windows(spark, [1] * 9, -3, 99, 4, "both") == [(0, 3)]
    assert windows(spark, [100] * 10, 0, 350, 60, "forward") == [(0, 2)]
    assert windows(spark, [1] * 1000, 500, 10_000_000, 60, "both") == [(471, 530)]
    assert windows(spark, [10] * 5, 99, 1000, 60, "forward") == [(4, 4)] and windows(spark, [10] * 5, -3, 1000, 60, "backward") == [(0, 0)]
    assert windows(spark, [], 0, 1000, 60, "both") == []


def test_a_side_that_ends_leaves_the_rest_to_the_other(spark):
    assert windows(spark, [5, 5, 5, 5, 900, 5], 3, 30, 60, "both") == [(0, 3)]
    assert windows(spark, [5, 900, 5, 5, 5, 5], 2, 18, 60, "both") == [(2, 4)]
    assert windows(spark, [5, 0, 900, 0, 5], 2, 900, 60, "both") == [(1, 3)]
    assert windows(spark, [5, 5, 900, 5], 2, 100, 60, "both") == [(2, 2)]


def test_pages_tile_every_work(spark):
    rows = [(w, i, s) for w, sizes in ((1, [5, 500, 1, 1, 1, 1, 1, 300, 400]), (2, [1])) for i, s in enumerate(sizes)]
    pages = R.paginate(spark.createDataFrame(rows, "work_id long, id long, size long"), 600, 4, 100).orderBy("work_id", "page").collect()
    first = [(p.lo, p.hi) for p in pages if p.work_id == 1]
    assert first == [(0, 3), (4, 7), (8, 8)] and [p.has_next for p in pages] == [True, True, False, False]
    assert pages[-1].complete and not pages[0].complete


def test_excerpts(spark):
    rows = [(1, 0, "Title."), (1, 1, "a" * 30), (1, 2, "b " * 60), (2, 0, "x" * 90), (2, 1, "y" * 50), (3, 0, "one two, three")]
    p = spark.createDataFrame(rows, "doc_id long, seq int, text string").withColumn("title", F.lit("title"))
    got = {(r.doc_id, r.seq): r.text for r in R.excerpts(p, 100, "title").collect()}
    assert got[1, 1] == "a" * 30 and got[1, 2].endswith("b…") and (1, 0) not in got
    assert (2, 1) not in got and got[3, 0] == "one two, three"
    assert R.excerpts(p.where("doc_id = 3"), 9, "title").first().text == "one two…"


def test_numerals_and_roman(spark):
    heads = ["Chapter XIV. Of works", "Sermon 105A", "Introduction", "Vision First", None, "IV", "Letter 12 [XX]", "Mixed"]
    df = R.parse_numeral(spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "id int, header string")).orderBy("id")
    assert [(r.number, r.suffix) for r in df.collect()] == [(14, ""), (105, "A"), (None, None), (1, ""), (None, None), (4, ""), (12, ""), (None, None)]


def test_reorder_moves_contents(spark):
    rows = [(1, 1, "Preface"), (2, 1, "John 2:1"), (3, 1, "Genesis 5:2"), (4, 1, "Genesis 1:3"), (5, 1, "John 1:9"), (9, 2, "b"), (10, 2, "a")]
    moved, report = R.reorder(spark.createDataFrame(rows, "id long, work_id long, header string"))
    assert {r.id: r.header for r in moved.collect()} == {1: "Preface", 2: "Genesis 1:3", 3: "Genesis 5:2", 4: "John 1:9", 5: "John 2:1", 9: "b", 10: "a"}
    assert {r.work_id: (r.mode, r.moved) for r in report.collect()} == {1: ("VERSE", 3), 2: (None, 0)}


def test_citations_and_markup(spark):
    f = lambda s: one(spark, [(s,)], "t string", T.strip_citations(F.col("t")))[0]
    assert f("See Matthew 8:22, and more") == "See, and more"
    assert f("1 Corinthians 13:4-7. Love") == "Love"
    assert f("Matthew said") == "Matthew said" and f("") == "" and f(None) is None
    df = spark.createDataFrame([(1, '<p>A<sup class="fn">1</sup> b <i>c</i></p>'), (2, "x Luke 1:2 y"), (3, None)], "id long, html string")
    assert [r.plain for r in T.strip_html(df, "html").orderBy("id").collect()] == ["A b c", "x y", ""]
    assert [r.m for r in T.remove_ref_markup(df, "html", "m").orderBy("id").collect()] == ["<p>A b <i>c</i></p>", "x Luke 1:2 y", None]


def test_chunks_of_a_page(spark):
    page = "<h1>Book</h1><p>One.</p><div><h2>Part</h2><p>Two <b>x</b>.</p></div><div class='pub'><p>no</p></div><hr><p>after</p>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<title>T</title><body><p>Source. x</p><p>Body</p><h3>Copyright</h3><p>z</p>")], "page_id long, html string")
    assert [(r.page_id, r.header, r.text) for r in T.chunk_pages(df).orderBy("page_id", "seq").collect()] == [(1, "Book", "One."), (1, "Part", "Two x."), (3, "T", "Body")]


def test_chunks_without_a_heading_of_their_own(spark):
    """No h1, or a first one that is none: the body, through rules, named by the title; what is inherited from pub; quotes; long texts."""
    pages = [
        (1, "<title>T</title><body><p>one</p><hr><p>two</p></body>"),
        (2, "<title>T</title><body><h1>Page not found</h1><p>one</p><div><h1>Later</h1><p>two</p></div></body>"),
        (3, "<body><h1>B</h1><div class='pub'><div><p>no</p></div></div><p class='pub'>own class</p><section><p>not reached</p></section></body>"),
        (4, "<h1>B</h1><blockquote><h3>H</h3><p>in</p></blockquote><blockquote><p>a</p>\n<p>b</p></blockquote><p>see <sup class='fn'>9</sup>Matthew 5:3 now</p>"),
        (5, "<h1>B</h1><p>" + "A sentence that is long enough here. " * 60 + "</p>"),
        (6, "<div>" * 3000 + "<h1>Deep</h1><p>text</p>" + "</div>" * 3000),
        (7, None),
    ]
    got = {}
    for x in T.chunk_pages(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "seq").collect():
        got.setdefault(x.page_id, []).append((x.header, x.text))
    assert got[1] == [("T", "one"), ("T", "two")] and got[2] == [("T", "one"), ("T", "two")] and got[3] == [("B", "own class")]
    assert got[4] == [("H", "in"), ("H", "a b"), ("H", "see now")] and got[6] == [("Deep", "text")] and 7 not in got
    assert len(got[5]) == 2 and all(len(t) <= 1500 for _, t in got[5])


def test_sections(spark):
    rows = [(1, i, h, t) for i, (h, t) in enumerate([("A", "0"), ("Start here", "1"), ("x", "begin 2"), ("x", "3"), ("x", "stop 4"), ("The End", "5"), ("The End", "6")])]
    c = spark.createDataFrame(rows, "page_id long, seq int, header string, text string")
    cut = lambda **k: [r.text for r in T.section_between(c, **k).orderBy("seq").collect()]
    assert cut(start="start", end="end") == ["1", "begin 2", "3", "stop 4"]
    assert cut(start="START", start_para="BEGIN", end_para="stop") == ["begin 2", "3"]
    assert [(r.spec_no, r.text) for r in T.compose_sections(c, [{"start": "end"}, {"end_para": "begin"}]).orderBy("spec_no", "seq").collect()] == [(0, "5"), (0, "6"), (1, "0"), (1, "1")]


def test_split_long_packs_sentences(spark):
    text = "Aaa aaa. Bbb bbb. " + "C" * 30 + ". Ddd."
    got = T.split_long(spark.createDataFrame([(1, "h", text), (2, "h", "short")], "id long, header string, text string"), 20).orderBy("id", "part")
    assert [r.text for r in got.collect()] == ["Aaa aaa. Bbb bbb.", "C" * 30 + ".", "Ddd.", "short"]


def test_urls_labels_and_truncation(spark):
    rows = [("https://www.CCEL.org/x", " "), ("http://www.a.org/b", None), (None, "T"), ("javascript:x", "")]
    df = T.with_citation(spark.createDataFrame(rows, "source_url string, source_title string"))
    assert [r.citation for r in df.collect()] == ["Christian Classics Ethereal Library (CCEL)", "a.org", "T", "javascript:x"]
    assert [T for T in one(spark, rows, "u string, t string", T.safe_url(F.col("u")))] == ["https://www.CCEL.org/x", "http://www.a.org/b", None, None]
    flags = T.flag_truncated(spark.createDataFrame([("x" * 60,), ("x" * 60 + ". 12 --",), ("short",), (None,)], "text string"))
    assert [r.truncated for r in flags.collect()] == [True, False, False, False]


def test_discovery_orders_parts_naturally(spark):
    paths = ["A/One.html", "A/index.html", "A/Conf/Book 10.html", "A/Conf/Book 2.html", "A/images/x.html", "A/Group/Sub/p.html", "A/Conf/deep/q.html", "readme.txt"]
    got = E.discover_works(spark.createDataFrame([(p,) for p in paths], "path string"), "r/").collect()
    assert {(r.title, r.part, r.part_no) for r in got} == {("One", None, 1), ("Conf", "Book 2", 1), ("Conf", "Book 10", 2), ("Group: Sub", "p", 1)}
    assert {r.source_url for r in got} == {"r/A", "r/A/Conf", "r/A/Group/Sub"}


def test_commentary_files(spark):
    good = '[[commentary]]\nquote = " q "\nsource_url = ""\n[[commentary]]\nquote = ""\n'
    files = [("X/1 John 3_5a-6.toml", good.encode()), ("X/bad 1_1.toml", b"= ="), ("X/other.toml", good.encode())]
    got = E.read_commentary_blocks(spark.createDataFrame(files, "path string, content binary")).collect()
    assert [(r.author, r.book, r.verse_ref, r.seq, r.quote, r.source_url) for r in got] == [("X", "1 John", "3:5a-6", 0, "q", None)]


def test_verse_headers(spark):
    heads = ["John 3:16", "Song of Solomon 2:1-4", "John 3:5a", "Preface", None, " 1 Cor. 1:2 – 3 "]
    got = E.build_verse_index(spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "id long, header string")).orderBy("passage_id").collect()
    assert [(r.passage_id, r.book, r.chapter, r.verse_start, r.verse_end) for r in got] == [(0, "John", 3, 16, None), (1, "Song of Solomon", 2, 1, 4), (5, "1 Cor.", 1, 2, 3)]


def test_new_ids_follow_the_old(spark):
    old = spark.createDataFrame([(7, "b")], "id long, name string")
    new = spark.createDataFrame([(n,) for n in "cabdc"], "name string")
    assert {(r.name, r.id) for r in E.upsert_dim(old, new, ["name"]).collect()} == {("b", 7), ("a", 8), ("c", 9), ("d", 10)}


def test_file_metadata(spark):
    files = spark.createDataFrame([("p", "A", "Mirrored from www.x.org/a by Y", "default_year = '310'"), ("q", "B", "", "default_year = 5")], "path string, author string, head string, meta string")
    known = spark.createDataFrame([("B", 99)], "author string, died int")
    assert {tuple(r) for r in E.file_metadata(files, known).collect()} == {("p", "www.x.org/a", 310), ("q", None, 99)}


def test_inserts_only_where_nothing_is(spark):
    works = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    have = spark.createDataFrame([(5, 1, "h", "t")], "id long, work_id long, header string, text string")
    new = spark.createDataFrame([(1, "h", "x" * 60), (2, "h", "x" * 60), (3, "h", "x"), (4, "h", "x" * 60)], "work_id long, header string, text string")
    out, status = E.insert_missing(works, have, new)
    assert {(r.id, r.work_id) for r in out.collect()} == {(5, 1), (6, 2)}
    assert {r.work_id: r.status for r in status.collect()} == {1: "has passages", 2: "inserted", 3: "too short", 4: "no such work"}


def test_batches_respect_budget_and_blanks(spark):
    rows = [(i, c, t) for i, (c, t) in enumerate([("a", 60), ("", 1), ("b", 60), ("c", 500), ("d", 1), ("e", 1)])]
    got = M.pack_batches(spark.createDataFrame(rows, "id long, clean string, tokens long"), 1, 100, 3).orderBy("id").collect()
    assert [(r.id, r.batch) for r in got] == [(0, 0), (2, 1), (3, 2), (4, 3), (5, 3)]


def test_sinks_round_trip(spark, tmp_path):
    routes = spark.createDataFrame([("work", "/a%20b"), ("work", "/c&d")], "family string, path string")
    write_sitemap(routes, f"{tmp_path}/s", "https://x")
    back = spark.read.format("xml").option("rowTag", "url").load(f"{tmp_path}/s")
    assert {r.loc for r in back.collect()} == {"https://x/a%20b", "https://x/c&d"}
    write_topics(spark.createDataFrame([("t", [1, 2])], "topic string, hits array<int>"), f"{tmp_path}/t", "https://x", "2026-01-01")
    assert spark.read.json(f"{tmp_path}/t").first().hits == [1, 2]


def test_streams_equal_their_batches(spark, tmp_path):
    calls = spark.sql("SELECT timestamp '2026-01-31 23:59:00' + make_interval(0,0,0,0,0,id) AS ts, if(id % 2 = 0, 'gemini_parse', 'x') AS call_type, id * 1.0D AS latency_ms, id % 3 > 0 AS ok, id AS event_id, id % 2 AS client, 'search' AS endpoint FROM range(10)")
    calls.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")

    def finish(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(r.month, r.call_type, r.spent) for r in finish(J.spend_stream(source), "update", "spend").collect()}
    assert got == {(r.month, r.call_type, r.spent) for r in L.monthly_spend(calls).collect()}
    assert finish(J.call_stats_stream(source), "append", "stats").columns == ["start", "call_type", "calls", "errors", "avg_ms", "p50_ms", "p95_ms"]
    over = {(r.client, r.n) for r in finish(J.over_limit_stream(source, {"search": 2}), "update", "over").collect()}
    assert over == {(r.client, r.n) for r in L.over_limit(calls, {"search": 2}).collect()}


def test_stale_kind_is_ignored(spark):
    r = spark.createDataFrame([(1, "x", "writing"), (1, "y", "writing"), (2, "x", "writing"), (2, "x", "commentary")], "query_id long, tradition string, kind string")
    s = spark.createDataFrame([(1, None, "commentary"), (2, "x", "commentary")], "query_id long, tradition string, kind string")
    assert sorted((x.query_id, x.kind) for x in C.facet_filter(r, s).collect()) == [(1, "writing"), (1, "writing"), (2, "commentary")]
