"""Queries of the text, import, repair and embedding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import embed as M
from stemma.operators import etl as E
from stemma.operators.reader import reorder
from stemma.plans.registry import query
from stemma.sources.bindings import bind

#: Citations in the documents' texts, some with two spaces inside a book's name, which are none.
CITED = "CASE doc_id % 5 WHEN 0 THEN 'As in Matthew 8:22, and 1 Corinthians  13:4-7. ' || text WHEN 1 THEN text || ' Song of Solomon 2:1' WHEN 2 THEN text || ' Song of  Solomon 2:1' WHEN 3 THEN '1  Corinthians 13:4, see ' || text ELSE text END"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def cited(spark, d):
    return docs(spark, d).select("doc_id", F.expr(CITED).alias("text"))


WHOLE = f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({CITED}, '(?i)\\b(?:Matthew|1\\sCorinthians|Song\\sof\\sSolomon)\\s+\\d+:\\d+(?:-\\d+)?\\.?', ' ', 'g'),
  '[ \\t\u00a0]+', ' ', 'g'), '\\bof\\s*,', ',', 'g'), '\\s+([,.;:!?])', '\\1', 'g'), '"\\s+', '" ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents"""


@query("", WHOLE)
def strip_citations(spark, d):
    return cited(spark, d).select("doc_id", T.strip_citations(F.col("text")).alias("text"))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: str) -> str:
    """SQL for a text with the references that the pages hold decoded; those by name need no semicolon, as in cut titles."""
    for name, to in ENTITIES:
        text = f"replace({text}, '{name}', '{to}')" if name[1] == "#" else f"regexp_replace({text}, '{name}?', '{to}', 'g')"
    return text


BARE = rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t ]+', ' ', 'g'), '\bof\s*,', ',', 'g'), '\s+([,.;:!?])', '\1', 'g'), '"\s+', '" ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS plain FROM (
  SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', '<i>', 'gis'), '<style\b[^>]*>.*?</style>', '<i>', 'gis'), '<!--.*?-->', '<i>', 'gs'), '<[^>]+>'), lambda x: trim({decoded('x')}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ') AS t FROM pages)""".replace("\\u00a0", " ")


@query("", BARE)
def strip_html(spark, d):
    return T.strip_html(pages(spark, d), "html").select("page_id", "plain")


#: Notes put into the pages before bold words, of which some hold other elements of their kind, or notes.
NOTES = ("<sup class='fn'>1</sup>", '<span class="ref small">see <span>p. <sup>2</sup></span> 3</span>', "<span class='stiki'><span class=\"fn\">a</span>b</span>")


@query("", "SELECT page_id, trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM pages")
def remove_ref_markup(spark, d):
    note = F.array(*(F.lit(n) for n in NOTES))[F.col("page_id") % 3]
    marked = pages(spark, d).withColumn("html", F.regexp_replace("html", F.lit("<b>"), F.concat(note, F.lit("<b>"))))
    return T.remove_ref_markup(marked, "html", "clean").select("page_id", "clean")


PARTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '\s*\n\s*', ' ', 'g'), '</(?:p|div|h[1-6]|li|blockquote|tr)\s*>|<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"""
PARA = rf"""SELECT page_id, CAST(i AS INTEGER) AS seq, t AS text FROM (SELECT page_id, i, trim(regexp_replace(l, '[ \t\u00a0]+', ' ', 'g')) AS t FROM (SELECT page_id, unnest(string_split(h, chr(10))) AS l, unnest(range(0, len(string_split(h, chr(10))))) AS i FROM (
  SELECT page_id, {decoded(PARTED)} AS h FROM pages))) WHERE length(t) >= 2 AND NOT regexp_matches(t, '^[-–—_=*\s]+$')""".replace("\\u00a0", "\u00a0")


@query("", PARA)
def paragraphs(spark, d):
    return T.to_paragraphs(pages(spark, d), "html", "page_id")


SENTENCES = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\\s+([A-Z\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("", f"""WITH RECURSIVE s AS (SELECT doc_id AS id, text, {SENTENCES.format('text')} AS ss FROM documents),
walk AS (SELECT id, 1 AS i, 0 AS part, ss[1] AS buf FROM s WHERE length(text) > 500 AND len(ss) > 0
  UNION ALL SELECT w.id, i + 1, CASE WHEN length(buf) + 1 + length(ss[i + 1]) <= 500 THEN part ELSE part + 1 END, CASE WHEN length(buf) + 1 + length(ss[i + 1]) <= 500 THEN buf || ' ' || ss[i + 1] ELSE ss[i + 1] END FROM walk w JOIN s ON s.id = w.id WHERE i < len(ss))
SELECT id, 'h' AS header, CAST(part AS INTEGER) AS part, arg_max(buf, i) AS text FROM walk GROUP BY id, part UNION ALL SELECT id, 'h', 0, text FROM s WHERE length(text) <= 500""")
def split_long(spark, d):
    return T.split_long(docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("h").alias("header"), "text"), 500)


TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[ \t\n ]+', ' ', 'g'), '\bof\s*,', ',', 'g'), '\s+([,.;:!?])', '\1', 'g'), '"\s+', '" ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"""
#: The pages' paragraphs follow their h1 in an article. One that begins in bold is never closed, nor is its bold text, so that it holds all that comes after it.
CHUNKS = f"""WITH RECURSIVE art AS (SELECT page_id, trim({decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}) AS label, regexp_extract(html, '</h1>(.*?)</article>', 1, 's') AS a FROM pages),
half AS (SELECT page_id, label, CASE WHEN contains(a, '<p><b>') THEN left(a, position('<p><b>' IN a) - 1) ELSE a END AS head, CASE WHEN contains(a, '<p><b>') THEN substr(a, position('<p><b>' IN a)) ELSE '' END AS tail FROM art),
para AS (SELECT page_id, label, unnest(range(len(regexp_extract_all(head, '<p>(.*?)</p>', 1)))) AS n, {decoded("unnest(regexp_extract_all(head, '<p>(.*?)</p>', 1))")} AS t FROM half
  UNION ALL SELECT page_id, label, 1000000, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(tail, '<b>|</b>|<br>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)), lambda x: trim({decoded('x')}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ') FROM half),
s AS (SELECT page_id, label, n, text, {SENTENCES.format('text')} AS ss FROM (SELECT page_id, label, n, {TIDY.format('t')} AS text FROM para) WHERE text <> ''),
walk AS (SELECT page_id, n, 1 AS i, 0 AS part, ss[1] AS buf FROM s WHERE length(text) > 1500 AND len(ss) > 0
  UNION ALL SELECT w.page_id, w.n, i + 1, CASE WHEN length(buf) + 1 + length(ss[i + 1]) <= 1500 THEN part ELSE part + 1 END, CASE WHEN length(buf) + 1 + length(ss[i + 1]) <= 1500 THEN buf || ' ' || ss[i + 1] ELSE ss[i + 1] END FROM walk w JOIN s ON s.page_id = w.page_id AND s.n = w.n WHERE i < len(ss)),
parts AS (SELECT page_id, n, part, arg_max(buf, i) AS text FROM walk GROUP BY ALL UNION ALL SELECT page_id, n, 0, text FROM s WHERE length(text) <= 1500),
l AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n, part) - 1 AS INTEGER) AS seq, label AS header, text FROM parts JOIN art USING (page_id))"""


@query("", f"{CHUNKS} SELECT * FROM l")
def chunk_pages(spark, d):
    return T.chunk_pages(pages(spark, d))


def lines(spark, d):
    """Lines of the documents as paragraphs under headers."""
    split = docs(spark, d).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return split.withColumn("header", F.expr("concat('Part ', cast(page_id + seq as bigint) div 3 % 5)")).select("page_id", "seq", "header", "text")


LINES = "l AS (SELECT doc_id AS page_id, CAST(i AS INTEGER) AS seq, 'Part ' || ((doc_id + i) // 3 % 5) AS header, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"
SEEN = "coalesce(max(CASE WHEN contains(lower({col}), '{mark}') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq), 0)"


@query("", f"""WITH {LINES}, a AS (SELECT * FROM l QUALIFY {SEEN.format(col='header', mark='part 2')} = 1), b AS (SELECT * FROM a QUALIFY {SEEN.format(col='header', mark='part 1')} = 0),
c AS (SELECT * FROM b QUALIFY {SEEN.format(col='text', mark='an')} = 1) SELECT * FROM c QUALIFY {SEEN.format(col='text', mark='qu')} = 0""")
def section_between_lines(spark, d):
    return T.section_between(lines(spark, d), "PART 2", "Part 1", "an", "qu")


@query("", f"""WITH {LINES}, a AS (SELECT * FROM l QUALIFY {SEEN.format(col='header', mark='part 3')} = 1), b AS (SELECT * FROM l QUALIFY {SEEN.format(col='text', mark='er')} = 0)
SELECT *, CAST(0 AS INTEGER) AS spec_no FROM a UNION ALL SELECT *, CAST(1 AS INTEGER) FROM b""")
def compose_sections_lines(spark, d):
    return T.compose_sections(lines(spark, d), [{"start": "part 3"}, {"end_para": "er"}])


@query("", f"{CHUNKS}, a AS (SELECT * FROM l QUALIFY {SEEN.format(col='text', mark='the')} = 1) SELECT * FROM a QUALIFY {SEEN.format(col='text', mark='that')} = 0")
def section_between(spark, d):
    return T.section_between(T.chunk_pages(pages(spark, d)), start_para="the", end_para="that")


@query("", f"""{CHUNKS}, a AS (SELECT * FROM l QUALIFY {SEEN.format(col='text', mark='and')} = 1), b AS (SELECT * FROM l QUALIFY {SEEN.format(col='text', mark='the')} = 0)
SELECT *, CAST(0 AS INTEGER) AS spec_no FROM a UNION ALL SELECT *, CAST(1 AS INTEGER) FROM b""")
def compose_sections(spark, d):
    return T.compose_sections(T.chunk_pages(pages(spark, d)), [{"start_para": "and"}, {"end_para": "the"}])


@query("", "SELECT page_id, CASE WHEN regexp_matches(trim(u), '(?i)^https?://[^\\s/?#]+') THEN trim(u) END AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'javascript:alert(1)' WHEN 1 THEN '//' || url WHEN 2 THEN ' ' || url ELSE url END AS u FROM pages)")
def safe_urls(spark, d):
    u = F.expr("case page_id % 4 when 0 then 'javascript:alert(1)' when 1 then concat('//', url) when 2 then concat(' ', url) else url end")
    return pages(spark, d).select("page_id", T.safe_url(u).alias("safe"))


@query("", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'A title' WHEN 1 THEN 'Christian Classics Ethereal Library (CCEL)' ELSE regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') END AS citation FROM pages")
def citations(spark, d):
    p = pages(spark, d).select("page_id", F.expr("case when page_id % 3 = 0 then ' A title ' else '' end").alias("source_title"), F.expr("case when page_id % 3 = 1 then 'https://www.ccel.org/x' else url end").alias("source_url"))
    return T.with_citation(p).select("page_id", "citation")


TRUNC = r"regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(coalesce({}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '(parparpar|par)+$', '')), '[-–— \t0-9]+$', '')"


@query("", f"SELECT doc_id, length(v) >= 50 AND NOT regexp_matches(v, '[.!?\"'')]$') AS truncated FROM (SELECT doc_id, {TRUNC.format('text')} AS v FROM documents)")
def flag_truncated(spark, d):
    return T.flag_truncated(docs(spark, d).select("doc_id", "text")).select("doc_id", "truncated")


@query("", r"SELECT doc_id, left(regexp_replace(trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'IV. ' WHEN 1 THEN '12. ' ELSE '' END || text, '\s+', ' ', 'g')), '^(?:[IVXivx]+\.|\d+\.|§\d+\.?)\s+', ''), 200) AS title FROM documents")
def clean_titles(spark, d):
    return E.clean_titles(docs(spark, d).select("doc_id", F.expr("concat(case doc_id % 3 when 0 then 'IV. ' when 1 then '12. ' else '' end, text)").alias("title")), "title")


OUTLINE = r"""SELECT page_id, CAST(i AS INTEGER) AS seq, CASE WHEN length(t) > 80 THEN regexp_replace(left(t, 77), '\s+\S*$', '') || '…' ELSE t END AS heading
FROM (SELECT page_id, i, regexp_replace(trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '\.\s*[-–—]\s*', '. ', 'g') AS t
FROM (SELECT page_id, unnest(hs) AS h, unnest(range(0, len(hs))) AS i FROM (SELECT page_id, regexp_extract_all(replace(replace(html, '<p>', '<h2>'), '</p>', '</h2>'), '(?is)<h[23]\b[^>]*>(.*?)</h[23]\s*>', 1) AS hs FROM pages) WHERE len(hs) >= 2))"""


@query("", OUTLINE)
def inner_outline(spark, d):
    h = F.expr("replace(replace(html, '<p>', '<h2>'), '</p>', '</h2>')")
    return T.inner_outline(pages(spark, d).select("page_id", h.alias("html")), "page_id", "html")


BLOCKS = "SELECT w.id AS work_id, 'h' || (d.doc_id % 3) AS header, d.text, d.doc_id AS seq FROM documents d JOIN text_works w ON d.source = w.source AND d.lang = w.lang"


def blocks(spark, d):
    return bind(spark, d, "text_passages").select("work_id", F.expr("concat('h', id % 3)").alias("header"), "text", F.col("id").alias("seq"))


@query("text_works", f"WITH b AS ({BLOCKS}) SELECT work_id, header, seq FROM (SELECT *, row_number() OVER (PARTITION BY work_id, header, left(text, 100) ORDER BY seq) AS r FROM b) x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM b e WHERE e.seq % 10 = 0 AND e.work_id = x.work_id AND e.header = x.header AND left(e.text, 100) = left(x.text, 100))")
def dedupe_blocks(spark, d):
    b = blocks(spark, d)
    return E.dedupe_blocks(b, b.where("seq % 10 = 0")).select("work_id", "header", "seq")


@query("text_works", f"WITH p AS ({BLOCKS}), b AS (SELECT work_id, header, seq, CASE WHEN seq % 2 = 0 THEN text ELSE left(text, 120) || ' changed' END AS quote, 'T' || seq AS t FROM p WHERE seq % 3 <> 0), e AS (SELECT p.seq AS id, b.seq, t FROM b JOIN p ON b.work_id = p.work_id AND b.header = p.header AND b.quote = p.text), n AS (SELECT p.seq AS id, b.seq, t FROM b JOIN p ON b.work_id = p.work_id AND b.header = p.header AND left(b.quote, 120) = left(p.text, 120) WHERE b.seq NOT IN (SELECT seq FROM e)) SELECT p.seq AS id, (SELECT max_by(t, seq) FROM (SELECT * FROM e UNION ALL SELECT * FROM n) h WHERE h.id = p.seq) AS source_title FROM p")
def backfill_sources(spark, d):
    p = blocks(spark, d)
    b = p.where("seq % 3 <> 0").select("work_id", "header", F.expr("case when seq % 2 = 0 then text else concat(substring(text, 1, 120), ' changed') end").alias("quote"), "seq", F.expr("concat('T', seq)").alias("source_title"), F.lit(None).cast("string").alias("source_url"))
    return E.backfill_sources(p.withColumnRenamed("seq", "id"), b).select("id", "source_title")


def fresh_texts(spark, d):
    p = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("folder"), F.expr("concat('H ', doc_id)").alias("header"), F.expr("case when doc_id % 2 = 0 then substring(text, 1, 200) else text end").alias("text"))
    fresh = docs(spark, d).where("doc_id % 3 <> 0").select(F.col("doc_id").alias("fresh_id"), F.expr("case when doc_id % 5 = 0 then 'elsewhere' else source end").alias("folder"), F.lit("part").alias("stem"), F.expr("concat(' h  ', doc_id)").alias("header"), "text")
    return E.repair_truncated(p, fresh)


VIS = r"length(trim(regexp_replace(regexp_replace(coalesce({}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))"


@query("", f"SELECT doc_id AS fresh_id, CASE WHEN doc_id % 5 = 0 THEN 'unmatched' WHEN length(v) >= 50 AND NOT regexp_matches(v, '[.!?\"'')]$') AND {VIS.format('text')} >= {VIS.format('o')} + 500 THEN 'repaired' ELSE 'skipped' END AS status FROM (SELECT *, {TRUNC.format('o')} AS v FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN left(text, 200) ELSE text END AS o FROM documents)) WHERE doc_id % 3 <> 0")
def repair_truncated(spark, d):
    return fresh_texts(spark, d)[1].select("fresh_id", "status")


def recovered(spark, d):
    r = bind(spark, d, "runs")
    works = r.select(F.col("work_id").alias("id")).distinct()
    new = works.select(F.col("id").alias("work_id"), F.lit("New").alias("header"), F.expr("case when id % 4 = 0 then 'short' else repeat('long enough ', 9) end").alias("text"))
    return E.insert_missing(works, r.where("work_id % 2 = 1"), new)


@query("runs", "SELECT work_id, 'New' AS header, CASE WHEN work_id % 2 = 1 THEN 'has passages' WHEN work_id % 4 = 0 THEN 'too short' ELSE 'inserted' END AS status FROM (SELECT DISTINCT work_id FROM runs)")
def insert_missing(spark, d):
    return recovered(spark, d)[1]


@query("runs", "WITH top AS (SELECT max(id) AS m FROM runs WHERE work_id % 2 = 1) SELECT id, work_id, header, length(text) AS n FROM runs WHERE work_id % 2 = 1 UNION ALL SELECT m + row_number() OVER (ORDER BY work_id), work_id, 'New', 108 FROM (SELECT DISTINCT work_id FROM runs WHERE work_id % 2 = 0 AND work_id % 4 <> 0), top")
def inserted_passages(spark, d):
    return recovered(spark, d)[0].select("id", "work_id", "header", F.length("text").cast("long").alias("n"))


@query("text_passages", "SELECT id FROM text_passages WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def pending_passages(spark, d):
    return M.pending(bind(spark, d, "text_passages").select("id", "text"), bind(spark, d, "vectors")).select("id")


@query("", r"SELECT doc_id AS id, CAST(length(t) AS BIGINT) AS n, CAST(floor(length(t) / 3.0) + 1 AS BIGINT) AS tokens FROM (SELECT doc_id, regexp_replace(left(coalesce(text, ''), 120000), '^\s+|\s+$', '', 'g') AS t FROM documents)")
def prepare_texts(spark, d):
    prepared = M.prepare_texts(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), markup=False)
    return prepared.select("id", F.length("clean").cast("long").alias("n"), "tokens")


@query("", f"SELECT page_id AS id, CAST(length(t) AS BIGINT) AS n, CAST(floor(length(t) / 3.0) + 1 AS BIGINT) AS tokens FROM (SELECT page_id, regexp_replace(left(plain, 120000), '^\\s+|\\s+$', '', 'g') AS t FROM ({BARE}))")
def prepare_pages(spark, d):
    prepared = M.prepare_texts(pages(spark, d).select(F.col("page_id").alias("id"), F.col("html").alias("text")))
    return prepared.select("id", F.length("clean").cast("long").alias("n"), "tokens")


@query("", r"""WITH RECURSIVE t AS (SELECT doc_id AS id, regexp_replace(left(coalesce(text, ''), 120000), '^\s+|\s+$', '', 'g') AS t FROM documents),
n AS (SELECT greatest(1, ceil(count(*) / 4096.0)) :: BIGINT AS shards FROM t),
k AS (SELECT id, id % shards AS shard, CAST(floor(length(t) / 3.0) + 1 AS BIGINT) AS tokens, t = '' AS blank, row_number() OVER (PARTITION BY id % shards ORDER BY id) AS no FROM t, n),
walk AS (SELECT id, shard, no, tokens, blank, CAST(0 AS BIGINT) AS batch, 1 AS win, CASE WHEN blank THEN 0 ELSE tokens END AS used, CASE WHEN blank THEN 0 ELSE 1 END AS held FROM k WHERE no = 1
  UNION ALL SELECT k.id, k.shard, k.no, k.tokens, k.blank, CASE WHEN win = 128 OR held > 0 AND used + k.tokens > 10000 THEN batch + CAST(held > 0 AS BIGINT) ELSE batch END, CASE WHEN win = 128 OR held > 0 AND used + k.tokens > 10000 THEN 1 ELSE win + 1 END,
    CASE WHEN win = 128 OR held > 0 AND used + k.tokens > 10000 THEN 0 ELSE used END + CASE WHEN k.blank THEN 0 ELSE k.tokens END, CASE WHEN win = 128 OR held > 0 AND used + k.tokens > 10000 THEN 0 ELSE held END + CASE WHEN k.blank THEN 0 ELSE 1 END
  FROM walk w JOIN k ON k.shard = w.shard AND k.no = w.no + 1)
SELECT id, shard, batch, tokens FROM walk WHERE NOT blank""")
def pack_batches(spark, d):
    return M.pack_batches(M.prepare_texts(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), markup=False), most_tokens=10_000)


@query("", r"SELECT vec_id AS passage_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings UNION ALL SELECT doc_id, 64 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND regexp_matches(text, '\S')")
def embed_pending(spark, d):
    texts = M.prepare_texts(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return M.embed(texts, M.hashing_encoder(), bind(spark, d, "vectors")).select("passage_id", F.size("embedding").alias("dim"))


@query("", "SELECT vec_id AS passage_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)")
def invalidate_vectors(spark, d):
    return M.invalidate(bind(spark, d, "vectors"), docs(spark, d).where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))).select("passage_id")


@query("verse_passages", "SELECT work_id, CASE WHEN count(*) >= 3 THEN 'VERSE' END AS mode FROM verse_passages GROUP BY work_id")
def reorder_report(spark, d):
    return reorder(bind(spark, d, "verse_passages").select("id", "work_id", "header"))[1].select("work_id", "mode")


TREE = "CASE doc_id % 4 WHEN 0 THEN source || '/Work ' || lang || '.html' WHEN 1 THEN source || '/Long ' || lang || '/Book ' || doc_id || '.html' WHEN 2 THEN source || '/Group/' || lang || '/' || doc_id || '.html' ELSE source || '/images/' || doc_id || '.html' END"


@query("", f"WITH f AS (SELECT DISTINCT source, lang, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS n FROM documents WHERE doc_id % 4 < 3) SELECT source AS author, CASE k WHEN 0 THEN 'Work ' || lang WHEN 1 THEN 'Long ' || lang ELSE 'Group: ' || lang END AS title, CAST(row_number() OVER (PARTITION BY source, lang, k ORDER BY n) AS INTEGER) AS part_no, CASE k WHEN 0 THEN source || '/Work ' || lang || '.html' WHEN 1 THEN source || '/Long ' || lang || '/Book ' || n || '.html' ELSE source || '/Group/' || lang || '/' || n || '.html' END AS path, CASE k WHEN 0 THEN source WHEN 1 THEN source || '/Long%20' || lang ELSE source || '/Group/' || lang END AS source_url FROM f")
def discover_works(spark, d):
    files = docs(spark, d).select(F.expr(TREE).alias("path")).distinct()
    return E.discover_works(files).select("author", "title", "part_no", "path", "source_url")


@query("", "SELECT source AS author, '1 John' AS book, CAST(doc_id AS VARCHAR) || ':2a-4' AS verse_ref, CAST(0 AS INTEGER) AS seq, lang || ' ' || doc_id AS quote, 'https://s.example/' || doc_id AS source_url FROM documents WHERE doc_id % 3 > 0")
def read_commentary_blocks(spark, d):
    body = "concat('[[commentary]]\nquote = \" ', lang, ' ', doc_id, ' \"\nsource_url = \"https://s.example/', doc_id, '\"\n[[commentary]]\nquote = \"\"\n')"
    content = F.expr(f"cast(case when doc_id % 3 = 0 then '= broken' else {body} end as binary)")
    files = docs(spark, d).select(F.expr("concat(source, '/1 John ', doc_id, '_2a-4.toml')").alias("path"), content.alias("content"))
    return E.read_commentary_blocks(files).drop("source_title")


@query("", "SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'www.x.example/' || doc_id ELSE '' END AS mirror_url, CASE WHEN source = 'src1' THEN 99 WHEN doc_id % 3 = 0 THEN -1 ELSE CAST(doc_id AS INTEGER) END AS year FROM documents")
def file_metadata(spark, d):
    head = F.expr("case when doc_id % 2 = 0 then concat('<!-- Mirrored from www.x.example/', doc_id, ' by tool -->') else text end")
    meta = F.expr("case when doc_id % 3 = 0 then 'wiki = 1' else concat('a = 1\ndefault_year = ', doc_id) end")
    files = docs(spark, d).select(F.expr("concat(source, '/', doc_id)").alias("path"), F.col("source").alias("author"), head.alias("head"), meta.alias("meta"))
    return E.file_metadata(files, spark.createDataFrame([("src1", 99)], "author string, died int")).fillna(-1, "year").fillna("", "mirror_url")
