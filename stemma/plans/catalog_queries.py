"""Queries of the catalogue, verse index, ETL and publishing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import card_title, format_dates
from stemma.operators import catalog as C
from stemma.operators import etl as E
from stemma.operators.publish import route_metadata as metadata
from stemma.operators.publish import section_pages, write_sitemap, write_topics
from stemma.plans.registry import query
from stemma.session import Scratch
from stemma.sources.bindings import bind
from stemma.sources.corpus import load_corpus as read_corpus

FOLD = "CASE WHEN category IS NULL OR category NOT IN ('father','commentary','council','liturgy','apocrypha') THEN 'misc' WHEN category = 'commentary' THEN 'father' ELSE category END"
SECTION = "COALESCE(NULLIF(section, ''), CASE WHEN lower(trim(title)) LIKE 'commentary on%' THEN 'Commentary' ELSE 'Miscellaneous' END)"
FILTERS = [(1, "father", None, None), (2, "misc", None, None), (3, None, "NATION_3", None), (4, "council", None, "nicene"), (5, None, None, None)]
FILTERS_SQL = "(VALUES (1,'father',NULL,NULL),(2,'misc',NULL,NULL),(3,NULL,'NATION_3',NULL),(4,'council',NULL,'nicene'),(5,NULL,NULL,NULL)) f(filter_id, fc, ft, fe)"
ORDER_SQL = "[" + ", ".join(f"'{b.lower()}'" for b in C.BOOK_ORDER) + "]"


def b1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return bind(spark, d, "authors"), bind(spark, d, "works"), bind(spark, d, "passages")


def verses(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "verse_passages").withColumn("passage_id", F.col("id"))


@query("authors works passages", "SELECT p.id, p.work_id, p.header, w.title AS work, a.id AS author_id, a.name AS author FROM passages p JOIN works w ON p.work_id = w.id JOIN authors a ON w.author_id = a.id")
def corpus_full(spark, d):
    a, w, p = b1(spark, d)
    return C.full(p, w, a).select("id", "work_id", "header", "work", "author_id", "author")


@query("authors works", f"SELECT filter_id, CAST(row_number() OVER (PARTITION BY filter_id ORDER BY name, id) AS INTEGER) AS place, id, name, coalesce(n, 0) AS work_count FROM (SELECT *, {FOLD} AS folded FROM authors) a JOIN {FILTERS_SQL} ON (fc IS NULL OR fc = folded) AND (ft IS NULL OR ft = tradition) AND (fe IS NULL OR fe = era) LEFT JOIN (SELECT author_id, count(*) AS n FROM works GROUP BY 1) c ON c.author_id = a.id")
def list_authors(spark, d):
    a, w, _ = b1(spark, d)
    return C.list_authors(a, w, spark.createDataFrame(FILTERS, "filter_id int, category string, tradition string, era string"))


@query("text_passages", "SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'commentary' ELSE 'writing' END AS kind FROM text_passages")
def passage_kinds(spark, d):
    index = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("passage_id"))
    return C.with_kind(bind(spark, d, "text_passages").drop("kind"), index).select("id", "kind")


@query("authors works passages", "SELECT i.rank, p.id AS passage_id, w.title AS work, a.name AS author FROM (SELECT l_orderkey * 1000 + l_linenumber AS passage_id, l_partkey AS rank, 'CUSTOMER#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS who FROM lineitem) i JOIN passages p ON p.id = i.passage_id JOIN works w ON p.work_id = w.id JOIN authors a ON w.author_id = a.id")
def fetch_passages(spark, d):
    a, w, p = b1(spark, d)
    ids = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 1000 + l_linenumber AS passage_id", "l_partkey AS rank")
    return C.fetch_passages(p, w, a, ids).select("rank", "passage_id", "work", "author")


@query("authors works passages", "SELECT i.rank, p.id AS passage_id, w.title AS work, a.name AS author FROM (SELECT l_orderkey * 1000 + l_linenumber AS passage_id, l_partkey AS rank, 'CUSTOMER#00000000' || CAST(l_suppkey % 10 AS VARCHAR) AS who FROM lineitem) i JOIN passages p ON p.id = i.passage_id JOIN works w ON p.work_id = w.id JOIN authors a ON w.author_id = a.id WHERE lower(a.name) = lower(i.who)")
def fetch_passages_of_author(spark, d):
    a, w, p = b1(spark, d)
    ids = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 1000 + l_linenumber AS passage_id", "l_partkey AS rank", "concat('CUSTOMER#00000000', l_suppkey % 10) AS who")
    return C.fetch_passages(p, w, a, ids, "who").select("rank", "passage_id", "work", "author")


@query("text_authors", "SELECT id, name FROM text_authors WHERE name NOT IN ('src3', 'src5') AND name NOT IN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey BETWEEN 10 AND 12)")
def exclude_authors(spark, d):
    books = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey between 10 and 12").selectExpr("concat('src', n_nationkey) AS book")
    return C.exclude_authors(bind(spark, d, "text_authors"), spark.createDataFrame([("src3",), ("src5",)], "name string"), books).select("id", "name")


@query("text_works text_passages", "SELECT w.id, w.title, count(p.id) AS kept, count(p.id) = 0 AS dropped FROM text_works w LEFT JOIN (SELECT * FROM text_passages WHERE length(trim(text)) > 2000) p ON p.work_id = w.id GROUP BY w.id, w.title")
def drop_empty_works(spark, d):
    w, p = bind(spark, d, "text_works"), bind(spark, d, "text_passages")
    kept, bodies, gone = C.drop_empty(w, p, 2000)
    full = kept.join(bodies.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("kept")), "id").select("id", "title", "kept", F.lit(False).alias("dropped"))
    return full.unionByName(gone.select("id", "title", F.lit(0).cast("long").alias("kept"), F.lit(True).alias("dropped")))


@query("works", f"SELECT id, {SECTION} AS section FROM works")
def effective_sections(spark, d):
    return bind(spark, d, "works").select("id", C.effective_section(F.col("section"), F.col("title")).alias("section"))


@query("text_passages", "SELECT work_id, bool_or(coalesce(CASE WHEN id % 40 = 0 THEN 'https://x.example' WHEN id % 3 = 0 THEN '' END, '') <> '') AS has_sources FROM text_passages GROUP BY work_id")
def works_with_sources(spark, d):
    return C.has_sources(bind(spark, d, "text_passages").withColumn("source_url", F.expr("case when id % 40 = 0 then 'https://x.example' when id % 3 = 0 then '' end")))


REFS_SQL = "(SELECT p_partkey AS ref_id, CASE p_partkey % 4 WHEN 0 THEN 'GENESIS' WHEN 1 THEN 'Matthew' WHEN 2 THEN 'romans' ELSE '1 Corinthians' END AS book, CAST(p_partkey % 7 + 1 AS INT) AS chapter, CAST(p_partkey % 30 + 1 AS INT) AS verse FROM part)"


def refs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT p_partkey AS ref_id, CASE p_partkey % 4 WHEN 0 THEN 'GENESIS' WHEN 1 THEN 'Matthew' WHEN 2 THEN 'romans' ELSE '1 Corinthians' END AS book, CAST(p_partkey % 7 + 1 AS INT) AS chapter, CAST(p_partkey % 30 + 1 AS INT) AS verse FROM {part}", part=spark.read.parquet(f"{d}/part.parquet"))


@query("verse_passages verse_works verse_authors", f"SELECT r.ref_id, p.id, w.title AS work, a.name AS author FROM {REFS_SQL} r JOIN verse_passages p ON lower(r.book) = lower(p.book) AND r.chapter = p.chapter AND ((p.verse_end IS NULL AND p.verse_start = r.verse) OR r.verse BETWEEN p.verse_start AND p.verse_end) JOIN verse_works w ON p.work_id = w.id JOIN verse_authors a ON w.author_id = a.id")
def catena(spark, d):
    p = bind(spark, d, "verse_passages")
    index = verses(spark, d).select("passage_id", "book", "chapter", "verse_start", "verse_end")
    return C.catena(p.select("id", "work_id", "header"), bind(spark, d, "verse_works"), bind(spark, d, "verse_authors"), index, refs(spark, d)).select("ref_id", "id", "work", "author")


@query("verse_passages verse_works verse_authors", f"SELECT * FROM (SELECT r.ref_id, CAST(row_number() OVER (PARTITION BY r.ref_id ORDER BY a.name, w.title, p.id) AS INTEGER) AS place, p.id FROM (SELECT ref_id, book, chapter, CASE WHEN ref_id % 5 <> 0 THEN verse END AS verse FROM {REFS_SQL} x) r JOIN verse_passages p ON (r.verse IS NOT NULL AND (p.header ILIKE r.book || ' ' || r.chapter || ':' || r.verse OR p.header ILIKE r.book || ' ' || r.chapter || ':' || r.verse || '-%')) OR (r.verse IS NULL AND p.header ILIKE r.book || ' ' || r.chapter || ':%') JOIN verse_works w ON p.work_id = w.id AND w.title ILIKE 'Commentary on %' JOIN verse_authors a ON w.author_id = a.id) WHERE place <= 20")
def catena_by_header(spark, d):
    r = refs(spark, d).withColumn("verse", F.expr("case when ref_id % 5 <> 0 then verse end"))
    return C.catena_by_header(bind(spark, d, "verse_passages").select("id", "work_id", "header"), bind(spark, d, "verse_works"), bind(spark, d, "verse_authors"), r, 20).select("ref_id", "place", "id")


@query("works", "SELECT work_id, CAST(place AS INTEGER) AS place, sibling_id, sibling FROM (SELECT a.id AS work_id, b.id AS sibling_id, b.title AS sibling, row_number() OVER (PARTITION BY a.id ORDER BY b.title, b.id) AS place FROM works a JOIN works b ON a.author_id = b.author_id AND a.id <> b.id) WHERE place <= 8")
def sibling_works(spark, d):
    return C.siblings(bind(spark, d, "works"))


@query("authors works passages", f"SELECT place, l.category, label, coalesce(na, 0) AS author_count, coalesce(nw, 0) AS work_count, coalesce(np, 0) AS passage_count FROM (VALUES (0,'father','Church Fathers'),(1,'council','Councils'),(2,'liturgy','Liturgies'),(3,'apocrypha','Apocrypha'),(4,'misc','Miscellaneous')) l(place, category, label) LEFT JOIN (SELECT {FOLD} AS category, count(DISTINCT a.id) AS na, count(DISTINCT w.id) AS nw, count(p.id) AS np FROM authors a LEFT JOIN works w ON w.author_id = a.id LEFT JOIN passages p ON p.work_id = w.id GROUP BY 1) s ON s.category = l.category")
def category_summary(spark, d):
    return C.category_summary(*b1(spark, d))


@query("verse_passages", f"SELECT book, n, chapters, CAST(row_number() OVER (ORDER BY coalesce(list_position({ORDER_SQL}, lower(book)) - 1, {len(C.BOOK_ORDER)}), lower(book), book) AS INTEGER) AS place FROM (SELECT book, count(*) AS n, count(DISTINCT chapter) AS chapters FROM verse_passages GROUP BY book)")
def scripture_books(spark, d):
    return C.scripture_books(verses(spark, d))


@query("verse_passages", "SELECT book, chapter, count(*) AS n FROM verse_passages GROUP BY ALL")
def scripture_chapters(spark, d):
    return C.scripture_chapters(verses(spark, d))


@query("verse_passages", "SELECT book, chapter, verse_start, coalesce(verse_end, -1) AS verse_end, count(*) AS n FROM verse_passages GROUP BY ALL")
def scripture_verses(spark, d):
    return C.scripture_verses(verses(spark, d)).fillna(-1, "verse_end")


@query("verse_passages", "SELECT book, chapter, verse_start AS verse, count(*) AS n FROM verse_passages GROUP BY ALL HAVING count(*) >= 3")
def dense_verses(spark, d):
    return C.dense_verses(verses(spark, d))


@query("authors works passages", f"SELECT {SECTION} AS section, a.id AS author_id, a.name, string_agg(w.title || '/' || w.id || '/' || coalesce(n, 0), ';' ORDER BY w.title, w.id) AS works FROM works w JOIN authors a ON w.author_id = a.id LEFT JOIN (SELECT work_id, count(*) AS n FROM passages GROUP BY 1) c ON c.work_id = w.id GROUP BY 1, 2, 3")
def library(spark, d):
    branch = C.library(*b1(spark, d))
    return branch.select("section", "author_id", "name", F.array_join(F.transform("works", lambda x: F.concat_ws("/", x["title"], x["work_id"], x["passage_count"])), ";").alias("works"))


@query("authors works passages", f"SELECT author_id, CAST(row_number() OVER (PARTITION BY author_id ORDER BY CASE section WHEN 'Father' THEN 0 WHEN 'Commentary' THEN 1 WHEN 'Miscellaneous' THEN 2 ELSE 3 END, section, title, work_id) AS INTEGER) AS place, work_id, title, section, passage_count FROM (SELECT w.author_id, w.id AS work_id, w.title, {SECTION} AS section, coalesce(n, 0) AS passage_count FROM works w JOIN authors a ON a.id = w.author_id LEFT JOIN (SELECT work_id, count(*) AS n FROM passages GROUP BY 1) c ON c.work_id = w.id)")
def author_works(spark, d):
    return C.author_works(*b1(spark, d))


ERA_SQL = "coalesce(nullif(era, ''), CASE WHEN coalesce(died, born) IS NULL THEN 'unknown' WHEN coalesce(died, born) <= 100 THEN 'apostolic' WHEN coalesce(died, born) <= 325 THEN 'ante-nicene' WHEN coalesce(died, born) <= 381 THEN 'nicene' ELSE 'post-nicene' END)"


@query("authors", f"SELECT CAST(list_position(['apostolic','ante-nicene','nicene','post-nicene','unknown'], era_id) AS INTEGER) AS place, era_id, CAST(row_number() OVER (PARTITION BY era_id ORDER BY name, id) AS INTEGER) AS nr, name FROM (SELECT {ERA_SQL} AS era_id, id, name FROM authors)")
def authors_by_era(spark, d):
    return C.authors_by_era(bind(spark, d, "authors"))


@query("authors works", f"SELECT l.category, coalesce(n, 0) AS n FROM (VALUES ('father'),('council'),('liturgy'),('apocrypha'),('misc')) l(category) LEFT JOIN (SELECT {FOLD} AS category, count(*) AS n FROM authors GROUP BY 1) s USING (category) UNION ALL SELECT 'commentary', count(*) FROM works WHERE {SECTION} = 'Commentary'")
def tile_counts(spark, d):
    return C.tile_counts(*b1(spark, d))


@query("runs", "SELECT work_id, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, coalesce(sum(length(text)), 0) <= 4000 AS complete FROM runs GROUP BY work_id")
def work_sizes(spark, d):
    return C.work_sizes(bind(spark, d, "runs"), 4000)


@query("text_passages", r"SELECT work_id, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) < 3000 AND sum(length(text)) <= 40000 AS short FROM text_passages GROUP BY work_id")
def short_works(spark, d):
    return C.short_works(bind(spark, d, "text_passages"), "text", 3000, 40000)


@query("works", "SELECT * FROM (SELECT author_id, id, title, CAST(row_number() OVER (PARTITION BY author_id ORDER BY title, id) AS INTEGER) AS place FROM works) WHERE place <= 3")
def first_works(spark, d):
    return C.top_k(bind(spark, d, "works").select("author_id", "id", "title"), ["author_id"], [F.col("title"), F.col("id")], 3)


@query("text_passages", "SELECT author, count(v.vec_id) AS embedded, count(*) AS total FROM text_passages p LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = p.id GROUP BY author")
def vector_coverage(spark, d):
    return C.coverage(bind(spark, d, "text_passages"), bind(spark, d, "vectors"))


ROUTES_SQL = """SELECT family, path FROM (
 SELECT 'static' AS family, unnest(['/', '/about']) AS path UNION ALL SELECT 'topic', '/topics/' || unnest(['grace', 'prayer']) UNION ALL SELECT 'browse', '/browse/' || unnest(['father','council','liturgy','apocrypha','misc'])
 UNION ALL SELECT 'work', '/works/' || id FROM works UNION ALL SELECT 'author', '/authors/' || id FROM authors WHERE id IN (SELECT author_id FROM works)
 UNION ALL SELECT DISTINCT 'book', '/scripture/' || url_encode(book) FROM verse_passages UNION ALL SELECT DISTINCT 'chapter', '/scripture/' || url_encode(book) || '/' || chapter FROM verse_passages
 UNION ALL SELECT 'verse', '/scripture/' || url_encode(book) || '/' || chapter || '/' || verse_start FROM verse_passages GROUP BY book, chapter, verse_start HAVING count(*) >= 3)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    return C.route_inventory(bind(spark, d, "authors"), bind(spark, d, "works"), verses(spark, d), ["grace", "prayer"])


@query("authors works verse_passages", ROUTES_SQL)
def route_inventory(spark, d):
    return routes(spark, d)


@query("authors works verse_passages", f"SELECT 'https://s.example' || path AS loc FROM ({ROUTES_SQL})")
def sitemap(spark, d):
    scratch = Scratch(spark)
    write_sitemap(routes(spark, d), f"{scratch.root}/sitemap", "https://s.example")
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(f"{scratch.root}/sitemap")


@query("authors", f"SELECT 'https://s.example' AS site, '2026-01-01' AS generated, category AS slug, count(*) AS n, min(name) AS first FROM authors GROUP BY category")
def topics_file(spark, d):
    scratch = Scratch(spark)
    topics = bind(spark, d, "authors").groupBy(F.col("category").alias("slug")).agg(F.struct(F.count("*").alias("n"), F.min("name").alias("first")).alias("hits"))
    write_topics(topics, f"{scratch.root}/topics", "https://s.example", "2026-01-01")
    kinds = "site string, generated string, slug string, hits struct<n:bigint,first:string>"
    return spark.read.schema(kinds).json(f"{scratch.root}/topics").select("site", "generated", "slug", "hits.*")


@query("authors works passages", "SELECT a.id, name, category, CAST(NULL AS VARCHAR) AS era, CAST(NULL AS VARCHAR) AS section, w.id AS work_id, p.id AS passage_id, CAST(NULL AS VARCHAR) AS source_title FROM authors a JOIN works w ON w.author_id = a.id JOIN passages p ON p.work_id = w.id")
def load_corpus(spark, d):
    scratch = Scratch(spark)
    a, w, p = b1(spark, d)
    for name, df in (("authors", a.drop("era")), ("works", w.drop("section")), ("passages", p)):
        df.write.parquet(f"{scratch.root}/{name}.parquet")
    c = read_corpus(spark, scratch.root)
    works = c.works.select(F.col("id").alias("work_id"), F.col("author_id").alias("id"), "section")
    return c.authors.select("id", "name", "category", "era").join(works, "id").join(c.passages.select(F.col("id").alias("passage_id"), "work_id", "source_title"), "work_id")


@query("authors works verse_passages", f"SELECT coalesce(family, 'total') AS family, count(*) AS n FROM ({ROUTES_SQL}) GROUP BY ROLLUP (family)")
def route_counts(spark, d):
    return C.route_counts(routes(spark, d))


@query("verse_passages", "SELECT DISTINCT book, chapter FROM verse_passages")
def distinct_refs(spark, d):
    return verses(spark, d).select("book", "chapter").distinct()


@query("verse_passages", "SELECT id AS passage_id, book, chapter, verse_start, coalesce(verse_end, -1) AS verse_end FROM verse_passages")
def build_verse_index(spark, d):
    return E.build_verse_index(bind(spark, d, "verse_passages").select("id", "header")).fillna(-1, "verse_end")


NAMES_SQL = "CASE id % 12 WHEN 0 THEN 'Origen' WHEN 1 THEN 'Council of Nicaea' WHEN 2 THEN 'Gospel of Thomas' WHEN 3 THEN 'Didache' WHEN 4 THEN 'Liturgy of St James' WHEN 5 THEN 'Ephrem the Syrian' WHEN 6 THEN 'Leo the Great' WHEN 7 THEN 'Book of Enoch' WHEN 8 THEN 'Desert Father ' || name WHEN 9 THEN 'Clement of Rome' WHEN 10 THEN 'Muratorian fragment' ELSE name END"
CLASSIFY_SQL = f"""
SELECT id, name, category,
  CASE WHEN n LIKE 'origen%' THEN 'greek' WHEN n LIKE 'leo the great%' OR n LIKE '%of rome%' THEN 'latin' WHEN n LIKE 'ephrem%' OR n LIKE '%syrian%' THEN 'syriac' WHEN n LIKE '%desert father%' THEN 'coptic' WHEN category = 'father' THEN 'greek' ELSE 'other' END AS tradition,
  CASE WHEN y <= 100 THEN 'apostolic' WHEN y <= 325 THEN 'ante-nicene' WHEN y <= 381 THEN 'nicene' WHEN y IS NOT NULL THEN 'post-nicene' END AS era
FROM (SELECT *, coalesce(died, CASE n WHEN 'origen' THEN 253 WHEN 'ephrem the syrian' THEN 373 WHEN 'leo the great' THEN 461 WHEN 'clement of rome' THEN 99 END, born) AS y,
             CASE WHEN real OR by_name IN ('misc', 'apocrypha') THEN by_name ELSE 'commentary' END AS category
      FROM (SELECT id, name, lower(trim(name)) AS n, born, died, coalesce(r, 0) > 0 AS real,
                   CASE WHEN lower(name) LIKE '%council%' THEN 'council' WHEN name = 'Didache' THEN 'misc' WHEN lower(name) LIKE '%liturgy%' THEN 'liturgy' WHEN lower(name) LIKE 'gospel of%' THEN 'apocrypha'
                        WHEN lower(name) LIKE 'book of%' OR lower(name) LIKE '%fragment%' THEN 'misc' ELSE 'father' END AS by_name
            FROM (SELECT id, {NAMES_SQL} AS name, born, died FROM authors) a LEFT JOIN (SELECT author_id, sum(CASE WHEN title ILIKE 'Commentary on%' THEN 0 ELSE 1 END) AS r FROM works GROUP BY 1) w ON w.author_id = a.id))"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    named = bind(spark, d, "authors").withColumn("name", F.expr(NAMES_SQL))
    return E.classify_authors(named, bind(spark, d, "works"))


@query("authors works", CLASSIFY_SQL)
def classify_authors(spark, d):
    return classified(spark, d).select("id", "name", "category", "tradition", "era")


@query("authors works", f"WITH c AS ({CLASSIFY_SQL}) SELECT 'category' AS field, coalesce(category, '(null)') AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'tradition', coalesce(tradition, '(null)'), count(*) FROM c GROUP BY ALL UNION ALL SELECT 'era', coalesce(era, '(null)'), count(*) FROM c GROUP BY ALL")
def migration_summary(spark, d):
    return E.migration_summary(classified(spark, d))


@query("verse_passages", "SELECT count(header) AS headers_scanned, count(*) AS index_rows, count(DISTINCT book) AS distinct_books FROM (SELECT header, book FROM verse_passages)")
def import_summary(spark, d):
    p = bind(spark, d, "verse_passages").select("id", "header")
    return E.import_summary(p, E.build_verse_index(p))


@query("authors works passages", "SELECT a.id AS author_id, name, count(DISTINCT w.id) AS works, count(p.id) AS passages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM authors a LEFT JOIN works w ON w.author_id = a.id LEFT JOIN passages p ON p.work_id = w.id GROUP BY a.id, name")
def author_totals(spark, d):
    return E.author_totals(*b1(spark, d))


@query("authors works passages", "WITH g AS (SELECT id FROM authors WHERE name IN (SELECT name FROM authors WHERE id % 11 = 1)), gw AS (SELECT id FROM works WHERE author_id IN (SELECT id FROM g)), gp AS (SELECT id FROM passages WHERE work_id IN (SELECT id FROM gw)) SELECT 'authors' AS \"table\", count(*) AS removed FROM g UNION ALL SELECT 'works', count(*) FROM gw UNION ALL SELECT 'passages', count(*) FROM gp UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id * 1000 + 1 IN (SELECT id FROM gp) UNION ALL SELECT 'verse_index', count(*) FROM (SELECT id FROM passages) p WHERE id IN (SELECT id FROM gp)")
def prune_authors(spark, d):
    a, w, p = b1(spark, d)
    v = bind(spark, d, "vectors").withColumn("passage_id", F.expr("passage_id * 1000 + 1"))
    return E.prune_authors(a, w, p, v, p.select(F.col("id").alias("passage_id")), a.where("id % 11 = 1").select("name"))["counts"]


@query("authors works passages", "SELECT p.id, p.work_id FROM passages p WHERE p.work_id NOT IN (SELECT id FROM works WHERE author_id % 11 = 1)")
def prune_authors_passages(spark, d):
    a, w, p = b1(spark, d)
    v = bind(spark, d, "vectors")
    return E.prune_authors(a, w, p, v, v, a.where("id % 11 = 1").select("name"))["passages"].select("id", "work_id")


@query("authors", "SELECT id, CASE WHEN id % 3 = 1 AND category <> 'misc' THEN 'misc' ELSE category END AS category FROM authors")
def reclassify_authors(spark, d):
    a = bind(spark, d, "authors")
    return E.reclassify(a, a.where("id % 3 = 1").select("name"))[0].select("id", "category")


@query("authors", "SELECT count(*) AS changed FROM authors WHERE id % 3 = 1 AND category <> 'misc'")
def reclassify_count(spark, d):
    a = bind(spark, d, "authors")
    return E.reclassify(a, a.where("id % 3 = 1").select("name"))[1]


@query("authors", "WITH new AS (SELECT DISTINCT CONCAT('New ', CAST(o_custkey % 50 AS VARCHAR)) AS name FROM orders UNION SELECT name FROM authors WHERE id < 5), top AS (SELECT max(id) AS m FROM authors) SELECT id, name FROM authors UNION ALL SELECT m + row_number() OVER (ORDER BY name), name FROM new, top WHERE name NOT IN (SELECT name FROM authors)")
def upsert_authors(spark, d):
    a = bind(spark, d, "authors").select("id", "name")
    new = spark.read.parquet(f"{d}/orders.parquet").selectExpr("concat('New ', o_custkey % 50) AS name").union(a.where("id < 5").select("name"))
    return E.upsert_dim(a, new, ["name"])


def corrected(spark: SparkSession, d: str) -> tuple:
    c = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 9 = 0").groupBy(F.col("l_orderkey").alias("work_id"), F.col("l_returnflag").alias("header")).agg(F.lit("Corrected text.").alias("text"))
    c = c.withColumn("correction_id", F.expr("work_id * 10 + case header when 'A' then 1 when 'N' then 2 else 3 end"))
    return E.apply_corrections(bind(spark, d, "passages"), c)


@query("passages", "SELECT id, CASE WHEN work_id % 9 = 0 AND count(*) OVER (PARTITION BY work_id, header) = 1 THEN 'Corrected text.' ELSE text END AS text FROM passages")
def apply_corrections(spark, d):
    return corrected(spark, d)[0].select("id", "text")


@query("passages", "SELECT work_id * 10 + CASE header WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS correction_id, count(*) AS matches, CASE WHEN count(*) = 1 THEN max(CAST(length(text) AS INTEGER)) ELSE -1 END AS old_len, 15 AS new_len FROM passages WHERE work_id % 9 = 0 GROUP BY work_id, header")
def corrections_report(spark, d):
    return corrected(spark, d)[1].fillna(-1, "old_len")


@query("authors", "SELECT id, CASE WHEN born IS NULL AND died IS NULL THEN '' WHEN born = died THEN 'c. ' || born WHEN born IS NULL THEN 'd. ' || died WHEN died IS NULL THEN 'b. ' || born ELSE born || '–' || died END AS dates FROM authors")
def life_dates(spark, d):
    return bind(spark, d, "authors").select("id", format_dates(F.col("born"), F.col("died")).alias("dates"))


@query("works", r"SELECT id, CASE WHEN h = '' THEN w WHEN w = '' THEN h WHEN starts_with(nh, nw) OR starts_with(nw, nh) THEN CASE WHEN length(w) >= length(h) THEN w ELSE h END ELSE h END AS card FROM (SELECT id, trim(title) AS w, hd AS h, trim(regexp_replace(lower(trim(title)), '\.\s*$', '')) AS nw, trim(regexp_replace(lower(hd), '\.\s*$', '')) AS nh FROM (SELECT *, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN title || '.' WHEN 2 THEN 'Commentary' ELSE 'Prologue' END AS hd FROM works))")
def card_titles(spark, d):
    w = bind(spark, d, "works").withColumn("header", F.expr("case id % 4 when 0 then '' when 1 then concat(title, '.') when 2 then 'Commentary' else 'Prologue' end"))
    return w.select("id", card_title(F.col("title"), F.col("header")).alias("card"))


DATES = "CASE WHEN born IS NULL AND died IS NULL THEN '' WHEN born = died THEN 'c. ' || born WHEN born IS NULL THEN 'd. ' || died WHEN died IS NULL THEN 'b. ' || born ELSE born || '–' || died END"


@query("authors works passages", f"SELECT 'work' AS family, '/works/' || w.id AS path, title || ' — ' || name AS title, title || ' by ' || name || CASE WHEN {DATES} <> '' THEN ' (' || {DATES} || ')' ELSE '' END || ': ' || coalesce(n, 0) || ' passages.' AS description, 'https://s.example/works/' || w.id AS canonical, '' AS links FROM works w JOIN authors a ON a.id = w.author_id LEFT JOIN (SELECT work_id, count(*) AS n FROM passages GROUP BY 1) c ON c.work_id = w.id UNION ALL SELECT 'author', '/authors/' || a.id, name || CASE WHEN {DATES} <> '' THEN ' (' || {DATES} || ')' ELSE '' END, 'Works of ' || name || '.', 'https://s.example/authors/' || a.id, l.links FROM authors a JOIN (SELECT author_id, string_agg('/works/' || id, ' ' ORDER BY r) AS links FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY title, id) AS r FROM works) WHERE r <= 60 GROUP BY author_id) l ON l.author_id = a.id")
def route_metadata(spark, d):
    rows = metadata(*b1(spark, d), "https://s.example")
    return rows.drop("json_ld").withColumn("links", F.array_join("links", " "))


TOPICS = "SELECT s_suppkey AS n, 'topic-' || s_suppkey AS slug, s_name AS title, 'On ' || s_name AS description, 'What is said on ' || s_name || '.' AS intro FROM supplier"


@query("authors", f"""WITH t AS ({TOPICS}), k AS (SELECT category AS slug, count(*) AS n FROM authors WHERE category IS NOT NULL GROUP BY 1),
x AS (SELECT 'topic' AS family, '/topics' AS path, 'Topics' AS title, 'All topics.' AS description, '' AS excerpt, (SELECT string_agg('/topics/' || slug, ' ' ORDER BY n) FROM (SELECT * FROM t ORDER BY n LIMIT 60)) AS links
UNION ALL SELECT 'topic', '/topics/' || slug, title, description, intro, '' FROM t
UNION ALL SELECT 'browse', '/browse', 'Browse', 'All categories.', '', (SELECT string_agg('/browse/' || slug, ' ' ORDER BY slug) FROM (SELECT * FROM k ORDER BY slug LIMIT 60))
UNION ALL SELECT 'browse', '/browse/' || slug, slug, n || ' authors.', '', '' FROM k
UNION ALL SELECT 'static', '/about', 'About', 'What this is.', '', '')
SELECT *, 'https://s.example' || path AS canonical, CASE WHEN path = '/topics' THEN 'CollectionPage' WHEN family = 'topic' THEN 'Article' ELSE '' END AS kind FROM x""")
def section_metadata(spark, d):
    topics = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as n", "concat('topic-', s_suppkey) as slug", "s_name as title", "concat('On ', s_name) as description", "concat('What is said on ', s_name, '.') as intro")
    tiles = bind(spark, d, "authors").where("category is not null").groupBy(F.col("category").alias("slug")).agg(F.count("*").alias("n"))
    tiles = tiles.select("slug", F.col("slug").alias("title"), F.concat(F.col("n").cast("string"), F.lit(" authors.")).alias("description"))
    rows = section_pages(topics, tiles, {"/about": ("About", "What this is."), "/topics": ("Topics", "All topics."), "/browse": ("Browse", "All categories.")}, "https://s.example")
    return rows.withColumn("links", F.array_join("links", " ")).withColumn("kind", F.coalesce(F.get_json_object("json_ld", "$['@type']"), F.lit(""))).drop("json_ld")


@query("text_passages", """WITH f AS (SELECT work_id AS doc_id, arg_min(text, id) AS text FROM text_passages GROUP BY 1),
p AS (SELECT doc_id, i AS seq, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM f) WHERE trim(t) <> ''),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM p),
o AS (SELECT *, upto - length(text) AS used, sum(CASE WHEN upto > 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS overs FROM s),
e AS (SELECT doc_id, seq, text FROM o WHERE overs = 0 AND used < 1200
UNION ALL SELECT doc_id, seq, rtrim(CASE WHEN length(cut) - instr(reverse(cut), ' ') > 0 AND instr(cut, ' ') > 0 THEN substring(cut, 1, length(cut) - instr(reverse(cut), ' ')) ELSE cut END, ' ,;:') || '…'
FROM (SELECT doc_id, seq, substring(text, 1, CAST(1200 - used AS INTEGER)) AS cut FROM o WHERE overs = 1 AND upto > 1200 AND used < 600))
SELECT doc_id AS work_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS excerpt FROM e GROUP BY 1""")
def work_excerpts(spark, d):
    return C.work_excerpts(bind(spark, d, "text_passages").select("work_id", "id", "text"))
