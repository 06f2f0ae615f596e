"""Catalogue look-ups, filters, joins and aggregates over authors, works and passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.intervals import holding_ranges

#: Tasks a core that the passages of a verse are dealt to, refs in a list.
SPREAD, LIST = 16, 512
#: Category names and labels in display order (fixed values).
CATEGORIES = (("father", "Church Fathers"), ("council", "Councils"), ("liturgy", "Liturgies"), ("apocrypha", "Apocrypha"), ("misc", "Miscellaneous"))
NAMED = ("father", "commentary", "council", "liturgy", "apocrypha")
ERAS = ("apostolic", "ante-nicene", "nicene", "post-nicene")
#: The canonical order of books (fixed values).
BOOK_ORDER = (
    "Genesis", "Exodus", "Leviticus", "Numbers", "Deuteronomy", "Joshua", "Judges", "Ruth", "1 Samuel", "2 Samuel", "1 Kings", "2 Kings",
    "1 Chronicles", "2 Chronicles", "Ezra", "Nehemiah", "Tobit", "Judith", "Esther", "1 Maccabees", "2 Maccabees", "Job", "Psalms", "Psalm",
    "Proverbs", "Ecclesiastes", "Song of Solomon", "Wisdom", "Sirach", "Isaiah", "Jeremiah", "Lamentations", "Baruch", "Ezekiel", "Daniel",
    "Prayer of Azariah", "Hosea", "Joel", "Amos", "Obadiah", "Jonah", "Micah", "Nahum", "Habakkuk", "Zephaniah", "Haggai", "Zechariah", "Malachi",
    "Matthew", "Mark", "Luke", "John", "Acts", "Romans", "1 Corinthians", "2 Corinthians", "Galatians", "Ephesians", "Philippians", "Colossians",
    "1 Thessalonians", "2 Thessalonians", "1 Timothy", "2 Timothy", "Titus", "Philemon", "Hebrews", "James", "1 Peter", "1 Pet", "2 Peter", "2 Pet",
    "1 John", "2 John", "3 John", "Jude", "Revelation",
)


def full(passages: DataFrame, works: DataFrame, authors: DataFrame) -> DataFrame:
    """Passages with their work's title and author's name."""
    w = works.select(F.col("id").alias("work_id"), "author_id", F.col("title").alias("work"))
    a = authors.select(F.col("id").alias("author_id"), F.col("name").alias("author"))
    return passages.join(w, "work_id").join(a, "author_id")


def folded_category(category: Column) -> Column:
    """father for a father or a commentator, misc for nothing or an unknown name."""
    return F.when(category.isNull() | ~category.isin(*NAMED), "misc").when(category == "commentary", "father").otherwise(category)


def list_authors(authors: DataFrame, works: DataFrame, filters: DataFrame) -> DataFrame:
    """For every filter row (filter_id, category, tradition, era; null: any) its authors with work counts, numbered by name.

    A filter asks for some of the three values, and an author answers with every choice of theirs, so that both meet by equality.
    """
    counts = works.groupBy("author_id").agg(F.count("*").alias("n"))
    known = authors.withColumn("folded", folded_category(F.col("category"))).join(counts, F.col("id") == F.col("author_id"), "left")
    f = filters.select("filter_id", F.col("category").alias("fc"), F.col("tradition").alias("ft"), F.col("era").alias("fe"))
    asked = F.expr("filter(transform(sequence(0, 7), i -> named_struct('c', if(i % 2 = 1, folded, null), 't', if(i div 2 % 2 = 1, tradition, null), 'e', if(i div 4 = 1, era, null), 'i', i)), x -> (x.c is not null) = (x.i % 2 = 1) and (x.t is not null) = (x.i div 2 % 2 = 1) and (x.e is not null) = (x.i div 4 = 1))")
    cut = known.withColumn("x", F.explode(asked)).join(f, F.expr("x.c <=> fc and x.t <=> ft and x.e <=> fe"))
    order = Window.partitionBy("filter_id").orderBy("name", "id")
    return cut.select("filter_id", F.row_number().over(order).alias("place"), "id", "name", F.coalesce("n", F.lit(0)).alias("work_count"))


def with_kind(passages: DataFrame, verse_index: DataFrame) -> DataFrame:
    keyed = verse_index.select(F.col("passage_id").alias("id"), F.lit(True).alias("keyed")).distinct()
    return passages.join(keyed, "id", "left").withColumn("kind", F.when(F.col("keyed"), "commentary").otherwise("writing")).drop("keyed")


def fetch_passages(passages: DataFrame, works: DataFrame, authors: DataFrame, ids: DataFrame, author_col: str | None = None) -> DataFrame:
    """Bibliographic rows for a ranked table of ids (passage_id, rank); missing ids drop; author_col restricts each to an author, in any case."""
    found = full(passages, works, authors).withColumnRenamed("id", "passage_id").join(ids, "passage_id")
    return found if author_col is None else found.where(F.lower(F.col("author")) == F.lower(F.col(author_col)))


def facet_filter(results: DataFrame, selections: DataFrame) -> DataFrame:
    """Results (query_id, tradition, kind, ...) under each query's selection; a chosen kind counts only where both kinds are there."""
    chosen = selections.select("query_id", F.col("tradition").alias("st"), F.col("kind").alias("sk"))
    both = Window.partitionBy("query_id")
    joined = results.join(chosen, "query_id", "left").withColumn("both", (F.max((F.col("kind") == "writing").cast("int")).over(both) + F.max((F.col("kind") == "commentary").cast("int")).over(both)) == 2)
    return joined.where("(st is null or st = '' or tradition = st) and (sk is null or not both or kind = sk)").drop("st", "sk", "both")


def exclude_authors(authors: DataFrame, denied: DataFrame, books: DataFrame) -> DataFrame:
    return authors.join(denied.select("name"), "name", "left_anti").join(books.select(F.col("book").alias("name")), "name", "left_anti")


def drop_empty(works: DataFrame, passages: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works and passages whose trimmed bodies pass ``least`` characters, and the works left with none."""
    bodies = passages.where(F.length(F.trim("text")) > least)
    ids = bodies.select(F.col("work_id").alias("id")).distinct()
    return works.join(ids, "id", "left_semi"), bodies, works.join(ids, "id", "left_anti")


def effective_section(section: Column, title: Column) -> Column:
    given = F.when(section != "", section)
    return F.coalesce(given, F.when(F.lower(F.trim(title)).startswith("commentary on"), "Commentary").otherwise("Miscellaneous"))


def has_sources(passages: DataFrame) -> DataFrame:
    return passages.groupBy("work_id").agg(F.coalesce(F.bool_or(F.coalesce(F.col("source_url"), F.lit("")) != ""), F.lit(False)).alias("has_sources"))


def catena(passages: DataFrame, works: DataFrame, authors: DataFrame, verse_index: DataFrame, refs: DataFrame) -> DataFrame:
    """Passages on each verse of refs (ref_id, book, chapter, verse): an open verse equals it, a range holds it.

    Different ranges and different verses meet first, once each, however many passages and refs have them. The pairs of passages and refs,
    which are the result, are made in the last step and go nowhere from there: a passage meets lists of the refs on its verse and is
    written out against them. A verse's passages are spread over several tasks, however many are on it, and a list is bounded.
    """
    at, key = ["b", "chapter", "verse_start", "verse_end"], ["b", "chapter", "verse"]
    v = verse_index.select(F.col("passage_id").alias("id"), F.lower("book").alias("b"), "chapter", "verse_start", F.coalesce("verse_end", "verse_start").alias("verse_end"))
    r = refs.select("ref_id", F.lower("book").alias("b"), "chapter", "verse")
    held = holding_ranges(v.select(*at).distinct(), "verse_start", "verse_end", r.select(*key).distinct(), "verse", ["b", "chapter"])
    on = full(passages, works, authors).join(v.join(held, at), "id").drop("verse_start", "verse_end")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ref_id")) - 1
    lists = r.withColumn("_list", F.floor(nth / LIST)).groupBy(*key, "_list").agg(F.collect_list(F.struct("ref_id")).alias("_refs")).drop("_list")
    # what a task has to do is pairs, which the planner doesn't count: so the number of tasks is given
    tasks = SPREAD * passages.sparkSession.sparkContext.defaultParallelism
    dealt = on.withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).repartition(tasks, *key, "_deal")
    each = lists.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).repartition(tasks, *key, "_deal")
    met = dealt.join(each.hint("merge"), [*key, "_deal"])
    return met.select(*(c for c in on.columns if c not in key), F.inline("_refs"))


def catena_by_header(passages: DataFrame, works: DataFrame, authors: DataFrame, refs: DataFrame, limit: int = 200) -> DataFrame:
    """Commentary passages whose header names a verse (``B C:V`` or ``B C:V-...``) or any verse of a chapter, in any case.

    refs: ref_id, book, chapter, verse (null: the whole chapter); the first ``limit`` of each by author, work and id stay. A passage stands under
    its chapter and its verse; the first ones are taken of each that is asked for, and only they meet the refs.
    """
    r = refs.select("ref_id", F.lower(F.concat_ws(" ", "book", "chapter")).alias("head"), F.coalesce(F.col("verse").cast("string"), F.lit("")).alias("verse"))
    marked = passages.where(F.col("header").contains(":")).withColumn("head", F.lower(F.substring_index("header", ":", 1))).withColumn("tail", F.expr("substring(header, length(head) + 2)"))
    under = marked.withColumn("verse", F.explode(F.array_distinct(F.array(F.lit(""), F.regexp_extract("tail", "^-?[^-]*", 0))))).drop("tail")
    asked = under.join(r.select("head", "verse").distinct(), ["head", "verse"], "left_semi")
    named = full(asked, works, authors).where(F.col("work").ilike("Commentary on %"))
    order = [F.col("author"), F.col("work"), F.col("id")]
    first = top_k(named, ["head", "verse"], order, limit, "place").drop("place")
    return top_k(first.join(r, ["head", "verse"]), ["ref_id"], order, limit, "place").drop("head", "verse")


def siblings(works: DataFrame, n: int = 8) -> DataFrame:
    """For each work the first n other works of its author, by title and id."""
    # the first n + 1 by title are enough, as a work leaves out only itself
    order = Window.partitionBy("author_id").orderBy("title", "id")
    first = works.select("author_id", F.col("id").alias("sibling_id"), F.col("title").alias("sibling"), F.row_number().over(order.orderBy("title", "id")).alias("r")).where(F.col("r") <= n + 1)
    met = works.select(F.col("id").alias("work_id"), "author_id").join(first, "author_id").where("work_id <> sibling_id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("work_id").orderBy("r"))).where(F.col("place") <= n).select("work_id", "place", "sibling_id", "sibling")


def category_summary(authors: DataFrame, works: DataFrame, passages: DataFrame) -> DataFrame:
    """Authors, works and passages per category, in the fixed order, zero where absent."""
    per_work = passages.groupBy("work_id").agg(F.count("*").alias("np"))
    per_author = works.join(per_work, F.col("id") == F.col("work_id"), "left").groupBy("author_id").agg(F.count("*").alias("nw"), F.sum("np").alias("np"))
    sums = authors.withColumn("category", folded_category(F.col("category"))).join(per_author, F.col("id") == F.col("author_id"), "left").groupBy("category").agg(F.count("*").alias("na"), F.sum("nw").alias("nw"), F.sum("np").alias("np"))
    labels = authors.sparkSession.createDataFrame([(i, k, label) for i, (k, label) in enumerate(CATEGORIES)], "place int, category string, label string")
    return F.broadcast(labels).join(sums, "category", "left").select("place", "category", "label", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("na", "author_count"), ("nw", "work_count"), ("np", "passage_count"))))


def work_excerpts(passages: DataFrame, budget: int = 1200) -> DataFrame:
    """(work_id, excerpt): the first paragraphs of each work's first passage, up to a budget."""
    from stemma.operators.reader import excerpts

    first = passages.groupBy("work_id").agg(F.min_by("text", "id").alias("text"))
    lines = first.select(F.col("work_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).where("trim(text) <> ''")
    taken = excerpts(lines, budget)
    return taken.groupBy(F.col("doc_id").alias("work_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("excerpt"))


def book_rank(book: Column) -> Column:
    table = F.create_map(*(x for i, b in enumerate(BOOK_ORDER) for x in (F.lit(b.lower()), F.lit(i))))
    return F.coalesce(table[F.lower(book)], F.lit(len(BOOK_ORDER)))


def scripture_books(verse_index: DataFrame) -> DataFrame:
    books = verse_index.groupBy("book").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))
    return books.withColumn("place", F.row_number().over(Window.orderBy(book_rank(F.col("book")), F.lower("book"), "book")))  # one row per book


def scripture_chapters(verse_index: DataFrame) -> DataFrame:
    return verse_index.groupBy("book", "chapter").agg(F.count("*").alias("n"))


def scripture_verses(verse_index: DataFrame) -> DataFrame:
    return verse_index.groupBy("book", "chapter", "verse_start", "verse_end").agg(F.count("*").alias("n"))


def dense_verses(verse_index: DataFrame, least: int = 3) -> DataFrame:
    return verse_index.groupBy("book", "chapter", F.col("verse_start").alias("verse")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def work_rows(authors: DataFrame, works: DataFrame, passages: DataFrame) -> DataFrame:
    """Works with author, effective section and passage count."""
    counts = passages.groupBy("work_id").agg(F.count("*").alias("n"))
    a = authors.select(F.col("id").alias("author_id"), "name", "bio")
    rows = works.join(a, "author_id").join(counts, F.col("id") == F.col("work_id"), "left")
    return rows.select("author_id", "name", "bio", F.col("id").alias("work_id"), "title", F.col("section").alias("raw_section"), effective_section(F.col("section"), F.col("title")).alias("section"), F.coalesce("n", F.lit(0)).alias("passage_count"))


def library(authors: DataFrame, works: DataFrame, passages: DataFrame) -> DataFrame:
    """section, author and the author's works there as an array by title: the tree, one row per branch."""
    rows = work_rows(authors, works, passages)
    branch = rows.groupBy("section", "author_id", "name", "bio").agg(F.sort_array(F.collect_list(F.struct("title", "work_id", "passage_count"))).alias("works"))
    return branch.select("section", "author_id", "name", "bio", "works")


def author_works(authors: DataFrame, works: DataFrame, passages: DataFrame) -> DataFrame:
    """Each author's works in the order Father, Commentary, Miscellaneous, any others, then by title."""
    rank = F.when(F.col("section") == "Father", 0).when(F.col("section") == "Commentary", 1).when(F.col("section") == "Miscellaneous", 2).otherwise(3)
    order = Window.partitionBy("author_id").orderBy(rank, "section", "title", "work_id")
    rows = work_rows(authors, works, passages)
    return rows.select("author_id", F.row_number().over(order).alias("place"), "work_id", "title", "section", "passage_count")


def era_of(died: Column, born: Column, era: Column | None = None) -> Column:
    year = F.coalesce(died, born)
    by_year = F.when(year.isNull(), "unknown").when(year <= 100, "apostolic").when(year <= 325, "ante-nicene").when(year <= 381, "nicene").otherwise("post-nicene")
    return by_year if era is None else F.coalesce(F.when(era != "", era), by_year)


def authors_by_era(authors: DataFrame) -> DataFrame:
    """(place, era_id, nr, name): the eras in order, and in each its authors numbered by name."""
    rank = F.array_position(F.array(*(F.lit(e) for e in (*ERAS, "unknown"))), F.col("era_id"))
    nr = F.row_number().over(Window.partitionBy("era_id").orderBy("name", "id"))
    return authors.withColumn("era_id", era_of(F.col("died"), F.col("born"), F.col("era"))).select(rank.cast("int").alias("place"), "era_id", nr.alias("nr"), "name")


def tile_counts(authors: DataFrame, works: DataFrame, passages: DataFrame) -> DataFrame:
    """The number on each browse tile: authors of a category, or works of the Commentary section."""
    a = category_summary(authors, works, passages).select("category", F.col("author_count").cast("long").alias("n"))
    w = works.withColumn("section", effective_section(F.col("section"), F.col("title"))).agg(F.count_if(F.col("section") == "Commentary").alias("n")).select(F.lit("commentary").alias("category"), "n")
    return a.union(w)


def work_sizes(passages: DataFrame, whole: int = 400_000) -> DataFrame:
    return passages.groupBy("work_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("complete", F.col("chars") <= whole)


def short_works(passages: DataFrame, plain: str = "text", most_words: int = 300, most_chars: int = 4000) -> DataFrame:
    words = F.expr(f"size(filter(split(coalesce({plain}, ''), '\\\\s+'), w -> w <> ''))")
    sums = passages.groupBy("work_id").agg(F.sum(words).alias("words"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    return sums.select("work_id", "words", ((F.col("words") < most_words) & (F.col("chars") <= most_chars)).alias("short"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)


def coverage(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("passage_id").alias("id"), F.lit(1).alias("v")).distinct()
    return passages.join(v, "id", "left").groupBy("author").agg(F.count("v").alias("embedded"), F.count("*").alias("total"))


def route_inventory(authors: DataFrame, works: DataFrame, verse_index: DataFrame, topics: list[str], least: int = 3) -> DataFrame:
    """family and path of every page: fixed ones, topics, browse tiles, works, authors with a work, books, chapters, dense verses."""
    spark = authors.sparkSession
    encode = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    fixed = [("static", "/"), ("static", "/about"), *(("topic", f"/topics/{t}") for t in topics), *(("browse", f"/browse/{c}") for c, _ in CATEGORIES)]
    book = encode(F.col("book"))
    parts = [
        spark.createDataFrame(fixed, "family string, path string"),
        works.select(F.lit("work").alias("family"), F.concat(F.lit("/works/"), F.col("id").cast("string")).alias("path")),
        authors.join(works.select(F.col("author_id").alias("id")).distinct(), "id", "left_semi").select(F.lit("author").alias("family"), F.concat(F.lit("/authors/"), F.col("id").cast("string")).alias("path")),
        verse_index.select("book").distinct().select(F.lit("book").alias("family"), F.concat(F.lit("/scripture/"), book).alias("path")),
        verse_index.select("book", "chapter").distinct().select(F.lit("chapter").alias("family"), F.concat(F.lit("/scripture/"), book, F.lit("/"), F.col("chapter").cast("string")).alias("path")),
        dense_verses(verse_index, least).select(F.lit("verse").alias("family"), F.concat(F.lit("/scripture/"), book, F.lit("/"), F.col("chapter").cast("string"), F.lit("/"), F.col("verse").cast("string")).alias("path")),
    ]
    return reduce(DataFrame.unionByName, parts)


def route_counts(routes: DataFrame) -> DataFrame:
    return routes.rollup("family").agg(F.count("*").alias("n")).select(F.coalesce("family", F.lit("total")).alias("family"), "n")
