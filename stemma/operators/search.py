"""Full-text, title and vector search for tables of queries, fused, diversified and routed."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.catalog import catena_by_header, top_k
from stemma.operators.patterns import holding
from stemma.operators.postings import ALL, SET, TITLE, Blocks, search_blocks, store_blocks
from stemma.operators.vectors import Vectors, nearest, store_vectors
from stemma.session import Scratch

ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Weights of the vector, text and title signals and the fusion constant (fixed values).
WEIGHTS, RRF_K = {"vector": 1.3, "fts": 1.0, "title": 0.5}, 60
#: Words of names that do not tell authors apart (fixed values).
NAME_STOPWORDS = ("st", "st.", "saint", "pope", "the", "of", "and", "bishop", "martyr", "venerable", "blessed", "abba", "deacon", "elder", "great", "council", "synod", "letter", "epistle", "acts", "pseudo")
MAX_QUERY = 500
#: The columns of the index, in their order.
COLUMNS = ("text", "author", "work")


def terms(text: Column) -> Column:
    """Lower-case, unaccented runs of letters and digits."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Index:
    """An inverted index: postings (term, col, id, pos), lengths (id, dl), and the passages' id, author and work."""

    postings: DataFrame
    lengths: DataFrame
    entries: DataFrame


def build_index(passages: DataFrame, columns: tuple[str, ...] = COLUMNS) -> Index:
    """The index of passages (id and ``columns``), as a plan: every use of it reads the passages again."""
    cols = F.array(*(F.struct(F.lit(c).alias("col"), terms(F.col(c)).alias("terms")) for c in columns))
    each = passages.select("id", F.explode(cols).alias("c")).select("id", "c.col", "c.terms")
    postings = each.select("id", "col", F.posexplode("terms").alias("pos", "term")).select("term", "col", "id", "pos")
    lengths = passages.select("id", F.size(F.concat(*(terms(F.col(c)) for c in columns))).cast("long").alias("dl"))
    return Index(postings, lengths, passages.select("id", *(c for c in ("author", "work") if c in passages.columns)))


def store_index(passages: DataFrame, scratch: Scratch) -> Blocks:
    """The index of passages (id, text, author, work) written in blocks, with the sets of each author's passages and of those that are no commentaries."""
    cols = {c: terms(F.col(c)) for c in COLUMNS}
    sets = F.array_compact(F.array(F.concat(F.lit("by "), F.lower("author")), F.when(~F.coalesce(F.col("work"), F.lit("")).ilike("Commentary on %") & F.col("work").isNotNull(), "titled")))
    chars = sum((F.coalesce(F.length(c), F.lit(0)).cast("long") for c in cols), F.lit(0))
    return store_blocks(passages, cols, sets, chars, scratch, "work")


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, j, term): a query's distinct tokens, each a phrase of one or more adjacent terms."""
    tokens = F.array_distinct(F.regexp_extract_all("query", F.lit(r"(?U)([\w']+)"), 1))
    phrases = queries.select("query_id", F.explode(tokens).alias("token")).select("query_id", terms(F.col("token")).alias("ts")).where("size(ts) > 0")
    return phrases.select("query_id", F.concat_ws(" ", "ts").alias("phrase"), "ts").distinct().select("query_id", "phrase", F.size("ts").alias("n"), F.posexplode("ts").alias("j", "term"))


def asked_for(queries: DataFrame, field: str, every: bool) -> DataFrame:
    """The phrases of queries (query_id, query) as search_blocks takes them."""
    return query_phrases(queries).select("query_id", F.lit(field).alias("field"), "phrase", "n", "j", "term", F.lit(every).alias("needed"), F.lit(True).alias("scored"))


def chosen(queries: DataFrame, name: Column) -> DataFrame:
    """That a query's passages have to be in a set; those whose name is null can be any."""
    return queries.select("query_id", name.alias("term")).where("term is not null").select("query_id", F.lit(SET).alias("field"), F.col("term").alias("phrase"), F.lit(1).alias("n"), F.lit(0).alias("j"), "term", F.lit(True).alias("needed"), F.lit(False).alias("scored"))


def bm25_search(queries: DataFrame, index: Blocks, k: int = 100) -> DataFrame:
    """The k best passages per query that hold all its tokens: query_id, rank, id, score. An author column in queries limits each to that author."""
    asks = asked_for(queries, ALL, True)
    if "author" in queries.columns:
        asks = asks.unionByName(chosen(queries, F.concat(F.lit("by "), F.lower("author"))))
    return search_blocks(asks, index, k)


def title_search(queries: DataFrame, index: Blocks, k: int = 50) -> DataFrame:
    """The k best passages per query by any token in the work's title; titles of commentaries are left out."""
    return search_blocks(asked_for(queries, TITLE, False).unionByName(chosen(queries, F.lit("titled"))), index, k)


def vector_topk(queries: DataFrame, vectors: DataFrame | Vectors, dim: int, k: int = 100) -> DataFrame:
    """The k nearest passages by cosine for queries (query_id, embedding, optional author): query_id, rank, id, score.

    ``vectors`` are stored ones, or a table (passage_id, embedding, optional author) that is stored first.
    """
    scratch = Scratch(queries.sparkSession)
    return nearest(queries, vectors if isinstance(vectors, Vectors) else store_vectors(vectors, dim, scratch), dim, k, scratch)


def rrf_fuse(signals: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank) of ranked lists (query_id, rank, id); ties keep the order in which the signals list them."""
    tagged = None
    for no, (name, hits) in enumerate(signals.items()):
        part = hits.select("query_id", "id", F.struct(F.lit(no).alias("no"), "rank").alias("at"), (F.lit(weights[name]) / (k + F.col("rank"))).alias("s"))
        tagged = part if tagged is None else tagged.unionByName(part)
    summed = tagged.groupBy("query_id", "id").agg(F.round(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), F.lit(0.0), lambda a, s: a + s), 12).alias("score"), F.min("at").alias("at"))
    return top_k(summed, ["query_id"], [F.desc("score"), F.col("at")], 1 << 30, "rank").select("query_id", "rank", "id", "score")


def diversify(ranked: DataFrame, work_cap: int = 3, author_cap: int = 6, limit: int = 100) -> DataFrame:
    """Ranked rows (query_id, rank, id, work_id, author_id) under caps per work and author, in order.

    A work has one author, so counting works first and authors among what stays accepts the same rows as going down the list.
    """
    a = top_k(ranked, ["query_id", "work_id"], [F.col("rank")], work_cap, "nw")
    b = top_k(a, ["query_id", "author_id"], [F.col("rank")], author_cap, "na")
    return top_k(b, ["query_id"], [F.col("rank")], limit, "place").drop("nw", "na")


def diversify_mixed(ranked: DataFrame, work_cap: int = 3, author_cap: int = 6, limit: int = 100) -> DataFrame:
    """As diversify, where a work can have several authors: (query_id, place, id).

    A row that a full work turns away still leaves its author's place free, so the list is gone down in order. A query's rows are
    a bounded pool of candidates, so it fits one group however large the corpus is.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool, works, authors, taken = pool.sort_values("rank"), Counter(), Counter(), []
        for at, (work, author) in enumerate(zip(pool.work_id, pool.author_id)):
            if len(taken) < limit and works[work] < work_cap and authors[author] < author_cap:
                works[work] += 1
                authors[author] += 1
                taken.append(at)
        kept = pool.iloc[taken]
        return pd.DataFrame({"query_id": kept.query_id, "place": range(1, len(kept) + 1), "id": kept.id})

    return ranked.select("query_id", "rank", "id", "work_id", "author_id").groupBy("query_id").applyInPandas(run, "query_id long, place int, id long")


def writing_floor(ranked: DataFrame, diversified: DataFrame, scratch: Scratch, floor: int = 2, window: int = 15, work_cap: int = 3, author_cap: int = 6) -> DataFrame:
    """(query_id, place, id): the diversified rows with ``floor`` writings on the first page, if the ranking (query_id, rank, id, work_id, author_id, kind) has them.

    The page's rows that are no writings are numbered from its end: the first of them may give way in the first round, the next
    in the second, and so on for as many writings as the page lacks. In each round the best writing that is not on the page
    and not tried before comes in: one that is listed further down, or one whose work and author stay under their caps without the row that
    gives way. The writings then take the freed places in their own order; a row that gave way takes the old
    place of the writing that is there now, or goes if that was not listed. Rounds are joins over the whole table of queries.
    """
    q, page = Window.partitionBy("query_id"), F.col("place") <= window
    rows = ranked.join(diversified.select("query_id", "id", "place"), ["query_id", "id"], "left").select("query_id", "rank", "id", "work_id", "author_id", "kind", "place")
    rows = rows.withColumn("writing", F.col("kind").eqNullSafe("writing")).withColumn("on_page", F.coalesce(page, F.lit(False)))
    same = lambda *keys: F.count("place").over(Window.partitionBy("query_id", *keys))
    rows = rows.withColumn("lacks", floor - F.count_if(F.col("on_page") & F.col("writing")).over(q)).withColumn("of_work", same("work_id")).withColumn("of_author", same("author_id"))
    from_end = Window.partitionBy("query_id", F.col("on_page") & ~F.col("writing")).orderBy(F.desc("place"))
    rows = scratch.cut(rows.withColumn("weak", F.when(F.col("on_page") & ~F.col("writing"), F.row_number().over(from_end))))
    spare = rows.where("writing and not on_page and lacks > 0")
    state = rows.where("lacks > 0").select("query_id").distinct().withColumn("tried", F.lit(0)).withColumn("swaps", F.expr("cast(array() as array<struct<w:bigint,a:bigint,out_w:bigint,out_a:bigint>>)"))
    took = []
    for no in range(1, floor + 1):
        leaving = rows.where((F.col("weak") == no) & (F.col("lacks") >= no)).select("query_id", F.col("work_id").cast("long").alias("out_w"), F.col("author_id").cast("long").alias("out_a"))
        met = spare.join(leaving, "query_id").join(state, "query_id").where("rank > tried")
        held = lambda n, key, own: f"{n} + aggregate(swaps, 0, (s, x) -> s + int(x.{key} <=> {own}) - int(x.out_{key} <=> {own})) - int(out_{key} <=> {own})"
        able = met.where(f"place is not null or ({held('of_work', 'w', 'work_id')} < {work_cap} and {held('of_author', 'a', 'author_id')} < {author_cap})")
        came = scratch.cut(able.groupBy("query_id").agg(F.min(F.struct("rank", "id", "place", "swaps", "work_id", "author_id", "out_w", "out_a")).alias("m")).select("query_id", "m.*"))
        took.append(came.select("query_id", F.lit(no).alias("no"), "id", F.col("place").alias("old")))
        swap = F.struct(F.col("work_id").cast("long").alias("w"), F.col("author_id").cast("long").alias("a"), "out_w", "out_a")
        state = came.select("query_id", F.col("rank").alias("tried"), F.when(F.col("place").isNull(), F.concat("swaps", F.array(swap))).otherwise(F.col("swaps")).alias("swaps"))
    came = reduce(DataFrame.unionByName, took)
    # the best of m writings takes the highest of the last m weak places
    came = came.withColumn("weak", F.count("*").over(q) + 1 - F.col("no"))
    freed = rows.where("weak is not null").select("query_id", "weak", "place", F.col("id").alias("left"))
    moved = scratch.cut(came.join(freed, ["query_id", "weak"]).select("query_id", "id", "place", "old", "left"))
    changed = moved.select("query_id", "id", "place").union(moved.select("query_id", F.col("left"), F.col("old")))
    stays = rows.where("place is not null").select("query_id", "id", "place").join(changed.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return stays.union(changed.where("place is not null")).select("query_id", "place", "id")


def hybrid_search(queries: DataFrame, qvecs: DataFrame, passages: DataFrame, index: Blocks, vectors: DataFrame | Vectors, dim: int, scratch: Scratch, limit: int = 100, floor: bool = True) -> DataFrame:
    """Vector, text and title hits fused, diversified and floored: query_id, place, id. Text is joined by the caller, last."""
    pool = limit * 3
    fused = rrf_fuse({"vector": vector_topk(qvecs, vectors, dim, pool), "fts": bm25_search(queries, index, pool), "title": title_search(queries, index, 50)})
    ranked = scratch.cut(fused.join(passages.select("id", "work_id", "author_id", "kind"), "id"))
    spread = diversify(ranked, limit=limit)
    return writing_floor(ranked, spread, scratch) if floor else spread.select("query_id", "place", "id")


def author_token_index(authors: DataFrame) -> DataFrame:
    """(token, name): tokens of four letters or more that name one author whose name does not begin with pseudo."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]+)"), 1)))
    real = authors.where(~F.lower("name").startswith("pseudo")).select("name", token.alias("token")).where(F.length("token") >= 4).where(~F.col("token").isin(*NAME_STOPWORDS))
    return real.groupBy("token").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).where("n = 1").select("token", "name")


def detect_author(queries: DataFrame, authors: DataFrame) -> DataFrame:
    """(query_id, query, author): the longest full name in the query, or else the author of its first distinctive token."""
    roster = authors.where(~F.lower("name").startswith("pseudo")).select("name").distinct()
    q = queries.select("query_id", "query", F.lower("query").alias("low"))
    named = holding(q, "low", roster, "name", longest=True).groupBy("query_id").agg(F.min("name").alias("by_name"))
    tokens = q.select("query_id", F.posexplode(F.regexp_extract_all("low", F.lit("([a-z]+)"), 1)).alias("at", "token"))
    first = tokens.join(author_token_index(authors), "token").groupBy("query_id").agg(F.min(F.struct("at", "name")).alias("m")).select("query_id", F.col("m.name").alias("by_token"))
    return q.join(named, "query_id", "left").join(first, "query_id", "left").select("query_id", "query", F.coalesce("by_name", "by_token").alias("author"))


def topic_of(detected: DataFrame) -> DataFrame:
    """Adds topic: the query without the words of its author's name."""
    drop = F.regexp_extract_all(F.lower(F.coalesce("author", F.lit(""))), F.lit("([a-z]+)"), 1)
    kept = F.expr("filter(split(trim(query), '\\\\s+'), w -> not array_contains(own, regexp_replace(lower(w), '[^a-z]', '')))")
    return detected.withColumn("own", drop).withColumn("topic", F.when(F.col("author").isNull(), F.col("query")).otherwise(F.array_join(kept, " "))).drop("own")


def resolve_names(candidates: DataFrame, authors: DataFrame) -> DataFrame:
    """(candidate_id, name, author_id): equal in any case first, or else the first name by alphabet where one holds the other."""
    roster = authors.groupBy("name").agg(F.min("id").alias("author_id"))
    c = candidates.select("candidate_id", F.lower(F.trim("candidate")).alias("c")).where("c is not null and c not in ('none', 'n/a', '')")
    best = holding(roster, "name", c, "c").unionByName(holding(c, "c", roster, "name")).distinct()
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("candidate_id").orderBy((F.lower("name") != F.col("c")).cast("int"), "name"))).where("r = 1")
    return candidates.select("candidate_id").join(best.select("candidate_id", "name", "author_id"), "candidate_id", "left")


REFERENCE = r"^\s*([1-3]?\s?[A-Za-z][A-Za-z]+(?:\s+(?:of\s+)?[A-Za-z]+)*?)\s+(\d{1,3})(?::(\d{1,3}))?\s*$"


def parse_refs(queries: DataFrame) -> DataFrame:
    """(query_id, book, chapter, verse, ref) of the queries that are a bare reference."""
    part = lambda n: F.regexp_extract("query", REFERENCE, n)
    found = queries.where(F.col("query").rlike(REFERENCE)).withColumn("b", F.trim(F.regexp_replace(part(1), r"\s+", " ")))
    word = F.transform(F.split("b", " "), lambda w: F.when(w.rlike("^[0-9]+$"), w).when(F.lower(w) == "of", "of").otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    parsed = found.select("query_id", F.array_join(word, " ").alias("book"), part(2).cast("int").alias("chapter"), F.when(part(3) != "", part(3).cast("int")).alias("verse"))
    return parsed.withColumn("ref", F.concat("book", F.lit(" "), "chapter", F.when(F.col("verse").isNotNull(), F.concat(F.lit(":"), "verse")).otherwise("")))


def route_queries(queries: DataFrame, authors: DataFrame, passages: DataFrame, works: DataFrame, work_authors: DataFrame) -> DataFrame:
    """(query_id, path): empty, rejected, reference (with hits), author_only or hybrid."""
    q = queries.withColumn("query", F.trim(F.coalesce("query", F.lit(""))))
    refs = parse_refs(q)
    hits = catena_by_header(passages, works, work_authors, refs.withColumnRenamed("query_id", "ref_id"), 1).select(F.col("ref_id").alias("query_id"), F.lit(True).alias("cited"))
    topics = topic_of(detect_author(q.where(F.length("query") <= MAX_QUERY), authors)).select("query_id", "author", "topic")
    path = F.when(F.col("query") == "", "empty").when(F.length("query") > MAX_QUERY, "rejected").when(F.col("cited"), "reference").when(F.col("author").isNotNull() & (F.col("topic") == ""), "author_only").otherwise("hybrid")
    return q.join(hits, "query_id", "left").join(topics, "query_id", "left").select("query_id", path.alias("path"))


def snippet(text: Column, n: int, ellipsis: str) -> Column:
    """The first n characters, cut back to a word, with an ellipsis if anything is cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r"\s\S*\z", ""), F.lit(ellipsis)))


def facets(results: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("writing", "commentary")]
    return results.groupBy("query_id").agg(F.sort_array(F.collect_set(F.when(F.col("tradition") != "", F.col("tradition")))).alias("traditions"), *kinds)


def highlight(results: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """Results with marks around the query's terms of three characters or more, in any case."""
    found = F.array_distinct(F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda t: F.length(t) >= 3))
    safe = F.transform(found, lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    q = queries.select("query_id", F.concat(F.lit("(?iu)("), F.array_join(safe, "|"), F.lit(")")).alias("pattern"), F.size(safe).alias("n"))
    marked = F.expr(f"case when n > 0 then regexp_replace({text}, pattern, '<mark>$1</mark>') else {text} end")
    return results.join(q, "query_id").withColumn("marked", marked).drop("pattern", "n")


def build_topics(specs: DataFrame, passages: DataFrame, index: Index, k: int = 8, chars: int = 480) -> DataFrame:
    """(topic, author, hits): for each curated query the k best passages of its author with snippets."""
    numbered = specs.select("query_id", "topic", "author", "query")
    hits = bm25_search(numbered.select("query_id", "query", "author"), index, k)
    rows = hits.join(passages.select("id", "work", snippet(F.trim(F.regexp_replace("text", r"\s+", " ")), chars, "…").alias("snippet")), "id").join(numbered.select("query_id", "topic", "author"), "query_id")
    return rows.groupBy("topic", "author").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "work", "snippet"))).alias("hits"))


def page(results: DataFrame, n: int = 0, size: int = 15) -> DataFrame:
    return results.where((F.col("place") > n * size) & (F.col("place") <= (n + 1) * size))
