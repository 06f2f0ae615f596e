"""Publishing tables: sitemap, topics and page metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import format_dates
from stemma.operators.catalog import top_k


def write_sitemap(routes: DataFrame, path: str, site: str) -> None:
    """The routes as XML (urlset of url with loc), in files the job's tasks write."""
    routes.select(F.concat(F.lit(site), "path").alias("loc")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("overwrite").save(path)


def write_topics(topics: DataFrame, path: str, site: str, generated: str) -> None:
    """The topics as nested JSON, one row each, with the site and the day they were made."""
    topics.select(F.lit(site).alias("site"), F.lit(generated).alias("generated"), "*").write.mode("overwrite").json(path)


def section_pages(topics: DataFrame, tiles: DataFrame, fixed: dict[str, tuple[str, str]], site: str, links: int = 60) -> DataFrame:
    """(family, path, title, description, excerpt, canonical, json_ld, links) of topics (n, slug, title, description, intro), browse tiles
    (slug, title, description) and fixed pages (path to title and description).

    /topics and /browse list the first topics and tiles; a topic is an article, their list a collection; other pages have no JSON-LD.
    """
    spark = topics.sparkSession

    def listed(rows: DataFrame, folder: str, order: str) -> DataFrame:
        paths = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit(f"{folder}/"), "slug").alias("path"))))
        return rows.orderBy(order).limit(links).agg(F.transform(paths, lambda x: x["path"]).alias("links")).withColumn("path", F.lit(folder))

    none = F.array().cast("array<string>")
    page = lambda family, folder, excerpt: (F.lit(family).alias("family"), F.concat(F.lit(f"{folder}/"), "slug").alias("path"), "title", "description", excerpt.alias("excerpt"), none.alias("links"))
    named = [("topic" if p == "/topics" else "browse" if p == "/browse" else "static", p, t, text) for p, (t, text) in fixed.items()]
    lists = listed(topics, "/topics", "n").unionByName(listed(tiles, "/browse", "slug"))
    fixed_rows = spark.createDataFrame(named, "family string, path string, title string, description string").join(lists, "path", "left")
    rows = fixed_rows.select("family", "path", "title", "description", F.lit("").alias("excerpt"), F.coalesce("links", none).alias("links"))
    rows = rows.unionByName(topics.select(*page("topic", "/topics", F.col("intro")))).unionByName(tiles.select(*page("browse", "/browse", F.lit(""))))
    url = F.concat(F.lit(site), "path")
    collection = F.to_json(F.struct(F.lit("CollectionPage").alias("@type"), F.col("title").alias("name"), url.alias("url")))
    article = F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("title").alias("headline"), "description", url.alias("url")))
    return rows.withColumn("canonical", url).withColumn("json_ld", F.when(F.col("path") == "/topics", collection).when(F.col("family") == "topic", article))


def route_metadata(authors: DataFrame, works: DataFrame, passages: DataFrame, site: str, links: int = 60) -> DataFrame:
    """(family, path, title, description, canonical, json_ld, links) of every work's and author's page with a work.

    A person has birth and death years only if they are positive; other categories are collections. An author's page links its first works by title.
    """
    counts = passages.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("n"))
    a = authors.select(F.col("id").alias("author_id"), "name", "category", "born", "died", format_dates(F.col("born"), F.col("died")).alias("dates"))
    w = works.join(counts, "id", "left").join(a, "author_id")
    path = F.concat(F.lit("/works/"), F.col("id").cast("string"))
    work = w.select(
        F.lit("work").alias("family"), path.alias("path"), F.concat("title", F.lit(" — "), "name").alias("title"),
        F.concat("title", F.lit(" by "), "name", F.when(F.col("dates") != "", F.concat(F.lit(" ("), "dates", F.lit(")"))).otherwise(""), F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" passages.")).alias("description"),
        F.concat(F.lit(site), path).alias("canonical"), F.to_json(F.struct(F.lit("Book").alias("@type"), F.col("title").alias("name"), F.col("name").alias("author"))).alias("json_ld"), F.array().cast("array<string>").alias("links"),
    )
    first = top_k(works.select("author_id", "id", "title"), ["author_id"], [F.col("title"), F.col("id")], links)
    listed = first.groupBy("author_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: F.concat(F.lit("/works/"), x["id"].cast("string"))).alias("links"))
    apath = F.concat(F.lit("/authors/"), F.col("author_id").cast("string"))
    person = F.coalesce(F.col("category").isin("father", "commentary"), F.lit(False))
    year = lambda c: F.when(person & (F.col(c) > 0), F.col(c).cast("string"))
    author = a.join(listed, "author_id").select(
        F.lit("author").alias("family"), apath.alias("path"), F.concat("name", F.when(F.col("dates") != "", F.concat(F.lit(" ("), "dates", F.lit(")"))).otherwise("")).alias("title"),
        F.concat(F.lit("Works of "), "name", F.lit(".")).alias("description"), F.concat(F.lit(site), apath).alias("canonical"),
        F.to_json(F.struct(F.when(person, "Person").otherwise("Collection").alias("@type"), "name", year("born").alias("birthDate"), year("died").alias("deathDate"))).alias("json_ld"), "links",
    )
    return work.unionByName(author)
