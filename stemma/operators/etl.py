"""Building and repairing the corpus: discovery, imports, classification, corrections, removals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.markup import guarded
from stemma.functions.text import clean_title, flag_truncated
from stemma.session import Scratch

#: Words that classify names (fixed values).
APOCRYPHA = ("epistle of", "gospel of", "acts of", "shepherd of hermas", "protoevangelium", "odes of solomon", "testaments of the twelve patriarchs", "sibylline")
MISC_NAMES = ("Apostolic Constitutions", "Didache")
MISC_STARTS = ("book of", "passion of", "epistle to", "religious discussion", "martyrdom of")
GREEK = ("origen", "athanasius", "basil of", "basil the", "gregory of", "gregory thaumaturgus", "john chrysostom", "chrysostom", "cyril of", "eusebius", "irenaeus", "justin", "clement of alexandria", "didymus", "evagrius", "maximus the confessor", "theodoret", "diodore", "theodore of mopsuestia", "methodius", "gregory palamas")
LATIN = ("tertullian", "cyprian", "augustine", "jerome", "ambrose", "leo the great", "hilary", "lactantius", "novatian", "optatus", "salvian", "prosper", "vincent of lér")
LATIN_PLACES = ("of carthage", "of rome", "of milan", "of poitiers", "of lyon", "of gaul", "of africa")
SYRIAC = ("ephrem", "aphrahat", "jacob of serugh")
SYRIAC_PLACES = ("syrian", "of edessa", "of nisibis", "the assyrian")
COPTIC = ("shenoute", "pachomius", "macarius of egypt", "anthony the great", "abba poemen")
KNOWN_DEATHS = {
    "clement of rome": 99, "ignatius of antioch": 108, "polycarp": 155, "justin martyr": 165, "irenaeus": 202, "clement of alexandria": 215,
    "tertullian": 220, "hippolytus of rome": 235, "origen": 253, "origen of alexandria": 253, "cyprian": 258, "cyprian of carthage": 258,
    "methodius of olympus": 311, "lactantius": 325, "eusebius of caesarea": 340, "athanasius of alexandria": 373, "ephrem the syrian": 373,
    "basil of caesarea": 379, "basil the great": 379, "cyril of jerusalem": 386, "gregory of nazianzus": 390, "gregory of nyssa": 395, "ambrose of milan": 397,
    "john chrysostom": 407, "jerome": 420, "augustine of hippo": 430, "john cassian": 435, "cyril of alexandria": 444, "theodoret of cyrus": 457,
    "leo the great": 461, "vincent of lérins": 445, "prosper of aquitaine": 455,
}
#: The forms of a commentary file's name and of a header that names a verse (fixed values).
VERSE_FILE = r"(?i)^(.+?)\s+(\d+)_(\d+[a-z]?(?:-\d+[a-z]?)?)\.toml$"
VERSE_HEADER = r"^\s*([1-3]?\s?[A-Za-z][A-Za-z.]*(?:\s+[A-Za-z.]+)*)\s+(\d{1,3}):(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?\s*$"


def _any(test, col: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(col, F.lit(w))
    return out


def category_of(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return (
        F.when(_any(F.contains, n, ("council", "synod")), "council")
        .when(name.isin(*MISC_NAMES), "misc")
        .when(_any(F.contains, n, ("liturgy", "liturgical")), "liturgy")
        .when(_any(F.startswith, n, APOCRYPHA), "apocrypha")
        .when(_any(F.startswith, n, MISC_STARTS) | _any(F.contains, n, ("fragment", "muratorian")), "misc")
        .otherwise("father")
    )


def tradition_of(name: Column, category: Column) -> Column:
    n = F.lower(F.trim(name))
    return (
        F.when(_any(F.startswith, n, GREEK), "greek")
        .when(_any(F.startswith, n, LATIN) | _any(F.contains, n, LATIN_PLACES), "latin")
        .when(_any(F.startswith, n, SYRIAC) | _any(F.contains, n, SYRIAC_PLACES), "syriac")
        .when(_any(F.startswith, n, COPTIC) | _any(F.contains, n, ("desert father", "of egypt", "egyptian")), "coptic")
        .when(category == "father", "greek")
        .otherwise("other")
    )


def classify_authors(authors: DataFrame, works: DataFrame) -> DataFrame:
    """authors with category, tradition and era set: who only has commentaries is a commentator, unless the name says misc or apocrypha."""
    real = works.groupBy("author_id").agg(F.sum(F.when(F.col("title").ilike("Commentary on%"), 0).otherwise(1)).alias("n")).where("n > 0").select(F.col("author_id").alias("id"), F.lit(True).alias("real"))
    by_name = category_of(F.coalesce("name", F.lit("")))
    category = F.when(F.col("real") | by_name.isin("misc", "apocrypha"), by_name).otherwise("commentary")
    deaths = authors.sparkSession.createDataFrame(list(KNOWN_DEATHS.items()), "k string, known int")
    rows = authors.drop("category", "tradition", "era").join(real, "id", "left").withColumn("category", category)
    rows = rows.withColumn("tradition", tradition_of(F.coalesce("name", F.lit("")), F.col("category"))).join(F.broadcast(deaths), F.lower(F.trim("name")) == F.col("k"), "left")
    year = F.coalesce("died", "known", "born")
    era = F.when(year <= 100, "apostolic").when(year <= 325, "ante-nicene").when(year <= 381, "nicene").when(year.isNotNull(), "post-nicene")
    return rows.withColumn("era", era).drop("real", "k", "known")


def migration_summary(classified: DataFrame) -> DataFrame:
    """Counts by category, by tradition and by era in one pass; (null) where a value is missing."""
    label = lambda c: F.coalesce(c, F.lit("(null)"))
    g = classified.select(label("category").alias("category"), label("tradition").alias("tradition"), label("era").alias("era"))
    sets = g.groupingSets([["category"], ["tradition"], ["era"]], "category", "tradition", "era").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return sets.select(F.when(F.col("gid") == 3, "category").when(F.col("gid") == 5, "tradition").otherwise("era").alias("field"), F.coalesce("category", "tradition", "era").alias("value"), "n")


def import_summary(passages: DataFrame, verse_index: DataFrame) -> DataFrame:
    """One row: headers scanned, verse index rows made of them, and the distinct books among these."""
    scanned = passages.agg(F.count("header").alias("headers_scanned"))
    return scanned.crossJoin(F.broadcast(verse_index.agg(F.count("*").alias("index_rows"), F.count_distinct("book").alias("distinct_books"))))  # one row each


def author_totals(authors: DataFrame, works: DataFrame, passages: DataFrame) -> DataFrame:
    """(name, works, passages, chars) imported for every author."""
    per_work = passages.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("p"), F.sum(F.length("text")).alias("c"))
    per_author = works.join(per_work, "id", "left").groupBy("author_id").agg(F.count("*").alias("works"), F.coalesce(F.sum("p"), F.lit(0)).alias("passages"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"))
    return authors.select(F.col("id").alias("author_id"), "name").join(per_author, "author_id", "left").fillna(0, ["works", "passages", "chars"]).select("author_id", "name", "works", "passages", "chars")


def build_verse_index(passages: DataFrame) -> DataFrame:
    """(passage_id, book, chapter, verse_start, verse_end) of the passages whose header is a verse reference."""
    part = lambda n: F.regexp_extract("header", VERSE_HEADER, n)
    return passages.where(F.col("header").rlike(VERSE_HEADER)).select(F.col("id").alias("passage_id"), F.trim(F.regexp_replace(part(1), r"\s+", " ")).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse_start"), F.nullif(part(4), F.lit("")).cast("int").alias("verse_end"))


def natural_key(col: Column) -> Column:
    """A text that sorts numbers by value: digit runs are padded, the rest is lower-case."""
    padded = F.transform(F.regexp_extract_all(F.lower(col), F.lit(r"(\d+|\D+)"), 1), lambda t: F.when(t.rlike("^[0-9]"), F.lpad(t, 20, "0")).otherwise(t))
    return F.array_join(padded, "")


def discover_works(files: DataFrame, tree: str = "") -> DataFrame:
    """(author, title, part, part_no, path, source_url) of a tree of files (path relative to its root).

    author/work.html is a work of one part; author/work/part.html one part of a work; author/group/work/part.html the same for a
    work named ``group: work``, where the group has no files of its own. index.html and the folders images, pseudo and .git are passed over at the top.
    """
    p = F.split("path", "/")
    f = files.where(F.col("path").endswith(".html")).withColumn("p", p).withColumn("depth", F.size("p")).where("depth between 2 and 4")
    f = f.withColumn("file", F.element_at("p", -1)).withColumn("stem", F.regexp_replace("file", r"\.html$", ""))
    f = f.where("not (depth = 2 and lower(file) = 'index.html') and not (depth > 2 and lower(p[1]) in ('images', 'pseudo', '.git'))")
    direct = f.where("depth = 3").select(F.expr("p[0]").alias("a"), F.expr("p[1]").alias("b")).distinct()
    f = f.join(direct, F.expr("depth = 4 and p[0] = a and p[1] = b"), "left_anti")
    title = F.when(F.col("depth") == 2, F.col("stem")).when(F.col("depth") == 3, F.expr("p[1]")).otherwise(F.concat(F.expr("p[1]"), F.lit(": "), F.expr("p[2]")))
    folder = F.when(F.col("depth") == 2, F.expr("slice(p, 1, 1)")).otherwise(F.expr("slice(p, 1, depth - 1)"))
    url = F.concat(F.lit(tree), F.array_join(F.transform(folder, lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/"))
    rows = f.select(F.expr("p[0]").alias("author"), title.alias("title"), F.when(F.col("depth") > 2, F.col("stem")).alias("part"), "path", "file", url.alias("source_url"))
    return rows.withColumn("part_no", F.row_number().over(Window.partitionBy("author", "title", F.col("part").isNull()).orderBy(natural_key(F.col("file"))))).drop("file")


def read_commentary_blocks(files: DataFrame) -> DataFrame:
    """(author, book, verse_ref, seq, quote, source_title, source_url) of commentary files (path author/name.toml, content); a broken file gives none."""
    import tomllib

    @guarded
    def parse(data: bytes) -> list[dict]:
        return tomllib.loads(bytes(data).decode()).get("commentary", [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda v: (v or "").strip() or None
        for b in batches:
            rows = [(a, book, ref, i, clean(k.get("quote")), clean(k.get("source_title")), clean(k.get("source_url"))) for a, book, ref, c in zip(b.author, b.book, b.verse_ref, b.content) for i, k in enumerate(parse(c) or [])]
            yield pd.DataFrame(rows, columns=["author", "book", "verse_ref", "seq", "quote", "source_title", "source_url"])

    name = F.element_at(F.split("path", "/"), -1)
    part = lambda n: F.regexp_extract(name, VERSE_FILE, n)
    named = files.where(name.rlike(VERSE_FILE)).select(F.element_at(F.split("path", "/"), -2).alias("author"), F.trim(part(1)).alias("book"), F.concat(part(2), F.lit(":"), part(3)).alias("verse_ref"), "content")
    kinds = "author string, book string, verse_ref string, seq int, quote string, source_title string, source_url string"
    return named.mapInPandas(run, kinds).where("quote is not null")


def dedupe_blocks(blocks: DataFrame, existing: DataFrame, prefix: int = 100) -> DataFrame:
    """The first block (seq) of each work, header and start of text that no existing passage has."""
    key = ["work_id", "header", "start"]
    first = blocks.withColumn("start", F.substring("text", 1, prefix)).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_r = 1")
    return first.join(existing.select("work_id", "header", F.substring("text", 1, prefix).alias("start")), key, "left_anti").select(*blocks.columns)


def upsert_dim(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows (id, keys) and the new keys with the ids that follow, in the order of the keys.

    Ids are dealt in ranges: each partition of the sorted new keys continues after those before it, so no task holds them all.
    """
    new = incoming.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    spark = existing.sparkSession
    ranged = new.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    dealt = Scratch(spark).cut(ranged.withColumn("_p", F.spark_partition_id()))  # written, as ranges are sampled anew each time
    counts = dealt.groupBy("_p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    ids = dealt.join(F.broadcast(counts.select("_p", "before")), "_p").withColumn("id", F.lit(top) + F.col("before") + F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    return existing.select("id", *keys).unionByName(ids.select("id", *keys))


def backfill_sources(passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """passages with source_title and source_url from blocks (work_id, header, quote, seq, source_title, source_url).

    A block goes to the passages with its exact text, or only if there are none to those with the same 120 first characters; of several
    blocks the last one counts.
    """
    b = blocks.where("source_title is not null or source_url is not null").select("work_id", "header", "quote", "seq", F.col("source_title").alias("t"), F.col("source_url").alias("u"))
    exact = b.join(passages.select("id", "work_id", "header", F.col("text").alias("quote")), ["work_id", "header", "quote"])
    rest = b.join(exact.select("seq").distinct(), "seq", "left_anti").withColumn("start", F.substring("quote", 1, 120))
    near = rest.join(passages.select("id", "work_id", "header", F.substring("text", 1, 120).alias("start")), ["work_id", "header", "start"])
    hits = exact.select("id", "seq", "t", "u").unionByName(near.select("id", "seq", "t", "u"))
    last = hits.groupBy("id").agg(F.max(F.struct("seq", "t", "u")).alias("m"))
    have = passages.drop("source_title", "source_url") if "source_title" in passages.columns else passages
    kept = passages.select("id", "source_title", "source_url") if "source_title" in passages.columns else None
    out = have.join(last, "id", "left")
    if kept is not None:
        out = out.join(kept, "id").withColumn("source_title", F.when(F.col("m").isNotNull(), F.col("m.t")).otherwise(F.col("source_title"))).withColumn("source_url", F.when(F.col("m").isNotNull(), F.col("m.u")).otherwise(F.col("source_url")))
        return out.drop("m")
    return out.withColumn("source_title", F.col("m.t")).withColumn("source_url", F.col("m.u")).drop("m")


def apply_corrections(passages: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """passages, a report and the ids to embed anew, for corrections (correction_id, work_id, header, text).

    A correction is applied only if it matches one passage; the report has its matches and both lengths.
    """
    hit = corrections.select("correction_id", "work_id", "header", F.col("text").alias("new")).join(passages.select("id", "work_id", "header", F.length("text").alias("old_len")), ["work_id", "header"], "left")
    hit = hit.withColumn("n", F.count("id").over(Window.partitionBy("correction_id")))
    report = hit.groupBy("correction_id").agg(F.max("n").alias("matches"), F.max(F.when(F.col("n") == 1, F.col("old_len"))).alias("old_len"), F.max(F.length("new")).alias("new_len"))
    good = hit.where("n = 1 and id is not null").groupBy("id").agg(F.max(F.struct("correction_id", "new")).alias("m"))
    fixed = passages.join(good, "id", "left").withColumn("text", F.coalesce("m.new", "text")).drop("m")
    return fixed, report, good.select("id")


def repair_truncated(passages: DataFrame, fresh: DataFrame, gain: int = 500) -> tuple[DataFrame, DataFrame]:
    """passages (id, folder, header, text) and a status per fresh text (fresh_id, folder, stem, header, text).

    A fresh text meets the passage in its folder with the same header, or else the one in folder/stem; it replaces a stored text that is truncated if it
    has ``gain`` visible characters more.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    seen = lambda c: F.length(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " ")))
    old = flag_truncated(passages).select("folder", norm(F.col("header")).alias("h"), "id", seen(F.col("text")).alias("old_len"), "truncated").groupBy("folder", "h").agg(F.max(F.struct("id", "old_len", "truncated")).alias("p"))
    f = fresh.select("fresh_id", "folder", F.concat_ws("/", "folder", "stem").alias("alt"), norm(F.col("header")).alias("h"), F.col("text").alias("new"), seen(F.col("text")).alias("new_len"))
    met = f.join(old, ["folder", "h"], "left").join(old.select(F.col("folder").alias("alt"), "h", F.col("p").alias("q")), ["alt", "h"], "left").withColumn("p", F.coalesce("p", "q"))
    status = F.when(F.col("p").isNull(), "unmatched").when(F.col("p.truncated") & (F.col("new_len") >= F.col("p.old_len") + gain), "repaired").otherwise("skipped")
    judged = met.select("fresh_id", F.col("p.id").alias("id"), status.alias("status"), "new", "new_len", F.col("p.old_len").alias("old_len"))
    good = judged.where("status = 'repaired'").groupBy("id").agg(F.max(F.struct("fresh_id", "new")).alias("m"))
    return passages.join(good, "id", "left").withColumn("text", F.coalesce("m.new", "text")).drop("m"), judged.drop("new")


def prune_authors(authors: DataFrame, works: DataFrame, passages: DataFrame, vectors: DataFrame, verse_index: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """The tables without the named authors and all that is theirs, and ``counts`` of what went."""
    gone_a = authors.join(names.select("name"), "name", "left_semi").select("id")
    gone_w = works.join(gone_a.withColumnRenamed("id", "author_id"), "author_id", "left_semi").select("id")
    gone_p = passages.join(gone_w.withColumnRenamed("id", "work_id"), "work_id", "left_semi").select("id")
    pid = gone_p.withColumnRenamed("id", "passage_id")
    gone = {"authors": (authors, gone_a, "id"), "works": (works, gone_w, "id"), "passages": (passages, gone_p, "id"), "vectors": (vectors, pid, "passage_id"), "verse_index": (verse_index, pid, "passage_id")}
    out = {name: df.join(ids, key, "left_anti") for name, (df, ids, key) in gone.items()}
    counts = None
    for name, (df, ids, key) in gone.items():
        one = df.join(ids, key, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = one if counts is None else counts.union(one)
    return out | {"counts": counts}


def reclassify(authors: DataFrame, names: DataFrame, to: str = "misc") -> tuple[DataFrame, DataFrame]:
    """authors with the named ones' category set, where it is another (a missing one is left), and how many changed."""
    listed = names.select("name").distinct().withColumn("listed", F.lit(True))
    rows = authors.join(listed, "name", "left").withColumn("hit", F.coalesce(F.col("listed") & (F.col("category") != to), F.lit(False)))
    return rows.withColumn("category", F.when(F.col("hit"), to).otherwise(F.col("category"))).drop("listed", "hit"), rows.agg(F.count_if("hit").alias("changed"))


def insert_missing(works: DataFrame, passages: DataFrame, recovered: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """passages with recovered bodies (work_id, header, text) of works that have none, and a status per recovered body."""
    have = passages.select("work_id").distinct().withColumn("full", F.lit(True))
    known = works.select(F.col("id").alias("work_id"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "no such work").when(F.col("full"), "has passages").when(F.length(F.trim(F.coalesce("text", F.lit("")))) <= least, "too short").otherwise("inserted")
    judged = recovered.join(have, "work_id", "left").join(known, "work_id", "left").withColumn("status", status)
    top = passages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    keys = upsert_dim(passages.select("id", "work_id", "header").limit(0), judged.where("status = 'inserted'"), ["work_id", "header"]).withColumn("id", F.col("id") + top)
    new = judged.where("status = 'inserted'").join(keys, ["work_id", "header"]).select("id", "work_id", "header", "text")
    return passages.select("id", "work_id", "header", "text").unionByName(new), judged.select("work_id", "header", "status")


def file_metadata(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, mirror_url, year) of files (path, author, head, meta): the mirror named in a file's head; the author's known year or else that of its metadata."""
    mirror = F.nullif(F.regexp_extract(F.substring("head", 1, 800), r"Mirrored from (\S+) by", 1), F.lit(""))
    year = F.nullif(F.regexp_extract("meta", r"(?m)^\s*default_year\s*=\s*['\"]?(\d+)", 1), F.lit("")).cast("int")
    return files.join(known.select("author", F.col("died").alias("_k"), F.lit(True).alias("_has")), "author", "left").select("path", mirror.alias("mirror_url"), F.when(F.col("_has"), F.col("_k")).otherwise(year).alias("year"))


def clean_titles(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, clean_title(F.col(col)))
