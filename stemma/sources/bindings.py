"""How the given tables stand for a catalogue, a text corpus, a verse index, logs and ordered runs.

Each binding is one SQL text that Spark and DuckDB read alike; later ones may name earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Books of the verse index; the last two are outside the canonical list.
BOOKS = ("Genesis", "Exodus", "Psalms", "Isaiah", "Matthew", "Mark", "Luke", "John", "Romans", "1 Corinthians", "Song of Songs", "Enoch")

BINDINGS = {
    "authors": """
SELECT c_custkey AS id, c_name AS name, n_name AS tradition, CONCAT('Bio of ', c_name) AS bio,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 600 + 50 AS INT) END AS born,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 600 + 50 AS INT) ELSE CAST(c_custkey % 600 + 110 AS INT) END AS died,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'father' WHEN 'BUILDING' THEN 'commentary' WHEN 'AUTOMOBILE' THEN 'council' WHEN 'FURNITURE' THEN 'liturgy' ELSE CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END END AS category,
       CASE WHEN c_custkey % 15 = 0 THEN NULL WHEN c_custkey % 600 <= 40 THEN 'apostolic' WHEN c_custkey % 600 <= 265 THEN 'ante-nicene' WHEN c_custkey % 600 <= 321 THEN 'nicene' ELSE 'post-nicene' END AS era
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "works": """
SELECT o_orderkey AS id, o_custkey AS author_id,
       CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('Commentary on ', o_orderpriority) ELSE CONCAT(o_orderpriority, ' ', CAST(o_orderkey AS STRING)) END AS title,
       CASE WHEN o_orderstatus = 'F' THEN 'Father' END AS section, CAST(NULL AS STRING) AS source_url
FROM orders WHERE o_custkey % 7 <> 0""",
    "passages": """
SELECT l_orderkey * 1000 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
       l_orderkey AS work_id, l_returnflag AS header, CONCAT('Part ', CAST(l_partkey AS STRING), ' by ', CAST(l_suppkey AS STRING), '.') AS text
FROM lineitem""",
    "text_authors": """
SELECT ROW_NUMBER() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT source AS name FROM documents) s""",
    "text_works": """
SELECT ROW_NUMBER() OVER (ORDER BY w.source, w.lang) AS id, a.id AS author_id,
       CASE WHEN w.lang = 'es' THEN CONCAT('Commentary on ', w.source) ELSE CONCAT(w.lang, ' of ', w.source) END AS title, w.lang AS lang, w.source AS source
FROM (SELECT DISTINCT source, lang FROM documents) w JOIN text_authors a ON w.source = a.name""",
    "text_passages": """
SELECT d.doc_id AS id, w.id AS work_id, w.author_id AS author_id, CAST(NULL AS STRING) AS header, d.text AS text, w.title AS work, d.source AS author, d.lang AS tradition,
       CASE WHEN l.doc_id IS NULL THEN 'writing' ELSE 'commentary' END AS kind
FROM documents d JOIN text_works w ON d.source = w.source AND d.lang = w.lang LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
    "verse_passages": """
SELECT id, work_id, book, chapter, verse_start, verse_end,
       CONCAT(book, ' ', CAST(chapter AS STRING), ':', CAST(verse_start AS STRING), CASE WHEN verse_end IS NULL THEN '' ELSE CONCAT('-', CAST(verse_end AS STRING)) END) AS header
FROM (
  SELECT l_orderkey * 1000 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id, l_suppkey AS work_id,
         CASE l_partkey % 12 """
    + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BOOKS))
    + """ END AS book, CAST(l_linenumber AS INT) AS chapter, CAST(l_suppkey % 30 + 1 AS INT) AS verse_start,
         CASE WHEN l_quantity > 25 THEN CAST(l_suppkey % 30 + 1 + l_linenumber AS INT) END AS verse_end
  FROM lineitem) v""",
    "verse_works": "SELECT s_suppkey AS id, s_suppkey AS author_id, CONCAT(CASE WHEN s_suppkey % 4 = 0 THEN 'Notes on ' ELSE 'Commentary on ' END, CAST(s_suppkey AS STRING)) AS title FROM supplier",
    "verse_authors": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "vectors": "SELECT vec_id AS passage_id, embedding, label FROM embeddings",
    "logs": """
SELECT event_id, ts, user_id AS client, CASE event_type WHEN 'click' THEN 'voyage_embed' WHEN 'view' THEN 'gemini_parse' WHEN 'signup' THEN 'groq_parse' WHEN 'purchase' THEN 'anthropic_parse' ELSE 'other' END AS call_type,
       value AS latency_ms, event_type <> 'error' AS ok, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'reader' WHEN 'signup' THEN 'default' ELSE 'health' END AS endpoint
FROM events""",
    "runs": "SELECT conv_id AS work_id, conv_id * 1000 + turn AS id, role AS header, text, CAST(LENGTH(text) AS BIGINT) AS size FROM conversations",
    "search_queries": """
SELECT item_id AS query_id, REGEXP_EXTRACT(text, '^[^ ]+ [^ ]+', 0) AS query FROM benchmark""",
}


def needed(name: str) -> list[str]:
    """The bindings that a binding is made of, itself last."""
    out: list[str] = []
    for other in BINDINGS:
        if other != name and re.search(rf"\b{other}\b", BINDINGS[name]):
            out += [x for x in needed(other) if x not in out]
    return [*out, name]


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(re.search(rf"\b{t}\b", BINDINGS[n]) for n in needed(name))}
    for n in needed(name):
        used = {t: df for t, df in parts.items() if re.search(rf"\b{t}\b", BINDINGS[n])}
        text = BINDINGS[n]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b|\(SELECT DISTINCT (.*?) FROM {t}\b", lambda m: m[0].replace(f" {t}", " {" + t + "}"), text)
        parts[n] = spark.sql(text, **used)
    return parts[name]


def with_bindings(names: str, sql: str) -> str:
    """DuckDB SQL with the named bindings before it."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in needed(name) if n not in order]
    texts = ",\n".join(f"{n} AS ({BINDINGS[n].replace('REGEXP_EXTRACT(text, ' + chr(39) + '^[^ ]+ [^ ]+' + chr(39) + ', 0)', 'REGEXP_EXTRACT(text, ' + chr(39) + '^[^ ]+ [^ ]+' + chr(39) + ')')})" for n in order)
    head = f"WITH RECURSIVE {texts}" if texts else ""
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}" if head else body
    return f"{head}\n{body}"
