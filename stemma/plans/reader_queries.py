"""Queries of the reading operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import reader as R
from stemma.plans.registry import query
from stemma.sources.bindings import bind

CHAPTERS = "SELECT work_id, CAST(run AS BIGINT) AS run, min(header) AS header, CAST(min(n) AS INTEGER) AS start, count(*) AS count FROM (SELECT *, sum(c) OVER (PARTITION BY work_id ORDER BY id) AS run FROM (SELECT *, row_number() OVER w - 1 AS n, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN header IS DISTINCT FROM lag(header) OVER w THEN 1 ELSE 0 END AS c FROM src WINDOW w AS (PARTITION BY work_id ORDER BY id))) GROUP BY work_id, run"


def shown(spark, d):
    return bind(spark, d, "runs").withColumn("header", F.expr("case when id % 5 < 3 then header end"))


@query("runs", f"WITH src AS (SELECT work_id, id, CASE WHEN id % 5 < 3 THEN header END AS header FROM runs) {CHAPTERS}")
def chapter_index(spark, d):
    return R.chapter_index(shown(spark, d))


@query("runs", f"WITH src AS (SELECT work_id, id, CASE WHEN id % 5 < 3 THEN header END AS header FROM runs), ch AS ({CHAPTERS}) SELECT a.work_id, a.at, c.run, c.header FROM (SELECT DISTINCT work_id, CAST(id % 1000 * 2 AS INTEGER) AS at FROM runs) a ASOF JOIN ch c ON a.work_id = c.work_id AND a.at >= c.start")
def active_chapter(spark, d):
    places = bind(spark, d, "runs").selectExpr("work_id", "cast(id % 1000 * 2 as int) as at").distinct()
    return R.active_chapter(R.chapter_index(shown(spark, d)), places)


WINDOW_SQL = """WITH s AS (SELECT work_id, id, size, row_number() OVER (PARTITION BY work_id ORDER BY id) - 1 AS n FROM runs),
grown AS (SELECT a.work_id, a.n AS here, b.n AS n, sum(b.size) OVER (PARTITION BY a.work_id, a.n ORDER BY {order}) AS used, row_number() OVER (PARTITION BY a.work_id, a.n ORDER BY {order}) AS k FROM s a JOIN s b ON a.work_id = b.work_id AND {side}),
fit AS (SELECT work_id, here, n, k, min(CASE WHEN k > 1 AND used > 600 OR k > 4 THEN k END) OVER (PARTITION BY work_id, here) AS stop FROM grown)
SELECT work_id * 1000 + here AS anchor_id, work_id, CAST(min(n) AS INTEGER) AS lo, CAST(max(n) AS INTEGER) AS hi FROM fit WHERE stop IS NULL OR k < stop GROUP BY work_id, here"""


def anchors(spark, d):
    w = "row_number() over (partition by work_id order by id) - 1"
    return bind(spark, d, "runs").selectExpr("work_id", f"{w} as at").withColumn("anchor_id", F.expr("work_id * 1000 + at"))


@query("runs", WINDOW_SQL.format(order="b.n", side="b.n >= a.n"))
def window_forward(spark, d):
    return R.read_windows(bind(spark, d, "runs"), anchors(spark, d), "forward", 600, 4)


@query("runs", WINDOW_SQL.format(order="b.n DESC", side="b.n <= a.n"))
def window_backward(spark, d):
    return R.read_windows(bind(spark, d, "runs"), anchors(spark, d), "backward", 600, 4)


@query("runs", """WITH s AS (SELECT work_id, size, row_number() OVER (PARTITION BY work_id ORDER BY id) - 1 AS n FROM runs),
walk AS (SELECT work_id, n AS here, n AS lo, n AS hi, size AS used, 0 AS turn, 0 AS stuck FROM s
  UNION ALL SELECT w.work_id, here, CASE WHEN fits AND turn % 2 = 1 THEN lo - 1 ELSE lo END, CASE WHEN fits AND turn % 2 = 0 THEN hi + 1 ELSE hi END, CASE WHEN fits THEN used + next ELSE used END, turn + 1, CASE WHEN fits THEN 0 ELSE stuck + 1 END
  FROM (SELECT w.*, s.size AS next, coalesce(used + s.size <= 600, false) AS fits FROM walk w LEFT JOIN s ON s.work_id = w.work_id AND s.n = CASE WHEN turn % 2 = 0 THEN hi + 1 ELSE lo - 1 END WHERE stuck < 2 AND hi - lo + 1 < 4) w)
SELECT work_id * 1000 + here AS anchor_id, work_id, CAST(min(lo) AS INTEGER) AS lo, CAST(max(hi) AS INTEGER) AS hi FROM walk GROUP BY work_id, here""")
def window_around(spark, d):
    return R.read_windows(bind(spark, d, "runs"), anchors(spark, d), "both", 600, 4)


@query("runs", """WITH s AS (SELECT work_id, size, row_number() OVER (PARTITION BY work_id ORDER BY id) - 1 AS n FROM runs),
whole AS (SELECT work_id, sum(size) <= 2000 AS complete, max(n) AS top FROM s GROUP BY work_id),
walk AS (SELECT s.work_id, n, 1 AS page, size AS used, 1 AS held FROM s WHERE n = 0
  UNION ALL SELECT s.work_id, s.n, CASE WHEN NOT complete AND (held = 4 OR used + s.size > 600) THEN page + 1 ELSE page END, CASE WHEN NOT complete AND (held = 4 OR used + s.size > 600) THEN s.size ELSE used + s.size END, CASE WHEN NOT complete AND (held = 4 OR used + s.size > 600) THEN 1 ELSE held + 1 END
  FROM walk JOIN s ON s.work_id = walk.work_id AND s.n = walk.n + 1 JOIN whole ON whole.work_id = s.work_id)
SELECT work_id, page, CAST(min(n) AS INTEGER) AS lo, CAST(max(n) AS INTEGER) AS hi, any_value(complete) AS complete, page > 1 AS has_prev, max(n) < any_value(top) AS has_next FROM walk JOIN whole USING (work_id) GROUP BY work_id, page""")
def paginate(spark, d):
    return R.paginate(bind(spark, d, "runs"), 600, 4, 2000)


PARAGRAPHS = "SELECT doc_id, CAST(i AS INTEGER) AS seq, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE t <> ''"


@query("", f"""WITH p AS ({PARAGRAPHS}), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM p),
o AS (SELECT *, upto - length(text) AS used, sum(CASE WHEN upto > 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS overs FROM s)
SELECT doc_id, seq, text FROM o WHERE overs = 0 AND used < 1200
UNION ALL SELECT doc_id, seq, rtrim(CASE WHEN length(cut) - instr(reverse(cut), ' ') > 0 AND instr(cut, ' ') > 0 THEN substring(cut, 1, length(cut) - instr(reverse(cut), ' ')) ELSE cut END, ' ,;:') || '…'
FROM (SELECT doc_id, seq, substring(text, 1, CAST(1200 - used AS INTEGER)) AS cut FROM o WHERE overs = 1 AND upto > 1200 AND used < 600)""")
def excerpts(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).where("text <> ''")
    return R.excerpts(lines)


@query("runs", "SELECT work_id, coalesce(CAST(min(CASE WHEN header = 'assistant' THEN n END) AS INTEGER), -1) AS first_chapter FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY id) - 1 AS n FROM runs) GROUP BY work_id")
def front_matter(spark, d):
    return R.front_matter(bind(spark, d, "runs").withColumn("header", F.expr("case header when 'assistant' then 'CHAPTER I' else header end"))).fillna(-1)


LINES_SQL = "SELECT doc_id, CAST(i AS INTEGER) AS seq, CASE (doc_id + i) % 9 WHEN 0 THEN 'The Canons' WHEN 1 THEN 'Canon IV.' WHEN 4 THEN 'Notes.' ELSE trim(regexp_replace(t, '\\s+', ' ', 'g')) END AS t, CASE WHEN (doc_id + i) % 17 = 3 THEN 'h3' ELSE 'p' END AS tag FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)"


@query("", f"""WITH l AS (SELECT * FROM ({LINES_SQL}) WHERE tag = 'h3' OR t <> ''),
m AS (SELECT *, CASE WHEN tag = 'h3' THEN 'heading' WHEN t = 'The Canons' THEN 'canons-head' WHEN t = 'Canon IV.' THEN 'canon-title' WHEN t = 'Notes.' THEN 'notes-label' END AS marker FROM l),
s AS (SELECT *, CASE WHEN marker = 'heading' THEN CASE WHEN regexp_matches(t, '(?i)\\bnote') THEN 'note' ELSE 'body' END WHEN marker = 'canon-title' THEN 'canon' WHEN marker IS NOT NULL THEN 'note' END AS sets FROM m),
c AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), 'body') AS mode FROM s)
SELECT doc_id, seq, mode, coalesce(marker, CASE mode WHEN 'canon' THEN 'canon-text' WHEN 'note' THEN CASE WHEN length(t) <= 28 AND regexp_matches(t, '^[A-Z][A-Za-z.''’-]+(?:\\s[A-Z][A-Za-z.''’-]+){{0,2}}\\.$') THEN 'attribution' ELSE 'note-text' END ELSE 'body' END) AS class FROM c""")
def tag_structure(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "t"))
    text = F.expr("case (doc_id + seq) % 9 when 0 then 'The Canons' when 1 then 'Canon IV.' when 4 then 'Notes.' else t end")
    return R.tag_structure(lines.select("doc_id", "seq", F.expr("case when (doc_id + seq) % 17 = 3 then 'h3' else 'p' end").alias("tag"), text.alias("text"))).drop("text")


RITE = "CASE (doc_id + i) % 9 WHEN 8 THEN '<i>' || t || '</i> <em>and so on</em>' WHEN 0 THEN 'XIV' WHEN 1 THEN 'The Deacon: ' || t WHEN 2 THEN '<i>' || t || '</i>' WHEN 3 THEN 'II. Then aloud: ' || t WHEN 4 THEN '(Aloud.) ' || t WHEN 5 THEN '3. ' || t WHEN 6 THEN '<em>' || t || '</em> but <i>not</i>' ELSE t END"


RITE_SQL = rf"""WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS seq, {RITE} AS html FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
h AS (SELECT doc_id, seq, regexp_replace(html, '^\s+', '') AS h, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM l),
n AS (SELECT *, nullif(regexp_extract(h, '^((?:[IVXLCDM]+|\d+)\.)\s+', 1), '') AS number, regexp_replace(h, '^((?:[IVXLCDM]+|\d+)\.)\s+', '') AS s FROM h WHERE t <> ''),
c AS (SELECT *, regexp_extract(s, '^([^:<]{{2,90}}?:)\s*', 1) AS cue, regexp_extract(s, '^(\([^)]{{1,40}}\))\s*', 1) AS aside FROM n),
k AS (SELECT *, regexp_matches(cue, '(?i)\b(priests?|deacons?|sub-?deacons?|people|bishops?|readers?|singers?|choirs?|catechumens?)\b') AS speaks, regexp_matches(cue, '(?i)^(prayer\b|first\b|response\b|responsive\b|aloud\b|then\b|and again\b|again\b|the response\b)') AS directs FROM c),
g AS (SELECT *, CASE WHEN regexp_matches(t, '^[IVXLCDM]+$') THEN 'section' WHEN regexp_matches(h, '^<(?:i|em)>') AND trim(regexp_replace(regexp_replace(h, '<i>.*?</i>', '', 'gs'), '<em>.*?</em>', '', 'gs')) = '' THEN 'note' WHEN speaks THEN 'speaker' WHEN directs OR aside <> '' THEN 'rubric' WHEN number IS NOT NULL THEN 'line' ELSE 'body' END AS class FROM k)
SELECT doc_id, seq, last_value(CASE WHEN class = 'section' THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS section, class, number, CASE WHEN speaks OR directs THEN cue WHEN aside <> '' THEN aside END AS label,
  CASE WHEN speaks OR directs THEN regexp_replace(s, '^([^:<]{{2,90}}?:)\s*', '') WHEN aside <> '' THEN regexp_replace(s, '^(\([^)]{{1,40}}\))\s*', '') ELSE s END AS rest FROM g"""


@query("", RITE_SQL)
def tag_rite(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return R.tag_rite(lines.select("doc_id", F.col("i").alias("seq"), F.expr(RITE).alias("html")))


@query("verse_passages", """WITH r AS (SELECT *, CASE book WHEN 'Genesis' THEN 0 WHEN 'Exodus' THEN 1 WHEN 'Psalms' THEN 22 WHEN 'Isaiah' THEN 29 WHEN 'Matthew' THEN 48 WHEN 'Mark' THEN 49 WHEN 'Luke' THEN 50 WHEN 'John' THEN 51 WHEN 'Romans' THEN 53 WHEN '1 Corinthians' THEN 54 ELSE 999 END AS b FROM verse_passages),
n AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY id) AS old, CASE WHEN count(*) OVER (PARTITION BY work_id) >= 3 THEN row_number() OVER (PARTITION BY work_id ORDER BY b, chapter, verse_start, id) ELSE row_number() OVER (PARTITION BY work_id ORDER BY id) END AS new FROM r),
z AS (SELECT work_id, list(id ORDER BY old) AS ids, list(header ORDER BY new) AS headers FROM n GROUP BY work_id)
SELECT unnest(ids) AS id, work_id, unnest(headers) AS header FROM z""")
def reorder_passages(spark, d):
    return R.reorder(bind(spark, d, "verse_passages").select("id", "work_id", "header"))[0]


@query("runs", f"WITH src AS (SELECT work_id, id, CASE id % 5 WHEN 0 THEN 'SERMON IV' WHEN 1 THEN 'The Confessions (Book II)' WHEN 2 THEN 'Contents' WHEN 3 THEN rpad('Part 3 of a heading', 90, ' that runs on') END AS header FROM runs), ch AS ({CHAPTERS}), l AS (SELECT *, CASE WHEN header IS NULL THEN CASE WHEN start = 0 THEN 'Introduction' ELSE 'Section ' || (start + 1) END WHEN header = 'Contents' THEN 'Table of Contents' WHEN header LIKE 'SERMON%' THEN 'Sermon IV' WHEN header LIKE 'The%' THEN 'Confessions (Book II)' ELSE header END AS label FROM ch) SELECT work_id, start, label, CASE WHEN length(label) > 72 THEN regexp_replace(left(label, 69), '\\s+\\S*$', '') || '...' ELSE label END AS short, coalesce(header LIKE 'The%' OR header LIKE 'Part%', false) AS divider FROM l")
def chapter_labels(spark, d):
    header = "case id % 5 when 0 then 'SERMON IV' when 1 then 'The Confessions (Book II)' when 2 then 'Contents' when 3 then rpad('Part 3 of a heading', 90, ' that runs on') end"
    return R.chapter_labels(R.chapter_index(bind(spark, d, "runs").withColumn("header", F.expr(header)))).select("work_id", "start", "label", "short", "divider")


@query("runs", r"SELECT id, nullif(regexp_extract(t, '^([^\n]{5,120}?\bsaid\s*[:\-,—–]+\s*)', 1), '') AS speaker, substring(t, length(regexp_extract(t, '^([^\n]{5,120}?\bsaid\s*[:\-,—–]+\s*)', 1)) + 1) AS speech FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'Bishop ' || header || ' said: ' || text ELSE text END AS t FROM runs)")
def split_speaker(spark, d):
    said = bind(spark, d, "runs").withColumn("text", F.expr("case when id % 2 = 0 then concat('Bishop ', header, ' said: ', text) else text end"))
    return R.split_speaker(said).select("id", "speaker", "speech")


#: Headers of the documents' own lines, some under a section's word with a number, a roman numeral or an ordinal.
HEADS = "CASE (doc_id + i) % 7 WHEN 0 THEN 'Chapter ' || (i % 60 + 1) || CASE WHEN i % 2 = 0 THEN 'b' ELSE '' END || '. ' || t WHEN 1 THEN 'Homily ' || list_r || ', ' || t WHEN 2 THEN (doc_id % 300) || ' ' || t WHEN 3 THEN t || ' tenth' ELSE t END"
ROMANS = "'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIV', 'XIX', 'XL', 'XC', 'CD', 'CM', 'MCMXCIX'"
NUMERAL = rf"(?i)^(?:(?:{R.SECTION_WORDS})\.?\s+)?([IVXLCDM]+|\d+)([A-Z]?)(?:[\s.,;:)\]]|$)"


@query("", rf"""WITH l AS (SELECT doc_id, i, t, list_extract([{ROMANS}], CAST(i % 19 + 1 AS INTEGER)) AS list_r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
h AS (SELECT doc_id, CAST(i AS INTEGER) AS seq, trim(regexp_replace(regexp_replace({HEADS}, '\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS h FROM l),
p AS (SELECT *, upper(regexp_extract(h, '{NUMERAL}', 1)) AS tok, upper(regexp_extract(h, '{NUMERAL}', 2)) AS suf, list_filter(regexp_extract_all(lower(h), '([a-z]+(?:-[a-z]+)?)'), lambda x: x IN ({", ".join(repr(o) for o in R.ORDINALS)}))[1] AS word FROM h),
d AS (SELECT *, list_transform(string_split(tok, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END) AS vs FROM p),
n AS (SELECT doc_id, seq, tok, suf, CASE WHEN tok = '' THEN CAST(list_position([{", ".join(repr(o) for o in R.ORDINALS)}], word) AS INTEGER) WHEN regexp_matches(tok, '^[0-9]+$') THEN TRY_CAST(tok AS INTEGER)
  ELSE CAST(list_sum(list_transform(range(1, len(vs) + 1), lambda k: CASE WHEN vs[k] < coalesce(list_max(vs[k + 1:]), 0) THEN -vs[k] ELSE vs[k] END)) AS INTEGER) END AS number FROM d)
SELECT doc_id, seq, coalesce(number, -1) AS number, CASE WHEN number IS NOT NULL THEN CASE WHEN tok = '' THEN '' ELSE suf END END AS suffix FROM n""")
def parse_numerals(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    heads = lines.withColumn("list_r", F.expr(f"element_at(array({ROMANS}), i % 19 + 1)")).select("doc_id", F.col("i").alias("seq"), F.expr(HEADS).alias("header"))
    return R.parse_numeral(heads).select("doc_id", "seq", "number", "suffix").fillna(-1, "number")


@query("runs", "SELECT id, CAST(sum(c) OVER (PARTITION BY work_id ORDER BY id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN header IS DISTINCT FROM lag(header) OVER w THEN 1 ELSE 0 END AS c FROM runs WINDOW w AS (PARTITION BY work_id ORDER BY id))")
def card_sections(spark, d):
    return R.runs(bind(spark, d, "runs"), ["work_id"], ["id"]).select("id", "run")
