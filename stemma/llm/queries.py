"""The registered queries opN_<name>, one per operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.html_template import extract
from stemma.llm.lines import dedup_lines
from stemma.llm.middle import fill_in_middle, restored
from stemma.llm.mixing import mix
from stemma.llm.nbsvm import classify
from stemma.llm.packing import pack
from stemma.llm.passages import remove_repeats
from stemma.llm.pieces import decode, encode
from stemma.llm.pipeline import run
from stemma.llm.quality_rules import CLASS_SPREAD, COMMON, VOCABULARY, WORD_SPREAD, judge
from stemma.llm.secrets import find_secrets
from stemma.llm.simhash import simhash_groups
from stemma.llm.topk import top_k
from stemma.llm.variants import group_variants
from stemma.session import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_secret_scan, op3_simhash, op4_quality_classifier, op5_substring_dedup, op6_packing, op7_quality_rules, op8_mixing, op9_exact_topk, op10_line_dedup)
    own += (op11_fill_in_middle, op12_spelling_variants, op13_sentencepiece)
    return {f.__name__: f for f in own} | {"pipeline": run}


WORD = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS r, k.rank, k.name, regexp_extract_all(t, k.p) AS m, string_split_regex(t, k.p) AS s,
         CASE WHEN k.rank = 0 THEN regexp_extract_all(t, k.p, 2) ELSE regexp_extract_all(t, k.p) END AS v, d
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS d FROM documents),
       (VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
               (1, 'access', 'AKIA[A-Z0-9]{16,}', 20), (2, 'hex', '[0-9a-f]{24,}', 24),
               (3, 'ident', '(?i:access_?key_?id|access_?id|client_?id|account_?id|tenant_?id|user_?name|user|login)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}', 0),
               (4, 'secret', '[A-Za-z0-9+/_=-]{20,}', 20),
               (5, 'endpoint', '(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D"''<>]{4,}', 0)) k(rank, name, p, least)),
placed AS (
  SELECT d, doc_id, rank, name, m[i] AS hit, v[i] AS val,
         list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st, i
  FROM found, unnest(range(1, len(m) + 1)) AS n(i)),
span AS (
  SELECT d, doc_id, rank, name, CAST(st AS BIGINT) AS st, CAST(st + length(hit) AS BIGINT) AS en FROM placed
  WHERE (rank <> 0 OR length(val) >= 6)
    AND (rank <> 4 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')))),
part AS (
  SELECT * FROM span a WHERE rank <> 4 OR NOT EXISTS (SELECT 1 FROM span b WHERE b.d = a.d AND b.rank < 3 AND b.st < a.en AND a.st < b.en)),
near AS (
  SELECT a.d, a.rank, a.name, a.st, a.en,
         EXISTS (SELECT 1 FROM part b WHERE b.d = a.d AND b.rank IN (1, 3) AND b.st - 256 < a.en AND a.st < b.en + 256) AS names,
         EXISTS (SELECT 1 FROM part b WHERE b.d = a.d AND b.rank IN (0, 2, 4) AND b.st - 256 < a.en AND a.st < b.en + 256) AS secrets
  FROM part a),
kept AS (
  SELECT * FROM near WHERE rank < 3 OR (rank = 3 AND secrets) OR (rank = 4 AND names) OR (rank = 5 AND names AND secrets)),
listed AS (
  SELECT d, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         coalesce(string_agg(name || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (rank < 3), '') AS base,
         string_agg(name || ':' || st || ':' || en, ',' ORDER BY st, rank) AS spans FROM kept GROUP BY d)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT doc_id, row_number() OVER () AS d FROM documents) LEFT JOIN listed USING (d)
"""

OP5 = rf"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, r, unnest(range(1, len(ws) - 48)) AS s,
               unnest(list_transform(range(1, len(ws) - 48), lambda s: md5(array_to_string(ws[s:s + 49], ' ')))) AS h FROM doc WHERE len(ws) >= 50),
later AS (SELECT r, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT r, s + o AS i FROM later, range(0, 50) AS t(o)),
word AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM doc),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""


def _op7() -> str:
    listed = ", ".join(f"'{w}'" for w in VOCABULARY)
    langs = ", ".join(f"'{x}'" for x in COMMON)
    classes = ", ".join(f"CAST(length(regexp_replace(t, '{p}', '', 'g')) AS BIGINT)" for p in (r"[^\p{Ll}]", r"[^\x20\x09-\x0D]", r"[^\p{Lu}\p{Lt}]", r"[^\p{Nd}]", r"[^.,;:?\x27\x22()-]", r"[^\p{Lo}\p{Lm}\p{M}]"))
    return rf"""
WITH doc AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
tri AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM doc WHERE len(ws) >= 3),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri), range(0, 3) AS t(o) WHERE c >= 2 GROUP BY r),
base AS (
  SELECT doc_id, lang, r, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_value({classes}) AS c6,
         list_filter(list_transform(ws, lambda w: lower(regexp_replace(w, '[.,;:?!]+$', ''))), lambda w: w IN ({listed})) AS common
  FROM doc LEFT JOIN rep USING (r)),
hist AS (SELECT *, list_append(c6, CAST(length(t) - list_sum(c6) AS BIGINT)) AS c7, list_transform([{listed}], lambda v: CAST(len(list_filter(common, lambda w: w = v)) AS BIGINT)) AS cw FROM base),
refc AS (SELECT lang, i, sum(c) AS s FROM (SELECT lang, unnest(c7) AS c, unnest(range(1, 8)) AS i FROM hist WHERE NOT base_failed AND lang IN ({langs})) GROUP BY ALL),
refw AS (SELECT lang, i, sum(c) AS s FROM (SELECT lang, unnest(list_append(cw, n_words - list_sum(cw))) AS c, unnest(range(1, {len(VOCABULARY)} + 2)) AS i FROM hist WHERE NOT base_failed AND lang IN ({langs})) GROUP BY ALL),
refs AS (
  SELECT lang, rc, rw FROM (SELECT lang, list(q ORDER BY i) AS rc FROM (SELECT lang, i, CAST(s AS DOUBLE) / sum(s) OVER (PARTITION BY lang) AS q FROM refc) GROUP BY lang)
  JOIN (SELECT lang, list(q ORDER BY i) AS rw FROM (SELECT lang, i, CAST(s AS DOUBLE) / sum(s) OVER (PARTITION BY lang) AS q FROM refw) GROUP BY lang) USING (lang)),
mine AS (
  SELECT r, length(t) AS n, list_transform(c7, lambda c: CAST(c AS DOUBLE) / length(t)) AS pc,
         list_transform(list_append(cw, n_words - list_sum(cw)), lambda c: CAST(c AS DOUBLE) / n_words) AS pw FROM hist WHERE NOT base_failed AND lang IN ({langs})),
far AS (
  SELECT r, n, min(sqrt(greatest(0, list_sum(list_transform(range(1, 8), lambda i: 0.5 * (CASE WHEN pc[i] > 0 THEN pc[i] * log2(2 * pc[i] / (pc[i] + rc[i])) ELSE 0 END + CASE WHEN rc[i] > 0 THEN rc[i] * log2(2 * rc[i] / (pc[i] + rc[i])) ELSE 0 END)))))) AS jc,
         min(sqrt(greatest(0, list_sum(list_transform(range(1, {len(VOCABULARY)} + 2), lambda i: 0.5 * (CASE WHEN pw[i] > 0 THEN pw[i] * log2(2 * pw[i] / (pw[i] + rw[i])) ELSE 0 END + CASE WHEN rw[i] > 0 THEN rw[i] * log2(2 * rw[i] / (pw[i] + rw[i])) ELSE 0 END)))))) AS jw
  FROM mine, refs GROUP BY r, n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(jc <= sqrt(0.3 * 0.3 + {CLASS_SPREAD!r}::DOUBLE / n), true) AND coalesce(jw <= sqrt(0.23 * 0.23 + {WORD_SPREAD!r}::DOUBLE / n_words), true) AS kept
FROM hist LEFT JOIN far USING (r)
"""


OP8 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM doc GROUP BY source),
ordered AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] :: DOUBLE AS weight, 2.0 * source_size AS cap FROM src),
running AS (
  SELECT *, cap / weight AS level, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM ordered),
aim AS (
  SELECT source, source_size, n, least(cap, coalesce(weight * max(CASE WHEN lam <= level THEN lam END) OVER (), cap)) :: DOUBLE AS target FROM running),
share AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS ratio, floor(ratio) AS whole, ratio - whole AS part, target - whole * source_size AS lft FROM aim),
sizes AS (SELECT d.source, size, count(*) AS k, any_value(lft) AS lft FROM doc d JOIN share s ON d.source IS NOT DISTINCT FROM s.source WHERE lft > 0 AND size > 0 GROUP BY d.source, size),
rates AS (
  SELECT source, max_by(c, size) AS rate FROM (
    SELECT source, size, (lft - coalesce(sum(k * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: DOUBLE)
           / sum(k * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) :: DOUBLE AS c FROM sizes)
  WHERE c * size <= 1 GROUP BY source),
ranked AS (
  SELECT r, doc_id, d.source, size, lft, CASE WHEN rate * size < 1 THEN round(ln(u) - ln(1 - u) - ln(rate * size) + ln(1 - rate * size), 9) ELSE -1000 END AS rank
  FROM doc d JOIN share s ON d.source IS NOT DISTINCT FROM s.source JOIN rates c ON d.source IS NOT DISTINCT FROM c.source WHERE lft > 0 AND size > 0),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size, r ROWS UNBOUNDED PRECEDING) <= lft AS inn FROM ranked),
short AS (SELECT source, any_value(lft) - sum(CASE WHEN inn THEN size ELSE 0 END) AS gap FROM summed GROUP BY source),
closing AS (
  SELECT s.r FROM summed s JOIN short g ON s.source IS NOT DISTINCT FROM g.source WHERE NOT inn AND abs(s.size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY s.source ORDER BY abs(s.size - gap), rank, doc_id, s.size, r) = 1),
once AS (SELECT r, 1 AS extra FROM summed WHERE inn UNION ALL SELECT r, 1 FROM closing)
SELECT d.doc_id, d.size, s.source_size, s.target, CAST(d.size * (s.whole + coalesce(o.extra, 0)) AS BIGINT) AS taken
FROM doc d JOIN share s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN once o USING (r)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS z, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, z, min(r) AS no FROM v WHERE vec_id % 20 = 0 GROUP BY ALL),
met AS (SELECT q.vec_id AS query_id, no, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z))
SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM met QUALIFY rank <= 20
"""

OP10 = r"""
WITH doc AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, r, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM doc WHERE text IS NOT NULL),
solid AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
win AS (SELECT a.doc_id, a.r, a.l AS l1, b.l AS l2, c.l AS l3, a.i AS i1, b.i AS i2, c.i AS i3 FROM solid a JOIN solid b ON a.r = b.r AND b.k = a.k + 1 JOIN solid c ON a.r = c.r AND c.k = a.k + 2),
later AS (SELECT r, i1, i2, i3 FROM win QUALIFY (doc_id, i1) <> min((doc_id, i1)) OVER (PARTITION BY l1, l2, l3)),
gone AS (SELECT r, i1 AS i FROM later UNION SELECT r, i2 FROM later UNION SELECT r, i3 FROM later),
kept AS (SELECT r, string_agg(l, chr(10) ORDER BY i) AS t, count(*) AS n FROM line ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""


OP11 = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * i + 1, 8) AS BIGINT)) AS h FROM documents),
cut AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM doc),
part AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM part
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": OP2, "op5_substring_dedup": OP5, "op7_quality_rules": _op7(), "op8_mixing": OP8, "op9_exact_topk": OP9, "op10_line_dedup": OP10, "op11_fill_in_middle": OP11}
