"""Quality rules: Jensen-Shannon distance of a document's character classes and common words from language references."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.expr import SPACE, let, words
from stemma.session import Scratch

#: Frequent function words of four languages (fixed values).
COMMON = {
    "en": "the of and to a in that is it for was on with as be by this from or an are at have not but".split(),
    "fr": "de la le et les des en un une que est pour dans qui sur pas par au avec elle du il ne se plus".split(),
    "de": "der die und das von zu den mit sich auf ist nicht ein eine dem im für als auch es an er aus bei sie".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus".split(),
}
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = ("lower", "space", "upper", "digit", "stop", "caseless", "symbol")
#: What stays of a text when the classes before are gone is cut down by one pattern at a time. Letters without case (and marks) are letters.
STEPS = (r"\\p{Ll}+", SPACE, r"[\\p{Lu}\\p{Lt}]+", r"\\p{Nd}+", r"[.,;:?\\x27\\x22()-]+", r"[\\p{Lo}\\p{Lm}\\p{M}]+")
#: The squared distance (base 2) of n draws from their own distribution over K values is (K - 1) / (8 ln 2) / n on average:
#: for the 25 listed words of a language and all others, and for the character classes.
WORD_SPREAD = 25 / (8 * math.log(2))
CLASS_SPREAD = (len(CLASSES) - 1) / (8 * math.log(2))


def measures(text: str = "text") -> str:
    """SQL for the counts of a text: one struct, worked out in the row itself over the whole text.

    ``common`` holds (i, n) for the i-th word of VOCABULARY, from 1, that the text has n times.
    """
    t = f"coalesce({text}, '')"
    last = len(STEPS)
    lengths = ", ".join([f"length(r{i}) - length(r{i + 1})" for i in range(last)] + [f"length(r{last})"])
    classes = f"named_struct('counts', array({lengths}), 'n_symbols', cast(length(r{last}) - length(regexp_replace(r{last}, '[#*$%&|<>]+', '')) as bigint))"
    for i, pattern in reversed(list(enumerate(STEPS))):
        classes = let(f"r{i + 1}", f"regexp_replace(r{i}, '{pattern}', '')", classes)
    classes = let("r0", t, classes)
    again = let("s", "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'p', i)))", "sort_array(transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h or get(s, i + 1).h <=> x.h), x -> x.p))")
    covered = f"aggregate({again}, named_struct('n', 0L, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)"
    repeated = let("hs", "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))", f"if(size(array_distinct(hs)) = size(hs), 0L, {covered})")
    body = let("ws", words(text), f"named_struct('n_words', cast(size(ws) as bigint), 'n_repeat_words', if(size(ws) < 3, 0L, {repeated}))")
    listed = ", ".join(f"'{w}'" for w in VOCABULARY)
    # each word stands between two spaces of its own, so that removing it shortens the row by a known length
    times = "cast((length(c) - length(replace(c, concat(' ', w, ' '), ''))) div (length(w) + 2) as bigint)"
    counts = let("c", "concat(' ', array_join(cw, '  '), ' ')", f"transform(array_distinct(cw), w -> named_struct('i', int(array_position(array({listed}), w)), 'n', {times}))")
    common = let("cw", f"filter(split(lower(concat({t}, ' ')), '[.,;:?!]*{SPACE}', -1), w -> w in ({listed}))", counts)
    lines = let("l", f"filter(split({t}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "cast(size(l) - size(array_distinct(l)) as bigint)")
    return f"named_struct('words', {body}, 'classes', {classes}, 'common', {common}, 'n_dup_lines', {lines}, 'n_chars', cast(length({t}) as bigint))"


def references(measured: DataFrame) -> list[str]:
    """SQL for each listed language's histograms, as shares, over all rows in that language that pass the base rules; in order of language."""
    own = measured.where(F.col("lang").isin(*COMMON) & ~F.col("base_failed"))
    totals = own.groupBy("lang").agg(F.sum("n_words").alias("words"), *(F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))))
    found = own.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.i").agg(F.sum("x.n").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("common"))
    out = []
    for r in totals.join(found, "lang", "left").orderBy("lang").collect():  # a row for each listed language
        classes, common = [r[f"c{i}"] for i in range(len(CLASSES))], [(r.common or {}).get(i + 1, 0) for i in range(len(VOCABULARY))]
        shares = lambda xs, n: "array(" + ", ".join(f"{x / n!r}d" for x in xs) + ")"
        out.append(f"named_struct('classes', {shares(classes, sum(classes))}, 'common', {shares([*common, r.words - sum(common)], r.words)})")
    return out


def distance(have: str, n: str, share: str) -> str:
    """SQL for the Jensen-Shannon distance (base 2) of counts ``have`` (i from 1, n), which add up to ``n``, from the array ``share`` of all shares.

    Values that are not in ``have`` add half of their share, so only the others are gone through.
    """
    p, q = f"(x.n / cast({n} as double))", f"{share}[x.i - 1]"
    half = f"{p} * log2(2 * {p} / ({p} + {q})) + if({q} > 0, {q} * log2(2 * {q} / ({p} + {q})), 0d) - {q}"
    return f"sqrt(greatest(0d, 0.5d + 0.5d * aggregate({have}, 0d, (a, x) -> a + if(x.n > 0, {half}, 0d))))"


def judge(docs: DataFrame, max_classes: float = 0.3, max_words: float = 0.23, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` (text, lang and any others; of these the ones in ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_classes, js_words, kept.

    A text fails the base rules with under 50 words or if over half its words lie in repeated three-word windows. The other
    texts in a listed language are compared with every listed language's reference, which is the histogram of all the texts in
    that language that pass the base rules: seven character classes, and the frequent function words with all others as one
    more. kept is false if the nearest reference is further in Jensen-Shannon distance than d with d^2 = max^2 + s / n: ``max_words`` or
    ``max_classes`` is what a long text may differ by, and s / n is what n words, or characters, drawn from the reference itself
    differ by on average, so that one limit serves texts of every length. The guard against short texts is the 50 words of the base rules.

    A text in a language without a reference, or without a language, is judged by the base rules alone; so are all texts if
    no text of a listed language passes them. The references are at most four rows. A null text is an empty one. Repeated rows
    are judged alike. Input columns with the names of results are replaced. An empty table gives no rows.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_classes", "js_words", "kept")
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    measured = docs.select(*(F.col(c).alias(f"in_{c}") for c in names), "lang", F.expr(measures()).alias("m")).select(
        *(f"in_{c}" for c in names), "lang", "m.words.*", F.col("m.classes.counts").alias("classes"), F.col("m.classes.n_symbols").alias("n_symbols"), "m.common", "m.n_dup_lines", "m.n_chars"
    )
    measured = measured.withColumn("word_chars", F.expr(f"n_chars - classes[{CLASSES.index('space')}]")).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    measured = Scratch(docs.sparkSession).cut(measured)
    refs = references(measured)
    scored = measured
    every = "transform(classes, (n, i) -> named_struct('i', i + 1, 'n', n))"
    common = f"concat(common, array(named_struct('i', {len(VOCABULARY) + 1}, 'n', n_words - aggregate(common, 0L, (a, x) -> a + x.n))))"
    for field, have, n in (("classes", every, "n_chars"), ("words", common, "n_words")):
        share = "r." + ("classes" if field == "classes" else "common")
        near = let("h", have, f"array_min(transform(array({', '.join(refs)}), r -> {distance('h', n, share)}))") if refs else "cast(null as double)"
        scored = scored.withColumn(f"js_{field}", F.expr(f"if(base_failed or not coalesce(lang in ({', '.join(repr(x) for x in COMMON)}), false), null, {near})"))
    limit = lambda most, spread, n: f"sqrt({most}d * {most}d + {spread!r}d / {n})"
    within = f"coalesce(js_classes <= {limit(max_classes, CLASS_SPREAD, 'n_chars')}, true) and coalesce(js_words <= {limit(max_words, WORD_SPREAD, 'n_words')}, true)"
    kept = scored.withColumn("kept", F.expr(f"not base_failed and {within}"))
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in names), *added)
