"""Secret scans: spans of credentials, and weak parts of multipart credentials linked by an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.expr import let
from stemma.session import Scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: a name of an account, a mixed string that could be a key, an address to use them at.
IDENT = r"""(?i:access_?key_?id|access_?id|client_?id|account_?id|tenant_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D"'<>]{4,}"""
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")


NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"
#: Matches whose lengths are summed in one go.
RUN = 128


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(kind: str, text: str, pattern: str, keep: str = "true") -> str:
    """SQL for the array of (start, kind, end) of a pattern's matches that ``keep`` (over m, and i their number) accepts.

    What lies between matches is what split() returns, so running lengths give the places, in code points. The lengths are
    summed by runs of ``RUN`` matches and then inside a run, so that a text with very many matches costs little more a match.
    """
    p, rank = literal(pattern), KINDS.index(kind)
    total = lambda xs: f"aggregate({xs}, 0L, (a, x) -> a + x)"
    run = f"transform(sequence(0, (size(l) - 1) div {RUN}), c -> {total(f'slice(l, int(c * {RUN} + 1), {RUN})')})"
    starts = f"transform(sequence(0, size(k) - 1), c -> {total('slice(k, 1, c)')})"
    ahead = f"o[int(i div {RUN})] + {total(f'slice(l, int(i - i % {RUN} + 1), int(i % {RUN}))')} + length(s[i])"
    placed = f"transform(sequence(0, size(m) - 1), i -> if({keep}, {let('at', ahead, f'named_struct({chr(39)}start{chr(39)}, at, {chr(39)}kind{chr(39)}, {rank}, {chr(39)}end{chr(39)}, at + length(m[i]))')}, null))"
    found = f"filter({let('k', run, let('o', starts, placed))}, x -> x is not null)"
    lengths = "transform(m, (x, i) -> cast(length(s[i]) + length(x) as bigint))"
    return let("m", f"regexp_extract_all({text}, {p}, 0)", f"if(size(m) = 0, {NONE}, {let('s', f'split({text}, {p}, -1)', let('l', lengths, found))})")


def listed(col: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort({col}), x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def find_secrets(docs: DataFrame, reach: int = 256) -> DataFrame:
    """Credentials in every whole text of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Strong spans (an assignment whose value has 6 characters or more, an access id, a run of 24 hex digits or more) are always
    reported. Weak parts (an account's name, a mixed string with digits and both cases, an address) are reported only where
    complementary parts lie within ``reach`` characters: a name beside a secret (weak, assigned or hex), a secret beside
    a name (weak or access id), an address beside both. Weak strings that overlap strong spans are not parts of their own. Parts
    meet by interval joins within a text's scopes of ``reach`` characters, as semi-joins, so no pairs are emitted.

    Places are code points, the end exclusive; spans are ordered by start, then kind; a text with very many matches costs
    in proportion to them. A null or empty text has no spans. Repeated rows each get the same result; a null doc_id is
    kept, and texts are told apart by doc_id and a hash of the text. Other columns are not read. No rows give no rows.
    """
    t = "coalesce(text, '')"
    lengths = f"regexp_extract_all({t}, {literal(ASSIGN)}, 2)"
    strong = let("v", lengths, f"if(size(v) = 0, {NONE}, {spans('assign', t, ASSIGN, 'length(v[i]) >= 6')})")
    mixed = "m[i] rlike '[0-9]' and m[i] rlike '[a-z]' and m[i] rlike '[A-Z]'"
    scratch = Scratch(docs.sparkSession)
    marked = scratch.cut(
        docs.select("doc_id", "text").select(
            "doc_id",
            F.expr("xxhash64(doc_id, text)").alias("rid"),
            F.expr(f"concat({strong}, {spans('access', t, ACCESS)}, {spans('hex', t, HEX)})").alias("base"),
            F.expr(f"concat({spans('ident', t, IDENT)}, {spans('secret', t, MIXED, mixed)}, {spans('endpoint', t, ENDPOINT)})").alias("weak"),
        )
    )
    same = "a.doc_id <=> b.doc_id and a.rid = b.rid and a.scope = b.scope"
    whole = ["doc_id", "rid", "kind", "start", "end"]
    touched = marked.where("size(weak) > 0")
    both = scratch.cut(touched.select("doc_id", "rid", F.explode(F.concat("base", "weak")).alias("w")).select("doc_id", "rid", "w.*").distinct())

    def scoped(some: DataFrame, margin: int) -> DataFrame:
        """Spans in each scope that they, widened by ``margin``, reach into."""
        return some.withColumn("scope", F.expr(f"explode(sequence(int(floor((start - {margin}) / {reach})), int(floor((end - 1 + {margin}) / {reach}))))"))

    base, weak = both.where("kind < 3"), both.where("kind >= 3")
    hidden = scoped(weak.where("kind = 4"), 0).alias("a").join(scoped(base, 0).alias("b"), F.expr(f"{same} and b.start < a.end and a.start < b.end"), "left_semi").select(whole).distinct()
    weak = weak.alias("a").join(hidden.alias("b"), F.expr("a.doc_id <=> b.doc_id and " + " and ".join(f"a.{c} = b.{c}" for c in whole[1:])), "left_anti")
    weak = scratch.cut(weak.select(whole))
    near, placed = scoped(base.select(whole).union(weak.where("kind <> 5")), reach), scoped(weak, 0)

    def beside(some: DataFrame, kinds: str) -> DataFrame:
        met = some.alias("a").join(near.where(f"kind in {kinds}").alias("b"), F.expr(f"{same} and b.start - {reach} < a.end and a.start < b.end + {reach}"), "left_semi")
        return met.select([f"a.{c}" for c in whole]).distinct()

    names, secrets = "(1, 3)", "(0, 2, 4)"
    address = placed.where("kind = 5")
    kept = beside(placed.where("kind = 3"), secrets).union(beside(placed.where("kind = 4"), names))
    kept = kept.union(beside(address, names).intersect(beside(address, secrets)))
    found = kept.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    out = marked.drop("weak").alias("a").join(found.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.rid = b.rid"), "left").select("a.*", "b.linked")
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = {KINDS.index(kind)})) as bigint)").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(listed("base")), 256).alias("base_sha256"), F.expr(listed(f"concat(base, coalesce(linked, {NONE}))")).alias("spans"))
