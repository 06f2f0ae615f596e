"""HTML extraction by template deduction: tokens with equal occurrence vectors over a host's pages form its template."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import Scratch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
ASIDE = frozenset("nav header footer aside menu dialog".split())
FORMS = frozenset("form fieldset".split())
#: What a head can hold; anything else ends it.
METADATA = frozenset("html head base link meta title script style noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark what is not the article (fixed values), and others that may as well name its subject.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav subnav widget header masthead footer copyright ad ads advert adverts advertisement advertising adsense sponsor sponsored "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login comment comments respond replies disqus share sharing pagination pager toolbar skip".split()
)
WEAK_MARKS = frozenset(
    "side aside rail promo promotion promoted banner notice notices notification alert overlay social related recommended recommendations topbar sitemap logo branding legal disclaimer search form toc tags taglist "
    "teaser teasers trending popular discussion feedback guestbook reaction reactions".split()
)
#: Words that say no more than that something is a part or where it is, and words by which a name tells of what a page has or lacks.
NEUTRAL = frozenset(
    "box slot wrapper wrap container block unit bar area inner outer section list item items link links button buttons btn group panel col column row grid module zone top bottom left right main primary secondary "
    "site page content body text wide narrow fixed sticky mobile desktop small large".split()
)
STATES = frozenset("no non not with without has have free enabled disabled open closed allowed on".split())
#: Elements that hold text of their own; of their names only the last word counts, and a heading's id is what it is about.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is said against an element: nothing, a weak word, a sure word, that it is a form; or, beyond doubt, its tag or role or that it is hidden.
CLEAR, WEAK, SURE, FORM, HARD = range(5)
#: Of these, what inside an article is its title.
TITLES = frozenset("header masthead banner".split())
#: Names of containers of an article, and of ones that may hold more.
SURE_MARKS = frozenset("article articlebody articlecontent post postbody postcontent entry entrycontent story storybody".split())
LOOSE_MARKS = frozenset("content maincontent main body text".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_STAYS = frozenset("article aside blockquote body div footer form header li main nav section table td th ul ol".split())
LISTS = frozenset("ul ol table dl".split())
TRAITS = frozenset("class id role hidden aria-hidden style".split())
BLANK = re.compile(r"\s+")
#: Characters of a path beyond which it grows no longer.
PATH = 2000


def named(name: str, but: frozenset[str]) -> int:
    """What one name in a class or id says against its element.

    The last word tells what something is (a post-comments is comments, a comments-policy a policy), but for words like box or
    content; words before it say little, and names that tell what a page has or lacks (no-sidebar, ad-free) nothing.
    """
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if STATES & set(words):
        return CLEAR
    glued, told = "".join(words), [*words]
    while len(told) > 1 and told[-1] in NEUTRAL:
        told.pop()
    sure, weak = MARKS - but, WEAK_MARKS - but
    if glued in sure or told and told[-1] in sure:
        return SURE
    if glued in weak or told and told[-1] in weak:
        return WEAK
    return WEAK / 2 if (sure | weak) & set(words) else CLEAR


@lru_cache(1 << 14)
def traits(tag: str, attrs: tuple[tuple[str, str], ...]) -> tuple[str, int, int, int, bool]:
    """An element's name in paths, what is said against it outside and inside an article, how surely it is one (4 to 0), and if it is hidden."""
    have = dict(attrs)
    label = f"{have.get('class', '')} {have.get('id', '')}".strip().lower()
    names = (have.get("class", "") if tag in HEADINGS else label).lower().split()
    words = {w for w in re.split(r"[^a-z]+", label) if w} | {re.sub(r"[^a-z]", "", w) for w in label.split()}
    role = have.get("role")
    box = tag in ("div", "section", "td")
    main = 4 if tag == "article" or role == "article" else 3 if box and words & SURE_MARKS else 2 if tag == "main" or role == "main" else 1 if box and words & LOOSE_MARKS else 0
    hidden = "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", "")
    form = FORM if tag in FORMS or role == "form" else CLEAR

    def against(but: frozenset[str], asides: frozenset[str], alone: bool) -> int:
        said = max((named(n, but) for n in names), default=CLEAR) if tag not in ("html", "body") else CLEAR
        said = CLEAR if said < WEAK and alone else WEAK if 0 < said < WEAK else said
        return HARD if hidden or role in ROLES or tag in asides else max(form, said)

    outside = against(TITLES if main > 1 else frozenset(), ASIDE, tag in LEAVES)
    # what an article's own header holds is its title, as long as nothing else marks it
    inside = against(TITLES, ASIDE - {"header"}, True)
    if main > 2 and against(TITLES, frozenset(), True) == SURE:
        main = 0  # a comment is no article, whatever element it is in
    name = tag + ("." + ".".join(sorted(w for w in words if w)) if label else "")
    return name, outside, inside, main, hidden


class Page(HTMLParser):
    """Reads a page into blocks of text (path, what is said against it, how surely in the article, text, linked characters); the path names each open element.

    What is said against a block is a number and a level for each element around it that anything is said against, outermost first.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        # tag, path, said, main, mute, in a link: what an element has from those around it included
        self.open: list[tuple[str, str, str, int, bool, bool]] = [("", "", "", 0, False, False)]
        self.opened: dict[str, int] = {}
        self.blocks: list[tuple[str, str, int, str, int]] = []
        self.marked = 0
        self.paths: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.head = False
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = BLANK.sub(" ", "".join(self.parts)).strip()
            if text:
                _, path, said, main, _, _ = self.open[-1]
                self.blocks.append((path, said, main, text, self.linked))
            self.parts, self.linked = [], 0

    def end_head(self) -> None:
        self.shut(("head",), frozenset())
        self.head = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.head and tag not in METADATA:
            self.end_head()
        self.head = self.head or tag == "head"
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag in ENDS_P:
                self.shut(("p",), P_STAYS)
            if tag in CLOSES:
                self.shut(CLOSES[tag], LISTS)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, path, said, main, mute, link = self.open[-1]
        name, outside, inside, own, hidden = traits(tag, tuple((k, v or "") for k, v in attrs if k in TRAITS))
        if not inline:
            # elements below a path of that length are told apart no further, so that deep nesting costs no more
            path = path if len(path) > PATH else f"{path}/{name}" if path else name
            self.paths[path] += 1
            level = inside if main > 1 else outside
            # beyond doubt is beyond doubt, whatever else stands around or below
            if level and not said.endswith(f":{HARD}") and (level == HARD or len(said) < PATH):
                self.marked += 1
                said = f"{said},{self.marked}:{level}" if said else f"{self.marked}:{level}"
        self.open.append((tag, path, said, max(main, own), mute or tag in SILENT or (inline and hidden), link or tag == "a"))
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.shut((tag,), frozenset())

    def shut(self, tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        """Closes the innermost open element of these tags, unless one of ``barrier`` is inside it."""
        if not any(self.opened.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                for x in self.open[i:]:
                    self.opened[x[0]] -= 1
                del self.open[i:]
                return
            if self.open[i][0] in barrier:
                return

    def handle_data(self, data: str) -> None:
        if self.head and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        top = self.open[-1]
        if not top[4]:
            self.parts.append(data)
            if top[5]:
                self.linked += len(data.strip())


def read(html: str | None) -> list[tuple[str, str, int, str, int]]:
    return Page(html).blocks if html else []


def token(path: str, text: str | None = None) -> int:
    return xxhash.xxh64_intdigest(path if text is None else f"{path}\n{text}") - (1 << 63)


def tokens(page: Page) -> list[tuple[int, int, str, bool]]:
    """A page's tokens, how often it has each, on which path, and if it is a text: its elements by path, and its texts on theirs."""
    texts = Counter((b[0], b[3]) for b in page.blocks)
    return [(token(p), n, p, False) for p, n in page.paths.items()] + [(token(p, t), n, p, True) for (p, t), n in texts.items()]


def heard(blocks: list[tuple[str, str, int, str, int]], own: list[int]) -> list[int]:
    """What stands against each block in the end; ``own`` has each block's characters that are the page's own text.

    Words and forms only vote. From the outside inwards, what is said against an element falls if it holds most of the page's
    own text, next to that of blocks that nothing is said against; unless those have what an article has and the element
    lacks (an element or a name for it, a first heading) and not just a few words.
    """
    said = [[(int(k), int(level)) for k, level in (x.split(":") for x in b[1].split(","))] if b[1] else [] for b in blocks]
    fallen: set[int] = set()
    final = lambda marks: max((level for k, level in marks if k not in fallen), default=CLEAR)
    held: dict[int, list[int]] = {}
    for i, marks in enumerate(said):
        if own[i] and marks and marks[-1][1] < HARD:
            for k, _ in marks:
                held.setdefault(k, []).append(i)
    free = [i for i, marks in enumerate(said) if own[i] and not marks]
    outer = sum(own[i] for i in free)

    def like(some: list[int]) -> int:
        return 2 * any(blocks[i][2] > 2 for i in some) + any(blocks[i][0].rsplit("/", 1)[-1].split(".")[0] == "h1" for i in some)

    for k in sorted(held):
        inner = sum(own[i] for i in held[k])
        # below an element that stays out, nothing else matters
        if inner > outer and fallen.issuperset(j for j, _ in said[held[k][0]] if j < k) and not (like(free) > like(held[k]) and 10 * outer >= inner):
            fallen.add(k)
            freed = [i for i in held[k] if not final(said[i])]
            free, outer = free + freed, outer + sum(own[i] for i in freed)
    return [final(marks) for marks in said]


def article(blocks: list[tuple[str, str, int, str, int]], template: set[int], shared: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The texts of the slots that hold the article.

    A page's own text is what is neither the template's nor in slots that are mostly links (all that is not, if there is none).
    Slots that something stands against (``heard``) never count. Of the others, the ones that most surely hold the
    article are taken (an article element, a container named so, the main element, or all), as long as they have a fifth of the
    own text; and the template judges each: texts that belong to it are left out, as are slots most of whose characters are links. Inside
    article elements a text of the template goes only if ``shared``, that is if unlike articles have it, and such texts are under half of the
    article (else it is a copy of others); a single link there can be a title or a source and stays.
    """
    size, linked, times = Counter(), Counter(), Counter()
    for path, _, _, text, links in blocks:
        size[path] += len(text)
        linked[path] += links
        times[path] += 1
    prose = [2 * linked[b[0]] <= size[b[0]] for b in blocks]
    known = [token(b[0], b[3]) in template for b in blocks]
    own = [len(b[3]) * (p and not t) for b, p, t in zip(blocks, prose, known)]
    if not any(own):
        own = [len(b[3]) * p for b, p in zip(blocks, prose)]
    left = [i for i, level in enumerate(heard(blocks, own) if any(b[1] for b in blocks) else [CLEAR] * len(blocks)) if not level]
    total = sum(own[i] for i in left)
    surest = next((m for m in (4, 3, 2, 1) if (of := [i for i in left if blocks[i][2] == m]) and 5 * sum(own[i] for i in of) >= total), 0)
    useful = [i for i in left if blocks[i][2] == surest or not surest]
    if surest == 4:
        texts = lambda some: sum(len(blocks[i][3]) for i in some)
        common = [i for i in useful if token(blocks[i][0], blocks[i][3]) in shared]
        kept = useful if 2 * texts(common) >= texts(useful) else [i for i in useful if i not in set(common)]
        return [blocks[i][3] for i in [i for i in kept if times[blocks[i][0]] == 1 or prose[i]] or kept]
    return [blocks[i][3] for i in useful if not known[i] and prose[i]]


BLOCK = (("path", pa.string()), ("said", pa.string()), ("main", pa.int32()), ("text", pa.string()), ("linked", pa.int32()))
TOKEN = (("token", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("is_text", pa.bool_()))


def listed(rows: list[list[tuple]], kinds: tuple[tuple[str, pa.DataType], ...]) -> pa.ListArray:
    """Rows of tuples as a list column of structs."""
    flat = list(zip(*(t for r in rows for t in r))) or [()] * len(kinds)
    fields = [pa.array(column, kind) for column, (_, kind) in zip(flat, kinds)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.StructArray.from_arrays(fields, [name for name, _ in kinds]))


def tuples(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The rows of such a column."""
    ends, flat = column.offsets.to_pylist(), column.values
    rows = list(zip(*(flat.field(k).to_pylist()[ends[0] : ends[-1]] for k in range(flat.type.num_fields))))
    for a, b in zip(ends, ends[1:]):
        yield rows[a - ends[0] : b - ends[0]]


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, host, html) read once: their blocks and tokens instead of html, and a hash of what clear article elements hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [Page(html.as_py() or "") for html in b.column(3)]
            content = [token("", "\n".join(x[3] for x in page.blocks if x[2] == 4 and f":{HARD}" not in x[1])) for page in read]
            columns = [pa.array(content, pa.int64()), listed([page.blocks for page in read], BLOCK), listed([tokens(page) for page in read], TOKEN)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["page_id", "url", "host", "content", "blocks", "tokens"])

    kinds = "content long, blocks array<struct<path:string,said:string,main:int,text:string,linked:int>>, tokens array<struct<token:bigint,n:bigint,path:string,is_text:boolean>>"
    return pages.select("page_id", "url", "host", "html").mapInArrow(run, f"page_id long, url string, host string, {kinds}")


def templates(pages: DataFrame, scratch: Scratch, least: int, share: float) -> DataFrame:
    """(host, template, shared) of parsed pages: the texts of each host's template, as tokens, and those of them on pages with unlike articles.

    A token's occurrence vector is its count on every page of the host; equal vectors have equal sums of page hashes, so one
    grouped sum finds the equivalence classes. Classes on ``least`` pages and a ``share`` of the host's can be valid: one with
    elements that every page has once is, and so is one whose paths all run on from paths of valid classes (it nests in
    them) and which has elements, or as many texts on each page. Texts in valid classes are the template's own words.
    """

    seen = pages.select("host", "page_id", "content", F.explode("tokens").alias("t")).select("host", "content", "t.*", F.xxhash64("page_id", "t.n").cast("decimal(20,0)").alias("page"))
    # a token has one path, which is a key so that the sums are hashed and not sorted
    per_token = seen.groupBy("host", "token", "is_text", "path").agg(F.count("*").alias("pages"), F.sum("n").alias("times"), F.sum("page").alias("vector"), (F.min("content") != F.max("content")).alias("unlike"))
    totals = pages.groupBy("host").agg(F.count("*").alias("all"))
    frequent = per_token.where(f"pages >= {least}").join(totals, "host").where(f"pages >= {share} * all")
    classes = frequent.groupBy("host", "vector", "pages", "times").agg(F.collect_list(F.struct("token", "path", "is_text", "unlike")).alias("members"), F.max(~F.col("is_text")).alias("framed"))

    def within(group: dict, frame: set[str]) -> bool:
        """Whether all paths of a class run on from paths of the frame."""
        return all(any(p[:i] in frame for i in range(len(p), 0, -1) if i == len(p) or p[i] == "/") for p in {m["path"] for m in group["members"]})

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, both = [], []
            for groups in b.column(1).to_pylist():
                frame: set[str] = set()
                valid: list[dict] = []
                found = True
                while found:  # until no more classes nest in valid ones
                    found, rest = [], []
                    for g in groups:
                        nested = within(g, frame)
                        fits = g["framed"] and (nested or g["times"] == g["pages"]) or nested and g["times"] % g["pages"] == 0
                        (found if fits else rest).append(g)
                    frame.update(m["path"] for g in found for m in g["members"])
                    valid, groups = valid + found, rest
                texts = [m for g in valid for m in g["members"] if m["is_text"]]
                chosen, shared = [m["token"] for m in texts], [m["token"] for m in texts if m["unlike"]]
                kept.append(sorted(chosen)), both.append(sorted(shared))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int64())), pa.array(both, pa.list_(pa.int64()))], ["host", "template", "shared"])

    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("pages", "times", "framed", "members")).alias("classes"))
    return scratch.cut(by_host.mapInArrow(nest, "host string, template array<long>, shared array<long>"))


def extract(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html): the article's text, its blocks joined by \\n.

    Templates are deduced per host over all its pages; a page is then read against its host's. A host needs ``least`` pages
    for that, as one or two pages show no vectors; with fewer its template is empty and marks and links decide. Character references are
    decoded, white space inside a block becomes one space. A null or empty html gives an empty text, as does a page
    without an article. A null or odd url belongs to the host ''. Repeated rows come back each. Broken markup is read as
    far as it goes. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    source = scratch.cut(parsed(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string"))))
    known = templates(source, scratch, least, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for blocks, template, shared in zip(tuples(b.column(2)), b.column(3), b.column(4)):
                own, both = (set(np.asarray(x.values)) if x.is_valid else set() for x in (template, shared))
                texts.append("\n".join(article(blocks, own, both)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = source.join(known, "host", "left").select("page_id", "url", "blocks", "template", "shared")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
