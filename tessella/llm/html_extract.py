"""Main-text extraction with consensus host paths.

Pass 1 parses every page once and scores its containers: text of a container's
own blocks outside links, less its link text. Paths are generalised (tag and
class names, digits cut off), so pages of one template share them. Each page
votes for its containers' paths with their scores, damped by a square root so
that no long page outvotes a host. Votes are summed by host and path in Spark,
and a host's ``RANKED`` best supported paths are kept in order, less those that
only wrap a better one. Pass 2
re-extracts each page from the containers on the first of these paths that
carries a fair part of the page's own best score, so a host may have several
templates; a page with no such path keeps its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles never enter a container's text. Some are told by their tag or role.
Class and id words only raise a suspicion: an element that holds the main
element, the title of an article, or half of the page's text outside links is a
layout's wrapper and stays (adverts and comments only with an article or main
element in them), and words of state (``with-sidebar``) or topic
(``legal-news``) raise none.

Scale: pages are parsed once, in time and space linear in their length; their
blocks and candidate containers are written to the shared folder, so both
passes read the result of one parse. Votes are summed before the shuffle, one
row for each host, path and task. The ranking, a row for each host, is a table
of known size: Spark broadcasts it up to its threshold, and beyond joins by
sorting, where AQE splits a hot host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import in_slices
from tessella.runtime import materialise, ship

#: Paths that a host keeps, and the part of a page's best score that makes one of them fit the page.
RANKED, FAIR = 8, 0.25
#: A suspected element that holds this part of the page's text outside links is no noise.
MOSTLY = 0.5

# HTML element names by role, and class or id words of what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe svg math object xmp noembed noframes".split())
SKIPPED = frozenset("nav footer aside button select menu dialog fieldset label option datalist audio video canvas map".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption hgroup search".split()
)
CONTAINER = frozenset("article main section div td body center details form".split())
#: Adverts and comments; the frame of a page; words that may be a page's topic as well.
STRICT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments disqus replies respond outbrain taboola".split())
FRAME = frozenset(
    "sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations toolbar pagination pager".split()
)
TOPICAL = frozenset("banner notice notices overlay skip copyright legal disclaimer alert form search".split())
#: With these, a class name speaks of a state, not of the element; with those, of content.
STATE = frozenset("has no with without is not open opened closed enabled disabled collapsed expanded".split())
CONTENT = frozenset("article articles post posts entry story stories news content text body blog".split())
#: The words that make an article element noise: comments and teasers come as articles.
NOISE_ARTICLE = STRICT | {"related", "recommended"}
#: Elements whose start ends an open element of the same group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where implied ends stop looking.
SCOPE = frozenset("table ul ol dl div section article main body td th blockquote form header".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Longer paths and steps are named by a hash, so that nested pages stay linear.
_LONGEST = 300


def _short(name: str) -> str:
    return name if len(name) <= _LONGEST else "~" + hashlib.md5(name.encode("utf-8", "replace")).hexdigest()[:16]


def suspicion(names: list[str], article: bool) -> str:
    """Whether "strict", "loose" or nothing, by the words of class names and ids."""
    worst, loose = "", False
    words = [{w.lower() for w in _WORDS.findall(x)} for x in names]
    content = any(not CONTENT.isdisjoint(w) for w in words)
    for w in words:
        if not STATE.isdisjoint(w):
            continue
        if article:
            worst = worst or ("strict" if not NOISE_ARTICLE.isdisjoint(w) else "")
        elif not STRICT.isdisjoint(w):
            worst = "strict"
        elif not FRAME.isdisjoint(w) or not content and not TOPICAL.isdisjoint(w):
            loose = True
    return worst or ("loose" if loose else "")


def _attributes(raw: str, article: bool) -> tuple[str, str, bool]:
    """The generalised class part of a path step, the suspicion, and whether the element is hidden or noise by its role."""
    classes, names, gone = "", [], False
    for name, *values in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name not in ("class", "id", "role", "style", "hidden", "aria-hidden"):
            continue
        value = html.unescape("".join(values))
        if name in ("class", "id"):
            names += value.split()
            if name == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "", x) for x in value.lower().split()} - {""}))
        elif name == "role":
            gone = gone or value.lower() in _ROLES
        else:
            gone = gone or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(_HIDDEN.search(value))
    return classes, suspicion(names, article), gone


class Container:
    """An element that may hold the main text: the stretch of the page's blocks in it, and their characters out of and in links."""

    __slots__ = ("end", "linked", "path", "plain", "start")

    def __init__(self, path: str, start: int):
        self.path, self.start, self.end, self.plain, self.linked = path, start, start, 0, 0


class Suspect:
    """An element that may be noise: its blocks, what it holds, and what was dropped in it."""

    __slots__ = ("article", "end", "heading", "main", "minus", "start", "strict", "titled", "within")

    def __init__(self, start: int, strict: bool, titled: bool, within: Suspect | None):
        self.start, self.end, self.strict, self.titled, self.within = start, start, strict, titled, within
        self.main = self.article = self.heading = False
        self.minus = 0


class Scanner:
    """Tags of a page in one pass; what is never closed is looked for once."""

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def find(self, what: str, at: int) -> int:
        """The next place, or the page's end if there is none from here on."""
        if what in self.absent:
            return len(self.page)
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
            return len(self.page)
        return found

    def tag_end(self, at: int) -> int:
        """Where the ">" of a tag is; those within quoted values don't count, and a quote that is never closed is none."""
        stop = self.find(">", at)
        while True:
            m = _QUOTE.search(self.page, at, stop)
            if not m:
                return stop
            at = m.end()
            close = self.find(m[1], at)
            if close < len(self.page):
                at = close + 1
                if close > stop:
                    stop = self.find(">", at)


def parse(page: str) -> tuple[list[str], list[Container]]:
    """The blocks of a page in page order, noise left out, and the containers that hold some."""
    blocks: list[str] = []
    sizes: list[tuple[int, int]] = []
    root = Container("", 0)
    found, suspects = [root], []
    scan, end = Scanner(page), len(page)
    # An open element: name, path, whether in a link, whether skipped, its container, its suspect.
    stack: list[tuple] = [("", "", False, False, root, None)]
    #: The places in the stack of open elements by name, and of those that are scopes.
    open_at: dict[str, list[int]] = defaultdict(list)
    scopes = [0]
    suspect: Suspect | None = None
    buffer: list[str] = []
    size = [0, 0]

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append(text)
                sizes.append((size[0], size[1]))
        size[0] = size[1] = 0

    def pop() -> None:
        nonlocal suspect
        name, _, _, _, own, mine = stack.pop()
        open_at[name].pop()
        if name in SCOPE:
            scopes.pop()
        if name in BLOCK:
            flush()
        if own:
            own.end = len(blocks)
        if mine:
            flush()
            mine.end, suspect = len(blocks), mine.within
            suspects.append(mine)
            if suspect:
                suspect.main |= mine.main
                suspect.article |= mine.article
                suspect.heading |= mine.heading

    def last(names: tuple[str, ...]) -> int:
        return max((open_at[n][-1] for n in names if open_at[n]), default=-1)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            pop()

    at = 0
    while at < end:
        stop = scan.find("<", at)
        if stop > at:
            text = page[at:stop]
            if not stack[-1][3]:
                buffer.append(text)
                size[stack[-1][2]] += len(text.strip())
        if stop == end:
            break
        after = page[stop + 1 : stop + 2]
        if after == "!" or after == "?":
            at = scan.find("-->", stop + 4) + 3 if page.startswith("<!--", stop) else scan.find(">", stop) + 1
            continue
        closing = after == "/"
        m = _NAME.match(page, stop + 1 + closing)
        if not m:
            if closing:
                at = scan.find(">", stop) + 1
            else:
                if not stack[-1][3]:
                    buffer.append("<")
                    size[stack[-1][2]] += 1
                at = stop + 1
            continue
        name = m[0].lower()
        if closing:
            at = scan.find(">", m.end()) + 1
            depth = last((name,))
            if depth > 0 and (name in SCOPE or name == "a" or depth > scopes[-1]):
                pop_to(depth)
            elif name in BLOCK:
                flush()
            continue
        stop = scan.tag_end(m.end())
        raw, at = page[m.end() : stop], stop + 1
        if name in BLOCK:
            depth = last(("p",))
            if depth > scopes[-1] and name != "hr":
                pop_to(depth)
            flush()
        if name in CLOSES:
            depth = last(CLOSES[name])
            if depth > 0 and depth >= scopes[-1]:
                pop_to(depth)
        if name == "br" and buffer:
            buffer.append(" ")
        if name in VOID or raw.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = scan.find(">", close.end()) + 1 if close else end
            continue
        _, path, link, skipped, _, _ = stack[-1]
        classes, doubt, gone = _attributes(raw, name == "article") if raw else ("", "", False)
        step = _short(f"{name}.{classes}" if classes else name)
        path = _short(f"{path}>{step}")
        own = mine = None
        if name in ("html", "body", "main"):
            doubt, gone = "", False
        within = bool(open_at["article"] or open_at["main"])
        if name == "form" or name == "header" and within:
            doubt = doubt or "loose"
        skipped = skipped or gone or name in SKIPPED or name == "header" and not within
        if not skipped:
            if suspect and not doubt:
                suspect.main |= name == "main"
                suspect.article |= name == "article"
                suspect.heading |= name == "h1"
            if doubt:
                flush()
                words = {w.lower() for w in _WORDS.findall(raw)}
                mine = suspect = Suspect(len(blocks), doubt == "strict", within or not CONTENT.isdisjoint(words), suspect)
            if name in CONTAINER:
                flush()
                own = Container(path, len(blocks))
                found.append(own)
        open_at[name].append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append((name, path, link or name == "a", skipped, own, mine))
    pop_to(1)
    flush()
    root.end = len(blocks)
    return _without(blocks, sizes, suspects, found)


def _without(blocks: list[str], sizes: list[tuple[int, int]], suspects: list[Suspect], found: list[Container]) -> tuple[list[str], list[Container]]:
    """Blocks and containers less the suspects that are noise, inner ones first (they come in that order)."""
    edge = [0] * (len(blocks) + 1)

    def drop(s: Suspect) -> None:
        edge[s.start] += 1
        edge[s.end] -= 1

    def sums(values) -> list[int]:
        return list(accumulate(values, initial=0))

    plain = sums(p for p, _ in sizes)
    for s in suspects:
        if s.strict and not s.main and not (s.article and 2 * (plain[s.end] - plain[s.start]) >= plain[-1]):
            drop(s)
    rest = sums(0 if e else p for (p, _), e in zip(sizes, accumulate(edge), strict=False))
    for s in suspects:
        gross = rest[s.end] - rest[s.start]
        if not s.strict and not (s.main or s.titled and s.heading or gross > s.minus and gross - s.minus >= MOSTLY * rest[-1]):
            drop(s)
            s.minus = gross
        if s.within:
            s.within.minus += s.minus
    kept = [not e for e in accumulate(edge)][: len(blocks)]
    place = sums(kept)
    plain, linked = sums(p if k else 0 for (p, _), k in zip(sizes, kept, strict=True)), sums(q if k else 0 for (_, q), k in zip(sizes, kept, strict=True))
    for c in found:
        c.plain, c.linked = plain[c.end] - plain[c.start], linked[c.end] - linked[c.start]
        c.start, c.end = place[c.start], place[c.end]
    return [b for b, k in zip(blocks, kept, strict=True) if k], [c for c in found if c.end > c.start]


def score(c: Container) -> float:
    """Plain characters less thrice the linked ones; semantic containers of the article count for more, the outermost for less."""
    base = c.plain - 3.0 * c.linked
    last = c.path.rpartition(">")[2].partition(".")[0]
    return max(base, 0.0) * (1.6 if last in ("article", "main") else 0.5 if last in ("", "body") else 1.0)


def stretches(containers: list[Container]) -> list[list[int]]:
    """The blocks of containers of one path as stretches that don't overlap, in page order."""
    out: list[list[int]] = []
    for lo, hi in sorted((c.start, c.end) for c in containers):
        if out and lo < out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


_PARSED = [
    T.StructField("_votes", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())]))),
    T.StructField("_fitting", T.ArrayType(T.StringType())),
    T.StructField("_stretches", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))),
    T.StructField("_blocks", T.ArrayType(T.StringType())),
]


def ballot(boxes: list[Container]) -> tuple[list[dict], list[str], list[list[list[int]]]]:
    """A page's votes by path, and the paths that fit the page with their stretches, the best first (ties to the path that sorts first)."""
    by_path: dict[str, list[Container]] = defaultdict(list)
    for c in boxes:
        by_path[c.path].append(c)
    scores = {p: sum(map(score, x)) for p, x in by_path.items()}
    order = sorted(by_path, key=lambda p: (-scores[p], p))
    fitting = [p for p in order if scores[p] and scores[p] >= FAIR * scores[order[0]]] or order[:1]
    return [{"path": p, "score": scores[p]} for p in order if scores[p]], fitting, [stretches(by_path[p]) for p in fitting]


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: id, url, ``text`` (blocks joined by newlines), ``n_chars`` and the container's ``path``.

    Edge cases: null or empty html gives an empty text; a page without any
    container keeps its loose text; ids keep their type and value, null ids and
    urls too; pages without a host vote together under the empty host; equal
    votes go to the path that sorts first; rows that repeat vote each; no rows
    give no rows. A comment that is never closed runs to the end of the page, a
    tag without its ">" is left out with what follows, a quote that is never
    closed counts as none. Pages of any length and depth are read whole: time
    and space are linear in the length, and paths of over 300 characters are
    named by a hash. Further input columns are ignored.
    """
    ship(pages.sparkSession)
    base = pages.select(pages[id_col].alias("_id"), pages[html_col].cast("string").cast("binary").alias("_text"), pages[url_col].cast("string").alias("_url"))
    out = T.StructType([T.StructField("_id", base.schema["_id"].dataType), T.StructField("_url", T.StringType()), *_PARSED])
    arrow = to_arrow_schema(out)

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 4 << 20, 1024):
                got: list[list] = [[] for _ in _PARSED]
                for cell in batch.column(1):
                    blocks, boxes = parse((cell.as_py() or b"").decode("utf-8", "replace"))
                    for column, value in zip(got, (*ballot(boxes), blocks), strict=True):
                        column.append(value)
                new = [pa.array(x, arrow.field(f.name).type) for x, f in zip(got, _PARSED, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *new], schema=arrow)

    parsed = materialise(base.mapInArrow(containers, out)).withColumn("_host", host_of(F.col("_url")))
    ballots = parsed.select("_host", F.explode("_votes").alias("c"))
    votes = ballots.groupBy("_host", F.col("c.path").alias("_path")).agg(F.sum(F.floor(F.sqrt("c.score") * 1000).cast("long")).alias("_votes"))
    order = Window.partitionBy("_host").orderBy(F.desc("_votes"), "_path")
    best_of = votes.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= RANKED)
    # A table of its own, so that its size is known: below Spark's broadcast threshold the pages aren't shuffled at all.
    listed = best_of.groupBy(F.col("_host").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_rank", "_path"))).getField("_path").alias("_all"))
    # What merely wraps a better supported path is no template of its own.
    wraps = lambda p, i: F.exists(F.slice("_all", 1, i), lambda q: q.startswith(F.concat(p, F.lit(">"))))
    ranking = materialise(listed.select("_of", F.filter("_all", lambda p, i: (i == 0) | ~wraps(p, i)).alias("_ranked")))
    joined = parsed.join(ranking, parsed["_host"] == ranking["_of"], "left")
    # The first path of the host's ranking that fits the page, else the page's own best.
    winner = F.get(F.array_intersect("_ranked", "_fitting"), F.lit(0))
    place = F.coalesce(F.array_position("_fitting", winner), F.lit(1)) - 1
    picked = joined.withColumn("_place", place.cast("int"))
    parts = F.transform(F.get("_stretches", F.col("_place")), lambda x: F.slice("_blocks", x[0] + 1, x[1] - x[0]))
    text = F.coalesce(F.array_join(F.flatten(parts), "\n"), F.lit(""))
    return picked.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.get("_fitting", F.col("_place")).alias("path"))
