"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text that stands in them outside boilerplate and links. Its best container is the
one with the best score, or the outermost around it that adds text other than links. The page votes for the
generalised paths (tags and classes, digits left out) of its best ones. Votes are counted for each host in
Spark, and pages are extracted again from the containers at one of their host's winning paths; a page that has hardly any text
there falls back on its own best container, and one without containers on its body.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How HTML sorts its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("nav footer aside form script style noscript template svg math canvas iframe object embed audio video map button select option label input textarea dialog menu head title header applet frameset noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body".split())
#: A new block of the second kind ends an open element of the first.
ENDS = {
    "p": BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
}
#: Start tags that leave an open head open; any other one ends it, as text does.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Words that mark what is not article, as the head (last word) of a class, id or role; of readers' words first.
READERS = frozenset("comment comments respond replies disqus discussion".split())
BOILERPLATE = READERS | frozenset("""
ad ads advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb
breadcrumbs header masthead topbar footer foot colophon sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended recommendations
pagination pager toolbar search searchform copyright legal disclaimer complementary contentinfo skip tags
""".split())
#: First words of names that say how something is laid out or what state it is in, and from where on a name does.
STATES = frozenset("has have with without no not is are show shows hide hides js".split())
#: Heads that only hold what the words before them name.
HOLDERS = frozenset("area articles bar block body box btn button buttons card cell col column container content feed form group holder icon icons inner item items label labels layer link links list lists outer panel posts row section slot stories text thread title unit wrap wrapper".split())
#: What has a head of its own: a header of these belongs to the article.
HEADED = frozenset("article card chapter content entry figure post question recipe section story table".split())

#: Winning paths kept for each host, and what a page votes with.
MOST_PATHS, ONE_VOTE = 16, 1000
#: A page follows its host's first path with this share of what it has at any of them, and none below the second share of its own best container.
HALF, LEAST_SHARE = 0.5, 1 / 32

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_USED = frozenset("class id role hidden style aria-hidden".split())
_NONE = re.compile(r"display\s*:\s*none")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile("[ \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PROSE = re.compile(r"\b(?:article|post|entry|story)\b")
#: A path longer than this is named by a digest, so that deep pages stay small.
LONGEST_PATH = 256
#: When by their classes alone elements would drop so many times the text that stays, the classes are not believed.
DISBELIEF = 8


class Block:
    """Text between two block boundaries, and the innermost container that it stands in."""

    __slots__ = ("parts", "at", "links")

    def __init__(self, at: int):
        self.parts, self.at, self.links = [], at, 0


class Page:
    """A page's containers, numbered in page order (0 is the body), and its blocks outside boilerplate."""

    def __init__(self):
        self.paths, self.parents, self.depths, self.bonus = ["body"], [-1], [0], [1.0]
        self.blocks: list[Block] = []

    def add(self, parent: int, step: str) -> int:
        path = f"{self.paths[parent]}>{step}"
        self.paths.append(path if len(path) <= LONGEST_PATH else "~" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.bonus.append(1.5 if step.split(".", 1)[0] in ("article", "main") or _PROSE.search(step) else 1.0)
        return len(self.paths) - 1


class Tags:
    """Where tags end. A quoted attribute value may hold a >; once quotes let a tag run to the page's end, they mean nothing any more, so no character is passed over twice."""

    def __init__(self, html: str):
        self.html, self.loose = html, False
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """The place after the tag whose name ends at `at`, or -1 where nothing closes it."""
        html, here = self.html, at
        if self.last[">"] < at:
            return -1
        while not self.loose and (m := _MARK.search(html, here)):
            here, c = m.end(), m[0]
            if c == ">":
                return here
            k = m.start() - 1
            while html[k].isspace():
                k -= 1
            if html[k] == "=" and self.last[c] > m.start():
                here = html.index(c, here) + 1
        self.loose = True
        return html.index(">", at) + 1


def attributes(raw: str) -> dict[str, str]:
    found = {n.lower(): v for n, v in _ATTRIBUTE.findall(raw)} if raw.strip() else {}
    return {n: entities.unescape(v.strip("\"'")) for n, v in found.items() if n in _USED}


@lru_cache(maxsize=4096)
def marked(name: str) -> str:
    """The boilerplate word that a class, id or role names, or none.

    That is its head: `site-header` and `comment-list` name one, as lists only hold what stands before them; `has-sidebar`, `notice-period`
    and `post-header` do not.
    """
    words = [w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if len(w) > 1]
    words = words[: next((k for k, w in enumerate(words) if w in STATES), len(words))]
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    if not words or words[-1] not in BOILERPLATE or len(words) > 1 and words[-1] in ("header", "masthead") and words[-2] in HEADED:
        return ""
    return words[-1]


KEPT, BY_TAG, BY_CLASS, BY_READERS = range(4)


def judged(tag: str, named: dict[str, str], believed: bool) -> int:
    """Why an element is dropped, or that it is kept."""
    if tag in DROPPED or "hidden" in named or named.get("aria-hidden") == "true" or "style" in named and _NONE.search(named["style"]):
        return BY_TAG
    if tag in ("html", "body", "main", "article"):
        return KEPT
    words = {marked(n) for k in ("class", "id", "role") if k in named for n in named[k].split()} - {""}
    return BY_READERS if words & READERS else BY_CLASS if words and believed else KEPT


def general(tag: str, named: dict[str, str]) -> str:
    """A container's step in a path: its tag and classes in order, without digits."""
    return ".".join([tag, *sorted({_DIGITS.sub("", c) for c in named.get("class", "").lower().split()} - {""})])


def parse(html: str) -> Page:
    """The containers and blocks of a page. Where classes would drop nearly all its text, only those of readers' words count."""
    page, kept, lost = _parse(html, True)
    return page if lost <= DISBELIEF * kept else _parse(html, False)[0]


def _parse(html: str, believed: bool) -> tuple[Page, int, int]:
    """A page, and how much text outside links stays and is dropped by classes alone.

    Tolerant: unknown end tags are ignored, end tags close what is open within, and blocks end paragraphs, items and
    cells left open. Raw elements reach to their end tags, whatever stands in them; a head ends at its end tag or at what
    cannot stand in it. A page without a body has one container, `body`, that holds everything. Time and memory
    grow with the page's length only, however deep or broken it is.
    """
    page, tags = Page(), Tags(html)
    open_: list[tuple[str, int, int]] = []  # tag, why dropped, container's number or -1
    inside = [0]  # containers that are open
    around: list[int] = []  # places in open_ of the blocks that are open
    held: dict[str, int] = {}  # how many blocks of each tag are open
    frames: list[dict[str, int]] = [{}]  # how many inline elements of each tag are open within each open block
    drops = [0, 0, 0, 0]
    links = at = kept = lost = articles = 0
    block: Block | None = None

    def text(piece: str) -> None:
        nonlocal block, kept, lost
        if not piece:
            return
        if drops[1] and open_[-1][0] == "head" and piece.strip():
            close(len(open_) - 1)
        if drops[1] or drops[3]:
            return
        if drops[2]:
            lost += 0 if links else len(piece.strip())
            return
        if block is None:
            if not piece.strip():
                return
            block = Block(inside[-1])
            page.blocks.append(block)
        block.parts.append(piece)
        if links:
            block.links += len(piece)
        else:
            kept += len(piece.strip())

    def close(n: int) -> None:
        nonlocal links, block, articles
        while len(open_) > n:
            tag, why, container = open_.pop()
            drops[why] -= 1
            links -= tag == "a"
            articles -= tag in ("article", "main")
            if container >= 0:
                inside.pop()
            if tag in BLOCKS:
                around.pop()
                frames.pop()
                held[tag] -= 1
                block = None
            else:
                frames[-1][tag] -= 1

    find, size = html.find, len(html)
    while (start := find("<", at)) >= 0:
        if start > at:
            text(html[at:start])
        at = start + 1
        m = _NAME.match(html, start)
        if m is None:
            mark = html[at : at + 1]
            if mark in ("!", "?"):
                for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if html.startswith(opening, start):
                        end = find(ending, start + len(opening))
                        at = size if end < 0 else end + len(ending)
                        break
            elif mark == "/":
                end = find(">", at)
                at = size if end < 0 else end + 1
            else:
                text("<")
            continue
        if (end := tags.end(m.end())) < 0:
            text("<")
            continue
        at, tag, raw = end, m[2].lower(), html[m.end() : end - 1]
        if m[1]:
            if tag in BLOCKS:
                if held.get(tag):
                    close(next(n for n in reversed(around) if open_[n][0] == tag))
                block = None
            elif frames[-1].get(tag):
                close(next(n for n in range(len(open_) - 1, -1, -1) if open_[n][0] == tag))
            continue
        if open_ and open_[-1][0] == "head" and tag not in IN_HEAD:
            close(len(open_) - 1)
        if tag in BLOCKS:
            block = None
            for n in reversed(around):
                outer = open_[n][0]
                if tag in ENDS.get(outer, ()):
                    close(n)
                    break
                if outer not in ("li", "dt", "dd"):
                    break
        elif tag == "br":
            text(" ")
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            continue
        named = attributes(raw) if raw else {}
        if tag == "main" and drops[2] and not drops[1] and not drops[3]:
            # What holds the main part is no boilerplate, whatever its class says.
            open_[:] = [(t, KEPT if why == BY_CLASS else why, c) for t, why, c in open_]
            drops[0], drops[2] = drops[0] + drops[2], 0
        # A header within an article holds its headline.
        why = KEPT if tag == "header" and articles else judged(tag, named, believed)
        container = -1
        if tag in CONTAINERS and tag != "body" and why == KEPT and not (drops[1] or drops[2] or drops[3]):
            container = page.add(inside[-1], general(tag, named))
            inside.append(container)
        if tag in BLOCKS:
            around.append(len(open_))
            frames.append({})
            held[tag] = held.get(tag, 0) + 1
        else:
            frames[-1][tag] = frames[-1].get(tag, 0) + 1
        open_.append((tag, why, container))
        drops[why] += 1
        links += tag == "a"
        articles += tag in ("article", "main")
        if tag in RAW:
            ended = _RAW_END[tag].search(html, at)
            if ended is None:
                return page, kept, lost
            at = ended.start()
    text(html[at:])
    return page, kept, lost


def content(block: Block) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(block.parts))).strip(" ")


def weighed(page: Page) -> tuple[list[float], list[int]]:
    """Text outside links, and text at all, that stands in each container."""
    held, whole = [0.0] * len(page.paths), [0] * len(page.paths)
    for b in page.blocks:
        n = sum(map(len, b.parts))
        held[b.at] += max(0.0, n - 2.0 * b.links)
        whole[b.at] += n
    for c in range(len(held) - 1, 0, -1):
        held[page.parents[c]] += held[c]
        whole[page.parents[c]] += whole[c]
    return held, whole


def score(page: Page, held: list[float]) -> dict[int, float]:
    """What each container holds, deeper ones preferred to those that hold little more."""
    return {c: v * page.bonus[c] * (1 + 0.02 * page.depths[c]) for c, v in enumerate(held) if v}


def best_container(page: Page, found: dict[int, float], held: list[float], whole: list[int]) -> int:
    """The best container, or the outermost one around it that adds text which is not mostly links."""
    best = outer = max(found, key=lambda c: (found[c], -c), default=0)
    while (outer := page.parents[outer]) >= 0:
        if held[outer] - held[best] > 0.5 * (whole[outer] - whole[best]):
            best = outer
    return best


def votes(html: str | None, most: int = 2) -> list[tuple[str, float]]:
    """The paths a page votes for, that of its best container first, each with its share of the page's best score."""
    page = parse(html or "")
    held, whole = weighed(page)
    found = score(page, held)
    if not found:
        return []
    best: dict[str, float] = {}
    for c, v in found.items():
        best[page.paths[c]] = best.get(page.paths[c], 0.0) + v
    top = max(best.values())
    own = page.paths[best_container(page, found, held, whole)]
    others = [(p, v / top) for p, v in sorted(best.items(), key=lambda x: (-x[1], x[0])) if p != own and v >= 0.5 * top]
    return [(own, 1.0), *others[: most - 1]]


def extract(html: str | None, paths: list[str] | None) -> str:
    """Blocks of the containers at one of the host's `paths`, most votes first.

    That is the first path where the page has HALF of what it has at any of them. A page that has hardly anything (LEAST_SHARE of what
    its own best container holds) at them is extracted from its own best container.
    """
    page = parse(html or "")
    held, whole = weighed(page)
    own = best_container(page, score(page, held), held, whole)
    at: dict[str, float] = {}
    for c, v in enumerate(held):
        if whole[c]:
            at[page.paths[c]] = at.get(page.paths[c], 0.0) + v
    there = [p for p in paths or () if p in at]
    most = max((at[p] for p in there), default=-1.0)
    chosen = next(p for p in there if at[p] >= HALF * most) if most >= LEAST_SHARE * held[own] else page.paths[own]
    taken: list[bool] = []
    for c, p in enumerate(page.paths):
        taken.append(p == chosen or c > 0 and taken[page.parents[c]])
    texts = [content(b) for b in page.blocks if taken[b.at]]
    return "\n".join(t for t in texts if t)


def host(url):
    """The host of a url, empty where there is none; one longer than names may be is named by its digest."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.when(F.length(found) <= 253, found).otherwise(F.md5(found))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and paths: for each host the paths with most votes, ties to the smaller path. But for the first, a path needs more than one page's vote."""

    def run(batches):
        for b in batches:
            hosts, paths, shares = [], [], []
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for p, v in votes(page.as_py()):
                    hosts.append(h)
                    paths.append(p)
                    shares.append(round(v * ONE_VOTE))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())], ["host", "path", "votes"])

    counted = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path")))
    ranked = ranked.where((F.col("rank") <= MOST_PATHS) & ((F.col("rank") == 1) | (F.col("votes") > ONE_VOTE)))
    return ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("best")).select("host", F.col("best")["path"].alias("paths"))


#: Winning paths are sent to every task while they are at most so many bytes. Beyond that, those of hosts with 1/HOT of the pages are, and others are joined.
MOST_SENT, HOT = 64 << 20, 4096


def extract_pages(spark: SparkSession, pages: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Main text of every page; returns page_id, url, text, n_chars.

    Null and empty html give an empty text. Pages with a null or unreadable url share the empty host. Repeated rows give
    equal results and vote as often as they occur; an empty table gives no rows. Other columns are ignored. Pages are
    read whole, once to vote and once to be extracted: the blocks of the first pass, written, would be as large as
    the table.
    """
    from treeledger.llm.common import materialize

    best = materialize(spark, winning_paths(pages), "paths")
    size = best.agg(F.sum(F.length("host") + F.length(F.array_join("paths", " ")))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    if size <= most_sent:
        found = rows.join(F.broadcast(best), "host", "left")
    else:
        all_ = rows.count()
        hot = rows.groupBy("host").count().where(F.col("count") * HOT >= all_).select("host")
        # At most HOT hosts of 253 characters and MOST_PATHS paths of LONGEST_PATH; no other host has many pages.
        hot = F.broadcast(materialize(spark, best.join(hot, "host", "right"), "hot-paths"))
        found = rows.join(hot, "host").unionByName(rows.join(hot, "host", "left_anti").join(best, "host", "left"))

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py(), p.as_py()) for h, p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return found.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
