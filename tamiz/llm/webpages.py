"""Main text of web pages: what is left of a page without its site's template.

Every element subtree outside a page's prose is hashed. Spark counts on how
many pages of a host each hash occurs; subtrees that recur are template and
deleted. Elements whose tag or class says what they are (menus, footers,
adverts, forms, comments, ...) go as well, for sites with few pages. Copies of
a page are one page here: what recurs only in copies is text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.session import materialize

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "body", "button", "caption", "head", "html", "legend", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li td th caption figcaption".split())
# An open element that a new one ends, and the elements it is not looked for beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

# What is no main text by its tag, its role, or a word of its class or id.
NOT_TEXT_TAGS = set("head title script style noscript template nav header footer aside form button select textarea iframe svg math canvas object audio video dialog menu search".split())
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
EVERYWHERE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus replies "
    "cookie cookies consent gdpr notice notices newsletter subscribe popup modal overlay sidebar share sharing "
    "social breadcrumb breadcrumbs pagination pager".split()
)
# What articles that are not the page's own are called, or stand in, and what
# else such a name may consist of.
BESIDE = set("comment comments disqus reply replies related recommended recommendations teaser teasers sidebar".split())
PARTS = set(
    "list area section thread box bar button buttons banner slot unit container wrapper wrap widget block links icons "
    "item items panel inner content articles posts stories media bookmark prompt form signup dialog message policy top bottom".split()
)
OUTSIDE = EVERYWHERE | set("nav navbar navigation menu header footer masthead banner toolbar widget related login search".split())
# Words beside these in the names of parts outside the content.
PLACES = set("site main page global left right primary secondary mobile desktop sticky inner outer row col column root menu nav header footer top".split())
# Those that may as well stand around a whole page, and the length that its text has then.
WEAK = OUTSIDE - EVERYWHERE | set("sidebar overlay notice notices".split())
PAGE_TEXT = 200
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>"""
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NUMBER = re.compile(r"(\d+(x\d+)?)?")
_BREAK = None
#: Different pages that always make a subtree template, however large the host.
ENOUGH_PAGES = 50
#: Subtrees that a task remembers at a time while it counts.
REMEMBERED = 200_000


class Page:
    """A parsed page: ``events`` are texts and block breaks in page order, and
    each element covers a range of them. ``loose`` are the places of texts
    outside links and ``loose_until`` their length up to there."""

    __slots__ = ("events", "nodes", "loose", "loose_until")

    def __init__(self, html: str):
        self.events: list[str | None] = []
        # (tag, first event, event after the last, hash, role, words of class and
        # id, holds text outside links, holds an article, classes and ids, those of
        # them that may tell what it is inside the content)
        self.nodes: list[tuple] = []
        self.loose: list[int] = []
        self.loose_until = [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        events = self.events
        # Open elements: tag, first event, attributes, digest, holds text,
        # text outside links, holds an article.
        stack: list[list] = [["#", 0, "", hashlib.blake2b(digest_size=8), False, False, False]]

        def text(raw: str) -> None:
            plain = unescape(raw)
            if not plain:
                return
            events.append(plain)
            words = " ".join(plain.split())
            if words:
                top = stack[-1]
                top[3].update(b"t" + words.encode("utf-8", "surrogatepass"))
                top[4] = True
                if not any(e[0] == "a" for e in stack[-4:]):
                    top[5] = True
                    self.loose.append(len(events) - 1)
                    self.loose_until.append(self.loose_until[-1] + len(words))

        def close() -> None:
            tag, first, attributes, digest, holds, loose, article = stack.pop()
            up = stack[-1]
            if tag in BLOCKS:
                events.append(_BREAK)
            own = digest.digest()
            up[3].update(b"e" + own)
            up[4] |= holds
            up[5] |= loose
            up[6] |= article or tag in ("article", "main")
            if holds:
                words, whole, hints = set(), set(), set()
                role = ""
                for name, value in _ATTRIBUTE.findall(attributes):
                    value = value.strip("\"'").lower()
                    if name.lower() == "role":
                        role = value
                    else:
                        words.update(re.split(r"[\s_-]+", value))
                        whole.update(value.split())
                        # Ids of headings, paragraphs and sections are made from titles.
                        if name.lower() == "class" or tag not in PROSE and not (tag == "section" and loose):
                            hints.update(value.split())
                self.nodes.append((tag, first, len(events), int.from_bytes(own, "little", signed=True), role, words, loose, article, whole, hints))

        def end(tags: set[str], stop: set[str]) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    while len(stack) > i:
                        close()
                    return
                if stack[i][0] in stop:
                    return

        at = 0
        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            closing = m[1]
            if closing:
                closing = closing.lower()
                end({closing}, set())
                if closing in BLOCKS:
                    events.append(_BREAK)
                continue
            tag = m[2] or m[4]
            if not tag:
                continue
            tag, attributes = tag.lower(), m[3] or m[5] or ""
            if tag in CLOSES_P:
                end({"p"}, {"td", "th", "button", "article", "section", "div"} - {tag} if tag != "p" else set())
            if tag in ENDS:
                end(*ENDS[tag])
            if tag in BLOCKS:
                events.append(_BREAK)
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                stack[-1][3].update(b"v" + tag.encode())
                continue
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                at = stop.start() if stop else len(html)
                # What it holds is no text; its end tag is read next.
            digest = hashlib.blake2b(tag.encode(), digest_size=8)
            stack.append([tag, len(events), attributes, digest, False, False, False])
        if at < len(html):
            text(html[at:])
        while len(stack) > 1:
            close()

    def digest(self) -> int:
        """One number for the text of the whole page."""
        words = " ".join("".join(" " if e is _BREAK else e for e in self.events).split())
        return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def content(self) -> list[tuple[int, int]]:
        """Ranges of the page's own content: its articles, without those that
        are comments or teasers by their own or an enclosing element, else its
        main part. A main part with paragraphs of its own outside the articles
        is content as a whole. No range: all of the page."""
        beside = self.beside()
        apart = _Ranges(beside)
        articles = [n for n in self.nodes if n[0] == "article" and not apart.around(n[1], n[2])]
        main = [n for n in self.nodes if n[0] == "main" or n[4] == "main"]
        covered = _Ranges([(n[1], n[2]) for n in articles] + beside)
        own = _Ranges([(n[1], n[2]) for n in self.nodes if n[0] == "p" and n[6] and not covered.around(n[1], n[2])])
        whole = [m for m in main if own.within(m[1], m[2])]
        return [(n[1], n[2]) for n in whole + articles or main]

    def beside(self) -> list[tuple[int, int]]:
        """Ranges that hold articles but are comments, teasers or the like. A
        label around all articles of a page without other text is none."""
        found = [
            (n[1], n[2])
            for n in self.nodes
            if (n[7] or n[0] == "article")
            and n[0] not in ("main", "body", "html")
            and n[4] != "main"
            and (n[4] in NOT_TEXT_ROLES or n[0] in ("aside", "nav", "footer") or any(_named(c, BESIDE) for c in n[8]))
        ]
        rest = (n for n in self.nodes if n[6] and n[0] in ("article", "p", "div", "section"))
        ranges = _Ranges(found)
        if any(not ranges.around(n[1], n[2]) and not ranges.within(n[1], n[2]) for n in rest):
            return found
        return []

    def template_hashes(self) -> set[int]:
        """Subtrees that are template if they recur: all with text outside the
        content, and inside it those without prose of their own: lists of
        links, and labels outside paragraphs."""
        content = _Ranges(self.content())
        prose = _Ranges([(n[1], n[2]) for n in self.nodes if n[0] in PROSE and n[6]])
        out = set()
        for tag, a, b, own, role, words, loose, article, whole, hints in self.nodes:
            if article or tag in ("article", "main", "body", "html") or role == "main":
                continue
            if content.around(a, b):
                hinted = any(EVERYWHERE & set(re.split(r"[_-]+", h)) for h in hints)
                if not hinted and (tag in PROSE or tag not in BLOCKS):
                    continue
                if not hinted and loose and prose.within(a, b):
                    continue
            out.add(own)
        return out

    def main_text(self, template: set[int]) -> str:
        """Blocks of the content. On a page without articles and main parts a
        name like sidebar-wrapper is no proof where nothing else is left."""
        content, beside = self.content(), self.beside()
        candidates = self.template_hashes() & template if template else set()
        text = self._text(content, beside, candidates, True)
        if not text and not content and self.loose:
            text = self._text(content, beside, candidates, False)
        return text

    def _text(self, content: list, beside: list, candidates: set[int], by_name: bool) -> str:
        gone = bytearray(len(self.events))
        headings = sorted((n[1], n[2]) for n in self.nodes if n[0] in HEADINGS and n[6])
        own_parts, within_content, apart = set(content), _Ranges(content), set(beside)
        paragraphs = _Ranges([(n[1], n[2]) for n in self.nodes if n[0] in PROSE and n[6]])
        for tag, a, b, own, role, words, loose, article, whole, hints in self.nodes:
            inside = within_content.around(a, b)
            drop = own in candidates
            if not article and tag not in ("article", "main", "body", "html"):
                # A form around the page's paragraphs is the page.
                page_form = tag == "form" and not content and paragraphs.within(a, b) and 2 * self._loose_in(a, b) > self.loose_until[-1]
                drop = drop or tag in NOT_TEXT_TAGS and not page_form or role in NOT_TEXT_ROLES
                # A word of a name is no proof: the whole name is, or that all
                # text is links.
                if inside:
                    drop = drop or any(_named(h, EVERYWHERE) for h in hints)
                    drop = drop or not loose and any(EVERYWHERE & set(re.split(r"[_-]+", h)) for h in hints)
                    by_tag_only = tag == "header" and own not in candidates and role not in NOT_TEXT_ROLES and not any(_named(h, EVERYWHERE) for h in hints)
                    if by_tag_only:
                        # The titles in an article's own header are text.
                        title = headings[bisect_left(headings, (a, a)) : bisect_left(headings, (b, b))]
                        before = [(x, y, gone[x:y]) for x, y in title]
                        gone[a:b] = b"\1" * (b - a)
                        for x, y, state in before:
                            gone[x:y] = state
                        continue
                else:
                    page = not by_name and paragraphs.within(a, b) and self._loose_in(a, b) >= PAGE_TEXT
                    drop = drop or any(_named(c, OUTSIDE - WEAK if page else OUTSIDE, PLACES) for c in whole)
                    drop = drop or not loose and bool(words & OUTSIDE)
            # A label around an article is no reason to lose it, unless the
            # article is one of several inside the content, as comments are.
            if inside and article and (a, b) not in own_parts:
                drop = drop or any(_named(h, EVERYWHERE) for h in hints)
            if drop or (a, b) in apart:
                gone[a:b] = b"\1" * (b - a)
        return self._blocks(content, gone)

    def _loose_in(self, a: int, b: int) -> int:
        """Length of the text outside links in a range of events."""
        return self.loose_until[bisect_left(self.loose, b)] - self.loose_until[bisect_left(self.loose, a)]

    def _blocks(self, content: list, gone: bytearray) -> str:
        kept = bytearray(len(self.events)) if content else bytearray(b"\1") * len(self.events)
        for a, b in content:
            kept[a:b] = b"\1" * (b - a)
        blocks, now = [], []
        for i, e in enumerate(self.events):
            if e is _BREAK or gone[i] or not kept[i]:
                if e is _BREAK and now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            else:
                now.append(e)
        blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


class _Ranges:
    """Ranges of events, for two questions about another one."""

    def __init__(self, ranges: list[tuple[int, int]]):
        ranges = sorted(ranges)
        self.starts = [a for a, _ in ranges]
        self.last = list(accumulate((b for _, b in ranges), max))
        self.first = list(accumulate((b for _, b in reversed(ranges)), min))[::-1]

    def around(self, a: int, b: int) -> bool:
        """Whether one of them covers [a, b)."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.last[i - 1] >= b

    def within(self, a: int, b: int) -> bool:
        """Whether one of them lies in [a, b)."""
        i = bisect_left(self.starts, a)
        return i < len(self.first) and self.first[i] <= b


def _named(name: str, words: set[str], places: set[str] = frozenset()) -> bool:
    """Whether a whole class or id is one of ``words``, alone or with words for
    parts of pages, places and numbers: share-buttons, but not share-of-votes."""
    parts = {p for p in re.split(r"[_-]+", name) if not _NUMBER.fullmatch(p)}
    return bool(parts & words) and parts <= words | EVERYWHERE | PARTS | places


def host_of(url):
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def extract_main_text(
    pages: DataFrame,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_pages: int = 5,
    min_share: float = 0.02,
    salts: int = 32,
) -> DataFrame:
    """One row per page row: ``page``, ``url``, ``text``.

    A subtree is template where at least ``min_pages`` pages of the host have it
    that differ in their text, and ``min_share`` of all that do, or ``ENOUGH_PAGES``
    of them. Blocks are trimmed, their white space is
    one space, and they are joined by line ends in page order.

    A null or empty html gives an empty text; a null url counts as one host of
    its own; equal rows give equal rows, and count as one page together. Cut-off
    and badly nested pages are read as far as they go. No rows give no rows.
    Other columns are ignored, whatever their names.
    """
    rows = pages.select(
        F.col(page).alias("p"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h")
    ).select("*", F.xxhash64("p", "u", "h").alias("k"), host_of(F.col("u")).alias("host"))

    def subtrees(batches):
        for b in batches:
            rows_of, hashes = [], []
            for i, text in enumerate(b.column("h").to_pylist()):
                own = Page(text).template_hashes()
                rows_of.extend([i] * len(own))
                hashes.extend(own)
            at = pa.array(rows_of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("host").take(at), b.column("k").take(at), pa.array(hashes, pa.int64())], ["host", "k", "s"]
            )

    found = rows.select("host", "k", "h").mapInArrow(subtrees, "host string, k long, s long")

    # A task has no need to tell of more different pages than decide.
    enough = max(min_pages, ENOUGH_PAGES)

    def occurrences(batches):
        seen: dict = {}
        for b in batches:
            out = [], [], []
            for host, text in zip(b.column("host").to_pylist(), b.column("h").to_pylist()):
                page = Page(text)
                content = page.digest()
                # Without a subtree: the page itself.
                for s in (None, *page.template_hashes()):
                    if s is not None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        # One page is one number, several are a set.
                        before = seen.get((host, s))
                        if before is None:
                            seen[host, s] = content
                        elif isinstance(before, int):
                            if before == content:
                                continue
                            seen[host, s] = {before, content}
                        elif content in before or len(before) >= enough:
                            continue
                        else:
                            before.add(content)
                    for column, value in zip(out, (host, s, content)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["host", "s", "c"]
            )

    pages_of = rows.select("host", "h").mapInArrow(occurrences, "host string, s long, c long").distinct()
    counted = materialize(
        pages_of.groupBy("host", "s").agg(F.count("*").alias("n")).where(F.col("s").isNull() | (F.col("n") >= min_pages)), "subtrees"
    )
    per_host = counted.where("s IS NULL").select("host", F.col("n").alias("pages"))
    recurring = (
        counted.where("s IS NOT NULL")
        .join(per_host, "host")
        .where((F.col("n") >= enough) | (F.col("n") >= min_share * F.col("pages")))
        # A footer of a large host is on a large part of all pages: its key is
        # dealt to several tasks.
        .select("host", "s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    template = (
        found.withColumn("salt", F.pmod("k", F.lit(salts)).cast("int"))
        .join(recurring, ["host", "s", "salt"], "left_semi")
        .groupBy("k")
        .agg(F.collect_set("s").alias("template"))
    )

    schema = T.StructType(
        [
            T.StructField(page, pages.schema[page].dataType),
            T.StructField(url, pages.schema[url].dataType),
            T.StructField("text", T.StringType()),
        ]
    )

    def texts(batches):
        for b in batches:
            made = [
                Page(h).main_text(set(t or ()))
                for h, t in zip(b.column("h").to_pylist(), b.column("template").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(made, pa.string())], [page, url, "text"])

    return rows.join(template, "k", "left").select("p", "u", "h", "template").mapInArrow(texts, schema)
