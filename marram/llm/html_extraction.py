"""Main text of web pages by differencing with the page of the nearest URL.

Pages of a host are sorted by URL path, copies (pages with the same lines) being one, and each is paired with the neighbour
that shares the longer start of the path. The lines of both (the texts of all visible blocks, inside and outside the main
text) are aligned by a longest common subsequence, and shared lines are deleted as the site's frame.
Two pages may well share sentences of their articles, so lines inside an <article> or <main> are protected: they stay though
they are shared. What differencing leaves of other lines is the text only where a page marks no main text, and lines in
elements that hold none by their tag, role, class or id (menus, footers, forms, adverts, comments and the like) go in any
case, since frames that differ from page to page aren't shared. No class or id makes a page, its main text, a heading or a
paragraph such an element, and within main text only a whole class token or a known compound does: <h2 id="social-impact">
and <section class="related-work"> are part of an article.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import SLICE_ROWS, broadcast_if_small, extend, free_name, materialise

# HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
DROPPED = frozenset("head title script style noscript template nav footer aside form iframe object svg canvas audio video button select textarea input dialog menu".split())
#: Of these, what holds no line of a page.
SILENT = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
MAIN = frozenset(("article", "main"))
# Words in a class or id, and roles, of elements that hold no main text.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "share sharing social related recommended comment comments respond disqus footer masthead toolbar widget".split()
)
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
# Class tokens and ids that name a frame element within main text, where one word of a token tells too little.
FRAME_COMPOUNDS = frozenset(
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle google-ad share-bar share-box share-buttons share-links share-tools sharing-buttons "
    "social-bar social-buttons social-icons social-links social-media-links social-share social-sharing related-articles related-links related-news related-posts "
    "related-stories comment-form comment-list comment-respond comment-section comments-area comments-list comments-section disqus-thread newsletter-box "
    "newsletter-form newsletter-signup subscribe-box subscribe-form signup-form cookie-banner cookie-consent cookie-notice promo-banner promo-box sponsored-links "
    "post-navigation page-navigation nav-links".split()
)
FRAME_IDS = FRAME_COMPOUNDS | {"comments", "respond", "disqus"}
#: Elements that no class or id makes frame.
NEVER_FRAME = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that a start tag of the same kind closes, and those that any block closes.
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: A class token of an <article> that is one comment.
_ONE_COMMENT = re.compile(r"(?:user-|single-|blog-)?comment(?:-(?:body|item|entry|content|text|card|container|wrapper|\d+))?")
#: A class token or id that tells of a state or a layout ("has-sidebar", "menu-open") names no frame element.
_STATE = re.compile(r"(?:has|no|with|without)-.*|.*-(?:open|closed|enabled|disabled|on|off)")


def _tokens(value: str | None) -> list[str]:
    """The tokens of a class or id in lower case, their words joined by single hyphens."""
    return re.sub(r"[-_]+", "-", _CAMEL.sub(r"\1-\2", value or "").lower()).split()


def _is_frame(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if tag in MAIN:
        return tag == "article" and any(name == "class" and any(map(_ONE_COMMENT.fullmatch, _tokens(value))) for name, value in attrs)
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "role" and (value or "").lower() in FRAME_ROLES):
            return True
        if name not in ("class", "id") or tag in NEVER_FRAME:
            continue
        tokens = _tokens(value)
        if in_main:
            if not FRAME_COMPOUNDS.isdisjoint(tokens) or not (FRAME_WORDS if name == "class" else FRAME_IDS).isdisjoint(tokens):
                return True
        elif any(not _STATE.fullmatch(t) and not FRAME_WORDS.isdisjoint(_WORD.findall(t)) for t in tokens):
            return True
    return False


class _Lines(HTMLParser):
    """Collects (text, kind) of the visible blocks of a page in order; kind: 'main', 'frame' or 'free'."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.kind = "free"

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.kind))
            self.parts = []

    def _pop(self, n: int) -> None:
        del self.stack[n:]
        self.kind = self.stack[-1][1] if self.stack else "free"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block or tag in ("td", "th"):
            if block:
                self._end_line()
            else:
                self.parts.append(" ")
            closes = _SELF_CLOSING.get(tag)
            for n in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[n][0]
                if (block and open_tag == "p") or (closes and open_tag in closes):
                    self._pop(n)
                    break
                if open_tag in BLOCKS and open_tag != "p":
                    break
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        kind = self.kind
        if tag in SILENT:
            kind = "silent"  # a script inside a paragraph doesn't end its line
        elif kind not in ("frame", "silent"):
            if _is_frame(tag, attrs, kind == "main"):
                self._end_line()
                kind = "frame"
            elif tag in MAIN:
                kind = "main"
        self.stack.append((tag, kind))
        self.kind = kind

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag not in BLOCKS:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or (self.stack and self.stack[-1] == (tag, "frame")):
            self._end_line()
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] == tag:
                self._pop(n)
                break

    def handle_data(self, data: str) -> None:
        if self.kind != "silent":
            self.parts.append(data)


def page_lines(html: str | None) -> list[tuple[str, str]]:
    """(text, kind) of each block; character references decoded, white space made one space, empty blocks left out."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    return parser.lines


#: Lines of b whose places one integer of bits holds.
BITS = 4096


def _by_matches(a: list, b: list, places: dict) -> list[int]:
    """Places in a of a longest common subsequence, visiting every pair of equal lines: for few such pairs."""
    ends: list[int] = []  # least end in b of a common subsequence by its length
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j), links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _lengths(a: list, b: list) -> list[int]:
    """The length of the longest common subsequence of a with each start of b, from the empty one on.

    A row of the table is a bit for each line of b, 0 where the length grows; a line of a takes one addition on the row. The
    row is cut into words of BITS bits, and what an addition carries is kept for the next word."""
    out, total = [0], 0
    carries = [0] * len(a)
    for at in range(0, len(b), BITS):
        part = b[at : at + BITS]
        masks: dict = {}
        for j, line in enumerate(part):
            masks[line] = masks.get(line, 0) | 1 << j
        full = (1 << len(part)) - 1
        row = full
        for i, line in enumerate(a):
            hit = row & masks.get(line, 0)
            added = row + hit + carries[i]
            carries[i] = added >> len(part)
            row = (added | (row ^ hit)) & full
        for bit in reversed(bin(full ^ row | 1 << len(part))[3:]):
            total += bit == "1"
            out.append(total)
    return out


def shared_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b, in memory linear in their lines.

    Common starts and ends are matched, and lines that only one side has are dropped. What is left is aligned by its pairs of equal lines where
    these are few; else a is halved, b is cut where the halves' lengths add up to the most, and both are aligned so."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    inner = range(start, len(a) - stop)
    in_a, in_b = set(a[start : len(a) - stop]), set(b[start : len(b) - stop])
    where = [i for i in inner if a[i] in in_b]
    return [*range(start), *(where[k] for k in _align([a[i] for i in where], [x for x in b[start : len(b) - stop] if x in in_a])), *range(len(a) - stop, len(a))]


def _align(a: list, b: list) -> list[int]:
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    if len(a) < 2 or sum(len(places.get(line, ())) for line in a) <= 8 * (len(a) + len(b)):
        return _by_matches(a, b, places)
    half = len(a) // 2
    before, behind = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
    cut = max(range(len(b) + 1), key=lambda j: before[j] + behind[len(b) - j])
    return [*_align(a[:half], b[:cut]), *(half + k for k in _align(a[half:], b[cut:]))]


#: Bytes of a line's fingerprint.
PRINT = 16


def _prints(column: pa.Array) -> list[pa.Array]:
    found = [page_lines(h) for h in column.to_pylist()]
    packed = [b"".join(hashlib.blake2b(t.encode(), digest_size=PRINT).digest() for t, _ in x) for x in found]
    return [pa.array(packed, pa.binary()), pa.array([any(kind == "main" for _, kind in x) for x in found], pa.bool_())]


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, gone) of the pages (part, place, host, path, digest, prints) of a sorted stream that share lines with their
    nearest neighbour. place 0 and 2: the page before a part's first and after its last page, which gets no row here."""
    keys, gone = [], []

    def lines(page: tuple) -> list[bytes]:
        return [page[5][i : i + PRINT] for i in range(0, len(page[5]), PRINT)]

    def judge(page: tuple | None, *beside: tuple | None) -> None:
        near = [x for x in beside if page and x and page[1] == 1 and (x[0], x[2]) == (page[0], page[2])]
        if near:
            found = shared_lines(lines(page), lines(max(near, key=lambda x: _common_start(page[3], x[3]))))
            if found:
                keys.append(page[4]), gone.append(found)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["digest", "gone"])
        keys.clear(), gone.clear()
        return batch

    before = page = None
    for batch in batches:
        for after in zip(*(batch.column(i).to_pylist() for i in range(6))):
            judge(page, before, after)
            before, page = page, after
            if len(keys) >= SLICE_ROWS:
                yield out()
    judge(page, before)
    yield out()


def _nearest(narrow: DataFrame) -> DataFrame:
    """(digest, gone): the places of the lines that a page of (host, path, digest, prints) shares with its nearest neighbour.

    Pages with one digest are one, under the least path. A host's pages may fill many partitions: the pages at a partition's
    ends are dealt to its neighbours as rows, so that no host is gathered."""
    n = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ("host", "path", "digest")
    one = narrow.groupBy("digest").agg(F.min(F.struct("host", "path", "prints")).alias("x")).select("x.host", "x.path", "digest", "x.prints")
    dealt = materialise(one.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()))
    page = F.struct(*key, "prints")
    ends = dealt.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    in_order = Window.orderBy("part")  # a row for each partition
    ends = ends.select("part", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after"))
    beside = [ends.where(F.col(c).isNotNull()).select("part", F.lit(place).alias("place"), *[f"{c}.{x}" for x in (*key, "prints")]) for c, place in (("before", 0), ("after", 2))]
    stream = dealt.select("part", F.lit(1).alias("place"), *key, "prints").union(beside[0]).union(beside[1])
    return stream.repartition(n, "part").sortWithinPartitions("part", "place", *key).mapInArrow(_difference, "digest string, gone array<int>")


#: Deleted places that may be broadcast in all.
BROADCAST_PLACES = 2_000_000


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", report: bool = False) -> DataFrame:
    """pages with text, the main text as lines joined by one newline (empty if there is none), and n_chars, its code points.

    report: also n_lines, the visible lines of the page, n_differenced, those that differencing deletes, and n_protected,
    those that are shared but stay as part of a marked main text.
    Null or empty html gives an empty text. A null URL counts as one without host; such pages are neighbours by path
    as others are. Copies are no neighbours: a page is differenced with the nearest page of its host whose lines differ, and
    without such a page nothing is deleted. Copies, which are found by their lines, are judged alike. Lines are compared by
    fingerprints of 128 bits. Columns of pages called text or n_chars (with report: or as its columns) give way; no rows give
    no rows. The source is read twice, so it must give its rows in the same partitions each time, as files and checkpoints do.
    """
    row, shared = free_name(pages, "row_key"), free_name(pages, "shared_lines")
    keyed = pages.withColumn(row, F.monotonically_increasing_id())
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^(?:.*?://[^/?#]*)?([^?#]*)", 1)
    narrow = extend(keyed.select(host.alias("host"), path.alias("path"), F.col(row).alias("row"), F.col(f"`{html_col}`").alias("html")), "html", "prints binary, marked boolean", _prints).drop("html")
    narrow = materialise(narrow.withColumn("digest", F.sha2(F.concat("prints", F.lit(" ").cast("binary"), F.col("host").cast("binary")), 256)))
    nearest = materialise(_nearest(narrow.select("host", "path", "digest", "prints")))
    wanted = narrow if report else narrow.where(~F.col("marked"))  # what is shared of a marked page, but for its main text, is frame
    gone = materialise(wanted.select("row", "digest").join(broadcast_if_small(nearest), "digest").select(F.col("row").alias(row), F.col("gone").alias(shared)))
    few = (gone.agg(F.sum(F.size(shared) + 1)).first()[0] or 0) <= BROADCAST_PLACES
    both = free_name(pages, "page_parts")

    def final(column: pa.Array) -> list[pa.Array]:
        texts, counts = [], []
        for packed in column.to_pylist():
            found, skip = page_lines(packed["html"]), set(packed["gone"] or ())
            main = any(kind == "main" for _, kind in found)
            texts.append("\n".join(t for i, (t, kind) in enumerate(found) if (kind == "main" if main else kind == "free" and i not in skip)))
            protected = sum(found[i][1] == "main" for i in skip)
            counts.append((len(found), len(skip) - protected, protected))
        return [pa.array(texts, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3 if report else 0))]

    joined = keyed.join(F.broadcast(gone) if few else gone, row, "left").withColumn(both, F.struct(F.col(f"`{html_col}`").alias("html"), F.col(shared).alias("gone")))
    columns = "text string" + (", n_lines long, n_differenced long, n_protected long" if report else "")
    done = extend(joined.drop(shared, row), both, columns, final, kind="struct<html:string,gone:array<int>>").drop(both)
    return done.withColumn("n_chars", F.length("text").cast("long"))
