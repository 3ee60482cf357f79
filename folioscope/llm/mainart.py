"""HTML main-text extraction by differencing pages with their nearest neighbours by URL.

A page becomes a list of text blocks, each with the chain of elements around it. Pages of a host are sorted by URL
path, which puts pages of one template and section side by side, and every page is aligned with the page before and
the page after it, twice, by longest common subsequences. Blocks that agree in chain and text are shared lines. Blocks that
agree in elements, classes and order are shared places: menus, notices, adverts and footers whose words change from page to
page share no line, but their places are the template's.

What a page is about lies in its content root: the ``article`` or ``main`` element where it has one, else the element that
holds most of the text that differs from the neighbours (from the page's root down, as long as one child holds two thirds).
Outside the root shared lines and shared places are deleted. Inside it texts legitimately repeat passages, and copies of an
article share everything: there a block goes if both neighbours share its line and each of them shares half of the page's
blocks there at most. The first and the last page of a host have one neighbour; they lose the blocks that it shares with
them and loses itself.

Only what differencing can't tell is left to names: a page without neighbours, an element that one page alone has, and
elements inside the root (a form, reader comments) go by element and class (nav, footer, form, advert, comments ...), and
what stands outside an article or main element isn't the article.

Neighbours are found without gathering a host: the keys (host, path, url, id, hash of the page) are sorted first and cut
into ranges, and each range is sent to one task with copies of the HALO pages before and after it, so a hot host is
simply spread over tasks and every page meets both neighbours, wherever ranges end. Memory is three pages.

Blocks: white space (Unicode) inside a block becomes one space, block texts are joined by one line feed; ``br`` and
inline elements don't end a block. Character references are decoded as HTML 5 does.

Defined results: a null or empty page gives an empty text; a null URL sorts first, under an empty host; pages with the
same URL are neighbours; repeated rows all stay, each with its text; extra columns are ignored; an empty table gives no
rows. Broken markup (unclosed elements, a cut-off end) is read to its end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import only, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
SILENT = frozenset("script style noscript template iframe object svg math head title canvas audio video select textarea".split())
RAW = frozenset("script style noscript template iframe svg math title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "frameset"}
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MAIN = frozenset(("article", "main"))
#: Words of class, id or role that name furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login search "
    "share sharing social related recommended comment comments respond reply replies discussion disqus toolbar pagination pager skip complementary contentinfo".split()
)
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_NAME = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("body", "html", *MAIN):
        return False
    for name, *values in _NAME.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
        if not NAMES.isdisjoint(_WORD.findall(value)):
            return True
    return False


_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.I)


def styled(tag: str, attributes: str) -> str:
    """An element with its classes, whatever numbers they hold."""
    found = _CLASS.search(attributes)
    return f"{tag}.{' '.join(sorted(_WORD.findall(''.join(x or '' for x in found.groups()).lower())))}" if found else tag


class Block:
    __slots__ = ("chain", "text", "main", "drop", "place")

    def __init__(self, chain: str, text: str, main: bool, drop: bool, place: tuple[str, ...] = ()):
        self.chain, self.text, self.main, self.drop, self.place = chain, text, main, drop, place

    def line(self) -> tuple[str, str]:
        return self.chain, self.text


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, str]] = []  # element, main so far, furniture so far, element with classes
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                _, main, drop, _ = stack[-1] if stack else ("", False, False, "")
                out.append(Block("/".join(x[0] for x in stack if x[0] in BLOCK), text, main, drop, tuple(x[3] for x in stack if x[0] in BLOCK)))

    def close(to: int) -> None:
        if any(x[0] in BLOCK for x in stack[to:]):
            flush()
        del stack[to:]

    at, end = 0, len(html)
    while at < end:
        mark = html.find("<", at)
        if mark < 0:
            held.append(unescape(html[at:]))
            break
        if mark > at:
            held.append(unescape(html[at:mark]))
        found = _TAG.match(html, mark)
        if not found:
            held.append("<")
            at = mark + 1
            continue
        at = found.end()
        shut, tag, attributes = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if shut:
            if tag == "br":
                held.append(" ")
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k >= 0:
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW or tag in SILENT:
            over = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            if tag == "head" and (body := re.compile(r"<body\b", re.I).search(html, at)) and (not over or body.start() < over.start()):
                at = body.start()
            elif over:
                at = over.end()
            elif tag in RAW or tag == "head":
                at = end
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag in ("br", "img", "wbr"):
                held.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in ("article", "main", "td", "th", "li", "section", "div")), -1)
                if k >= 0 and stack[k][0] == "p":
                    close(k)
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in same or stack[i][0] in ("ul", "ol", "dl", "table", "tr") and stack[i][0] != tag), -1)
                if k >= 0 and stack[k][0] in same:
                    close(k)
        _, main, drop, _ = stack[-1] if stack else ("", False, False, "")
        own = furniture(tag, attributes or "")
        if own and tag == "header" and main:
            own = False  # an article's own header holds its title
        if not (attributes or "").rstrip().endswith("/") or tag in BLOCK:
            stack.append((tag, main or tag in MAIN, drop or own, styled(tag, attributes) if attributes else tag))
    flush()
    return out


def shared(a: list[Block], b: list[Block]) -> tuple[set[int], set[int]]:
    """Indices of a's and b's blocks in a longest common subsequence of their lines."""
    return common([p.line() for p in a], [p.line() for p in b])


def aligned(a: list[Block], b: list[Block]) -> tuple[set[int], set[int]]:
    """Indices of a's and b's blocks in a longest common subsequence of their places. Blocks in a row at one place, such as
    the items of a list, are one there, however many a page has."""
    runs = [[(place, [i for i, _ in own]) for place, own in groupby(enumerate(page), lambda x: x[1].place)] for page in (a, b)]
    found = common(*[[place for place, _ in r] for r in runs])
    return tuple({i for k in own for i in r[k][1]} for own, r in zip(found, runs, strict=True))


def common(x: list, y: list) -> tuple[set[int], set[int]]:
    """Indices of x and y in a longest common subsequence. Common ends are cut off first, and values that only one has are
    left out; what is left is small."""
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    tail = 0
    while tail < min(len(x), len(y)) - low and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    in_a, in_b = set(range(low)) | set(range(len(x) - tail, len(x))), set(range(low)) | set(range(len(y) - tail, len(y)))
    both = set(x[low : len(x) - tail]) & set(y[low : len(y) - tail])
    i_of, j_of = [i for i in range(low, len(x) - tail) if x[i] in both], [j for j in range(low, len(y) - tail) if y[j] in both]
    for i, j in subsequence([x[i] for i in i_of], [y[j] for j in j_of]):
        in_a.add(i_of[i])
        in_b.add(j_of[j])
    return in_a, in_b


def subsequence(x: list, y: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel rows (one big integer each)."""
    places: dict = {}
    for j, value in enumerate(y):
        places[value] = places.get(value, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [], full
    for value in x:
        m = places.get(value, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
        rows.append(v)
    out, i, j = [], len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:  # the length doesn't grow at j
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def content_root(page: list[Block], shared_lines: set[int]) -> tuple[str, ...]:
    """The place under which most of the text lies that differs from the neighbours; () is the whole page. A place that
    holds its text itself, as paragraphs do, is no root: headings stand beside it."""
    root: tuple[str, ...] = ()
    inside = [b for i, b in enumerate(page) if i not in shared_lines]
    while inside:
        weight: dict[str, int] = {}
        for b in inside:
            if len(b.place) > len(root):
                weight[b.place[len(root)]] = weight.get(b.place[len(root)], 0) + len(b.text)
        if not weight or 3 * max(weight.values()) < 2 * sum(len(b.text) for b in inside):
            return root
        child = (*root, max(sorted(weight), key=weight.__getitem__))
        inside = [b for b in inside if b.place[: len(child)] == child]
        if 2 * sum(len(b.text) for b in inside if b.place == child) > sum(len(b.text) for b in inside):
            return root
        root = child
    return root


def differenced(page: list[Block], shared_lines: set[int], shared_places: set[int], shared_main: frozenset | set = frozenset()) -> set[int]:
    """What the neighbours take from a page; shared_main: blocks to delete from article and main elements."""
    if any(b.main for b in page):
        return {i for i, b in enumerate(page) if (i in shared_main if b.main else i in shared_lines or i in shared_places)}
    root = content_root(page, shared_lines)
    return shared_lines | {i for i in shared_places if page[i].place[: len(root)] != root}


def kept(page: list[Block], shared_lines: set[int], shared_main: frozenset | set = frozenset(), shared_places: frozenset | set = frozenset()) -> str:
    """The page's text: what differencing leaves, without what elements and classes name as furniture."""
    gone, has_main = differenced(page, shared_lines, set(shared_places), shared_main), any(b.main for b in page)
    return "\n".join(b.text for i, b in enumerate(page) if i not in gone and not b.drop and (b.main or not has_main))


def little(page: list[Block], shared_lines: set[int]) -> set[int]:
    """Blocks of article and main elements that a neighbour shares, if it shares half of those at most."""
    main = {i for i, b in enumerate(page) if b.main and not b.drop}
    found = main & shared_lines
    return found if 2 * len(found) <= len(main) else set()


#: (host, path) of a URL: what pages are sorted by.
_HOST, _PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


#: Pages that a range has from each of its neighbours.
HALO = 2
ORDER = ["host", "path", "url", "page_id", "hash"]
#: Pages of a range at least, on average: with fewer, the copies cost more than the ranges.
RANGE_PAGES = 100


def order_key(host: str, path: str, url: str | None, page_id, hashed: int) -> tuple:
    """A page's place in Spark's order, where strings go by bytes and nulls come first."""
    return host.encode(), path.encode(), url is not None, (url or "").encode(), page_id is not None, page_id if page_id is not None else 0, hashed


def ranges(keys: DataFrame, n: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of each of n ranges at most, and to which other ranges a key's pages are copied."""

    def edges(batches):
        head: list[dict] = []
        tail: list[dict] = []
        kind = None
        for batch in batches:
            kind = batch.schema
            head += batch.slice(0, HALO - len(head)).to_pylist()
            tail = (tail + batch.slice(max(0, batch.num_rows - HALO)).to_pylist())[-HALO:]
        if head:
            yield pa.RecordBatch.from_pylist([{**r, "place": k} for k, r in enumerate(head + tail)], pa.schema([*kind, pa.field("place", pa.int32())]))

    schema = T.StructType([*keys.schema.fields, T.StructField("place", T.IntegerType())])
    parts: list[list[tuple]] = []
    for row in keys.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(edges, schema).collect():
        if row["place"] == 0:
            parts.append([])
        parts[-1].append(order_key(*row[:-1]))
    parts.sort(key=lambda p: p[0])
    copies: dict[tuple, list[int]] = {}
    for k in range(len(parts)):
        for step in (-1, 1):
            near: list[tuple] = []
            at = k + step
            while len(near) < HALO and 0 <= at < len(parts):
                # head and tail overlap in a small range: its keys once each are enough, as a key stands for all its pages
                own = list(dict.fromkeys(parts[at]))
                near += own[-HALO:] if step < 0 else own[:HALO]
                at += step
            for key in dict.fromkeys(near):
                copies.setdefault(key, []).append(k)
    return [p[0] for p in parts], copies


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", range_pages: int = RANGE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars, a row for each page."""
    own = only(pages, page_id=page_id, url=url, html=html).withColumn("html", text_or_empty("html"))
    keys = [F.regexp_extract(F.coalesce("url", F.lit("")), x, 1) for x in (_HOST, _PATH)]
    keyed = own.select(F.lower(keys[0]).alias("host"), keys[1].alias("path"), "url", "page_id", F.xxhash64("html").alias("hash"), "html")
    n = max(1, min(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // range_pages))
    bounds, copies = ranges(keyed.drop("html"), n)

    def deal(batches):
        for batch in batches:
            at, to, halo = [], [], []
            for i, row in enumerate(zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True)):
                key = order_key(*row)
                mine = max(0, bisect_right(bounds, key) - 1)
                targets = [mine, *copies.get(key, ())]
                at += [i] * len(targets)
                to += targets
                halo += [False] + [True] * (len(targets) - 1)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int32())).columns, pa.array(to, pa.int32()), pa.array(halo, pa.bool_())], names=[*batch.schema.names, "range", "halo"])

    dealt = keyed.mapInArrow(deal, T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("halo", T.BooleanType())]))
    dealt = dealt.repartitionById(max(1, len(bounds)), F.col("range")).sortWithinPartitions("range", *ORDER).select("page_id", "url", "html", "host", "range", "halo")
    schema = T.StructType([*dealt.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        # (id, url, (range, host), blocks, lines shared with the page before, halo, whether there is a page before, places
        # shared with the page before)
        before = None
        first = None  # the first page of its host and what it shares with the second, until that one is known
        done: list[tuple] = []

        def settle(page, lines: set[int], places: set[int], main: set[int]) -> None:
            if not page[5]:
                text = kept(page[3], lines, main, places)
                done.append((page[0], page[1], text, len(text)))

        def by_lines(page, shared_lines: set[int], lines: set) -> set[int]:
            return {i for i in little(page[3], shared_lines) if page[3][i].line() in lines}

        def settle_middle(page, after_shared: set[int], after_places: set[int]) -> set:
            """Settles a page with two neighbours, and the one before it if that is the host's first; the lines it loses."""
            nonlocal first
            main = little(page[3], page[4]) & little(page[3], after_shared)
            lines = {page[3][i].line() for i in main}
            if first is not None:
                settle(*first, by_lines(*first[:2], lines))
                first = None
            settle(page, page[4] | after_shared, page[7] & after_places, main)
            return lines

        def settle_last(page) -> None:
            nonlocal first
            if first is not None:  # a host of two pages
                settle(*first, set())
                first = None
            settle(page, page[4], page[7], by_lines(page, page[4], lost))

        lost: set = set()  # lines that the page before the last one loses

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.fieldNames())

        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64()]
            for at in range(0, batch.num_rows, 500):
                for row in batch.slice(at, 500).to_pylist():
                    found, group = blocks(row["html"]), (row["range"], row["host"])
                    mine: set[int] = set()
                    places: set[int] = set()
                    after = before is not None and before[2] == group
                    if after:
                        theirs, mine = shared(before[3], found)
                        their_places, places = aligned(before[3], found)
                        if before[6]:
                            lost = settle_middle(before, theirs, their_places)
                        else:
                            first, lost = (before, theirs, their_places), set()
                    elif before is not None:
                        settle_last(before)
                        lost = set()
                    before = (row["page_id"], row["url"], group, found, mine, row["halo"], after, places)
                if done:
                    yield batch_of(done)
                    done = []
        if before is not None:
            settle_last(before)
            if done:
                yield batch_of(done)

    return dealt.mapInArrow(run, schema)
