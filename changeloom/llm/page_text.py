"""Main text of web pages by differencing against the page with the nearest URL on the host.

A page is parsed into all its lines, one a block, those of menus, headers and footers too. Pages are ordered by host and
URL path; a page is aligned with the neighbour whose path begins alike the longest, by a longest common subsequence
of lines. Lines that both have are the host's template, and go: menus, footers, notices, whatever their markup.

Markup adds two rules. Lines of an article or main element are protected, as long as they aren't inside an
element of the second rule: pages of a host share licences, quotations and whole copies of articles, which are their text.
And of what differencing leaves, lines in elements that are named as menus, footers, adverts and the like go, as do
all lines outside the article of a page that marks one: no page may share a menu made for one page alone.

Cases: a null or empty html has no text; a null or odd url has its own empty host; a page alone on its host, or with
copies of itself alone, has no neighbour and keeps its lines; pages with the same lines are copies, and each is aligned
with the nearest page that isn't; rows that repeat are pages of their own; very long pages are aligned whole, in memory that
grows with their lines and not with the square; broken markup is read as browsers do, an element that isn't closed
ends with the one that holds it; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import cut, pick, slices, small_batches

#: Lines to delete are broadcast up to so many bytes, and joined beyond.
BROADCAST_BYTES = 32 << 20

#: Elements whose content is never text.
NEVER = frozenset("script style noscript template head iframe object svg canvas select option textarea audio video map".split())

#: Elements whose lines aren't of the article.
DROPPED = frozenset("nav footer aside form button dialog menu".split())

#: Lines of a page: of no marked part, of a marked article, of a part that isn't of the article.
PLAIN, MAIN, OTHER = 0, 1, 2

#: Two pages of this many lines by lines are aligned in one table of bits; larger ones are halved first.
SQUARE = 1 << 24

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that don't end a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

#: Parts of the names in classes and ids (split at what isn't a letter) that mark an element as not of the article. "ad" and
#: "ads" do so at the end of a name or before one of SLOTS. Inside an article they count on containers alone, not on its text.
SLOTS = frozenset("banner block box break container label placeholder section slot space unit wrap wrapper".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup promo promoted promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies related recommended share sharing social widget toolbar pagination pager masthead skip login search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: A new one of these ends an open one of the same kind.
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")


#: The attributes of a tag: quotes hold a value only after its equals sign.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""

#: Comments; elements whose content is raw text, none of it the page's; tags; declarations.
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noembed|noframes|xmp)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def marked(names: str) -> bool:
    """Whether a class or id holds a name of a part that isn't of the article."""
    for name in names.split():
        parts = [x for x in _SPLIT.split(name) if x]
        for i, x in enumerate(parts):
            if x in MARKS and (x not in ("ad", "ads") or i + 1 == len(parts) or parts[i + 1] in SLOTS):
                return True
    return False


class Lines:
    """All lines of a page: text and kind."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, int, int, int]] = []  # element, whether it is never text, not of the article, main
        self.never = self.other = self.main = 0

    def end_line(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                self.lines.append((text, OTHER if self.other else MAIN if self.main else PLAIN))
            self.parts = []

    def feed(self, page: str) -> None:
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at and not self.never:
                self.parts.append(page[at : m.start()])
            at = m.end()
            if tag := m[3]:
                if m[2]:
                    self.end_tag(tag.lower())
                else:
                    self.start_tag(tag.lower(), m[4])
        if not self.never:
            self.parts.append(page[at:])
        self.end_line()

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSED_BY:
            self.close_open(CLOSED_BY[tag])
        elif tag not in INLINE:
            self.close_open({"p"})
        values = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        names, role = f"{values.get('class', '')} {values.get('id', '')}", values.get("role", "")
        main = tag in ("article", "main") or role == "main"
        other = tag in DROPPED or role in ROLES
        if not other and values and not (self.main and tag in TEXTUAL | INLINE):
            other = marked(names)
        if not self.main and not main and (tag == "header" or "header" in _SPLIT.split(names)):
            other = True
        if other and tag in ("html", "body") or main and tag != "article" and not {"comment", "comments"} & {*_SPLIT.split(names)}:
            other = False
        never = tag in NEVER or "hidden" in values or other and tag in INLINE
        self.open.append((tag, never, other, main))
        self.never += never
        self.other += other
        self.main += main

    def close_open(self, tags: set[str]) -> None:
        """Ends an open element of these kinds if only inline elements stand in it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.pop_to(i)
                return
            if self.open[i][0] not in INLINE and not (self.open[i][0] == "p" or self.open[i][0] in HEADINGS):
                return

    def pop_to(self, i: int) -> None:
        self.end_line()
        for _, never, other, main in self.open[i:]:
            self.never -= never
            self.other -= other
            self.main -= main
        del self.open[i:]

    def end_tag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in INLINE:
                    _, never, other, main = self.open[i]
                    if main:
                        self.end_line()
                    self.never -= never
                    self.other -= other
                    self.main -= main
                    del self.open[i]
                else:
                    self.pop_to(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return


def lines_of(html: bytes | None) -> tuple[list[str], np.ndarray]:
    """All lines of a page and their kinds."""
    parser = Lines()
    parser.feed((html or b"").decode())
    return [t for t, _ in parser.lines], np.array([k for _, k in parser.lines], np.uint8)


def text_of(lines: list[str], kinds: np.ndarray, gone: list[int]) -> list[str]:
    """What is left of the lines without those that differencing deletes."""
    wanted = MAIN if (kinds == MAIN).any() else PLAIN
    lost = set(gone)
    return [t for i, (t, k) in enumerate(zip(lines, kinds, strict=True)) if k == wanted and i not in lost]


def _row(a: list, where: dict, n: int) -> int:
    """A bit for each of n lines of the other page: 0 where the common subsequence with a grows."""
    v = all_ones = (1 << n) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & all_ones
    return v


def _places(b: list) -> dict:
    out: dict = {}
    for j, x in enumerate(b):
        out.setdefault(x, []).append(j)
    return {x: sum(1 << j for j in js) for x, js in out.items()}


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the common subsequence of a and of b's first 0, 1, 2 ... lines."""
    v = _row(a, _places(b), len(b))
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b: what both begin and end with, and between it by rows of
    bits; where the rows would be too many, a is halved where the subsequences of both halves are longest together."""
    start, stop = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    edges = list(range(start)), list(range(len(a) - stop, len(a)))
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        inner = []
    elif len(a) * len(b) <= SQUARE or len(a) == 1:
        inner = _by_rows(a, b)
    else:
        half = len(a) // 2
        cut_at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        inner = shared_lines(a[:half], b[:cut_at]) + [half + i for i in shared_lines(a[half:], b[cut_at:])]
    return [*edges[0], *(start + i for i in inner), *edges[1]]


def _by_rows(a: list, b: list) -> list[int]:
    where, all_ones = _places(b), (1 << len(b)) - 1
    rows = [all_ones]
    for x in a:
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & all_ones)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _map(df: DataFrame, html: int, schema: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html):
                yield f(batch)

    return df.mapInArrow(run, schema)


@dataclass
class Run:
    """Pages that follow each other and have the same lines: host, lines by hash, kinds; the path and row of each."""

    host: str
    lines: bytes
    kinds: bytes
    paths: list[str]
    rows: list[int]

    def deleted(self, before: Run | None, after: Run | None) -> Iterator[tuple[int, list[int]]]:
        """(row, places) of the lines that each page shares with the neighbour whose path begins alike the longest, or
        the first of those, without protected ones."""
        near = [(x, x.paths[at]) for x, at in ((before, -1), (after, 0)) if x and x.host == self.host]
        found: dict[int, list[int]] = {}
        done = set()
        for path, row in zip(self.paths, self.rows, strict=True):
            if not near or row in done:
                continue
            done.add(row)
            k = max(range(len(near)), key=lambda k: len(commonprefix([path, near[k][1]])))
            if k not in found:
                own, other = (np.frombuffer(x, np.uint64).tolist() for x in (self.lines, near[k][0].lines))
                found[k] = [i for i in shared_lines(own, other) if self.kinds[i] != MAIN]
            if found[k]:
                yield row, found[k]


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """From batches of (task, host, path, row, lines, kinds)."""
    own = None
    for b in batches:
        for host, path, row, lines, kinds in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
            if own and (own.host, own.lines) == (host, lines):
                own.paths.append(path)
                own.rows.append(row)
                continue
            if own:
                yield own
            own = Run(host, lines, kinds, [path], [row])
    if own:
        yield own


def ordered(pages: DataFrame) -> DataFrame:
    """(task, host, path, row, lines, kinds) for pages(row, url, html), in the order of host, path, row.

    The order is made by a range shuffle of the lines' hashes, so that a host of any size is dealt to many tasks.
    """
    where = F.coalesce("url", F.lit(""))
    host, path = F.lower(F.regexp_extract(where, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_replace(where, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [lines_of(x) for x in batch.column(3).cast(pa.binary()).to_pylist()]
        hashes = [np.array([xxhash.xxh3_64_intdigest(t) for t in own], np.uint64).tobytes() for own, _ in made]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(hashes, pa.binary()), pa.array([k.tobytes() for _, k in made], pa.binary())], names=["host", "path", "row", "lines", "kinds"])

    seen = cut(_map(pages.select(host.alias("host"), path.alias("path"), "row", "html"), 3, "host string, path string, row bigint, lines binary, kinds binary", look))
    dealt = cut(seen.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row"))
    return dealt.select(F.spark_partition_id().alias("task"), "*")


def shared_with_neighbour(pages: DataFrame) -> DataFrame:
    """(row, gone) for pages(row, url, html): the places of lines that the neighbour has too and that aren't protected.

    The first and last run of each task are gathered to link tasks: two pages a task, as hashes of lines.
    """
    rows = ordered(pages)
    names = ["task", "host", "path", "row", "lines", "kinds"]

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ends = None, []

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal task
            for b in batches:
                if b.num_rows:
                    task = b.column(0)[0].as_py()
                    yield b

        for run in runs_of(watched()):
            ends = [*ends[:1], run]
        for x in ends:
            for at in (0, -1):
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((task, x.host, x.paths[at], x.rows[at], x.lines, x.kinds), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    ends: dict[int, list[Run]] = {}
    for r in rows.mapInArrow(edge, rows.schema).collect():
        ends.setdefault(r["task"], []).append(Run(r["host"], bytes(r["lines"]), bytes(r["kinds"]), [r["path"]], [r["row"]]))
    order = sorted(ends)
    linked = {}
    for k, task in enumerate(order):
        first, last = ends[task][0], ends[task][-1]
        before = next((x for t in order[:k][::-1] for x in ends[t][::-1] if (x.host, x.lines) != (first.host, first.lines)), None)
        after = next((x for t in order[k + 1 :] for x in ends[t] if (x.host, x.lines) != (last.host, last.lines)), None)
        linked[task] = before, after
    shared = pages.sparkSession.sparkContext.broadcast(linked)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal task
            for b in batches:
                if b.num_rows:
                    task = b.column(0)[0].as_py()
                    yield b

        before = own = None
        for run in runs_of(watched()):
            if own is not None:
                yield _gone(own.deleted(before, run))
            before, own = (shared.value[task][0] if own is None else own), run
        if own is not None:
            yield _gone(own.deleted(before, shared.value[task][1]))

    return rows.mapInArrow(link, "row bigint, gone array<int>")


def _gone(rows: Iterator[tuple[int, list[int]]]) -> pa.RecordBatch:
    found = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int32()))], names=["row", "gone"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row a page: page_id, url, text (blocks parted by an empty line), n_chars; n_lines of the page, and n_shared of them,
    which differencing has deleted.

    Pages are parsed twice, for their lines' hashes and for their text: to carry the text of all lines through the
    shuffle would take more disk than the pages themselves.
    """
    small_batches(pages.sparkSession)
    rows = pick(pages, page_id, url, html).toDF("page_id", "url", "html").withColumn("row", F.xxhash64("page_id", "url", "html"))
    gone = cut(shared_with_neighbour(rows.select("row", "url", "html")))
    size = gone.agg(F.sum(F.size("gone") * 4 + 16)).first()[0] or 0
    found = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, "row", "left").select("page_id", "url", "html", "gone")

    def text(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, n, lost = [], [], []
        for source, places in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            lines, kinds = lines_of(source)
            out.append("\n\n".join(text_of(lines, kinds, places or [])))
            n.append(len(lines))
            lost.append(len(places or []))
        made = [pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in out], n, lost))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])

    return _map(found, 2, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint", text)
