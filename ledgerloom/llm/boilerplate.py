"""The main body of web pages, by differencing pages with their nearest neighbours by URL.

Pages of one host are ordered by URL path.  Each is compared with the pages next to it: their text lines, with figures,
dates and the host's own name masked, are aligned by longest common subsequence.  A line that keeps being shared between
neighbours of its host is deleted from all pages of the host.

Links to other pages, breadcrumbs and bylines name somebody else on every page, so no line of theirs is shared.  What
the differences say of places decides these: a line's form is the line with names masked too, and a form of which a good
part stands before the title or in containers that mostly consist of shared lines is furniture, and so is one that always
stands right below the title.  Headings go with the lines of their container.  Last, a tie-break: what is left must stand in
the container of the page's title.  README.md has the share of each step.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.splitting import SPACE
from ledgerloom.storage import settle, spread

TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<![^>]*>", re.S)
SKIP = re.compile(r"<(script|style|noscript|template|svg)\b.*?</\1\s*>", re.S | re.I)
BLOCK = re.compile(r"""\bdata-b\s*=\s*["']?(\d+)""", re.I)
# Elements that hold blocks, and those that end a table cell's text.
CONTAINERS = frozenset("div section article main aside nav header footer form td th body".split())
NESTING = CONTAINERS | {"table", "tr", "ul", "ol", "tbody", "thead", "dl"}
CELLS = frozenset(["td", "th"])
INLINE = frozenset("b i em strong span a u small font sub sup mark code".split())

MONTH = "(?:jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec|january|february|march|april|august|september|october|november|december)"
MARKS = re.compile(r"[\W_]+")
FORM = re.compile(r"[^\w|:›%]+")
DATE = re.compile(rf"\d{{1,2}}(?:(?:\s+{MONTH}\s+|[-/]\d{{1,2}}[-/])\d{{4}}|\d\d-\d\d-\d\d)\b|\b(?:{MONTH})\s+(?:\d{{1,2}},?\s+)?\d{{4}}\b", re.I)
NUMBER = re.compile(r"(?:(?:\bRs\.?|\bINR|[₹$€£]) ?)?\d(?:[\d,.]*\d)?")
NAMES = re.compile(r"[A-Z][A-Za-z]*(?:\s*[-–&]\s*[A-Z][A-Za-z]*|\s+[A-Z][A-Za-z]*)*")
DIGIT = re.compile(r"\d")
WHITE = re.compile(f"[{SPACE}]+")
SPACES = "".join(c for c in map(chr, range(0x3001)) if WHITE.match(c))
NOT_ALNUM = bytes(c for c in range(128) if not chr(c).isalnum())
NOT_FORM = bytes(c for c in NOT_ALNUM if chr(c) not in "_|:%")
LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))

HEADING, TITLE, INSIDE, BEFORE, BELOW = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class Diff:
    """Each page is compared with the ``reach`` next ones of its host by URL.

    A line is shared furniture of its host from ``pairs`` comparisons and that part (``shared``) of all comparisons of pages that have it
    on, or from ``mostly`` of them, however few; with fewer here if the hosts where it is shared have it in ``backing`` comparisons
    and ``backed`` of all.  A container is furniture from that part of shared lines (``container``).  A form is furniture if
    ``outside`` of its lines, ``least`` at least, stand before titles or in such containers, or ``below`` of them, ``often`` at least,
    right below the title.
    """

    reach: int = 4
    pairs: int = 3
    shared: float = 0.01
    mostly: float = 0.5
    backing: int = 7
    backed: float = 0.02
    container: float = 0.4
    outside: float = 0.2
    least: int = 4
    below: float = 0.9
    often: int = 10


def squeeze(text: str) -> str:
    """White space collapsed; Python's is the class ``SPACE``."""
    return " ".join(text.split())


def mark(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def brand(site: str | None) -> tuple[str, re.Pattern] | None:
    """The host's own name, however it is spaced: the first label without www; and how it begins."""
    label = re.sub(r"^www\.", "", (site or "").lower()).split(".")[0]
    parts = [p for p in label.split("-") if p]
    return (parts[0], re.compile(r"[\s-]*".join(map(re.escape, parts)), re.I)) if parts else None


def _flat(text: str, drop: bytes, pattern: re.Pattern) -> str:
    if text.isascii():
        return text.encode().translate(LOWER, drop).decode()
    return pattern.sub("", text).lower()


def forms(text: str, own: tuple[str, re.Pattern] | None) -> tuple[str, str]:
    """The line with figures, dates and the host's name masked; and with all names masked too.

    >>> forms("* Join 52,401 readers of Site One by 3 Mar 2024", brand("site-one.example"))[0]
    'join0readersofsby0d'
    """
    if own is not None and own[0] in text.lower():
        text = own[1].sub(" s ", text)
    if DIGIT.search(text):
        text = NUMBER.sub("0", DATE.sub(" 0d ", text))
    flat = _flat(text, NOT_ALNUM, MARKS)
    if text.islower() or text.isupper():
        return flat, flat
    first = len(text) - len(text.lstrip(" *»›-"))

    def name(m: re.Match) -> str:
        return m[0] if m.start() == first and m[0].isalpha() else " _N_ "

    return flat, _flat(NAMES.sub(name, text), NOT_FORM, FORM)


def blocks(page: str, title: str | None = None) -> list[tuple[int, int, int, str]]:
    """(number, flags, container, text) of the numbered blocks of a page, in page order; unclosed elements end where the next begins.

    A block is inside if its nearest container is that of the title: the first h1, else the first heading that repeats
    the page's title, else the first heading.
    """
    page = SKIP.sub("", page)
    found = []  # number, tag, container, text
    stack: list[tuple[str, int]] = []
    count, at, begun, cell = 0, 0, None, False
    depth = 0  # elements of the block's own tag within it
    text: list[str] = []
    head: list[str] | None = None

    def end() -> None:
        nonlocal begun
        if begun is not None:
            got = "".join(text)
            found.append((*begun, squeeze(html.unescape(got) if "&" in got else got)))
        begun = None

    for m in TAG.finditer(page):
        here = m.start()
        if here > at:
            if begun is not None:
                text.append(page[at:here])
            elif head is not None:
                head.append(page[at:here])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE and begun is not None and tag != begun[1] and "data-b" not in m[3]:
            continue
        if tag == "title":
            head = [] if not m[1] else head
            if m[1] and head is not None and title is None:
                title = squeeze(html.unescape("".join(head)))
            if m[1]:
                head = None
            continue
        if m[1]:
            if begun is not None and tag == begun[1]:
                depth -= 1
                if depth < 0:
                    end()
            elif tag in NESTING and not (begun is not None and tag in CELLS):
                if any(t == tag for t, _ in stack):
                    end()
                    while stack.pop()[0] != tag:
                        pass
            continue
        if b := BLOCK.search(m[3]):
            end()
            where = next((c for t, c in reversed(stack) if c), 0)
            begun, text, cell, depth = (int(b[1]), tag, where), [], False, 0
        elif begun is not None and begun[1] == "tr" and tag in CELLS:
            if cell:
                text.append(" | ")
            cell = True
        elif tag == "br" and begun is not None:
            text.append(" ")
        elif begun is not None and tag == begun[1] and tag not in NESTING:
            depth += 1
        elif tag in NESTING:
            end()
            count += 1
            stack.append((tag, count if tag in CONTAINERS else 0))
    if begun is not None and at < len(page):
        text.append(page[at:])
    end()
    heads = [i for i, b in enumerate(found) if re.fullmatch("h[1-6]", b[1])]
    top = next((i for i in heads if found[i][1] == "h1"), None)
    if top is None:
        top = next((i for i in heads if title and found[i][3] == title), heads[0] if heads else None)
    out, below = [], False
    for i, (n, tag, where, t) in enumerate(found):
        if not t:
            continue
        flags = HEADING * (tag[0] == "h" and tag[1:].isdigit())
        if top is not None:
            flags |= BEFORE * (i < top) | TITLE * (i == top) | BELOW * below | INSIDE * (i >= top and where == found[top][2])
            below = i == top
        out.append((n, flags, where, t))
    return out


_PAGE = [("doc_id", pa.string()), ("site", pa.string()), ("path", pa.string()), ("pos", pa.list_(pa.int32())), ("flags", pa.list_(pa.int8())), ("part", pa.list_(pa.int32())), ("line", pa.list_(pa.int64())), ("form", pa.list_(pa.int64())), ("text", pa.list_(pa.int64()))]
_DDL = "doc_id string, site string, path string, pos array<int>, flags array<tinyint>, part array<int>, line array<long>, form array<long>, text array<long>"


def parse(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a page: its host, URL path and blocks as arrays of numbers, flags, containers and hashes; empty blocks are left out.

    Null pages are left out; a page without a known URL is its own host's only page.  A page that landed again with
    the same text is dropped later, where equal pages meet.
    """
    where = sources.where(F.col("doc_id").isNotNull() & F.coalesce("url", "site").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("url", "site")).alias("s")).select("doc_id", "s.url", "s.site")
    rows = spread(pages.where(F.col("doc_id").isNotNull() & F.col("html").isNotNull()).select("doc_id", "html")).join(where, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        brands: dict[str, tuple[str, re.Pattern] | None] = {}
        known: dict[tuple[str, str], tuple[int, int, int]] = {}  # short lines come again and again

        def marks(text: str, host: str) -> tuple[int, int, int]:
            if got := known.get((host, text)):
                return got
            line, form = forms(text, brands[host])
            got = mark(line), mark(form), mark(text)
            if len(text) < 80:
                if len(known) > 50_000:
                    known.clear()
                known[host, text] = got
            return got

        for b in batches:
            for a in range(0, b.num_rows, 500):
                out = []
                for doc, page, url, site in zip(*(c.to_pylist() for c in b.slice(a, 500).columns), strict=True):
                    try:
                        parts = urlsplit((url or "").strip())
                    except ValueError:
                        parts = urlsplit("")
                    host = (site or parts.hostname or "").lower()
                    if host not in brands:
                        brands[host] = brand(host)
                    got = blocks(page)
                    kinds = [marks(t, host) for *_, t in got]
                    out.append((doc, host, parts.path.rstrip("/").lower(), *([x[k] for x in got] for k in range(3)), *([x[k] for x in kinds] for k in range(3))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_PAGE)], schema=pa.schema(_PAGE))

    return rows.mapInArrow(run, _DDL)


def common(a: list[int], b: list[int], both: set[int] | None = None) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``: the longest rising chain of matches.

    ``both``: the values in both, if known.
    """
    both = set(a) & set(b) if both is None else both
    spots = defaultdict(list)
    for j, x in enumerate(b):
        if x in both:
            spots[x].append(j)
    tails: list[int] = []
    chain: list[tuple[int, int]] = []  # position in a, link to the match before
    ends: list[int] = []
    for i, x in enumerate(a):
        for j in reversed(spots.get(x, ())):
            k = bisect_left(tails, j)
            chain.append((i, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append(len(chain) - 1)
            else:
                tails[k], ends[k] = j, len(chain) - 1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(chain[at][0])
        at = chain[at][1]
    return out[::-1]


def differences(parsed: DataFrame, diff: Diff = Diff()) -> DataFrame:
    """(site, line, n, hits), summed per partition: in n comparisons one of the pages had the line, in hits both, in one alignment.

    A host of any size is cut into ranges of its URLs, so no task holds a whole host; pages at the seams have neighbours on
    one side only.  Headings are no lines here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        hits: Counter = Counter()
        near: list[tuple] = []
        host, last = None, None

        def give() -> pa.RecordBatch:
            keys = list(n)
            out = pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array([n[k] for k in keys], pa.int64()), pa.array([hits[k] for k in keys], pa.int64())], names=["site", "line", "n", "hits"])
            n.clear()
            hits.clear()
            return out

        for b in batches:
            for doc, site, flags, line in zip(*(c.to_pylist() for c in b.select(["doc_id", "site", "flags", "line"]).columns), strict=True):
                line = [x for f, x in zip(flags, line, strict=True) if not f & HEADING]
                if (doc, line) == last:
                    continue  # landed again
                last = doc, line
                if n and (site != host or len(n) > 500_000):
                    yield give()
                host, mine = site, set(line)
                near = [p for p in near if p[0] == site and p[1] != doc][-diff.reach :]
                for _, _, other, theirs in near:
                    both = mine & theirs
                    n.update(mine)
                    n.update(theirs - both)
                    if both:  # only lines that both have can be aligned
                        hits.update({line[i] for i in common(line, other, both)})
                near.append((site, doc, line, mine))
        if n:
            yield give()

    rows = parsed.select("doc_id", "site", "path", "flags", "line").repartitionByRange("site", "path", "doc_id").sortWithinPartitions("site", "path", "doc_id")
    return rows.mapInArrow(run, "site string, line long, n long, hits long")


def shared_lines(parsed: DataFrame, diff: Diff = Diff()) -> DataFrame:
    """(site, line) of the lines that the differences delete from the pages of a host."""
    sums = differences(parsed, diff).groupBy("site", "line").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where("hits > 0")
    line = Window.partitionBy("line")  # of each line at most a row a host
    sums = sums.withColumns({"all_n": F.sum("n").over(line), "all_hits": F.sum("hits").over(line)})
    share = F.col("hits") / F.col("n")
    often = (F.col("hits") >= diff.pairs) & (share >= diff.shared)
    backed = (F.col("all_hits") >= diff.backing) & (F.col("all_hits") / F.col("all_n") >= diff.backed)
    return sums.where(often | (share >= diff.mostly) | backed).select("site", "line")


def _of_site(pages: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``pages`` with ``gone``: the keys of furniture of the page's host, each line of which is on a good part of its pages, so few."""
    lists = gone.groupBy("site").agg(F.collect_list(key).alias("gone"))
    return pages.join(lists, "site", "left")


class _Sets:
    """Sets of the lists of hosts; the last ones are kept."""

    def __init__(self):
        self.known: dict[str | None, frozenset] = {}

    def of(self, site: str | None, values: pa.ListScalar) -> frozenset:
        if site not in self.known:
            if len(self.known) > 100:
                self.known.clear()
            self.known[site] = frozenset(values.as_py() or ())
        return self.known[site]


_OPEN = [("doc_id", pa.string()), ("site", pa.string()), ("pos", pa.list_(pa.int32())), ("flags", pa.list_(pa.int8())), ("part", pa.list_(pa.int32())), ("form", pa.list_(pa.int64())), ("text", pa.list_(pa.int64())), ("without", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("zone", pa.list_(pa.int64())), ("below", pa.list_(pa.int64()))]


def open_blocks(parsed: DataFrame, gone: DataFrame, diff: Diff = Diff()) -> DataFrame:
    """Pages without their shared lines (``pos`` to ``text``; ``without``: the texts taken out), and rows without doc_id: for each host
    and form of the lines left, ``n`` of them, how many stand before a title or in a container of mostly shared lines (``zone``),
    and how many right ``below`` the title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = _Sets(), {}

        def give() -> pa.RecordBatch:
            by: dict = defaultdict(list)
            for (site, form), c in counts.items():
                by[site].append((form, *c))
            counts.clear()
            cols = [[None] * len(by), list(by)] + [[None] * len(by)] * 3 + [[[x[0] for x in v] for v in by.values()]] + [[None] * len(by)] * 2 + [[[x[k] for x in v] for v in by.values()] for k in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _OPEN, strict=True)], schema=pa.schema(_OPEN))

        for b in batches:
            lists = b.column("gone")
            out = []
            for i, (doc, site, pos, flags, part, line, form, text) in enumerate(zip(*(c.to_pylist() for c in b.select(["doc_id", "site", "pos", "flags", "part", "line", "form", "text"]).columns), strict=True)):
                cut = sets.of(site, lists[i])
                keep = [k for k, x in enumerate(line) if flags[k] & HEADING or x not in cut]
                whole, left = Counter(p for p, f in zip(part, flags, strict=True) if not f & HEADING), Counter(part[k] for k in keep if not flags[k] & HEADING)
                kept = set(keep)
                for k in keep:
                    if not flags[k] & HEADING:
                        c = counts.setdefault((site, form[k]), [0, 0, 0])
                        c[0] += 1
                        c[1] += bool(flags[k] & BEFORE) or left[part[k]] < (1 - diff.container) * whole[part[k]]
                        c[2] += bool(flags[k] & BELOW)
                out.append((doc, site, *([x[k] for k in keep] for x in (pos, flags, part, form, text)), [x for k, x in enumerate(text) if k not in kept], None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(_OPEN)], schema=pa.schema(_OPEN))
            if len(counts) > 300_000:
                yield give()
        yield give()

    rows = _of_site(parsed.select("doc_id", "site", "pos", "flags", "part", "line", "form", "text"), gone, "line")
    return rows.mapInArrow(run, "doc_id string, site string, pos array<int>, flags array<tinyint>, part array<int>, form array<long>, text array<long>, without array<long>, n array<long>, zone array<long>, below array<long>")


def furniture_forms(opened: DataFrame, diff: Diff = Diff()) -> DataFrame:
    """(site, form) of the forms that are furniture, with each host that has them.  A form has no host's own words, so the evidence
    of all hosts is added up."""
    counts = opened.where("doc_id is null").select("site", F.inline(F.arrays_zip("form", "n", "zone", "below"))).groupBy("site", "form").agg(*(F.sum(c).alias(c) for c in ("n", "zone", "below")))
    form = Window.partitionBy("form")  # of each form at most a row a host
    sums = counts.select("site", "form", *(F.sum(c).over(form).alias(c) for c in ("n", "zone", "below")))
    outside = (F.col("zone") >= diff.least) & (F.col("zone") >= diff.outside * F.col("n"))
    return sums.where(outside | ((F.col("n") >= diff.often) & (F.col("below") >= diff.below * F.col("n")))).select("site", "form")


@dataclass(frozen=True)
class Bodies:
    """``pages`` (doc_id, pos, kept, dropped): the numbers of each page's main blocks, the texts, as hashes, of these and of all others;
    ``parsed``, ``lines`` and ``forms`` for further lines."""

    pages: DataFrame
    parsed: DataFrame
    lines: DataFrame
    forms: DataFrame

    @property
    def blocks(self) -> DataFrame:
        """(doc_id, pos) of the main bodies' blocks."""
        return self.pages.select("doc_id", F.explode("pos").alias("pos")).distinct()


def main_bodies(pages: DataFrame, sources: DataFrame, diff: Diff = Diff(), tie_break: bool = True) -> Bodies:
    """The blocks of each page's main body.  A page of which only headings are left, such as one that asks for consent, has none.

    ``tie_break``: what the differences leave must stand in the container of the page's title.
    """
    parsed = settle(parse(pages, sources), "pages")
    lines = settle(shared_lines(parsed, diff), "lines")
    opened = settle(open_blocks(parsed, lines, diff), "open")
    gone = settle(furniture_forms(opened, diff), "forms")
    schema = pa.schema([("doc_id", pa.string()), ("pos", pa.list_(pa.int32())), ("kept", pa.list_(pa.int64())), ("dropped", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for b in batches:
            lists, out = b.column("gone"), []
            for i, (doc, site, pos, flags, part, form, text, without) in enumerate(zip(*(c.to_pylist() for c in b.select(["doc_id", "site", "pos", "flags", "part", "form", "text", "without"]).columns), strict=True)):
                cut = sets.of(site, lists[i])
                body = {k for k, f in enumerate(flags) if not f & HEADING and form[k] not in cut and (f & INSIDE or not tie_break)}
                live = {part[k] for k in body}
                body |= {k for k, f in enumerate(flags) if f & HEADING and body and (f & TITLE or part[k] in live and not f & BEFORE)}
                kept = {text[k] for k in body}
                out.append((doc, [pos[k] for k in sorted(body)], sorted(kept), sorted({*text, *without} - kept)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = _of_site(opened.where("doc_id is not null").select("doc_id", "site", "pos", "flags", "part", "form", "text", "without"), gone, "form")
    return Bodies(settle(rows.mapInArrow(run, "doc_id string, pos array<int>, kept array<long>, dropped array<long>"), "bodies"), parsed, lines, gone)


def main_lines(sections: DataFrame, bodies: Bodies) -> DataFrame:
    """(doc_id, sec_ord, ln) of the section lines that belong to the main body; blank ones don't.

    A line is kept if its page keeps a block with that text.  A line that its page doesn't have, or whose page is
    missing, is judged by the shared lines of its host and by its form.
    """
    # a page may have landed more than once; a text that any of its copies keeps is kept
    state = bodies.pages.groupBy("doc_id").agg(F.flatten(F.collect_set("kept")).alias("kept"), F.flatten(F.collect_set("dropped")).alias("dropped"))
    texts = sections.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "sec_ord", "site", "text").join(state, "doc_id", "left")
    flat = F.translate("text", SPACES.replace("\n", ""), " " * (len(SPACES) - 1))
    squeezed = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    lines = F.transform(F.split(squeezed, "\n", -1), lambda x: F.trim(x))
    rows = texts.select("doc_id", "sec_ord", "site", "kept", "dropped", F.posexplode(lines).alias("ln", "line")).where(F.col("line") != "")
    has = lambda name: F.coalesce(F.array_contains(name, F.xxhash64("line")), F.lit(False))
    judged = rows.select("doc_id", "sec_ord", "ln", "site", F.when(has("kept"), True).when(has("dropped"), False).alias("kept"), "line").where(F.coalesce("kept", F.lit(True)))
    # the text of a line goes on only where its page doesn't have it
    judged = settle(judged.select("doc_id", "sec_ord", "ln", "site", "kept", F.when(F.col("kept").isNull(), F.col("line")).alias("line")), "lines")
    there, loose = judged.where("kept").select("doc_id", "sec_ord", "ln"), judged.where("kept is null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [(s or "").lower() for s in b.column(3).to_pylist()]
            got = [forms(t, brand(s)) for t, s in zip(b.column(4).to_pylist(), hosts, strict=True)]
            out = [*b.columns[:3], pa.array(hosts, pa.string()), pa.array([mark(x[0]) for x in got], pa.int64()), pa.array([mark(x[1]) for x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "sec_ord", "ln", "site", "line", "form"])

    own = loose.select("doc_id", "sec_ord", "ln", "site", "line").mapInArrow(run, "doc_id string, sec_ord int, ln int, site string, line long, form long")
    kept = own.join(bodies.lines, ["site", "line"], "left_anti").join(bodies.forms.select("form").distinct(), "form", "left_anti")
    return there.unionByName(kept.select("doc_id", "sec_ord", "ln")).distinct()
