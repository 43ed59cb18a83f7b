"""Main text of HTML pages by differencing with the nearest page of the same host.

A page becomes lines, one a block element. Pages of a host are ordered by the segments of
their URL path, so that the one with most leading segments in common is a neighbour; a
page is aligned with it by the longest common subsequence of all their lines, and lines
that they share are deleted: menus, headers, footers and whatever else the host repeats,
however it is marked. Pages of a host with equal lines count as one. A partner that shares
most of the page's text may be a near copy of it, or a different page whose furniture is
most of its text; what tells them apart is how many of the host's pages have each line. A
line weighs its length times the logarithm of how few they are, a near copy shares most of
the weight too, and the search goes outwards until a page is met that is not one.

Markup settles what differencing cannot. It protects lines that are inside a main
container (``article``, ``main``, ...) on both pages, such as a passage that two articles
quote, and it drops furniture that no other page has: an advert, a form, a reader's
comment.

Only line hashes travel between pages, and only texts that lose a line are shuffled.
Neighbours come from positions in one range sort over all hosts, so a host of any size is
spread over many tasks.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bitmap_of, in_bitmap, join_totals, materialise

DROPPED, INSIDE, OTHER = 0, 1, 2
#: A near copy shares this part of the text and of the information; positions tried at once on either side of a run.
COPY, REACH = 0.8, 4

# HTML element names and the usual names of page furniture.
RAW = "script style noscript textarea title iframe".split()
#: Left out with all they hold, if they end inside of what they began in; others are only tags.
UNREAD = frozenset("template svg object select button math canvas audio video".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form head menu dialog fieldset".split())
MAIN_NAMES = frozenset("content article post entry story main maincontent body-text articlebody".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|adslot|adsense|banner\w*|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|sidebar\w*|"
    r"widget\w*|footer\w*|header|masthead|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|newsletter\w*|subscri\w*|signup|"
    r"share|sharing|social\w*|related\w*|recommend\w*|comment\w*|disqus\w*|repl(?:y|ies)|login|search\w*|copyright|pagination|pager|toolbar|"
    r"contentinfo|complementary|hidden|skip-?link)(?:$|[-_ ])"
)
PREFIXED = re.compile(r"^(?:has|with|no|is|without)[-_]")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|$))", re.I)


def marks(name: str, attrs: str) -> tuple[bool, bool]:
    """(is furniture, is a main container) of an element."""
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attrs)} if "=" in attrs or "hidden" in attrs.lower() else {}
    names = [x for k in ("class", "id", "role") for x in values.get(k, "").split()]
    main = name in ("article", "main") or "main" in values.get("role", "") or any(x in MAIN_NAMES for x in names)
    shown = not ("hidden" in values or re.search(r"display\s*:\s*none", values.get("style", "")))
    named = name not in ("body", "html", "main") and any(FURNITURE_NAMES.search(x) and not PREFIXED.match(x) for x in names)
    return name in FURNITURE or named or not shown, main and not named


def unread(tokens: list) -> dict[int, int]:
    """Start -> end of each element of UNREAD that is closed before what holds it is."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in tokens:
        name = (m["name"] or m["name2"] or "").lower()
        if m["end"] or m["end2"]:
            if any(x[0] == name for x in reversed(stack)):
                while (old := stack.pop())[0] != name:
                    pass
                if name in UNREAD:
                    out[old[1]] = m.end()
        elif name and name not in VOID and not (name in FOREIGN and m[0].endswith("/>")):
            stack.append((name, m.start()))
    return out


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """A page's lines in order, and the kind of each; dropped lines are kept for alignment."""
    page = page or ""
    lines, kinds, parts = [], [], []
    stack: list[list] = []  # name, furniture, container
    furniture = container = 0
    seen_main = False

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(text)
                kinds.append(DROPPED if furniture else INSIDE if container else OTHER)

    at = 0
    tokens = list(TOKEN.finditer(page))
    left_out = unread(tokens) if any((m["name"] or m["name2"] or "").lower() in UNREAD for m in tokens) else {}
    for m in tokens:
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = left_out.get(m.start(), m.end())
        name = (m["name"] or m["name2"] or "").lower()
        if not name or name in UNREAD:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m["end"] or m["end2"]:
            if any(x[0] == name for x in reversed(stack)):
                while True:
                    old = stack.pop()
                    furniture -= old[1]
                    container -= old[2]
                    if old[0] == name:
                        break
        elif name not in VOID:
            drop, main = marks(name, m["attrs"] or "")
            if name == "header":
                drop = drop or not container
            if name == "body" or (main and not seen_main and name in ("article", "main")):
                for x in stack:  # what is still open before the first article was never closed
                    furniture, x[1] = furniture - x[1], False
            seen_main = seen_main or (main and name in ("article", "main"))
            stack.append([name, drop, main])
            furniture += drop
            container += main
    if at < len(page):
        parts.append(page[at:])
    flush()
    return lines, kinds


def place_of(url: str | None) -> tuple[str | None, str]:
    """(host, path) of a URL; no host: the page has no partner."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m and m[1] else (None, "")


def row_lengths(a: list, masks: dict, width: int) -> list[int]:
    """Bit vectors of the LCS table's rows: bit j is 0 where row's length rises at column j."""
    full = (1 << width) - 1
    v, out = full, []
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def masks_of(b: list) -> dict:
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def last_row(a: list, b: list) -> np.ndarray:
    """LCS lengths of a with every prefix of b."""
    v = row_lengths(a, masks_of(b), len(b))[-1]
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_lines(a: list, b: list, cells: int = 50_000_000) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence.

    Bit-parallel rows; a table of more than ``cells`` cells is halved where an optimal
    path crosses its middle row, so memory stays bounded for pages of any length.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        if len(x) * len(y) > cells and len(x) > 1:
            half = len(x) // 2
            cut = int((last_row(x[:half], y) + last_row(x[half:][::-1], y[::-1])[::-1]).argmax())
            pairs = common_lines(x[:half], y[:cut], cells)
            pairs += [(i + half, j + cut) for i, j in common_lines(x[half:], y[cut:], cells)]
        else:
            rows, pairs, i, j = row_lengths(x, masks_of(y), len(y)), [], len(x), len(y)
            while i and j:
                if x[i - 1] == y[j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
            pairs.reverse()
        out += [(head + i, head + j) for i, j in pairs]
    return out + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def content_kind(kinds: list[int]) -> int:
    return INSIDE if INSIDE in kinds else OTHER


def information(sizes: list[int], hashes: list[int], known: dict[int, int], pages: int) -> list[float]:
    """What each line says of its page: its length, times the logarithm of how few of the host's pages have it."""
    return [n * math.log((pages + 1) / known.get(h, 1)) for n, h in zip(sizes, hashes)]


def share(weights: list[float], content: list[int], shared: set[int]) -> float:
    """The part of the content's weight that is shared."""
    total = sum(weights[i] for i in content)
    return sum(weights[i] for i in content if i in shared) / total if total else 0.0


def compared(kinds: list[int], sizes: list[int], hashes: list[int], weights: list[float] | None, other: list[int], other_kinds: list[int]) -> tuple[bool, set[int]]:
    """(whether the other page is a near copy, the places of the page's lines that differencing with it deletes).

    A near copy shares most of the content's text, and, as far as ``weights`` are known,
    most of what the content says. All shared lines are deleted, but for what is inside a
    main container on both pages.
    """
    pairs = common_lines(hashes, other)
    shared = {i for i, _ in pairs}
    content = [i for i, k in enumerate(kinds) if k == content_kind(kinds)]
    near = share(sizes, content, shared) >= COPY and (weights is None or share(weights, content, shared) >= COPY)
    return near, {i for i, j in pairs if kinds[i] != INSIDE or other_kinds[j] != INSIDE}


def main_text(lines: list[str], kinds: list[int], gone: set[int] = frozenset()) -> str:
    """The page's text without the lines at the places ``gone``."""
    return "\n\n".join(x for i, x in enumerate(lines) if kinds[i] == content_kind(kinds) and i not in gone)


def packed(lines: list[str], kinds: list[int]) -> bytes:
    """A line in eight bytes: 62 bits of its hash, and its kind."""
    return np.array([xxhash.xxh64_intdigest(x) & ~3 | k for x, k in zip(lines, kinds)], "<u8").tobytes()


def unpacked(codes: bytes) -> tuple[list[int], list[int]]:
    """(hashes, kinds) of packed lines."""
    x = np.frombuffer(codes, "<u8")
    return (x >> np.uint64(2)).tolist(), (x & np.uint64(3)).astype(int).tolist()


PARSED = "id long, url string, host string, path string, lines array<string>, kinds array<int>, codes binary, sizes binary"


def parsed(pages: DataFrame, html: str, id: str, url: str) -> DataFrame:
    """A row a page, with ``key``: pages of a host with equal lines share it."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 200):
                ids, urls, sources = (c.slice(k, 200) for c in b.columns)
                both = [lines_of(x) for x in sources.to_pylist()]
                places = [place_of(u) for u in urls.to_pylist()]
                codes = [packed(*x) for x in both]
                sizes = [np.array([len(x) for x in lines], "<u4").tobytes() for lines, _ in both]
                shown = [[t if kind != DROPPED else "" for t, kind in zip(*x)] for x in both]
                columns = [ids, urls, pa.array([p[0] for p in places], pa.string()), pa.array([p[1] for p in places], pa.string()),
                           pa.array(shown, pa.list_(pa.string())), pa.array([x[1] for x in both], pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(sizes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PARSED.split(", ")])

    rows = pages.select(F.col(id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return rows.mapInArrow(run, PARSED).withColumn("key", F.xxhash64("host", "codes"))


def placed(rows: DataFrame) -> DataFrame:
    """(part, key, host, path, at): one row a host's distinct page, numbered in order of host and path.

    Of pages with equal lines the first in path order stands for all.
    """
    first = F.min(F.struct(F.translate("path", "/", "\u0001").alias("order"), "id", "path")).alias("x")
    light = rows.where(F.col("host").isNotNull()).groupBy("host", "key").agg(first).select("key", "host", "x.order", "x.path", "x.id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "order", "id", "key"]
    dealt = light.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("mono", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"part": F.shiftright("mono", 33), "row": F.col("mono").bitwiseAND((1 << 33) - 1)})
    dealt = materialise(dealt.select("part", "row", "key", "host", "path"), "pages-order")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a part
    offsets = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return materialise(dealt.join(F.broadcast(offsets), "part").select("part", "key", "host", "path", (F.col("row") + F.col("offset")).alias("at")), "pages-index")


def partners_at(todo: DataFrame, index: DataFrame, codes: DataFrame) -> DataFrame:
    """(key, partners): of the pages ``todo`` (index rows with ``targets``), the pages of their host
    at those positions as an array of (far, step, other), the nearest first."""
    wanted = todo.select("key", "host", "path", F.col("at").alias("own"), F.explode("targets").alias("at"))
    held = index.select("at", "host", F.col("key").alias("partner"), F.col("path").alias("partner_path"))
    # Nearness: leading path segments in common, then distance in path order.
    same = F.zip_with(F.split("path", "/"), F.split("partner_path", "/"), lambda a, b: a.eqNullSafe(b))
    leading = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same))
    step = F.col("at") - F.col("own")
    far = F.struct((-leading).alias("a"), F.abs(step).alias("b"), step.alias("step"))
    met = wanted.join(held, ["at", "host"]).select("key", "partner", far.alias("far")).join(codes.select(F.col("key").alias("partner"), F.col("codes").alias("other")), "partner")
    return met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("far", "other"))).alias("partners"))


def lines_by_page(own: DataFrame) -> DataFrame:
    """(key, line, hash), a row a distinct line of a page; ``line`` is the host's and the line's hash."""

    def run(batches):
        for b in batches:
            for key, site, codes in zip(*(c.to_pylist() for c in b.columns)):
                hashes = np.unique(np.frombuffer(codes, "<u8") >> np.uint64(2)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), key)), pa.array(np.full(len(hashes), site)), pa.array(hashes)], names=["key", "site", "hash"])

    found = own.select("key", F.xxhash64("host").alias("site"), "codes").mapInArrow(run, "key long, site long, hash long")
    return found.select("key", F.xxhash64("site", "hash").alias("line"), "hash")


def line_counts(doubtful: DataFrame, index: DataFrame, own: DataFrame) -> DataFrame:
    """(key, pages, hashes, counts): of doubtful pages, how many distinct pages their host has, and
    how many of them have each line that is not the page's alone."""
    hosts = index.join(doubtful, "key", "left_semi").select("host").distinct()
    sized = index.join(hosts, "host", "left_semi")
    pages = sized.groupBy("host").agg(F.count("*").alias("pages"))
    lines = lines_by_page(own.join(hosts, "host", "left_semi"))
    counts = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    asked = lines_by_page(own.join(doubtful, "key", "left_semi"))
    known = join_totals(asked, counts, "line").groupBy("key").agg(F.collect_list(F.struct("hash", "n")).alias("x"))
    light = index.join(doubtful, "key", "left_semi").select("key", "host").join(pages, "host").select("key", "pages").join(known, "key", "left")
    return light.select("key", "pages", F.col("x.hash").alias("hashes"), F.col("x.n").alias("counts"))


TRIED = "key long, shared int, gone array<int>, open boolean, left boolean, right boolean"


def tried(rows: DataFrame) -> DataFrame:
    """Differencing of (key, codes, sizes, partners) and, if known, (pages, hashes, counts).

    ``shared`` lines go, of them those at ``gone`` are content; ``open``: it is not settled,
    as all partners are near copies, or the nearest looks like one and the counts are not
    known. ``left`` and ``right``: the page before or after is a near copy.
    """
    known = "pages" in rows.columns

    def run(batches):
        for b in batches:
            out = []
            for i in range(len(b)):
                key, codes, sizes, partners, *rest = (b.column(k)[i].as_py() for k in range(b.num_columns))
                (hashes, kinds), sizes = unpacked(codes), np.frombuffer(sizes, "<u4").tolist()
                weights = information(sizes, hashes, dict(zip(rest[1] or [], rest[2] or [])), rest[0]) if known else None
                chosen, beside = None, {-1: False, 1: False}
                for p in partners:
                    if chosen is None or p["far"]["step"] in beside and known:
                        near, gone = compared(kinds, sizes, hashes, weights, *unpacked(p["other"]))
                        if near and not known:
                            break
                        chosen = gone if chosen is None and not near else chosen
                        beside[p["far"]["step"]] = near
                shown = None if chosen is None else sorted(i for i in chosen if kinds[i] == content_kind(kinds))
                out.append({"key": key, "shared": None if chosen is None else len(chosen), "gone": shown, "open": chosen is None, "left": beside[-1], "right": beside[1]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("shared", pa.int32()), ("gone", pa.list_(pa.int32())), ("open", pa.bool_()), ("left", pa.bool_()), ("right", pa.bool_())]))

    names = ["key", "codes", "sizes", "partners", *(["pages", "hashes", "counts"] if known else [])]
    return rows.select(*names).mapInArrow(run, TRIED)


def runs(index: DataFrame, found: DataFrame) -> DataFrame:
    """The index with the first and the last position of each page's run: neighbours of which
    one takes the other for a near copy are of one run.

    A task goes through one range of positions; what crosses ranges comes from one row a range.
    """
    flags = index.join(found.select("key", "left", "right"), "key", "left")
    joined = lambda c: F.coalesce(c, F.lit(False))
    here = flags.select("part", "at", "key", "host", "path", joined(F.col("left")).alias("left"), joined(F.col("right")).alias("right"))
    order = W.partitionBy("part").orderBy("at")
    here = here.withColumns({"before": F.lag("right").over(order), "after": F.lead("left").over(order)})
    edges = here.groupBy("part").agg(F.min(F.struct("at", "left", "right")).alias("first"), F.max(F.struct("at", "left", "right")).alias("last"))
    parts = W.orderBy("part")  # a row a range
    edges = edges.select("part", F.lag("last.right").over(parts).alias("part_before"), F.lead("first.left").over(parts).alias("part_after"))
    here = here.join(F.broadcast(edges), "part")
    begins = ~(F.col("left") | joined(F.coalesce("before", "part_before")))
    stops = ~(F.col("right") | joined(F.coalesce("after", "part_after")))
    here = here.withColumns({"begin": F.when(begins, F.col("at")), "stop": F.when(stops, F.col("at"))})
    up, down = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("part").orderBy(F.col("at").desc()).rowsBetween(W.unboundedPreceding, 0)
    here = here.withColumns({"first": F.max("begin").over(up), "last": F.min("stop").over(down)})
    summed = here.groupBy("part").agg(F.max("begin").alias("b"), F.min("stop").alias("s"))
    outer = summed.select("part", F.max("b").over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("b"), F.min("s").over(parts.rowsBetween(1, W.unboundedFollowing)).alias("s"))
    here = here.join(F.broadcast(outer), "part")
    return here.select("key", "host", "path", "at", F.coalesce("first", "b").alias("first"), F.coalesce("last", "s").alias("last"))


def deletions(rows: DataFrame) -> DataFrame:
    """(key, shared, gone), of the distinct pages that share lines with their partner: how many
    are deleted, and the places of those that markup would have kept. Only line codes travel.

    The partner is the nearest of four neighbours that is not a near copy. Where a
    neighbour looks like one, the host's lines are counted first. Where all four are, the
    search goes on from both ends of the page's run, over every position, until a page is
    met that is not a near copy or the host ends.
    """
    index = placed(rows)
    own = rows.where(F.col("host").isNotNull()).select("key", "host", "codes", "sizes").dropDuplicates(["key"])
    steps = F.array(*(F.col("at") + k for k in (-1, 1, -2, 2)))
    first = materialise(tried(own.join(partners_at(index.withColumn("targets", steps), index, own), "key")), "pages-tried")
    found = [first]
    doubtful = materialise(first.where("open").select("key"), "pages-doubtful")
    if not doubtful.isEmpty():
        counts = materialise(line_counts(doubtful, index, own), "pages-counts")
        todo = index.join(doubtful, "key", "left_semi").withColumn("targets", steps)
        second = materialise(tried(own.join(partners_at(todo, index, own), "key").join(counts, "key")), "pages-tried")
        found.append(second)
        if not second.where("open").isEmpty():
            # Positions outwards from the run: REACH on either side at once.
            within = materialise(runs(index, second).join(second.where("open").select("key"), "key", "left_semi"), "pages-runs")
            bounds = index.groupBy("host").agg(F.min("at").alias("low"), F.max("at").alias("high"))
            todo, reach = materialise(within.join(bounds, "host"), "pages-todo"), 0
            while not todo.isEmpty():
                targets = F.array(*(x for k in range(1, REACH + 1) for x in (F.col("first") - reach - k, F.col("last") + reach + k)))
                asked = todo.withColumn("targets", F.filter(targets, lambda x: (x >= F.col("low")) & (x <= F.col("high"))))
                more = materialise(tried(own.join(partners_at(asked, index, own), "key").join(counts, "key")), "pages-tried")
                found.append(more)
                reach += REACH
                rest = todo.where((F.col("first") - reach > F.col("low")) | (F.col("last") + reach < F.col("high")))
                todo = materialise(rest.join(more.where("open").select("key"), "key", "left_semi"), "pages-todo")
    out = found[0].where("shared > 0")
    for more in found[1:]:
        out = out.unionByName(more.where("shared > 0"))
    return out.select("key", "shared", "gone")


def extract(pages: DataFrame, html: str = "html", id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, url, text), a row a page.

    Null and empty html have empty text; a page of any length is read whole. Pages without
    a host in their URL (null too) have no partner, as the only page of a host has none:
    markup alone decides there. Of equally near partners the one before in path order is
    taken. Repeated rows and copies get their rows, and other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    rows = materialise(parsed(pages, html, id, url), "pages-lines")
    gone = materialise(deletions(rows).where("size(gone) > 0").select("key", "gone"), "pages-gone")
    light = rows.select("key", "id", "url", "lines", "kinds")
    # Only pages that may lose a line of their text are shuffled; a bitmap of fixed size says which may.
    may = in_bitmap(F.col("key"), bitmap_of(gone, "key"))
    some = light.where(may).join(gone, "key", "left").unionByName(light.where(~may).withColumn("gone", F.lit(None).cast("array<int>")))
    wanted = F.when(F.array_contains("kinds", INSIDE), INSIDE).otherwise(OTHER)
    lines = F.expr("transform(filter(arrays_zip(lines, kinds), (x, i) -> x.kinds = wanted AND NOT coalesce(array_contains(gone, i), false)), x -> x.lines)")
    text = F.array_join(lines, "\n\n")
    return some.withColumn("wanted", wanted).select(F.col("id").alias(id), F.col("url").alias(url), text.alias("text"))
