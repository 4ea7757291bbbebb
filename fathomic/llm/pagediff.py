"""HTML extraction by nearest-URL page differencing.

Pages are ordered by host and URL path, so each page stands between the pages of its host
with the nearest paths. Its neighbours are the nearest of them, one on each side, whose
lines differ: copies side by side (mirrors, repeated rows, one path with several queries)
don't delete each other, and share the neighbours around them. The text lines of a page and
of its neighbour are aligned by a longest common subsequence, and shared lines are deleted
as the host's template.

Two guards keep content that pages merely repeat. A neighbour that shares 0.8 or more of
the characters of both pages is a near copy and shows no template. And a line inside the
article that a page marks goes only where both neighbours share it inside theirs, it stands
in the run of such lines that closes the article, and it is a label (short and no sentence, as
"Share this page"); elsewhere in an article, shared lines are titles and quoted or repeated content.

Structure settles what no neighbour shows: markup, scripts, forms, menus, headers,
footers, sidebars, adverts, notices and reader comments never become lines, and where a
page marks its article, lines outside it are left out. Names of classes are split into
words for that outside an article; within one, only a whole name counts. Tags and
attributes are read by the tokenizer rules of the HTML standard.

Defined results: null or empty html has empty text; a null URL counts as an empty one;
rows may repeat; a host whose pages all have the same lines shows no template, so they
keep them; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as _html
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomic.llm._spark import bucket_of, durable, partitions

# Comments, tags with their attributes, and what the standard calls bogus comments.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)|'([^']*)|([^\s>"'][^\s>]*))?["']?)?""")
_UNQUOTED_SLASH = re.compile(r"""=\s*[^\s>"'][^\s>]*/\Z""")

# Elements by their part in a page.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_CHROME = frozenset("nav header footer aside form dialog menu button fieldset select noscript template object svg math".split())
_FOREIGN = frozenset(("svg", "math"))
#: HTML elements that end an open svg or math element.
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main nav footer header aside".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSTACKED = frozenset(("html", "head", "body"))
_ENDS_P = _BLOCKS - _UNSTACKED - frozenset(("title",))
_REPEATED = frozenset("p li dd dt tr td th option".split())
_MAIN = frozenset(("article", "main"))
_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

#: Share of the characters of both pages from which neighbours are near copies.
_NEAR_COPY = 0.8
#: Characters of a label at most.
_LABEL = 40
#: Bytes of html that a bucket is to hold.
_BUCKET_BYTES = 16 << 20
_LINES = "lines array<string>, marks string, digest string"
#: Most bits of the masks of lines that an alignment keeps; others are made when needed.
_MASK_BITS = 1 << 27


def _is_chrome(name: str, attributes: str, within_main: bool) -> bool:
    if name in _CHROME:
        return True
    if not attributes or name in _MAIN:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key == "role" and value in _ROLES:
            return True
        if key in ("class", "id") and any(w in _WORDS for w in (value.split() if within_main else re.split(r"[^a-z]+", value))):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool]]:
    """Text lines of blocks in page order, each with whether it lies in a marked article."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, main
    places: dict[str, list[int]] = {}  # where each name is open
    blocks: list[int] = []  # where blocks and chrome are open
    chrome = main = 0
    at = 0

    def add(piece: str) -> None:
        if not chrome:
            parts.append(_html.unescape(piece) if "&" in piece else piece)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, main > 0))

    def pop_to(depth: int) -> None:
        nonlocal chrome, main
        while len(stack) > depth:
            name, c, m = stack.pop()
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            chrome -= c
            main -= m

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1) and name != "br":
            if name in _BLOCKS:
                flush()
            open_ = places.get(name)
            # an end tag of a phrase ends no block above it
            if open_ and (name in _BLOCKS or name in _CHROME or not blocks or blocks[-1] <= open_[-1]):
                pop_to(open_[-1])
            continue
        attributes = m.group(3)
        if name in _BREAKS_OUT and chrome:
            foreign = max((places[x][-1] for x in _FOREIGN if places.get(x)), default=-1)
            if foreign >= 0:
                pop_to(foreign)
        if name in _RAW:
            at = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(page, at).end()
            if name == "title":
                flush()
            continue
        if name in _BLOCKS:
            flush()
        if name == "br":
            add(" ")
            continue
        if name in _VOID or name in _UNSTACKED:
            continue
        if name in _ENDS_P and blocks:
            # an open paragraph, or an open item of the same sort, ends here
            last = stack[blocks[-1]][0]
            if last == "p" or (last == name and name in _REPEATED):
                pop_to(blocks[-1])
        c = _is_chrome(name, attributes, main > 0)
        if c and attributes.endswith("/") and not _UNQUOTED_SLASH.search(attributes):
            continue
        m_ = name in _MAIN or bool(attributes and re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes, re.IGNORECASE))
        places.setdefault(name, []).append(len(stack))
        if c or name in _BLOCKS:
            blocks.append(len(stack))
        stack.append((name, c, m_))
        chrome += c
        main += m_
    flush()
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two lists of lines."""
    lead = 0
    while lead < len(a) and lead < len(b) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < len(a) - lead and tail < len(b) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(lead)] + [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail)]
    inside_b = set(b[lead : len(b) - tail])
    left = [i for i in range(lead, len(a) - tail) if a[i] in inside_b]
    inside_a = {a[i] for i in left}
    right = [j for j in range(lead, len(b) - tail) if b[j] in inside_a]
    if not left:
        return out
    return out + [(left[x], right[y]) for x, y in _aligned([a[i] for i in left], [b[j] for j in right])]


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence from rows of bits: a row tells where the lengths for ``a[x:]`` and ``b[y:]`` grow with y.

    Only about a square root of the rows is held: every k-th, and the k rows in use, made again from the one after them.
    """
    n, m = len(a), len(b)
    full = (1 << m) - 1
    places: dict[str, list[int]] = {}
    for y, line in enumerate(b):
        places.setdefault(line, []).append(m - 1 - y)
    masks: dict[str, int] = {}

    def mask(line: str) -> int:
        found = masks.get(line)
        if found is None:
            bits = np.zeros(m, np.uint8)
            bits[places[line]] = 1
            found = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if (len(masks) + 1) * m <= _MASK_BITS:
                masks[line] = found
        return found

    def before(row: int, x: int) -> int:
        same = row & mask(a[x])
        return ((row + same) | (row - same)) & full

    step = max(1, math.isqrt(n))
    kept = {n: full}
    row = full
    for x in range(n - 1, -1, -1):
        row = before(row, x)
        if x % step == 0:
            kept[x] = row
    rows: dict[int, int] = {}

    def at(x: int) -> int:
        if x not in rows:
            rows.clear()
            high = min(n, (x // step + 1) * step)
            r = kept[high]
            rows[high] = r
            for k in range(high - 1, x - 1, -1):
                r = before(r, k)
                rows[k] = r
        return rows[x]

    def length(row: int, y: int) -> int:
        return (~row & ((1 << (m - y)) - 1)).bit_count()

    out = []
    x = y = 0
    here, below = at(0), at(1) if n else 0
    now, then = length(here, 0), length(below, 0)
    while x < n and y < m and now:
        if a[x] != b[y] and then < now:
            # the length here is that of the next y, where the row doesn't grow
            then -= not (below >> (m - 1 - y)) & 1
            y += 1
            continue
        if a[x] == b[y]:
            out.append((x, y))
            y += 1
        x += 1
        if x < n:
            here, below = below, at(x + 1)
            now, then = length(here, y), length(below, y)
    return out


def _is_label(line: str) -> bool:
    return len(line) <= _LABEL and line[-1] not in ".!?;:,…。"


def difference(page: list[tuple[str, bool]], others: list[list[tuple[str, bool]]]) -> str:
    """The page's text without the lines it shares with its neighbours, of which there are two at most."""
    gone: set[int] = set()
    inside: list[set[int]] = []
    size = sum(len(x) for x, _ in page)
    for other in others:
        pairs = _common([x for x, _ in page], [x for x, _ in other])
        shared = sum(len(page[i][0]) for i, _ in pairs)
        if shared >= _NEAR_COPY * max(size, sum(len(x) for x, _ in other)):
            continue
        inside.append({i for i, j in pairs if page[i][1] and other[j][1]})
        gone |= {i for i, j in pairs if not (page[i][1] and other[j][1])}
    marked = [i for i, (_, m) in enumerate(page) if m]
    if len(inside) == 2:
        both = inside[0] & inside[1]
        gone.update(itertools.takewhile(lambda i: i in both and _is_label(page[i][0]), reversed(marked)))
    return "\n".join([x for i, (x, m) in enumerate(page) if i not in gone and (m or not marked)])


def _digest(found: list[tuple[str, bool]]) -> str:
    return hashlib.blake2b("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.string())
    for b in batches:
        found = [lines(h.as_py() or "") for h in b.column(b.num_columns - 1)]
        flags = pa.array(["".join("1" if m else "0" for _, m in x) for x in found], pa.string())
        digests = pa.array([_digest(x) for x in found], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([[t for t, _ in x] for x in found], kind), flags, digests], names=[*b.schema.names[:-1], "lines", "marks", "digest"])


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, host and path; runs of equal lines are compared with the rows beside the run of their host."""
    before: list | None = None
    place: tuple | None = None
    found: list[str] = []
    members: list[tuple] = []  # page, url, marks, edge
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        ids, urls, texts, sizes = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def close(following: list | None) -> Iterator[pa.RecordBatch]:
        nonlocal out, size
        texts: dict[str, str] = {}
        for page, url, marks, edge in members:
            if edge:
                continue
            if marks not in texts:
                texts[marks] = difference(_marked(found, marks), [x for x in (before, following) if x is not None])
            out.append((page, url, texts[marks], len(texts[marks])))
            size += len(texts[marks])
            if len(out) >= 2048 or size >= 4 << 20:
                yield batch()
                out, size = [], 0

    for b in batches:
        for page, url, host, bucket, edge, own, marks in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "bucket", "_edge", "lines", "marks")), strict=True):
            same = place == (host, bucket)
            if not same or own != found:
                yield from close(_marked(own, marks) if same else None)
                before = _marked(found, members[-1][2]) if same else None
                place, found, members = (host, bucket), own, []
            members.append((page, url, marks, edge))
    yield from close(None)
    if out:
        yield batch()


def _marked(found: list[str], marks: str) -> list[tuple[str, bool]]:
    return [(t, m == "1") for t, m in zip(found, marks, strict=True)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns page_id, url, text and n_chars of every page.

    Pages are parsed before they are dealt out, so only text lines are shuffled.
    Buckets are ranges of (host, path) with near equal rows, whatever the hosts'
    sizes; a bucket also carries the nearest pages outside it that differ from its ends.
    """
    spark = df.sparkSession
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)://(.*)", 1)
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    place = F.concat_ws("\u0001", F.col("host"), F.col("path"))
    sized = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")).first()
    count = max(2 * partitions(spark), math.ceil((sized["bytes"] or 0) / _BUCKET_BYTES))
    bounds = _string_bounds(rows.select(place.alias("place"), "page_id"), sized["n"], count)
    rows = rows.withColumn("bucket", bucket_of(place, bounds, "string"))
    parsed = rows.select("page_id", "url", "host", "path", "bucket", "html").mapInArrow(_parse, f"page_id long, url string, host string, path string, bucket int, {_LINES}")
    whole = parsed.withColumn("_edge", F.lit(0)).unionByName(_edges(rows))
    dealt = whole.repartition(max(partitions(spark), count // 2), "bucket").sortWithinPartitions("bucket", "_edge", "host", "path", "page_id", "digest")
    return dealt.select("page_id", "url", "host", "bucket", "_edge", "lines", "marks").mapInArrow(_pair, "page_id long, url string, text string, n_chars long")


def _string_bounds(keys: DataFrame, total: int, count: int) -> list[str]:
    """Bounds of ``place`` by the row counts of its hashed sample; exact ordering doesn't depend on them.

    The sample only sets where runs are cut; it holds at most about 64 keys a run.
    """
    if total < 2 or count < 2:
        return []
    wanted = 64 * count
    share = min(1.0, wanted / total)
    picked = keys.filter(F.pmod(F.xxhash64("place", "page_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("place")
    found = sorted(r["place"] for r in picked.collect())
    return sorted({found[k * len(found) // count] for k in range(1, count)}) if found else []


def _edges(rows: DataFrame) -> DataFrame:
    """For each bucket's first and last page the nearest of its host outside that has other lines, with ``_edge``.

    Only pages at the ends of a bucket are parsed for it: a few of different html, more
    where all of these have the same lines. A bucket sends its first and last page's place,
    and the nearest to each that differs from it, to the driver.
    """
    spark = rows.sparkSession
    columns = ["page_id", "url", "host", "path", "bucket"]
    rows = rows.withColumn("raw", F.xxhash64("html"))
    key = F.struct("host", "path", "page_id", "raw")
    groups = durable(rows.groupBy("bucket", "host", "raw").agg(F.min(key).alias("lo"), F.max(key).alias("hi")))
    by = Window.partitionBy("bucket")
    ranked = groups.withColumn("first", F.row_number().over(by.orderBy(F.col("lo").asc()))).withColumn("last", F.row_number().over(by.orderBy(F.col("hi").desc())))
    depth, open_ = 4, None
    ends: dict[int, list[list]] = {}  # the first two of a bucket whose lines differ, and the last two
    tables: list[DataFrame] = []
    while open_ is None or open_:
        near = ranked if open_ is None else ranked.filter(F.col("bucket").isin(sorted(open_)))
        near = near.select("bucket", "first", "last", "lo", "hi").filter(f"first <= {depth} OR last <= {depth}")
        keys = near.select("bucket", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("r"), F.col("lo").alias("k")), F.struct(F.lit(1).alias("side"), F.col("last").alias("r"), F.col("hi").alias("k")))).alias("e")).filter(f"e.r <= {depth}")
        keys = keys.select(F.col("bucket").alias("b"), "e.side", "e.r", F.col("e.k.host").alias("h"), F.col("e.k.path").alias("p"), F.col("e.k.page_id").alias("i"), F.col("e.k.raw").alias("x"))
        same = F.col("bucket").eqNullSafe(F.col("b")) & F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")) & F.col("page_id").eqNullSafe(F.col("i")) & (F.col("raw") == F.col("x"))
        # a few keys a bucket, so the size is bounded by the number of buckets
        copies = rows.join(F.broadcast(keys), same).select("side", "r", *columns, "html")
        table = durable(copies.mapInArrow(_parse, f"side int, r int, page_id long, url string, host string, path string, bucket int, {_LINES}").dropDuplicates(["side", "r", "bucket"]))
        tables.append(table)
        found: dict[int, list[list]] = {}
        for r in sorted(table.select("side", "r", "host", "path", "page_id", "bucket", "digest").collect(), key=lambda r: (r["bucket"], r["side"], r["r"])):
            found.setdefault(r["bucket"], [[], []])[r["side"]].append(r)
        open_ = set()
        for b, sides in found.items():
            firsts = [[s[0], *[x for x in s if (x["host"], x["digest"]) != (s[0]["host"], s[0]["digest"])][:1]] for s in sides]
            ends[b] = firsts
            if any(len(f) < 2 and len(s) == depth for f, s in zip(firsts, sides, strict=True)):
                open_.add(b)
        depth *= 8
    wanted = []
    present = sorted(ends)
    for side, buckets in ((1, present), (0, present[::-1])):
        # what stands nearest to the next bucket's end on this side, and the one that differs from it
        last: list = []
        for b in buckets:
            own = ends[b][1 - side][0]
            other = next((k for k in last if k["host"] == own["host"] and k["digest"] != own["digest"]), None)
            if other is not None and last[0]["host"] == own["host"]:
                wanted.append((b, -1 if side else 1, other["bucket"], other["side"], other["r"]))
            mine = ends[b][side]
            # a bucket of one run: what differs from it is farther back
            farther = next((k for k in last if (k["host"], k["digest"]) != (mine[0]["host"], mine[0]["digest"])), None)
            last = mine if len(mine) > 1 or farther is None else [mine[0], farther]
    parsed = functools.reduce(DataFrame.unionByName, tables).dropDuplicates(["side", "r", "bucket"])
    table = spark.createDataFrame(wanted, "nb int, want int, bucket int, side int, r int")
    # at most two keys a bucket
    return parsed.join(F.broadcast(table), ["bucket", "side", "r"]).select("page_id", "url", "host", "path", F.col("nb").alias("bucket"), "lines", "marks", "digest", F.col("want").alias("_edge"))
