"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks (runs of text between block-level tags). Blocks of menus, forms, adverts and the like are
known by their elements, classes and roles. All others, inside an article or main element or not, are compared with the
nearest page of the same host: pages are put in order of (host, path), each takes the neighbour that shares more of
its path, their block sequences are aligned by longest common subsequence, and what they share is deleted as the
host's furniture. Inside an article or main element a line must be shared with both neighbours, as far from the element's
start or end, be no heading, and be no part of a text of which the pages share more than half: a sentence that two articles
have in common, a heading such as `Conclusion` and the paragraphs of two versions stay. Of what is left, text outside the page's article or main elements stays only where there is no such
element or more text outside than inside, so that the element is a teaser.

Two pages of which next to nothing is left are copies, not one template twice: the other neighbour is taken. Where the
shared lines make up most of both pages, only those that the other neighbour has too are deleted, if there is one.

Order over all pages is by range partitioning and a running index, and neighbours are met by an equi-join on that index,
so a host with a third of all pages is as evenly spread as any other. Pages with equal url and html are one page there.

Defined cases: null html is an empty page with empty text; a null url is the empty host and path; pages that repeat
an id are each extracted; an empty table gives an empty result; very long pages are taken whole; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_table, materialize, ship

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z!/?][^<>]*+\Z""",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z][\w:-]*)""")
#: Elements whose content isn't markup; it ends at their end tag only.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu", "template", "svg", "math", "canvas", "object", "audio", "video"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | SKIP
#: Elements that an opening block ends when they are innermost.
IMPLIED = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
SKIP_CLASSES = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs crumbs footer header masthead topbar comment comments reply replies respond "
    "response responses disqus discussion share sharing social related recommended recommendations widget toolbar pagination pager skip copyright login search".split()
)
#: Words that may stand beside one of the above in a class or id that still means the same thing.
BESIDE = set("box wrapper wrap container holder list item items bar block area section zone panel row col inner outer main site page top bottom left right primary secondary fixed sticky links link icons icon buttons button posts post articles stories story content text message form module slot unit mobile desktop global js user users reader readers visitor fb law info policy settings preferences".split())
#: Of the first list those that name a thing by themselves, so that a compound that ends with one is such a thing: `fb-comments`, but not `notice-of-claim`.
HEADS = set("advert adverts advertisement sidebar breadcrumb breadcrumbs comment comments reply replies response responses notice notices newsletter popup paywall pagination navbar disqus".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)}


def is_furniture(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of an article. inside: it stands in an article or main element."""
    if tag in SKIP and not (tag == "header" and inside):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in SKIP_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        # Either every word of the name speaks for it, or what the name ends with: `share-price` or `notice-of-claim` is text.
        words = [x.lower() for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if x and not x.isdigit()]
        if set(words) & SKIP_CLASSES and set(words) <= SKIP_CLASSES | BESIDE:
            return True
        named = [x for x in words if x not in BESIDE]
        if named and named[-1] in HEADS and words[0] not in ("no", "non", "without", "with", "has"):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, furniture, inside an article or main element, heading) of each block, in page order."""
    out: list[tuple[str, bool, bool, bool]] = []
    open_: list[tuple[str, bool, bool]] = []
    skip = inside = False
    words: list[str] = []

    def flush() -> None:
        if words and (text := " ".join("".join(words).split())):
            out.append((text, skip, inside, any(x[0] in HEADING for x in open_[-3:])))
        words.clear()

    def state() -> tuple[bool, bool]:
        return (open_[-1][1], open_[-1][2]) if open_ else (False, False)

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            words.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if any(x[0] == tag for x in open_):
                flush()
                while open_.pop()[0] != tag:
                    pass
                skip, inside = state()
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        attrs = attributes(m["attrs"])
        furniture = is_furniture(tag, attrs, inside)
        if tag not in BLOCK and not furniture:
            continue
        flush()
        while tag in BLOCK and open_ and open_[-1][0] in IMPLIED:
            open_.pop()
        above_skip, above_inside = state()
        open_.append((tag, above_skip or furniture, above_inside or tag in ("article", "main") or attrs.get("role") == "main"))
        skip, inside = state()
        if m["attrs"].rstrip().endswith("/") and tag in ("div", "svg", "section"):
            open_.pop()
            skip, inside = state()
    words.append(html.unescape(page[at:]))
    flush()
    return out


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the longest common subsequences of each prefix of a with the prefixes of b."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        s = rows[-1]
        u = s & where.get(x, 0)
        rows.append(((s + u) | (s - u)) & full)
    return rows


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of a longest common subsequence of a with each prefix of b."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    s = full = (1 << len(b)) - 1
    for x in a:
        u = s & where.get(x, 0)
        s = ((s + u) | (s - u)) & full
    out = [0]
    for bit in reversed(f"{s:0{len(b)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(a: list[int], b: list[int], most: int = 1 << 30) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel rows; halved where the rows have more than `most` bits."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    both = set(a[first : len(a) - last]) & set(b[first : len(b) - last])
    at_a = [i for i in range(first, len(a) - last) if a[i] in both]
    at_b = [j for j in range(first, len(b) - last) if b[j] in both]
    inner = _pairs([a[i] for i in at_a], [b[j] for j in at_b], most)
    ends = [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]
    return [(i, i) for i in range(first)] + [(at_a[i], at_b[j]) for i, j in inner] + ends


def _pairs(a: list[int], b: list[int], most: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > most:
        half = len(a) // 2
        ahead, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + back[len(b) - j])
        return _pairs(a[:half], b[:cut], most) + [(i + half, j + cut) for i, j in _pairs(a[half:], b[cut:], most)]
    rows = _aligned(a, b)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    found, i, j = [], len(a), len(b)
    while i and j:
        n = length(i, j)
        if not n:
            break
        if length(i, j - 1) == n:
            j -= 1
        elif length(i - 1, j) == n:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def address(url: str | None) -> tuple[str, str]:
    """Host and path; the query and the fragment don't count."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def common_segments(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the hashes of its lines, and of each line 4 * characters + 2 if inside + 1 for a heading; -1 for furniture, which only takes part in the alignment."""
    for batch in batches:
        pages = [blocks(h or "") for h in batch.column(3).to_pylist()]
        at = [address(u) for u in batch.column(2).to_pylist()]
        lines = [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, *_ in page] for page in pages]
        chars = [[-1 if s else 4 * len(t) + 2 * inside + heading for t, s, inside, heading in page] for page in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a[0] for a in at], pa.string()), pa.array([a[1] for a in at], pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32()))],
            ["k1", "k2", "host", "path", "lines", "chars"],
        )


#: Of a pair of copies each page has at most so many characters, or this part of the shared ones, for itself.
LEFT_CHARS, LEFT = 20, 0.02
#: Where both pages share more than this part, the other neighbour is asked too.
MOST = 0.8


def deleted(page: dict, near: list[dict]) -> set[int]:
    """Which lines of a page are the host's furniture; near: its neighbours, the nearest first.

    Outside of article and main elements what the nearest one shares goes. Inside, a line goes only if both neighbours have it as
    far from their element's start or end (so the first and the last page of a host lose none there), it is no heading, and it is no part of a text that the pages share by and large.
    """
    found: list[tuple[set[int], bool]] = []
    inner: list[set[int]] = []
    mine = _inside(page)
    for other in near:
        pairs = shared_lines(page["lines"], other["lines"])
        theirs, own = {j for _, j in pairs}, {i for i, _ in pairs}
        gone = {i for i in own if page["chars"][i] >= 0}
        shared = sum(page["chars"][i] >> 2 for i in gone)
        left = [sum(n >> 2 for i, n in enumerate(x["chars"]) if n > 0 and i not in met) for x, met in ((page, own), (other, theirs))]
        if max(left) <= max(LEFT_CHARS, LEFT * shared):
            continue  # a copy
        found.append(({i for i in gone if i not in mine}, max(left) < (1 - MOST) * (shared + max(left))))
        place = _inside(other)
        alike = {i for i, j in pairs if i in mine and j in place}
        revised = 2 * sum(page["chars"][i] >> 2 for i in alike) > sum(n >> 2 for i, n in enumerate(page["chars"]) if n > 0 and (i in mine or i not in gone))
        same = {i for i, j in pairs if i in mine and j in place and (mine[i][0] == place[j][0] or mine[i][1] == place[j][1])}
        inner.append(set() if revised else {i for i in same if not page["chars"][i] & 1})
    if not found:
        return set()
    gone, alike = found[0]
    outer = gone & found[1][0] if alike and len(found) > 1 else gone
    return outer | (inner[0] & inner[1] if len(inner) > 1 else set())


def _inside(page: dict) -> dict[int, tuple[int, int]]:
    """Of the lines inside an article or main element, how many such lines stand before and behind each."""
    at = [i for i, n in enumerate(page["chars"]) if n >= 0 and n & 2]
    return {i: (k, len(at) - 1 - k) for k, i in enumerate(at)}


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages that lose text, with the places of the lost blocks among those that aren't furniture."""
    for batch in batches:
        keys, gone = [], []
        for r in batch.to_pylist():
            near = [p for p in (r["before"], r["after"]) if p is not None and p["host"] == r["host"]]
            near.sort(key=lambda p: -common_segments(r["path"], p["path"]))
            if lost := deleted(r, near):
                own = [i for i, n in enumerate(r["chars"]) if n >= 0]
                keys.append((r["k1"], r["k2"]))
                gone.append([at for at, i in enumerate(own) if i in lost])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["k1", "k2", "gone"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [[{"text": t, "inside": i} for t, s, i, _ in blocks(h or "") if not s] for h in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_())])))], ["page_id", "url", "k1", "k2", "blocks"])


def own_text(page: list[dict], gone: list[int] | None) -> str:
    """Text of a page without the blocks that differencing deletes."""
    lost = set(gone or ())
    kept = [b for i, b in enumerate(page) if i not in lost]
    inside = sum(len(b["text"]) for b in kept if b["inside"])
    if inside and sum(len(b["text"]) for b in kept if not b["inside"]) <= inside:
        kept = [b for b in kept if b["inside"]]
    return " ".join(b["text"] for b in kept)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [own_text(page, gone) for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def with_running_index(df: DataFrame, *order: str, name: str = "at") -> DataFrame:
    """Rows in a total order, numbered from 0 without gaps; written, so that the numbers stay."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    laid = materialize(df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ordered")
    sizes = sorted((r["p"], r["n"]) for r in laid.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, so_far = [], 0
    for p, n in sizes:
        starts.append((p, so_far))
        so_far += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "p long, start long")
    return laid.join(F.broadcast(offsets), F.shiftright("__m", 33) == F.col("p")).withColumn(name, F.col("start") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("p", "start", "__m")


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    What is put in order and met with neighbours is the hashes of lines; texts move once, to the lists of what they lose.
    """
    ship(df.sparkSession)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    none = F.isnull("url"), F.isnull("html")
    pages = pages.select("page_id", "url", F.xxhash64(*none, "url", "html").alias("k1"), F.xxhash64(F.lit(2), *none, "html", "url").alias("k2"), "html")
    lines = pages.select("k1", "k2", "url", "html").mapInArrow(_lines, "k1 long, k2 long, host string, path string, lines array<long>, chars array<int>")
    lines = materialize(lines.dropDuplicates(["k1", "k2"]), "lines")
    laid = with_running_index(lines, "host", "path", "k1", "k2")
    drop_table(lines)
    side = lambda step, name: laid.select((F.col("at") + step).alias("at"), F.struct("host", "path", "lines", "chars").alias(name))
    met = laid.join(side(1, "before"), "at", "left").join(side(-1, "after"), "at", "left").drop("at")
    gone = met.mapInArrow(_decide, "k1 long, k2 long, gone array<int>")
    texts = pages.mapInArrow(_texts, "page_id long, url string, k1 long, k2 long, blocks array<struct<text: string, inside: boolean>>")
    return texts.join(gone, ["k1", "k2"], "left").select("page_id", "url", "blocks", "gone").mapInArrow(_finish, "page_id long, url string, text string, n_chars long")
