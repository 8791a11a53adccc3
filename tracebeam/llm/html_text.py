"""Main text of web pages by differencing each page with its nearest neighbours by URL.

Pages of a host are put in the order of their URL paths, equal ones folded, so that each distinct page
meets the nearest pages before and after it that differ from it. Each is aligned with both by a longest
common subsequence of text lines. A line outside an article that a neighbour shares belongs to the site,
not to the page, and is deleted; one that no neighbour shares is kept in its place, also beside an article.
Two things are not left to differencing, as it cannot get them right: lines inside an article or main
element are kept though a neighbour has them (articles quote each other), and regions whose tag, class or
role marks a menu, advert, comment or the like are dropped though no neighbour has them (adverts differ
from page to page). ``n_shared`` tells how many lines were deleted.

What a page loses is kept by host and hash of the html, so rows of one page_id and url with different html
do not affect each other. Pages are parsed twice, for the hashes of their lines and for their text: writing
the texts in between would take the space of the corpus once more. The order comes from a range sort of (host, path, page), not from
one task per host, so a host may hold any share of the pages. Null or empty html gives an empty text; a
null or odd URL counts as a host of its own name; repeated rows each get their text; a page without a
differing neighbour keeps its unmarked lines. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.llm.common import salted_lookup
from tracebeam.operators.skew import numbered
from tracebeam.session import materialize

ARTICLE, OTHER, TEMPLATE = 1, 2, 0
LCS_CELLS = 1 << 30  # bits of one alignment table; larger pairs are halved first

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:\A|\s)hidden(?=[\s=/]|\Z)|display\s*:\s*none", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[a-z0-9]+")

# fixed values: elements and names by what they hold
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "textarea", "title", "object", "xmp"}
REGIONS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "head"}
MAIN = {"article", "main"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
TEMPLATE_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo",
    "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary",
}


def is_template(name: str, attrs: str) -> bool:
    if name in REGIONS:
        return True
    if not attrs or name in MAIN or name in ("body", "html"):
        return False
    if _HIDDEN.search(attrs):
        return True
    for _, a, b, c in _ATTR.findall(attrs):
        if TEMPLATE_NAMES.intersection(_NAME_PARTS.findall((a or b or c).lower())):
            return True
    return False


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of every text block in page order; white space is one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    skip, depth = "", 0  # the template region being passed: its tag and nesting
    inside: list[str] = []  # open article and main elements
    title = False  # in the h1 of an article's own header, which stays
    page = page or ""
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                dropped = skip and not (title and inside)
                out.append((TEMPLATE if dropped else ARTICLE if inside else OTHER, text))

    while True:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        closing, attrs = bool(m.group("close")), m.group("attrs")
        if name in BLOCKS or name in MAIN or name in REGIONS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name == "h1":
            title = not closing and skip == "header"
        if name in VOID:
            continue
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    flush()
                    skip = ""
            elif name in MAIN and not closing and not inside:  # an unclosed region ends here
                skip, depth = "", 0
                inside.append(name)
        elif closing:
            if name in MAIN and name in inside:
                while inside.pop() != name:
                    pass
        elif name in MAIN:
            inside.append(name)
        elif is_template(name, attrs):
            flush()
            skip, depth = name, 1
    flush()
    return out


def lcs_scores(a: list[int], b: list[int]) -> int:
    """Bit row of the LCS lengths of ``a`` against every prefix of ``b`` (0 bits are steps)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def common_lines(a: list[int], b: list[int], cells: int = LCS_CELLS) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = set(range(lo)) | set(range(len(a) - hi, len(a)))
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    seen = set(b)
    index = [i for i, x in enumerate(a) if x in seen]
    a = [a[i] for i in index]
    seen = set(a)
    b = [x for x in b if x in seen]
    if not a:
        return ends
    if len(a) * len(b) > cells and len(a) > 1:
        half = len(a) // 2
        front, rear = lcs_scores(a[:half], b), lcs_scores(a[half:][::-1], b[::-1])
        n = len(b)
        score = (rear ^ ((1 << n) - 1)).bit_count()
        best, cut = score, 0
        for j in range(n):  # b[:j + 1] to the front half, the others to the rear half
            score += not front >> j & 1
            score -= not rear >> (n - 1 - j) & 1
            if score > best:
                best, cut = score, j + 1
        found = common_lines(a[:half], b[:cut], cells)
        found |= {half + i for i in common_lines(a[half:], b[cut:], cells)}
    else:
        where: dict[int, int] = {}
        for j, x in enumerate(b):
            where[x] = where.get(x, 0) | 1 << j
        full = (1 << len(b)) - 1
        rows = [full]
        for x in a:
            hit = rows[-1] & where[x]
            rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
        found = set()
        i, j = len(a), len(b)
        while i and j:
            bit = 1 << (j - 1)
            if rows[i] & bit:
                j -= 1  # no step here: b[j - 1] is not needed
            elif not rows[i - 1] & bit:
                i -= 1  # the step is there without a[i - 1]
            else:
                found.add(i - 1)
                i, j = i - 1, j - 1
    return ends | {lo + index[i] for i in found}


def url_host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def url_path(url):
    return F.coalesce(
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit("")
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, host, html_md5, roles, lines, digest): the lines of every page, written once.

    ``lines`` holds the hashes of the texts, ``digest`` names their list. Texts are not written: those of a
    whole corpus would take its size again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            roles, lines, digests = [], [], []
            for page in batch.column(3):
                found = lines_of(page.as_py())
                roles.append([role for role, _ in found])
                lines.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t in found])
                digests.append(xxhash.xxh3_128_hexdigest("\n".join(t for _, t in found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(roles, pa.list_(pa.int8())),
                 pa.array(lines, pa.list_(pa.int64())), pa.array(digests, pa.string())],
                ["page_id", "url", "html_md5", "roles", "lines", "digest"],
            )

    parsed = with_keys(pages).select("page_id", "url", "html_md5", "html").mapInArrow(
        run, "page_id long, url string, html_md5 string, roles array<byte>, lines array<long>, digest string"
    )
    return materialize(
        parsed.withColumns({"host": url_host(F.col("url")), "key": F.monotonically_increasing_id()}), "page-lines"
    )


def with_keys(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, html_md5): rows of one host and the same html have the same text."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", url_host(F.col("url")).alias("host"),
        F.md5(F.coalesce("html", F.lit(""))).alias("html_md5"),
    )


def shared_lines(parsed: DataFrame) -> DataFrame:
    """(host, digest, shared): positions of lines that the nearest differing page on either side has too."""
    first = parsed.where(F.size("lines") > 0).groupBy("host", "digest").agg(
        F.min(F.struct(url_path(F.col("url")).alias("path"), "page_id", "key")).alias("first")
    )
    distinct = first.select("host", "digest", "first.*").join(parsed.select("key", "lines"), "key")
    placed = materialize(numbered(distinct, ["host", "path", "page_id", "key"], "place"), "pages-by-url")
    beside = placed.select(
        F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), "host",
        F.col("lines").alias("theirs"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            shared = [sorted(common_lines(a, b)) for a, b in zip(mine, theirs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shared, pa.list_(pa.int32()))],
                ["host", "digest", "shared"],
            )

    pairs = placed.join(beside, ["place", "host"]).select("host", "digest", "lines", "theirs")
    # two neighbours at most
    return pairs.mapInArrow(run, "host string, digest string, shared array<int>").groupBy("host", "digest").agg(
        F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared")
    )


def deleted_lines(parsed: DataFrame) -> DataFrame:
    """(host, html_md5, gone): positions of the lines that each distinct page loses to its neighbours."""
    # copies of one page may hold any share of the rows
    told = salted_lookup(
        parsed.select("key", "host", "html_md5", "digest", "roles"), shared_lines(parsed), ["host", "digest"], ["key"]
    )
    gone = F.filter("shared", lambda i: F.get("roles", i) == OTHER)
    return told.where("shared is not null").select("host", "html_md5", gone.alias("gone")).where(
        F.size("gone") > 0
    ).dropDuplicates(["host", "html_md5"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of ``pages``; ``n_shared``: lines deleted."""
    gone = materialize(deleted_lines(page_lines(pages)), "deleted-lines")
    joined = with_keys(pages).join(gone, ["host", "html_md5"], "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for page, lost in zip(batch.column(2), batch.column(3)):
                lost = set(lost.as_py() or ())
                kept = [
                    t for i, (role, t) in enumerate(lines_of(page.as_py()))
                    if role == ARTICLE or (role == OTHER and i not in lost)
                ]
                texts.append("\n\n".join(kept))
                counts.append(len(lost))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_shared"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")
