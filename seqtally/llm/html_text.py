"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes (paths of elements with their
classes). A node whose presentation and content hardly vary over the site's pages, measured
by entropy, has low importance; its branch is cut out of every page, also inside article and
main. What elements say about themselves (nav, footer, class="ad") comes first.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stage

# Fixed values of HTML: elements by the part they play.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "video", "audio", "textarea", "title", "select")
NOISE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head", "fieldset"}
CONTENT = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = NOISE | CONTENT | {
    "html", "body", "div", "p", "ul", "ol", "li", "dl", "dt", "dd", "header", "section", "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "address",
    "details", "summary", "center", "hgroup",
}
#: An opening tag on the left ends open elements on the right (up to the nearest other block).
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of a class or id that name furniture of a page.
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "notice", "popup", "modal",
    "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "comment", "comments", "replies",
    "disqus", "pagination", "pager", "widget", "login", "signup",
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


@dataclass(frozen=True)
class Settings:
    """A branch is noise when it stands on at least `min_pages` pages and `min_share` of the
    host's, and its importance is under `threshold`. `min_share` bounds a host's noise nodes
    to 1 / min_share times the nodes of a page. `content_weight` weighs content entropy
    against presentation entropy."""

    min_pages: int = 5
    min_share: float = 0.01
    threshold: float = 0.3
    content_weight: float = 0.7


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    """An open element: its style path, whether it is furniture or content, and its parent."""

    __slots__ = ("tag", "path", "noise", "content", "parent", "key")

    def __init__(self, tag, path, noise, content, parent):
        self.tag, self.path, self.noise, self.content, self.parent = tag, path, noise, content, parent


_STYLES: dict[tuple[str, str], tuple[str, bool]] = {}


def _style(tag: str, attrs: str) -> tuple[str, bool]:
    """Style name of an element and whether it calls itself furniture (or is hidden)."""
    if not attrs:
        return tag, tag in NOISE
    if (known := _STYLES.get((tag, attrs))) is not None:
        return known
    names, noise = [], tag in NOISE
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            words = value.split()
            names += words
            noise = noise or (tag not in ("html", "body") and any(p in FURNITURE for w in words for p in re.split(r"[-_]+", w)))
        elif name == "role":
            noise = noise or value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")
        elif name == "style":
            noise = noise or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            noise = noise or name == "hidden" or value == "true"
    # numbers in names are taken out, so post-17 and post-18 are one style
    known = (re.sub(r"\d+", "#", ".".join([tag, *sorted(set(names))])), noise)
    if len(_STYLES) > 100_000:
        _STYLES.clear()
    _STYLES[tag, attrs] = known
    return known


def blocks_of(page: str | None) -> Iterator[tuple[Node, str]]:
    """(element, raw text) of every block of text of a page in page order; markup is left out."""
    page = page or ""
    top = Node("", "", False, False, None)
    nodes: dict[str, Node] = {}
    stack, parts, at = [top], [], 0

    def opened(tag, attrs):
        up = stack[-1]
        name, noise = _style(tag, attrs)
        path = f"{up.path}/{name}"
        if (node := nodes.get(path)) is None or node.noise != (noise or up.noise):
            if tag == "header" and not up.content:
                noise = True
            content = up.content or tag in CONTENT or "role=main" in attrs.replace('"', "").replace("'", "")
            node = nodes[path] = Node(tag, path, noise or up.noise, content, up)
        return node

    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK or tag in VOID:
            if tag == "hr" and parts:
                yield stack[-1], "".join(parts)
                parts = []
            continue
        if parts:
            yield stack[-1], "".join(parts)
            parts = []
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()  # a block ends an open paragraph
        ends = IMPLIED.get(tag, ())
        while len(stack) > 1 and stack[-1].tag in ends:
            stack.pop()
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        stack.append(opened(tag, m["attrs"]))
    if at < len(page):
        parts.append(page[at:])
    if parts:
        yield stack[-1], "".join(parts)


def clean(raw: str) -> str:
    """Character references decoded, white space runs as one space, trimmed."""
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def extract(page: str | None, noise_keys: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page: its blocks outside furniture and low-importance branches.

    Content roots (outermost article, main) win over other text. Where the host has
    low-importance nodes, a low root loses to another root or to longer text outside, and a
    root with less text than what is left outside does not displace that. Inside a root that
    is low as a whole (copies of one page) no branch stands out, so none is cut there.
    """
    inside, low_inside, outside = [], [], []
    seen: dict[tuple[str, bool], tuple[bool, bool]] = {}

    def verdict(node):
        """Whether the node is in a low branch, and whether its content root is low."""
        if (node.path, node.content) not in seen:
            up, low, root = node, False, None
            while up is not None:
                if up.content and not (up.parent and up.parent.content):
                    root = _key(up.path) in noise_keys
                    break
                low = low or _key(up.path) in noise_keys
                up = up.parent
            seen[node.path, node.content] = low, bool(root)
        return seen[node.path, node.content]

    for at, (node, raw) in enumerate(blocks_of(page)):
        if node.noise or not (text := clean(raw)):
            continue
        low, low_root = verdict(node) if noise_keys else (False, False)
        if low_root:
            low_inside.append((at, text))
        elif not low:
            (inside if node.content else outside).append((at, text))
    size = lambda blocks: sum(len(text) for _, text in blocks)
    main = inside or low_inside or outside
    if noise_keys and size(outside) > size(main):
        main = sorted(inside + outside)
    return "\n\n".join(text for _, text in main)


def style_rows(page: str | None) -> dict[str, tuple[int, int]]:
    """Per style node of a page: digest of its branch's presentation and of its content."""
    shapes: dict[str, list[str]] = {}
    texts: dict[str, list[str]] = {}
    for node, raw in blocks_of(page):
        text = clean(raw)
        if not text:
            continue
        up = node
        while up is not None and up.path:
            shapes.setdefault(up.path, []).append(node.path)
            texts.setdefault(up.path, []).append(text)
            up = up.parent
    return {p: (_key("\n".join(shapes[p])), _key("\n".join(texts[p]))) for p in shapes}


def style_tree(pages: DataFrame, s: Settings) -> DataFrame:
    """(host, node, pages, importance) of the style nodes of every host.

    importance: weighted mean of the entropies of presentation and content over the node's
    pages, each divided by its maximum, log(pages).
    """

    def rows(batches):
        for batch in batches:
            host, node, kind, digest = [], [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, pair in style_rows(page).items():
                    key = _key(path)
                    for k in (0, 1):
                        host.append(h)
                        node.append(key)
                        kind.append(k)
                        digest.append(pair[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(digest, pa.int64())],
                ["host", "node", "kind", "digest"],
            )

    found = pages.select("host", "html").mapInArrow(rows, "host string, node long, kind int, digest long")
    counts = found.groupBy("host", "node", "kind", "digest").agg(F.count(F.lit(1)).alias("c"))
    own = lambda k: F.sum(F.when(F.col("kind") == k, F.col("c") * F.log("c")))
    nodes = counts.groupBy("host", "node").agg(F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"), own(0).alias("p"), own(1).alias("t"))
    share = lambda c: (F.log("pages") - F.col(c) / F.col("pages")) / F.log("pages")
    w = s.content_weight
    importance = F.when(F.col("pages") > 1, (1 - w) * share("p") + w * share("t")).otherwise(F.lit(1.0))
    return nodes.select("host", "node", "pages", importance.alias("importance"))


def noise_nodes(pages: DataFrame, s: Settings) -> DataFrame:
    """(host, nodes): the low-importance style nodes of each host that has any."""
    tree = style_tree(pages, s).where((F.col("pages") >= s.min_pages) & (F.col("importance") < s.threshold))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    low = tree.join(sizes, "host").where(F.col("pages") >= F.col("all") * s.min_share)
    return low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("nodes"))


def extract_text(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """page_id, url and text for every row of `pages` (page_id, url, html).

    Text inside article or main elements wins over other text of the page, unless the style
    tree tells that the main text is elsewhere. A null or empty
    html, and a page that is all furniture, have the text ""; a null url belongs to the host
    "". Repeated rows are pages of their own; other columns are not read; an empty table gives
    an empty result. Nothing is cut from long pages.
    """
    s = settings or Settings()
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # written, so Spark knows its size and broadcasts it only below its threshold
    noise = stage(noise_nodes(rows, s), "noise")
    joined = rows.join(noise, "host", "left")

    @F.arrow_udf("string")
    def text(pages: pa.Array, nodes: pa.Array) -> pa.Array:
        return pa.array([extract(p, set(k) if k else frozenset()) for p, k in zip(pages.to_pylist(), nodes.to_pylist())], pa.string())

    return joined.select("page_id", "url", text("html", "nodes").alias("text"))
