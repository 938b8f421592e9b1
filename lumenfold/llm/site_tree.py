"""Main text by site style trees.

The DOMs of a host's pages are merged into one tree: elements with the same tag and classes under the
same parent are one node, whose presentation styles are the ways in which its children follow each
other. A node's importance (Yi, Liu and Li, "Eliminating noisy information in web pages", 2003) is
an entropy: of its styles for inner nodes, and of where its contents occur for leaves. Content that
all pages share has importance 0, content of single pages 1. Branches of low importance are removed
from every page, in its article too, and the blocks of what is left are the text.

Entropy alone cannot give the required result here: adverts and menus whose words differ on every
page look like content, and an article that a host repeats looks like noise. So the role that the
markup states bounds a node's importance: a menu, footer, advert, form, script or comment section has
0; and the limit is lower inside of an article or main element, where only what at least
MARKED_PAGES different articles of the host share goes. On a page that has such an element, branches
outside of it have importance 0.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, tidy

#: Composite importance under which a branch goes; the same inside of an article; how fast the weight of a node's own styles falls.
THRESHOLD, MARKED, GAMMA = 0.2, 0.05, 0.9
#: Different articles that must have a node before it can go from them.
MARKED_PAGES = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text.
RAW = frozenset("script style noscript template textarea iframe title".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the first kind ends where one of the second begins.
_CLOSES = {"p": BLOCKS - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"])}
_NOISE_TAGS = frozenset("nav footer aside form header head menu dialog button select svg canvas object audio video map input label fieldset".split()) | RAW
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Not noise inside of an article: its own headline and the like.
_OWN_TAGS, _OWN_ROLES = frozenset(["header", "label", "fieldset"]), frozenset(["banner"])
#: Elements that hold text and no sections: inside of an article their class says how they look.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr table tbody caption figcaption hgroup header b i em strong code q cite a mark small sub sup u s".split())
#: Words of class and id that state noise.
_NOISE = re.compile(
    r"(?:^|[\s_\-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|foot\w*|side-?bar\w*|aside|widget\w*|related|recommend\w*|popular|comments?|reply|replies|respond|disqus|discussion|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|subscribe|newsletter|signup|login|search\w*|share|sharing|social|pagination|pager|tags?|skip|hidden|toolbar|copyright|legal|disclaimer|toc)(?=$|[\s_\-\d])",
    re.I,
)
_HEADS = re.compile(r"header|masthead", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMENT = re.compile(r"comment|reply", re.I)
_CONTENT_TAGS = frozenset(["article", "main"])
_SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    """outside, inside: whether its markup states noise, when it stands outside or inside of content. content: "main", "article" or ""."""

    tag: str
    name: str = ""
    outside: bool = False
    inside: bool = False
    content: str = ""
    children: list[Element | str] = field(default_factory=list)


def _element(tag: str, attrs: dict[str, str]) -> Element:
    classes = ".".join(sorted(re.sub(r"\d+", "0", attrs["class"]).lower().split())) if "class" in attrs else ""
    el = Element(tag, f"{tag}.{classes}" if classes else tag)
    role = attrs.get("role", "").lower() if attrs else ""
    el.outside = tag in _NOISE_TAGS or role in _NOISE_ROLES
    el.inside = (tag in _NOISE_TAGS and tag not in _OWN_TAGS) or (role in _NOISE_ROLES and role not in _OWN_ROLES)
    if not attrs or tag in ("html", "body"):
        el.content = tag if tag in _CONTENT_TAGS else ""
        return el
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        el.outside = el.inside = True
    words = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if (tag in _CONTENT_TAGS and not _COMMENT.search(words)) or role in _CONTENT_TAGS:
        el.content = role if role in _CONTENT_TAGS else tag
    elif words.strip() and _NOISE.search(words):
        el.outside = True
        el.inside = el.inside or (tag not in _TEXT_TAGS and bool(_NOISE.search(_HEADS.sub("", words))))
    return el


class _Tokens:
    """Tags of a page from left to right, in time linear in its length: whatever is looked for in vain once isn't looked for again."""

    def __init__(self, text: str):
        self.text, self.last = text, {c: text.rfind(c) for c in ">\"'"}

    def tag(self, at: int) -> tuple[bool, str, str, bool, int] | None:
        """(whether it is an end, name, attributes, whether it closes itself, place after it) of the tag at ``at``; None if it never ends."""
        text = self.text
        m = _SIMPLE_TAG.match(text, at) if at < self.last[">"] else None
        if m:
            closing, name, rest, end = bool(m[1]), m[2], m[3], m.end()
        else:
            named = _TAG_NAME.match(text, at)
            pos = start = named.end()
            while True:
                if pos > self.last[">"]:
                    return None
                m = _STOP.search(text, pos)
                if m is None:
                    return None
                pos = m.end()
                if m[0] == ">":
                    break
                # A quote opens a value only after "="; any other is a letter like others.
                before = text[start : m.start()].rstrip()[-1:] if m.start() - start < 64 else text[m.start() - 64 : m.start()].rstrip()[-1:]
                if before == "=" and pos <= self.last[m[0]]:
                    pos = text.index(m[0], pos) + 1
            closing, name, rest, end = text[at + 1] == "/", named[1], text[start : pos - 1], pos
        return closing, name.lower(), rest, rest.endswith("/"), end


def parse(html: str | None) -> Element:
    """The element tree of a page. Open ends are closed as browsers close them; no markup raises."""
    root, text, at = Element("#root", "#root"), html or "", 0
    tokens, lower = _Tokens(text), None
    # Places in the stack: of elements of each tag, of those that an inline element can't keep open, and of those that a stray end doesn't leave.
    stack, places, firm, walls = [root], {}, [], []

    def cut(k: int) -> None:
        for e in reversed(stack[k:]):
            places[e.tag].pop()
        del stack[k:]
        while firm and firm[-1] >= k:
            firm.pop()
        while walls and walls[-1] >= k:
            walls.pop()

    while at < len(text):
        begin = text.find("<", at)
        if begin < 0:
            stack[-1].children.append(text[at:])
            break
        if begin > at:
            stack[-1].children.append(text[at:begin])
        nxt = text[begin + 1 : begin + 2]
        if nxt in ("!", "?"):
            close, skip = ("-->", 4) if text.startswith("<!--", begin) else ("]]>", 9) if text.startswith("<![CDATA[", begin) else (">", 2)
            end = text.find(close, begin + skip)
            at = len(text) if end < 0 else end + len(close)
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and (c := text[begin + 2 : begin + 3]).isascii() and c.isalpha()):
            stack[-1].children.append("<")
            at = begin + 1
            continue
        token = tokens.tag(begin)
        if token is None:
            break
        closing, tag, rest, alone, at = token
        if closing:
            if places.get(tag):
                k = places[tag][-1]
                if not walls or walls[-1] <= k or tag in ("table", "body", "html", "article", "tr", "tbody", "main"):
                    cut(k)
            continue
        while firm and tag in _CLOSES.get(stack[firm[-1]].tag, ()):
            cut(firm[-1])
        attrs: dict[str, str] = {}
        if rest.strip(" \t\n\r\f/"):
            for a in _ATTR.finditer(rest):
                attrs.setdefault(a[1].lower(), entities.unescape(next((v for v in a.groups()[1:] if v is not None), "")))
        el = _element(tag, attrs)
        stack[-1].children.append(el)
        if tag in VOID or alone:
            continue
        if tag in RAW:
            lower = lower if lower is not None else text.lower() if len(text.lower()) == len(text) else re.sub("[A-Z]", lambda m: m[0].lower(), text)
            while True:
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    at = len(text)
                    break
                at = end + 2 + len(tag)
                if text[at : at + 1] in ("", ">", "/") or text[at].isspace():
                    close = text.find(">", at)
                    at = len(text) if close < 0 else close + 1
                    break
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS or tag in _CLOSES:
            firm.append(len(stack))
        if tag in ("td", "th", "article"):
            walls.append(len(stack))
        stack.append(el)
    return root


def _child_key(parent: int, name: str, marked: bool) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent ^ marked) >> 1


@dataclass(slots=True)
class Region:
    """A content element: its kind, the region around it, the element that holds it, and how much text is its own."""

    kind: str
    around: int
    holder: int
    size: int = 0


@dataclass(slots=True)
class Page:
    """blocks: (node, region, whether a branch of ``low`` holds it, text). styles: (node, parent, marked, style). Noise is in neither."""

    blocks: list[tuple[int, int, bool, str]]
    styles: list[tuple[int, int, bool, str]]
    regions: list[Region]


def layout(root: Element, low: frozenset[int] | set[int] = frozenset()) -> Page:
    """A page's blocks in order and its nodes' styles. Region -1 is outside of content. No recursion, so any depth will do."""
    page, run = Page([], [], []), []

    def flush(node: int, region: int, gone: bool, noise: bool) -> None:
        text = _SPACES.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text and not noise:
            page.blocks.append((node, region, gone, text))
            if region >= 0:
                page.regions[region].size += len(text)

    # A frame: children, node, region, gone, noise, whether a block ends with it, number of the element.
    frames: list[tuple] = [(iter(root.children), 0, -1, False, False, True, 0)]
    page.styles.append((0, 0, False, _style(root, False)))
    elements = 0
    while frames:
        children, node, region, gone, noise, ends, number = frames[-1]
        for c in children:
            if isinstance(c, str):
                run.append(c)
                continue
            if c.tag == "br" or c.tag == "hr":
                run.append("\n")
                if c.tag == "hr":
                    flush(node, region, gone, noise)
                continue
            elements += 1
            own_noise = noise or (c.inside if region >= 0 else c.outside and not c.content)
            content = c.content and not own_noise
            block = c.tag in BLOCKS or own_noise != noise or bool(content)
            if not block:
                frames.append((iter(c.children), node, region, gone, noise, False, elements))
                break
            flush(node, region, gone, noise)
            at = region
            if content:
                page.regions.append(Region(c.content, region, number))
                at = len(page.regions) - 1
            key = _child_key(node, c.name, at >= 0)
            if not own_noise:
                page.styles.append((key, node, at >= 0, _style(c, at >= 0)))
            frames.append((iter(c.children), key, at, gone or key in low, own_noise, True, elements))
            break
        else:
            if ends:
                flush(node, region, gone, noise)
            frames.pop()
    return page


def _style(e: Element, marked: bool) -> str:
    """Names of the child blocks in order, repeats once."""
    return ",".join(dict.fromkeys(c.name for c in e.children if isinstance(c, Element) and c.tag in BLOCKS and not (c.inside if marked else c.outside)))


def main_regions(regions: list[Region]) -> set[int]:
    """The content elements whose text is the page's: the main element, or else its articles.

    Of articles that stand in different places, those that stand where most text does; an article
    inside of an article that has text of its own is a comment or teaser.
    """
    def best(members: list[int]) -> list[int]:
        """Of ``members``, regions on one level, those that share an element with most text in all."""
        by: dict[int, int] = {}
        for i in members:
            by[regions[i].holder] = by.get(regions[i].holder, 0) + total[i]
        top = max(by, key=lambda h: by[h])  # the first of those that tie
        return [i for i in members if regions[i].holder == top]

    total = [r.size for r in regions]
    for i in range(len(regions) - 1, -1, -1):
        if regions[i].around >= 0:
            total[regions[i].around] += total[i]
    inner: dict[int, list[int]] = {}
    for i, r in enumerate(regions):
        inner.setdefault(r.around, []).append(i)
    top = [i for i in inner.get(-1, []) if total[i]]
    level = [i for i in top if regions[i].kind == "main"] or (best(top) if top else [])
    kept: set[int] = set()
    while level:
        kept.update(level)
        below: list[int] = []
        for i in level:
            own = [j for j in inner.get(i, []) if total[j]]
            if own and (regions[i].kind == "main" or not regions[i].size):
                below += best(own)
        level = below
    return kept


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of a page outside of noise and of the branches ``low``, joined by empty lines; of its main content, if it marks one."""
    page = layout(parse(html), low)
    kept = main_regions(page.regions) or {-1}
    return "\n\n".join(t for _, r, gone, t in page.blocks if r in kept and not gone)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


_NODE = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("marked", pa.bool_()), ("kind", pa.string()), ("value", pa.int64())])
_PAGE_DDL = "host string, page long, rows array<struct<node: bigint, parent: bigint, marked: boolean, kind: string, value: bigint>>"


def page_rows(html: str | None) -> tuple[int, list[dict]]:
    """What a page adds to its host's tree, and a number that pages with the same article share; kind "s" is a node's style, "c" a content of it."""
    page = layout(parse(html))
    kept = main_regions(page.regions)
    longest = max((t for _, r, _, t in page.blocks if r in kept), key=len, default=html or "")
    use = lambda r: not kept or r in kept  # noqa: E731  branches outside of marked content have no say
    rows = {(n, p, m, "s", _hash(v)) for n, p, m, v in page.styles if m or not kept}
    parents = {n: (p, m) for n, p, m, _ in page.styles}
    rows |= {(n, *parents[n], "c", _hash(t)) for n, r, _, t in page.blocks if use(r) and n in parents}
    return _hash(longest), [dict(zip(("node", "parent", "marked", "kind", "value"), r, strict=True)) for r in sorted(rows)]


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = [page_rows(h.as_py()) for h in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in pages], pa.int64()), pa.array([r for _, r in pages], pa.list_(_NODE))], names=["host", "page", "rows"])


def host_column():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def node_statistics(pages: DataFrame, path: str | None = None) -> DataFrame:
    """host, node, parent, marked, pages, styles, own (entropy of styles), leaf (importance of contents), single: a row for each node that two pages of its host have, or that has a child of one page.

    ``pages``: host, html. Pages of a host with the same article (or equal ones, if they mark none)
    count once. ``single`` is the number of children that one page has: their importance is 1.
    Groups are reduced by their values, so no host meets in one task.
    """
    once = pages.select("host", "html").mapInArrow(tidy(_page_batches), _PAGE_DDL).groupBy("host", "page").agg(F.min("rows").alias("rows"))
    counted = once.select("host", F.explode("rows").alias("r")).select("host", "r.*").groupBy("host", "node", "parent", "marked", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    node = counted.groupBy("host", "node", "parent", "marked", "kind").agg(total.alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.count(F.lit(1)).alias("k"))
    # Entropy of n_i / m, to base m: 1 for one page each, 0 for one value on all. A node of one page is important.
    entropy = F.when(F.col("m") <= 1, 1.0).otherwise((F.log2("m") - F.col("nlogn") / F.col("m")) / F.log2("m"))
    style, content = F.col("kind") == "s", F.col("kind") == "c"
    wide = node.withColumn("e", entropy).groupBy("host", "node", "parent", "marked").agg(
        F.max(F.when(style, F.col("m"))).alias("pages"), F.max(F.when(style, F.col("k"))).alias("styles"), F.max(F.when(style, F.col("e"))).alias("own"), F.max(F.when(content, F.col("e"))).alias("leaf")
    )
    wide = stored(wide, f"{path or scratch(pages.sparkSession)}/nodes")  # read twice below; pages are parsed once
    several, alone = F.col("pages") >= 2, (F.coalesce("pages", F.lit(1)) < 2) & (F.col("node") != 0)
    own = wide.where(several).withColumn("single", F.lit(0).cast("long"))
    kids = wide.where(alone).groupBy("host", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_single"))
    return own.join(kids, ["host", "node"], "left").withColumn("single", F.coalesce("_single", "single")).drop("_single")


def importances(nodes: list[tuple[int, int, int, float, float | None, int]]) -> dict[int, float]:
    """Composite importance of each node of a host. nodes: (node, parent, styles, own, leaf, single).

    A node with children weighs its own entropy against the mean of theirs, by GAMMA to the number of
    its styles; a leaf has that of its contents. A node with both takes the larger.
    """
    known = {n[0]: n for n in nodes}
    below: dict[int, list[int]] = {}
    for n, parent, *_ in nodes:
        if n != parent:
            below.setdefault(parent, []).append(n)
    order = [n for n, parent, *_ in nodes if n == parent or parent not in known]
    for n in order:  # grows: every node after its parent
        order += below.get(n, [])
    out: dict[int, float] = {}
    for n in reversed(order):
        _, _, styles, own, leaf, single = known[n]
        kids = [out[c] for c in below.get(n, ())]
        mean = (sum(kids) + single) / (len(kids) + single) if kids or single else None
        weight = GAMMA ** (styles or 1)
        inner = None if mean is None else (1 - weight) * (own or 0.0) + weight * mean
        out[n] = max(x for x in (inner, leaf, 0.0 if mean is not None or leaf is not None else own or 0.0) if x is not None)
    return out


def host_tables(statistics: DataFrame, threshold: float = THRESHOLD, marked: float = MARKED) -> DataFrame:
    """host, low: the nodes whose branches are removed. A host's nodes of two pages and more are bounded by its templates, not by its pages."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = []
            for nodes in b.column(1).to_pylist():
                imp = importances([tuple(n[k] for k in ("node", "parent", "styles", "own", "leaf", "single")) for n in nodes])
                low.append(sorted(n["node"] for n in nodes if n["node"] and (imp[n["node"]] < (marked if n["marked"] else threshold)) and (not n["marked"] or n["pages"] >= MARKED_PAGES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.list_(pa.int64()))], names=["host", "low"])

    grouped = statistics.groupBy("host").agg(F.collect_list(F.struct("node", "parent", "marked", "pages", "styles", "own", "leaf", "single")).alias("nodes"))
    return grouped.mapInArrow(tidy(one), "host string, low array<long>").where(F.size("low") > 0)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists, texts = b.column(4), []
        for i, html in enumerate(b.column(3)):
            low = lists[i]
            texts.append(main_text(html.as_py(), frozenset(np.asarray(low.values).tolist()) if low.is_valid else frozenset()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)


def extract(pages: DataFrame, path: str | None = None, threshold: float = THRESHOLD, marked: float = MARKED) -> DataFrame:
    """page_id, url, host, text, n_chars of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null and empty html give an empty text; a null or hostless url shares one tree with others like
    it. Repeated rows are each extracted. Time is linear in a page's length at any depth and however
    broken its markup, so a very long page is only long. No rows give no texts. Spark sends the
    hosts' tables to all tasks where they are small; else it joins them and splits a host of many pages.
    """
    path = path or scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_column().alias("host"), F.col("html").cast("string").alias("html"))
    tables = stored(host_tables(node_statistics(rows, path), threshold, marked), f"{path}/hosts")
    return rows.join(tables, "host", "left").select("page_id", "url", "host", "html", "low").mapInArrow(tidy(_extract), "page_id long, url string, host string, text string, n_chars long")


def site_tree_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``extract`` over all of ``pages``."""
    return extract(pages)
