"""Main text of web pages by equivalence-class template deduction.

Every page is read as tokens: the paths of its elements, its text blocks and its layout (the set of its container
paths). Over the distinct pages of a host, tokens with equal occurrence vectors (held as two 64-bit sums over
pages) form a class; it is valid on PAGES pages, whatever their share of the host. Paths nest by construction.
A layout on that many pages has slots: the containers (or article or main elements) whose text varies, each with at
least SHARE of the text of the largest; where the largest is an article or main element, only such ones. Shared text
outside the slots goes; inside, shared text goes if its class holds an element path or layout, that is, if it comes
with the layout, but headings stay, and all stays where such text is half of what the slots hold or more: then the
pages are copies of one article. Text inside a slot that only some pages of a layout share is a copied passage and
stays. Pages without a slot by template fall back on tag and class names, then on
their heaviest container. Lists of links, adverts, forms, notices, comments and other named boilerplate never
count as a slot and are left out inside one: their text varies as the main text does.

Defined results: null and empty html give an empty text; a null or odd url has no host and so no template,
and its page is judged alone; broken and cut-off markup is read as far as it goes; repeated rows are extracted
alike; extra columns stay, and those named like a result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, saved, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title|object|canvas|button)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s>/]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# Elements of HTML by how they shape text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "semantics"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
# Names of boilerplate: the first wherever they stand in a class or id, the others alone, last, or before words of layout.
_ANYWHERE = "advert|adverts|advertisement|adbox|sponsor|sponsored|sidebar|comment|comments|disqus|cookie|cookies|consent|gdpr|newsletter|breadcrumb|breadcrumbs|navbar|navigation|nav|footer|masthead|pagination|pager|menu|popup|modal"
_LAST = "ad|ads|banner|promo|side-bar|respond|reply|replies|notice|notices|alert|overlay|subscribe|subscription|signup|share|sharing|social|related|recommended|widget|toolbar|skip|login|search|legal|copyright|tags"
_LAYOUT = "area|articles|bar|banner|block|bottom|box|button|buttons|col|container|content|form|group|icons|inner|items|left|link|links|list|message|outer|panel|posts|right|row|section|slot|space|stories|text|top|unit|wrap|wrapper|zone|[0-9]+"
NAMED = re.compile(rf"(?:^|[\s_-])(?:(?:{_ANYWHERE})(?=$|[\s_-])|(?:{_LAST})(?:[_-](?:{_LAYOUT}))*(?=$|\s))", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main)(?:[\s_-]?(?:body|content|text))?(?=$|[\s])", re.I)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements of running text: the container of a text is the nearest element above it of another kind.
TEXTUAL = HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "caption", "center", "address"} | INLINE
#: A class is valid on this many distinct pages of a host.
PAGES = 3
#: Part of the largest slot's text that another slot of the layout has at least.
SHARE = 1 / 8
#: Pages of one host and layout meet its slots in so many parts, each with a copy of the slots.
PARTS = 16


class Block:
    __slots__ = ("bad", "linked", "main", "path", "text")

    def __init__(self, path, main, bad, text, linked):
        self.path, self.main, self.bad, self.text, self.linked = path, main, bad, text, linked


#: Characters from which the upper part of a path is written as a code; `above` leads from the code back to it.
LONG = 400


def parent(path: str, above: dict[str, str]) -> str:
    """The path of the element above."""
    up = path.rpartition("/")[0]
    return above.get(up, up)


def read(page: str) -> tuple[list[Block], dict[str, int], dict[str, str]]:
    """(text blocks in page order, how often each element path occurs, the upper parts of long paths by code)."""
    blocks: list[Block] = []
    above_of: dict[str, str] = {}
    paths: dict[str, int] = {}
    stack: list[tuple[str, str, str, bool]] = [("", "", "", False)]  # name, path, path of main ("": outside), boilerplate
    parts: list[str] = []
    in_link = linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, path, main, bad = stack[-1]
                blocks.append(Block(path, main, bad, text, linked))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if (text := m["text"]) is not None:
            text = entities.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            if m["raw"] is not None and m["raw"].lower() in ("title", "iframe", "object", "textarea"):
                flush()
            continue
        name, attrs = name.lower(), (m["attrs"] if m["name"] else m["attrs2"]) or ""
        closing = m["close"] or m["close2"]
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            if closing or not attrs or not ("class" in attrs or "id" in attrs or "hidden" in attrs):
                continue
            found = _named(attrs)
            if not found[0]:
                continue
            # a named boilerplate span is an element of its own
        flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, max(0, len(stack) - 4), -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
        ends = SIBLING.get(name)
        while ends and len(stack) > 1 and stack[-1][0] in ends:
            stack.pop()
        _, above, main, bad = stack[-1]
        named, main_named, label = _named(attrs) if attrs else (False, False, "")
        whole = name in ("html", "body", "main", "article")  # never boilerplate by a class name
        bad = bad or name in BOILERPLATE or (named and not whole) or (name == "header" and not main)
        if name == "header" and main:
            label = "~" + label
        if len(above) >= LONG:
            code = f"#{_code(above)}"
            above_of[code] = above
            above = code
        path = f"{above}/{name}{label}"
        if not main and not bad and (name in ("article", "main") or main_named):
            main = path
        if not attrs.rstrip().endswith("/") or name not in INLINE:
            stack.append((name, path, main, bad))
        paths[path] = paths.get(path, 0) + 1
    flush()
    return blocks, paths, above_of


def _named(attrs: str) -> tuple[bool, bool, str]:
    """(boilerplate by its names, main by its names, label of its classes)."""
    got = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    names = " ".join(x for x in (got.get("class", ""), got.get("id", "")) if x)
    hidden = "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs) is not None or "display:none" in got.get("style", "").replace(" ", "")
    role = got.get("role", "").lower()
    itemprop = got.get("itemprop", "").lower()
    bad = hidden or role in ROLES or bool(names and NAMED.search(names)) or got.get("aria-hidden") == "true"
    main = role in ("main", "article") or itemprop == "articlebody" or bool(names and MAIN.search(names))
    return bad and not main, main, "." + ".".join(names.split()).replace("/", "_") if names else ""


def _code(x: str) -> int:
    return int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _textual(step: str) -> bool:
    return re.split(r"[.~]", step, maxsplit=1)[0] in TEXTUAL


def _container(path: str, above: dict[str, str]) -> str:
    """The nearest element at or above the path that is not one of running text."""
    while path and _textual(path.rpartition("/")[2]):
        path = parent(path, above)
    return path


def host_of(url):
    """The host in lower case, without user and port."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, layout, t) for every page; t: code, n, is_text, slot (of a text that may be main), size and
    whether the slot is an article or main element."""
    cell = pa.struct([("code", pa.int64()), ("n", pa.int32()), ("is_text", pa.bool_()), ("slot", pa.int64()), ("size", pa.int32()), ("main", pa.bool_())])

    def run(batches):
        for b in batches:
            layouts, found = [], []
            for text in b.column("html").to_pylist():
                blocks, paths, above = read(text or "")
                layout = _code("\n".join(sorted({_container(p, above) for p in paths})))
                own = [(layout, 1, False, None, 0, False)] + [(_code(p), n, False, None, 0, False) for p, n in paths.items()]
                seen: dict = {}
                for x in blocks:
                    key = (x.path, x.text)
                    if key in seen:
                        seen[key][1] += len(x.text)
                    else:
                        seen[key] = [None if x.bad else x.main or _container(x.path, above), len(x.text), bool(x.main)]
                slots = {x: None if x is None else _code(x) for x, _, _ in seen.values()}
                own += [(_code(p + "\0" + t), 1, True, slots[x], size, main) for (p, t), (x, size, main) in seen.items()]
                layouts.append(layout)
                found.append([dict(zip(("code", "n", "is_text", "slot", "size", "main"), o, strict=True)) for o in own])
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(layouts, pa.int64()), pa.array(found, pa.list_(cell))], names=["host", "page", "layout", "t"])

    return pages.mapInArrow(run, "host string, page long, layout long, t array<struct<code: long, n: int, is_text: boolean, slot: long, size: int, main: boolean>>")


def templates(pages: DataFrame) -> DataFrame:
    """One row per distinct page: codes of its shared texts, of those its layout comes with, and of its slots.

    pages: host, page (a code of html), html.
    """
    t = saved(tokens(pages.where("host IS NOT NULL AND html IS NOT NULL")).dropDuplicates(["host", "page"]))
    each = t.select("host", "page", "layout", F.inline("t"))
    vectors = each.groupBy("host", "code").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("v1"), F.bit_xor(F.xxhash64(F.lit(3), "page", "n")).alias("v2"), F.count("*").alias("support"),
        F.first("is_text").alias("is_text"), F.first("slot").alias("slot"), F.max("main").alias("main"), F.sum("size").alias("size"), F.min("layout").alias("l1"), F.max("layout").alias("l2"),
    )
    often = F.col("support") >= PAGES
    # a text on fewer pages has at most two layouts: of all these only the sums by layout and slot are kept
    none = F.array(F.lit(None).cast("long"))
    kept = vectors.select("host", *(F.when(often, F.col(c)).alias(c) for c in ("code", "v1", "v2")), "is_text", F.when(~often, F.col("slot")).alias("slot"), "size", "main", F.explode(F.when(often, none).otherwise(F.array_distinct(F.array("l1", "l2")))).alias("layout"))
    kept = saved(kept.where("code IS NOT NULL OR slot IS NOT NULL").groupBy("host", "code", "v1", "v2", "is_text", "layout", "slot").agg(F.sum("size").alias("size"), F.max("main").alias("main")))
    shared = kept.where("code IS NOT NULL").select("host", "code", "v1", "v2", "is_text")
    classes = shared.groupBy("host", "v1", "v2").agg(F.max(~F.col("is_text")).alias("fixed"))
    texts = shared.where("is_text").join(classes, ["host", "v1", "v2"]).select("host", "code", "fixed")
    layouts = shared.where("NOT is_text").select("host", F.col("code").alias("layout"))
    varying = kept.where("code IS NULL").join(layouts, ["host", "layout"], "left_semi").select("host", "layout", "slot", "size", "main")
    largest = varying.groupBy("host", "layout").agg(F.max(F.struct("size", "main", "slot")).alias("top"))
    enough = (F.col("size") >= F.col("top.size") * SHARE) & (F.col("main") | ~F.col("top.main"))
    slots = varying.join(largest, ["host", "layout"]).where(enough).groupBy("host", "layout").agg(F.collect_list("slot").alias("slots"))
    on_page = each.where("is_text").select("host", "page", "code").join(texts, ["host", "code"]).groupBy("host", "page").agg(F.collect_list("code").alias("texts"), F.collect_list(F.when(F.col("fixed"), F.col("code"))).alias("fixed"))
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = t.select("host", "page", "layout", F.pmod("page", F.lit(PARTS)).cast("int").alias("part"))
    return dealt.join(slots, ["host", "layout", "part"], "left").drop("part").join(on_page, ["host", "page"], "left").drop("layout")


def _inside(path: str, main: str, slots: frozenset | set, known: dict, above: dict[str, str]) -> bool:
    """Whether a block is in a slot: its main element, or an element at or above its path, has the code of one."""
    key = (path, main)
    if key not in known:
        at, found = path, bool(main) and _code(main) in slots
        while at and not found:
            found = _code(at) in slots
            at = parent(at, above)
        known[key] = found or (not at and _code("") in slots)
    return known[key]


def _own(chosen: list[Block], fixed: frozenset | set) -> list[Block]:
    """The blocks of a slot without those that come with the layout, unless these are half of it or more."""
    came = [bool(fixed) and _code(b.path + "\0" + b.text) in fixed and not _heading(b) for b in chosen]
    size = sum(len(b.text) for b in chosen)
    if 2 * sum(len(b.text) for b, c in zip(chosen, came, strict=True) if c) >= size:
        return chosen
    return [b for b, c in zip(chosen, came, strict=True) if not c]


def _heading(b: Block) -> bool:
    return b.path.rpartition("/")[2].split(".")[0] in HEADINGS


def _under(path: str, top: str, above: dict[str, str]) -> bool:
    while path and path != top:
        path = parent(path, above)
    return path == top


def extract(page: str | None, texts: frozenset | set = frozenset(), slots: frozenset | set = frozenset(), fixed: frozenset | set = frozenset()) -> str:
    """The main text of one page, given its shared texts, its layout's slots and the texts that come with the layout."""
    if not page:
        return ""
    blocks, _, above = read(page)
    good = [b for b in blocks if not b.bad]
    chosen = []
    if slots:
        known: dict = {}
        chosen = _own([b for b in good if _inside(b.path, b.main, slots, known, above) and (b.main or b.linked * 2 < max(1, len(b.text)))], fixed)
    if not chosen:
        chosen = _own([b for b in good if b.main], fixed)
    if not chosen:
        good = [b for b in good if b.linked * 2 < max(1, len(b.text))]
        own = [b for b in good if not (texts and _code(b.path + "\0" + b.text) in texts)]
        good = own or good
        weight: dict = {}
        for b in good:
            up = parent(b.path, above)
            weight[up] = weight.get(up, 0) + len(b.text)
        if weight:
            top = max(weight, key=lambda k: (weight[k], k))
            chosen = [b for b in good if _under(b.path, top, above)]
    kept = []
    for b in chosen:
        if "/header~" in b.path and not _heading(b):
            continue
        kept.append(b.text)
    return "\n\n".join(kept)


def with_main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with host and main_text. Pages meet what their host's template says of them by host and code of html."""
    base = pages.drop("host", "main_text", "_page", "_texts", "_slots", "_fixed").withColumn("host", host_of(F.col(url))).withColumn("_page", F.xxhash64(html))
    found = templates(base.select("host", F.col("_page").alias("page"), F.col(html).alias("html")))
    joined = base.join(found.select("host", *(F.col(c).alias("_" + c) for c in ("page", "texts", "slots", "fixed"))), ["host", "_page"], "left")

    def run(batches):
        for b in batches:
            out = [extract(text, frozenset(texts or ()), frozenset(slots or ()), frozenset(fixed or ())) for text, texts, slots, fixed in zip(*(b.column(k).to_pylist() for k in (html, "_texts", "_slots", "_fixed")), strict=True)]
            keep = [c for c in b.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "main_text"])

    return joined.mapInArrow(run, plus(joined.drop("_page", "_texts", "_slots", "_fixed"), main_text="string"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
