"""Main text of web pages, with site template removal.

Pages are parsed into element trees.  The subtrees of every page are hashed and
counted per host in Spark; subtrees that recur on many pages of their host are
that site's template and are deleted.  Pages that agree count once, so that
copies do not make each other's text a template.  Within a marked article the
bar is higher: a block goes if most of the host's articles hold it, but a
stretch that is mostly links goes as it would outside.  What does not recur is
judged by markup: elements that it names as no part of an article (menus,
footers, forms, scripts, adverts, comments, ...) are deleted too, and if a page
marks its article, the text is taken from there.
"""

from __future__ import annotations

import html
import re
from collections import Counter


import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, session_of

#: A subtree is template if at least so many pages and this share of its host's pages hold it.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: A text block within marked articles is if at least so many articles and this share of its host's hold it.
LEAST_ARTICLES, ARTICLE_SHARE = 20, 0.5
#: Tells the hash of a block within an article from that of the same subtree elsewhere (any fixed number).
_INNER = 0x2545F4914F6CDD1D
#: Template hashes up to this many are broadcast; more are joined.
MOST_SENT = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that are no part of an article's text.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video map nav header footer aside form button input select textarea option optgroup datalist fieldset label dialog menu head title noembed noframes".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr".split())
#: Start tags that end an open element of these names, up to the given bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: Formatting elements only change looks; they need no node.
INLINE = frozenset("b i em strong u s small big font tt code kbd samp var cite abbr acronym span sub sup mark del ins q dfn time bdi bdo strike wbr nobr ruby rt rp data".split())
#: Words in class, id or role that name what is no part of an article.
NAMED = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar header masthead banner footer contentinfo complementary search ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus pagination pager widget toolbar skip".split()
)
#: Prefixes of class names which tell of a part elsewhere on the page.
_ABOUT = ("no-", "has-", "with-", "without-")
#: What never holds the page's own article, though it may hold an element so marked.
ASIDE = frozenset("nav footer aside template noscript menu svg select".split())
ASIDE_NAMES = frozenset("comment comments respond disqus related recommended sidebar footer widget promo sponsor sponsored ad ads advert nav".split())
_WORDS = re.compile(r"[a-z]+")
_ROLE_MAIN = re.compile(r"^(main|article)$")
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\s*=\s*"[^"]*"|\s*=\s*'[^']*'|[^>])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_CUT_OFF = re.compile(r"<[/a-zA-Z!?][^<]*\Z")
_SPACE = re.compile(r"[\s ]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)


class Element:
    """An element; ``items`` holds strings (text), elements and None (a line break)."""

    __slots__ = ("attrs", "items", "key", "links", "size", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.items = tag, attrs, []
        self.key, self.size, self.links = 0, 0, 0

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(self.attrs))} if "=" in self.attrs else {}


def parse(page: str) -> Element:
    """The tree of a page; never fails, whatever the markup."""
    root = Element("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # open elements by name
    search, unescape = _TOKEN.search, html.unescape
    while True:
        m = search(page, at)
        text = page[at : m.start() if m else len(page)]
        if m is None and "<" in text:
            text = _CUT_OFF.sub("", text)  # a tag that the end of the page cuts off
        if text:
            stack[-1].items.append(unescape(text) if "&" in text else text)
        if m is None:
            return root
        at, name = m.end(), m[2]
        if not name:
            continue
        tag = name.lower()
        if tag in INLINE:
            continue
        if m[1]:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    opened.subtract(e.tag for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "article", "body") and tag in ("p", "li", "a"):
                    break
            continue
        if tag == "br":
            stack[-1].items.append(" ")
            continue
        if tag in ENDS_P and opened["p"]:
            _close(stack, opened, {"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED and any(opened[t] for t in IMPLIED[tag][0]):
            _close(stack, opened, *IMPLIED[tag])
        element = Element(tag, m[3])
        stack[-1].items.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            element.items.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if not m[3].endswith("/") or tag in BLOCKS:
            stack.append(element)
            opened[tag] += 1


def _close(stack: list[Element], opened: Counter[str], tags: set[str], bounds: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            opened.subtract(e.tag for e in stack[i:])
            del stack[i:]
            return
        if stack[i].tag in bounds or (stack[i].tag in BLOCKS and stack[i].tag not in ("p", "div", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot")):
            return


def named_off(e: Element) -> bool:
    """Whether the element's name, class, id or role says that it is no part of an article."""
    if e.tag in DROPPED:
        return True
    if not e.attrs or e.tag in ("html", "body", "main", "article"):
        return False
    low = e.attrs.lower()
    if "hidden" in low and re.search(r"(?:^|\s)hidden(?:\s|=|$)", low):
        return True
    if "class" in low or "id" in low or "role" in low:
        a = e.attributes()
        return any(w in NAMED for k in ("class", "id", "role") for part in a.get(k, "").lower().split() if not part.startswith(_ABOUT) for w in _WORDS.findall(part))
    return False


def is_article(e: Element) -> bool:
    if e.tag in ("article", "main"):
        return True
    return bool(e.attrs) and ("role" in e.attrs or "itemprop" in e.attrs) and bool(_ROLE_MAIN.match((a := e.attributes()).get("role", "")) or a.get("itemprop") == "articleBody")


def find_articles(root: Element) -> list[Element]:
    """The outermost marked articles that are not within something named off."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.tag in ASIDE or (e.attrs and e.tag != "body" and named_off(e) and not ASIDE_NAMES.isdisjoint(_WORDS.findall(e.attrs.lower()))):
            continue
        if is_article(e):
            found.append(e)
        else:
            todo += [x for x in reversed(e.items) if isinstance(x, Element)]
    return found


def hash_subtrees(root: Element) -> None:
    """Give each element the hash of its subtree, its text length and how much of that is in links."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [x for x in e.items if isinstance(x, Element)]
    for e in reversed(order):
        parts, size, links = [e.tag], 0, 0
        for x in e.items:
            if isinstance(x, Element):
                parts.append(f"\x01{x.key:x}")
                size += x.size
                links += x.links
            elif x:
                t = _SPACE.sub(" ", x).strip()
                parts.append("\x02" + t)
                size += len(t)
        e.key = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        e.size, e.links = size, size if e.tag == "a" else links


def candidates(root: Element) -> tuple[set[int], set[int], int]:
    """Hashes of the subtrees that may be template: all outside marked articles and link lists within, blocks within, and the hash of the articles."""
    articles = find_articles(root)
    marked = {id(e) for e in articles}
    outer: set[int] = set()
    inner: set[int] = set()
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        if e is not root and e.size and id(e) not in marked and e.tag not in ("html", "body", "head") and e.tag not in RAW:
            if not inside or 2 * e.links >= e.size:
                outer.add(e.key)
            elif e.tag in BLOCKS:
                inner.add(e.key ^ _INNER)
        inside = inside or id(e) in marked
        todo += [(x, inside) for x in e.items if isinstance(x, Element)]
    return outer, inner, xxhash.xxh3_64_intdigest(",".join(str(e.key) for e in articles)) - (1 << 63)


def is_template(e: Element, template: frozenset[int] | set[int], inside: bool) -> bool:
    """Whether the host's counts say that a subtree is template."""
    if not inside or 2 * e.links >= e.size > 0:
        return e.key in template
    return e.tag in BLOCKS and e.key ^ _INNER in template


def extract(root: Element, template: frozenset[int] | set[int]) -> str:
    """The main text: blocks in page order, one line each."""
    articles = find_articles(root)
    roots, inside = (articles, True) if articles else ([root], False)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (text := _SPACE.sub(" ", "".join(held)).strip()):
            blocks.append(text)
        held.clear()

    for top in roots:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x is not top and (is_template(x, template, inside) or named_off(x)):
                if x.tag in BLOCKS:
                    flush()
            elif x.tag in BLOCKS:
                flush()
                todo.append(None)
                todo += reversed(x.items)
            else:
                todo += reversed(x.items)
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def subtrees(pages: DataFrame, page: str, url: str) -> DataFrame:
    """(host, inner, part, keys): the subtrees of each page that may be template; ``part`` names the page or, for those within articles, the articles."""
    narrow = pages.select(F.col(url).cast("string").alias("u"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("h"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(h)
            hash_subtrees(root)
            outer, inner, articles = candidates(root)
            rows.append((host_of(u), False, root.key, sorted(outer)))
            if inner:
                rows.append((host_of(u), True, articles, sorted(inner)))
        types = (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "inner", "part", "keys"])

    return map_arrow(narrow, "host string, inner boolean, part bigint, keys array<bigint>", step, "h")


def site_templates(pages: DataFrame, page: str = "html", url: str = "url", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_articles: int = LEAST_ARTICLES, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """(host, key) of template subtrees, counted over the distinct pages (within articles: distinct articles) of each host.

    A host has at most (subtrees of a page) / ``least_share`` of them, however many pages it has.
    """
    scratch = Scratch(session_of(pages))
    seen = scratch.save(subtrees(pages, page, url).dropDuplicates(["host", "inner", "part"]), "subtrees")
    least = F.when(F.col("inner"), least_articles).otherwise(least_pages)
    share = F.when(F.col("inner"), article_share).otherwise(least_share)
    sizes = seen.groupBy("host", "inner").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= least)
    counts = seen.select("host", "inner", F.explode("keys").alias("key")).groupBy("host", "inner", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.join(sizes, ["host", "inner"]).where(F.col("n") >= share * F.col("all")).select("host", "key")


def extract_pages(pages: DataFrame, page: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_articles: int = LEAST_ARTICLES, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """The columns ``keep``, then text and n_chars (code points): one row per row of ``pages``.

    A null page counts as empty and gives an empty text; a null url belongs to a
    host without name.  Repeated rows stay repeated, but count once for their
    host's template.  A page is parsed twice, once for the counts and once for
    its text, as trees are larger than pages.  An empty table gives no rows.
    """
    scratch = Scratch(session_of(pages))
    templates = scratch.save(site_templates(pages, page, url, least_pages, least_share, least_articles, article_share), "templates")
    few = templates.limit(MOST_SENT + 1).count() <= MOST_SENT
    by_host: dict[str, set[int]] = {}
    for r in templates.collect() if few else ():
        by_host.setdefault(r.host, set()).add(r.key)
    sent = pages.sparkSession.sparkContext.broadcast(by_host)
    rows = pages.select(*keep, F.col(url).cast("string").alias("__url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("__html"))
    if few:
        rows = rows.withColumn("__own", F.lit(None).cast("array<bigint>"))
    else:
        host = F.lower(F.regexp_extract(F.coalesce("__url", F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
        own = templates.groupBy("host").agg(F.collect_list("key").alias("__own"))
        rows = rows.withColumn("__host", host).join(own.withColumnRenamed("host", "__host"), "__host", "left").select(*keep, "__url", "__html", "__own")
    names = [*keep, "text", "n_chars"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-3]), "text string, n_chars bigint"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for u, h, own in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True):
            root = parse(h)
            template = set(own) if own else sent.value.get(host_of(u), ())
            if template:
                hash_subtrees(root)
            texts.append(extract(root, template))
        return pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return map_arrow(rows, schema, step, "__html")


__all__ = ["extract", "extract_pages", "parse", "site_templates"]
