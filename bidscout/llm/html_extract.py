r"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: an element's place in the tree is its path
of tags and styles (class, id, role) from the root. For each place the site knows
on how many pages it is, which sequences of children (presentations) it has
there, and which texts.

* Presentation importance: the entropy of a place's presentations over its pages,
  to the base of the number of pages (1 for a place on one page).
* Content importance: the entropy of a place's texts over its pages in the same
  way: a text that all pages share has 0, texts of their own have 1.
* A branch is as important as the more important of the two, its own or below it.

The tree sees every branch of every page, head and scripts included, and its
branches of low importance on enough pages are removed first. It can't know what
is no article but differs on each page, or is on too few pages: menus, adverts,
notices or comments like that have high entropy. For these what a page says in its
markup decides (nav, footer, script, form, role, and class names that are wholly
such names). Where a page has an article or main element, the text is from there.

A page sends a row for each of its places, not its text, to be counted; counts
are pre-aggregated, so that a hot host is spread over tasks. What comes back to a
page is the list of its own places that are to go. A place is a hash of its own
name and of its parent's place, so that depth costs nothing.

Defined cases: null html is empty and gives an empty text; pages with a null or
unreadable url are a host of their own (""); broken markup is read as it stands;
repeated rows count as pages and give repeated results; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sieve, sifted, table

#: Places with less importance are removed, if they are on so many pages at least.
LEAST_IMPORTANCE, LEAST_PAGES = 0.2, 5

# Names from the HTML standard and usual names of styles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
NOT_TEXT = frozenset("head script style noscript template iframe object svg math select option button form input textarea nav header footer aside menu dialog title canvas audio video map fieldset".split())
CLOSES = {
    "p": frozenset("p".split()),
    "li": frozenset("li p".split()),
    "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()),
    "tr": frozenset("tr td th p".split()),
    "td": frozenset("td th p".split()),
    "th": frozenset("td th p".split()),
    "option": frozenset("option".split()),
}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table article section div body html td th".split())
#: Words of class names and ids of what isn't the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead footer foot sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations teaser teasers comment comments disqus replies reply respond pagination pager skip toolbar copyright disclaimer".split()
)
#: Words that such a name may have beside them ("promo-box", "site-footer"); with any other word it says nothing ("tag-spark", "share-price").
BESIDE = frozenset(
    "area bar block bottom box center column container content entry form global group heading holder icons inner item items left link links list main outer page panel post primary region right row section secondary side site slot top unit wrap wrapper"
    " articles author avatar count customer customers guest guests member members posts public reader readers stories thread threads user users visitor visitors".split()
)
#: An article element is one unless it is of these.
NOT_AN_ARTICLE = frozenset("ad ads advert advertisement sponsor sponsored promo related recommended teaser comment comments reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)


_words = re.compile(r"[a-z]+")


def names_noise(names: str, noise: frozenset[str] = NOT_ARTICLE) -> bool:
    """Whether one of the class names (or ids) is made of a word of noise and of nothing that says otherwise."""
    for name in names.lower().split():
        words = _words.findall(name)
        if any(w in noise for w in words) and all(w in noise or w in BESIDE for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "name", "place", "above", "parts", "out")

    def __init__(self, tag: str, name: str, above: int, out: bool):
        self.tag, self.name, self.above, self.out = tag, name, above, out
        self.place = mark(f"{above}>{name}") if name else 0
        self.parts: list = []  # text, or nodes


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


def unwanted(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the markup itself says that an element isn't of the main text."""
    if tag in NOT_TEXT or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if set(attributes.get("role", "").lower().split()) & ROLES or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    return any(names_noise(attributes.get(k, ""), NOT_AN_ARTICLE if tag == "article" else NOT_ARTICLE) for k in ("class", "id"))


def parse(source: str) -> Node:
    """The tree of block elements; inline elements are part of their block's text."""
    root = Node("#", "", 0, False)
    stack, at = [root], 0
    opened: dict[str, int] = {}  # how many of a tag are on the stack
    hidden: list[str] = []  # inline elements that aren't text

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def child(tag: str, attributes: dict[str, str]) -> Node:
        style = " ".join(sorted(attributes.get("class", "").lower().split())) + "#" + attributes.get("id", "").lower() + "@" + attributes.get("role", "").lower()
        node = Node(tag, f"{tag}.{style}", stack[-1].place, stack[-1].out or unwanted(tag, attributes))
        stack[-1].parts.append(node)
        return node

    while at < len(source):
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text and not hidden:
            stack[-1].parts.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[0][:2] in ("<!", "<?"):
            if m[0].startswith("<![CDATA[") and not hidden:
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if hidden:
                if tag == hidden[-1]:
                    hidden.pop()
            elif tag not in INLINE and opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        attributes = _attributes(m[3])
        if tag in RAW:  # all up to its end tag is its own
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if end or tag in ("script", "style", "textarea", "title"):
                if not hidden:
                    child(tag, attributes).parts.append(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
            continue
        if hidden:
            if tag == hidden[-1]:
                hidden.append(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].parts.append("\n")
            continue
        if tag in INLINE:
            if unwanted(tag, attributes) and not m[3].rstrip().endswith("/"):
                hidden.append(tag)
            continue
        ends = CLOSES.get(tag, frozenset()) | (CLOSES["p"] if tag in ENDS_P else frozenset())
        if ends and any(opened.get(x) for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        node = child(tag, attributes)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed([p for p in node.parts if isinstance(p, Node)])


def squeeze(text: str) -> str:
    return " ".join(text.split())


def blocks(root: Node, gone: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks in page order, without branches that are to go."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := squeeze("".join(held)):
            out.append(text)
        held.clear()

    todo: list = [("in", root)]
    while todo:
        what, x = todo.pop()
        if what == "text":
            held.append(x)
        elif what == "end":
            flush()
        elif not x.out and x.place not in gone:
            flush()
            todo.append(("end", None))
            todo += reversed([("in", p) if isinstance(p, Node) else ("text", p) for p in x.parts])
    flush()
    return out


def article(root: Node) -> list[Node]:
    """Where the main text is: the outermost article or main elements that are kept, or else the page."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.out:
                continue
            if node.tag == tag:
                found.append(node)
            else:
                todo += reversed([p for p in node.parts if isinstance(p, Node)])
        if found:
            return found
    return [root]


def main_text(source: str, gone: frozenset[int] = frozenset()) -> str:
    """The text of a page's article. Where a site's articles are all alike, what it repeats is the article and stays."""
    tops = article(parse(source))
    found = [b for top in tops for b in blocks(top, frozenset() if top.place in gone else gone)]
    if not found and gone:
        found = [b for top in tops for b in blocks(top)]
    return " ".join(found)


def mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def places(source: str) -> dict[int, tuple[int, int, int]]:
    """place -> (its parent's place, its presentation, its content) on one page; a place that repeats is taken together."""
    found: dict[int, tuple[int, list, list]] = {}
    for node in _walk(parse(source)):
        if not node.name:
            continue
        _, shown, own = found.setdefault(node.place, (node.above, [], []))
        shown.append("\0".join(p.name for p in node.parts if isinstance(p, Node)))
        own.append(squeeze(" ".join(p for p in node.parts if isinstance(p, str))))
    return {k: (above, mark("\1".join(shown)), mark("\1".join(own)) if any(own) else 0) for k, (above, shown, own) in found.items()}


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_places(pages: DataFrame) -> DataFrame:
    """host, page (hash), place, parent, shown, own: a row for each place of each page."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("page"), "html")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, cols = [], ([], [], [], [])
            for i, source in enumerate(part.column(2).to_pylist()):
                for place, rest in places(source or "").items():
                    row.append(i)
                    for c, v in zip(cols, (place, *rest), strict=True):
                        c.append(v)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *(pa.array(c, pa.int64()) for c in cols)], names=["host", "page", "place", "parent", "shown", "own"])

    return keyed.mapInArrow(run, "host string, page long, place long, parent long, shown long, own long")


def style_trees(rows: DataFrame) -> DataFrame:
    """host, place, pages, importance (own, of presentations or texts) for each place of each host."""

    def entropy(what: str) -> DataFrame:
        counts = rows.groupBy("host", "place", what).agg(F.count("*").alias("n"))
        if what == "own":
            counts = counts.filter("own != 0")
        # sum p log p = sum n log n / m - log m: it needs no second pass
        out = counts.groupBy("host", "place").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        h = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
        return out.select("host", "place", F.col("m").alias(f"m_{what}"), h.alias(f"h_{what}"))

    both = entropy("shown").join(entropy("own"), ["host", "place"], "left")
    return both.select("host", "place", F.col("m_shown").alias("pages"), F.greatest("h_shown", F.coalesce("h_own", F.lit(0.0))).alias("importance"))


def noise(rows: DataFrame, least: float = LEAST_IMPORTANCE, pages: int = LEAST_PAGES) -> DataFrame:
    """host, place of the branches that are of low importance, themselves and all below them."""
    tree = cut(style_trees(rows), "trees")
    # what is above an important place is kept. After a round with pointers over n levels all within
    # 2n - 1 levels is, and pointers over 2n levels follow, so that the rounds are the log of the depth
    up = cut(rows.select("host", "place", F.col("parent").alias("above")).distinct(), "above")
    good = cut(tree.filter((F.col("importance") >= least) | (F.col("pages") < pages)).select("host", "place"), "good")
    while True:
        reached = up.join(good, ["host", "place"], "left_semi").select("host", F.col("above").alias("place")).filter("place != 0").distinct()
        more = cut(reached.join(good, ["host", "place"], "left_anti"), "more")
        if more.isEmpty():
            return tree.select("host", "place").join(good, ["host", "place"], "left_anti")
        good = cut(good.unionByName(more), "good")
        next_ = up.select("host", F.col("place").alias("above"), F.col("above").alias("further"))
        up = cut(up.join(next_, ["host", "above"]).select("host", "place", F.col("further").alias("above")), "above")


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text for every row."""
    pages = pages.select("page_id", "url", "html")
    rows = cut(page_places(pages), "places")
    low = cut(noise(rows, least, least_pages), "noise")
    bits = cut(sieve(low, F.xxhash64("host", "place")), "sieve")
    maybe = sifted(rows, F.xxhash64("host", "place"), bits, "maybe").filter("maybe").select("host", "page", "place")
    gone = maybe.join(low, ["host", "place"]).groupBy("page").agg(F.collect_set("place").alias("gone"))
    keyed = pages.withColumn("page", F.xxhash64(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))))
    met = keyed.join(gone, "page", "left").select("page_id", "url", "html", "gone")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = []
            for source, low_ in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                skip = frozenset(low_ or ())
                texts.append(main_text(source or "", skip))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.mapInArrow(run, f"page_id {kind}, url string, text string")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
