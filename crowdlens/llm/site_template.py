"""HTML extraction with site template removal.

Every element of a page is a subtree with a hash of its tag, its class and id, and its contents.  Spark counts on how many pages
of a host each subtree stands; equal pages of a host count once.  What recurs on a large share of a host's pages is template: it
is cut out of each page before the main text is read, unless it holds the article or is most of its text.  What is left is read
from the article, without elements whose tag, role or class marks them as menu, header, footer, sidebar, notice, advert, form or
reader comment.  A class or id is such a mark if all of its parts are words for these things or for boxes: "share-buttons" is,
"share-price-analysis" and "with-sidebar" aren't.  Remarks of readers are also known by their form: several elements of one kind, each
with an author and a time.  Parsing and reading take time in proportion to the page, however it is nested.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, cut, lean, small, stored, tame

#: A subtree is template if it is on at least LEAST pages and on this share of its host's pages.  Within the article more is
#: asked, as an author may repeat a line and several pages may have an article.
LEAST, SHARE = 3, 0.3
LEAST_INSIDE, SHARE_INSIDE = 5, 0.6
#: Share of an article's text that recurs from which on it is the article.
MOST = 0.75
#: Hashes that may be broadcast, 8 bytes each; beyond, pages are joined with their host's by a shuffle, in which a host with more
#: than so many pages is dealt to several tasks.
BROADCAST_HASHES, HOST_PAGES = 1_000_000, 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe noembed noframes object embed svg canvas audio video map dialog menu datalist xmp".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr caption address summary".split())
CONTAINERS = frozenset("div section ul ol dl table tbody thead tfoot figure details header hgroup center fieldset nav aside footer form".split())
BLOCKS = PROSE | CONTAINERS | frozenset("article main body html hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph, and what ends an open element of the same kind.
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption summary figcaption dt dd li html body".split()) | frozenset(["li"])
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words for what isn't the article, and words that a class or id made of them may hold besides.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup promo promotion "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond "
    "pagination pager toolbar widget widgets login signin search alert paywall skip topbar".split()
)
BOXES = frozenset(
    "area bar bottom box block btn button buttons card cards column container content form group header heading icon icons id inner item items js left link links list main mobile module outer page panel "
    "post posts article articles right row section site slot text thread title top unit user wrap wrapper zone bar to s".split()
)
#: Words that make even a paragraph of the article an advert.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion".split())
#: Words that name a container of remarks, whatever else its name says.
REMARKS = frozenset("comments commentlist disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HEADER_MARKS = frozenset(["header", "topbar", "masthead"])
#: Words in the names of what tells the author and the time of a remark, and among how many elements of it they are looked for.
AUTHORS, TIMES, NEAR = frozenset("author user username by name avatar commenter".split()), frozenset("date time posted published timestamp ago".split()), 16
CONTENT = frozenset("article post entry story content articlebody main".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "parent", "length", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.hash, self.parent = tag, attrs, [], 0, parent
        self.length = self.linked = 0


def parse(page: str) -> Node:
    """The element tree; unclosed and stray tags are mended much as browsers do."""
    root = Node("#page", {}, None)
    at, pos, size, last = root, 0, len(page), page.rfind(">")
    open_: Counter[str] = Counter()  # elements around `at`, so that no search upwards is in vain

    def leave(up: Node) -> Node:
        """Closes all from `at` to `up` and returns what holds it."""
        n = at
        while n is not up.parent:
            open_[n.tag] -= 1
            n = n.parent
        return n

    while pos < size:
        m = _TAG.search(page, pos) if pos <= last else None  # without another > there is no tag
        if m is None:
            open_comment = page.find("<!--", pos) if pos > last else -1
            at.children.append(page[pos:open_comment] if open_comment >= 0 else page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if open_[name]:
                up = at
                while up.tag != name:
                    up = up.parent
                at = leave(up)
            continue
        body = (m[3] or m[6] or "").strip()
        attrs = {a[1].lower(): html_lib.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(body)} if body and body != "/" else {}
        if name in CLOSES_P and open_["p"]:
            up = at
            while up is not None and up.tag != "p" and (up.tag not in BLOCKS or up.tag == "li" and name != "li"):
                up = up.parent
            if up is not None and up.tag == "p":
                at = leave(up)
        if name in SIBLINGS and any(open_[x] for x in SIBLINGS[name][0]):
            closes, within = SIBLINGS[name]
            up = at
            while up is not None and up.tag not in closes and up.tag not in within:
                up = up.parent
            while up is not None and up.tag in closes:
                at = leave(up)
                up = at if any(open_[x] for x in closes) else None
                while up is not None and up.tag not in closes and up.tag not in within:
                    up = up.parent
        node = Node(name, attrs, at)
        at.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            node.children.append(page[pos : end.start() if end else size])
            pos = end.end() if end else size
        elif name not in VOID and not (body.endswith("/") and name in ("svg", "path", "use")):  # HTML ignores the slash of <div/>
            open_[name] += 1
            at = node
    return root


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def hash_subtrees(root: Node) -> None:
    """Sets every element's hash; elements without text have 0.  Equal subtrees of different pages have equal hashes."""
    for n in reversed(list(walk(root))):
        parts, some = [], False
        for c in n.children:
            if isinstance(c, Node):
                if c.hash:
                    parts.append(str(c.hash))
                    some = True
            elif text := " ".join(c.split()):
                parts.append(text)
                some = True
        if some and n.tag not in ("script", "style"):
            what = "\x00".join([n.tag, n.attrs.get("class", ""), n.attrs.get("id", ""), *parts])
            n.hash = int.from_bytes(hashlib.blake2b(what.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) or 1


def subtree_hashes(page: str) -> set[int]:
    """Hashes of the page's blocks, each once."""
    root = parse(page)
    hash_subtrees(root)
    return {n.hash for n in walk(root) if n.hash and (n.tag in PROSE or n.tag in CONTAINERS or n.tag == "a" and n.parent.tag not in BLOCKS)}


def _marks(n: Node) -> set[str]:
    """The words of which class and id are made, of each name that is nothing but words for what isn't the article and for boxes."""
    out: set[str] = set()
    for name in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".split():
        parts = {x.lower() for x in _NAMES.findall(name)}
        if parts & MARKS and (parts <= MARKS | BOXES or n.tag in CONTAINERS and parts & REMARKS):
            out |= parts
    return out


def _words(n: Node) -> set[str]:
    return {x.lower() for x in _NAMES.findall(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}")}


def _unwanted(n: Node, inside: bool = False) -> bool:
    if n.tag in DROPPED or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return True
    if n.attrs.get("role", "").lower() in ROLES:
        return True
    if not n.attrs or n.tag in ("html", "body", "main"):
        return False
    if "style" in n.attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", n.attrs["style"], re.I):
        return True
    marks = _marks(n)
    return bool(marks & (ADVERTS | REMARKS) if inside and n.tag in PROSE - {"li"} else marks)


def _remarks(root: Node) -> set[int]:
    """The elements that are remarks of readers, several siblings of one tag and class, each with an author and a time, and the
    containers of nothing but these and headings."""
    out: set[int] = set()
    for n in reversed(list(walk(root))):
        inner = [c for c in n.children if isinstance(c, Node)]
        groups: dict[tuple[str, str], list[Node]] = {}
        for c in inner:
            if c.tag in ("li", "div", "article", "section"):
                groups.setdefault((c.tag, c.attrs.get("class", "")), []).append(c)
        out |= {id(c) for same in groups.values() if len(same) > 1 and all(_signed(c) for c in same) for c in same}
        some = any(id(c) in out for c in inner)
        if some and n.tag in CONTAINERS and all(id(c) in out or c.tag in HEADINGS for c in inner) and not any(isinstance(c, str) and c.strip() for c in n.children):
            out.add(id(n))
    return out


def _signed(n: Node) -> bool:
    """Whether near the top of the element, among its first NEAR, there are an author and a time."""
    who = when = False
    for x in itertools.islice(walk(n), NEAR):
        names = _words(x) if x.attrs else set()
        who = who or x.tag == "cite" or bool(names & AUTHORS) or x.attrs.get("rel") == "author"
        when = when or x.tag == "time" or bool(names & TIMES) or "datetime" in x.attrs
    return who and when


def _is_header(n: Node) -> bool:
    return n.tag == "header" or bool(n.attrs) and n.tag in CONTAINERS and bool(HEADER_MARKS & _words(n)) and _words(n) <= HEADER_MARKS | BOXES


def _prune(root: Node, template: frozenset[int], often: frozenset[int]) -> None:
    """Takes out template and unwanted elements.  What holds the article, the longest <article> or else <main>, stays and is looked
    into; within it, what is often there goes unless that is most of the article's text."""
    holds: set[int] = set()
    _measure(root)
    found = _articles(root) or [max(x, key=lambda n: n.length) for x in [[n for n in walk(root) if n.tag == "main"]] if x]
    for main in found:
        if often and sum(x.length for x in _outermost(main, often)) >= MOST * main.length:
            often = frozenset()
        n = main
        while n is not None and id(n) not in holds:
            holds.add(id(n))
            n = n.parent
    said = _remarks(root)
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        kept = []
        for c in n.children:
            if inside and isinstance(c, Node) and id(c) not in holds and (id(c) in said or c.tag == "article" and 2 * c.length < n.length):
                continue
            if isinstance(c, Node) and id(c) not in holds:
                if c.tag not in ("html", "body") and c.hash and c.hash in (often if inside else template):
                    continue
                if _unwanted(c, inside):
                    continue
                if _is_header(c):  # of an article's header, its headings are text
                    if not inside:
                        continue
                    kept += [x for x in walk(c) if x.tag in HEADINGS]
                    stack += [(x, inside) for x in walk(c) if x.tag in HEADINGS]
                    continue
            if isinstance(c, Node):
                stack.append((c, inside))
            kept.append(c)
        n.children = kept


def _outermost(node: Node, hashes: frozenset[int]) -> list[Node]:
    """The subtrees under a node whose hash is one of these, without those within another."""
    out, stack = [], [c for c in node.children if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        if n.hash and n.hash in hashes:
            out.append(n)
        else:
            stack += [c for c in n.children if isinstance(c, Node)]
    return out


def _measure(root: Node) -> None:
    """Sets every element's length of text, and how much of it stands in links."""
    for n in reversed(list(walk(root))):
        inner = [c for c in n.children if isinstance(c, Node)]
        n.length = sum(c.length for c in inner) + sum(len(c) for c in n.children if isinstance(c, str))
        n.linked = n.length if n.tag == "a" else sum(c.linked for c in inner)


def _articles(root: Node) -> list[Node]:
    """The elements that hold the article: the longest <article> and those of at least half its length, in page order.

    An article within another, or with a comment's or advert's name, is none if there is any other."""
    found, stack = [], [(root, False)]
    every = []
    while stack:
        n, inner = stack.pop()
        if n.tag == "article":
            every.append(n)
            if not inner and not _marks(n):
                found.append(n)
            inner = True
        stack.extend((c, inner) for c in reversed(n.children) if isinstance(c, Node))
    found = [n for n in found if n.length] or every[:1]
    most = max((n.length for n in found), default=0)
    return [n for n in found if 2 * n.length >= most]


def _content(root: Node) -> Node:
    """The element that holds the article: <article>, or several of about one length, else <main>, else what its class calls so,
    else all; the longest of each."""
    _measure(root)
    nodes = list(walk(root))
    if found := [n for n in _articles(root) if n.length]:
        if len(found) == 1:
            return found[0]
        root = Node("#page", {}, None)
        root.children = found
        return root
    for found in (
        [n for n in nodes if n.tag == "main" or n.attrs.get("role", "").lower() == "main"],
        [n for n in nodes if n.attrs and (n.attrs.get("itemprop", "").lower() == "articlebody" or n.tag in ("div", "section") and CONTENT & _words(n))],
    ):
        found = [n for n in found if n.length]
        if found:
            return max(found, key=lambda n: n.length)
    for n in nodes:  # no mark of an article: lists of links go
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in ("ul", "ol", "div", "p", "table") and c.linked > 0.7 * c.length)]
    return root


def text_of(node: Node) -> str:
    """The text of the blocks in page order, one line each."""
    lines: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        line = " ".join(html_lib.unescape("".join(inline)).split())
        if line:
            lines.append(line)
        inline.clear()

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            inline.append(n)
        elif n.tag == "br":
            inline.append(" ")
        else:
            if n.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(n.children))
    flush()
    return "\n".join(lines)


def extract(page: str | None, template: frozenset[int] = frozenset(), often: frozenset[int] = frozenset()) -> str:
    root = parse(page or "")
    if template or often:
        hash_subtrees(root)
    _prune(root, template, often)
    return text_of(_content(root))


def host(url: str | Column) -> Column:
    """Lower-case host of a URL; empty if it has none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, often): hashes of the subtrees that recur on a host's pages, and of those that recur so much that they
    are template even within the article.

    Equal html of a host is one page, however often it was crawled.  A subtree is on a share of its host's pages, so that a host has at most 1 / SHARE times as many as a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, hashes = [], []
            for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                found = subtree_hashes(page.as_py() or "")
                hosts += [h] * (len(found) + 1)
                hashes += [0, *found]  # 0 counts pages
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["host", "hash"])

    # 128 bits of a host and page; only pages that stand there several times are brought together
    keyed = pages.select(host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("h1", F.xxhash64("host", "html")).withColumn("h2", F.xxhash64(F.lit(1), "host", "html"))
    again = small(cut(keyed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")))
    rows = keyed.join(again, ["h1", "h2"], "left_anti").unionByName(keyed.join(again, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])).select("host", "html")
    counts = rows.mapInArrow(lean(run), "host string, hash long").groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    counts = cut(counts)
    sizes = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    shared = counts.where("hash <> 0").join(small(sizes), "host").where(F.col("n") >= F.col("pages") * SHARE)
    inside = (F.col("n") >= LEAST_INSIDE) & (F.col("n") >= F.col("pages") * SHARE_INSIDE)
    return shared.groupBy("host").agg(F.collect_list("hash").alias("template"), F.collect_list(F.when(inside, F.col("hash"))).alias("often"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null html is empty and gives an empty text.  Pages without url are one host.  Repeated rows count as pages of their own;
    other columns are ignored."""
    rows = tame(pages).select("page_id", "url", "html", host("url").alias("host"))
    found = stored(templates(pages), "templates")
    hashes = found.agg(F.sum(F.size("template") + F.size("often"))).first()[0] or 0
    if hashes <= BROADCAST_HASHES:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        # a host's pages are dealt to as many tasks as they need, and its template to each of them
        deals = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).cast("int").alias("deals")).where("deals > 1"))
        dealt = rows.join(small(deals, BROADCAST_ROWS // 10), "host", "left").withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("deals", F.lit(1))).cast("int"))
        many = found.join(small(deals, BROADCAST_ROWS // 10), "host", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
        rows = dealt.drop("deals").join(many.drop("deals"), ["host", "deal"], "left")
    rows = rows.select("page_id", "url", "html", "host", "template", "often")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for b in batches:
            texts = []
            for i, h in enumerate(b.column(3).to_pylist()):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = tuple(frozenset(b.column(k)[i].as_py() or ()) for k in (4, 5))
                texts.append(extract(b.column(2)[i].as_py(), *known[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
