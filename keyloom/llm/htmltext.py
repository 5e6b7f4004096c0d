"""Main text of web pages, with site templates removed.

Pass 1 walks each page's elements and hashes candidate subtrees: every element's whole subtree (its tag, class
and id, and everything below it), and for lists of links outside the article also the markup alone, with
runs of equal children taken as one, so that a menu is known again whatever it links to. Spark counts on
how many different pages of a host a hash occurs (copies of a page count once); a hash on at least ``MIN_PAGES`` of
them that are ``MIN_SHARE`` of the host's pages, or on ``MANY_PAGES``, is part of the site's template. Pass 2 walks
the page again and deletes those subtrees, together with what names itself as furniture (nav, footer,
aside, form, script, adverts, notices, comments and the like), which recurrence can't find on hosts of few pages.

Text blocks of the article itself (paragraphs, headings, list items ...) are no candidates inside
``article`` or ``main``: a sentence that many articles share belongs to each of them. Nor is a subtree with
more than half of the page's text: near copies of one page would lose it. If a page has
an article or a main element outside the furniture, only what lies in one is returned.

The table of template hashes is broadcast only if it was measured to be at most ``BROADCAST_ROWS`` rows; beyond
that each page's own hashes are joined with it, and the page with those that were found.

Cases: a null or empty html gives an empty text; a null url has the empty host; broken markup
(unclosed or stray tags, quotes and comments) is read as browsers do, near enough; parsing takes time in
proportion to the page's length, however it is nested or broken; repeated pages are each returned, but count as one page of
their host; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, read, staged
from .urlfilter import split_url

#: Different pages of a host, and their share or their plain number, that make a recurring subtree a template.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 3, 0.2, 100
#: The share of a subtree's text inside links, and its links, that make it a list of links.
LINKED, LINKS = 0.6, 2
BROADCAST_ROWS = 200_000

# Element names of HTML by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
_FURNITURE = frozenset("nav footer aside form script style noscript template iframe svg math object button select textarea menu dialog head title canvas audio video map".split())
_SWALLOWS = frozenset("script style textarea title".split())  # the rest of the page, if they aren't closed
_INLINE = frozenset("img input source track embed link meta param base col area a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split()) | _INLINE
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
_SELF_CLOSING = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Words in a class, id or role that name furniture.
_NAMED = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets footer header masthead banner topbar ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended comment comments disqus respond reply replies discussion pagination pager skip toolbar search complementary contentinfo".split()
)

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_REST = re.compile(r"""((?:[^"'>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class _Node:
    __slots__ = ("tag", "mark", "bad", "kids", "digest", "form", "chars", "linked", "links", "drawn")

    def __init__(self, tag: str, mark: str, bad: bool):
        self.tag, self.mark, self.bad, self.kids, self.digest = tag, mark, bad, [], None


def _open(tag: str, attributes: str) -> _Node:
    mark, bad = "", tag in _FURNITURE
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                mark += f"{name}={value};"
                named = _NAMED.intersection(_SPLIT.split(value))
                bad = bad or ("header" if named == {"header"} else bool(named))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                bad = True
    return _Node(tag, mark, False if tag in ("html", "body", "article", "main") else bad)


class _Stack:
    """The open elements; the innermost of a tag, and of those that aren't inline, is known without a search."""

    def __init__(self, root: _Node):
        self.nodes, self.at, self.blocks = [root], {}, [0]

    def push(self, node: _Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in _INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def innermost(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, i: int) -> None:
        """Closes element ``i`` and all inside it."""
        while len(self.nodes) > i:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if self.blocks[-1] == len(self.nodes):
                self.blocks.pop()


def parse(html: str) -> _Node:
    """A tree of the elements; text pieces are strings among an element's children."""
    root = _Node("#root", "", False)
    stack, at, unclosed = _Stack(root), 0, set()
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            stack.nodes[-1].kids.append(html[at:])
            break
        mark = html[lt + 1 : lt + 2]
        named = _NAME.match(html, lt + 1) if mark not in "!?" else None
        if lt > at or mark not in "!?" and not named:
            upto = lt if mark and mark in "!?" or named else lt + 1  # a sign that opens nothing is text
            stack.nodes[-1].kids.append(html[at:upto])
            if upto > lt:
                at = upto
                continue
        if not named:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(html)
            elif html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt + 9)
                stack.nodes[-1].kids.append(entities.escape(html[lt + 9 : end if end >= 0 else len(html)]))
                at = end + 3 if end >= 0 else len(html)
            else:
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else len(html)
            continue
        rest = _REST.match(html, named.end())
        if rest is None:
            break  # the page ends inside a tag
        at, tag, attributes = rest.end(), named[2].lower(), rest[1]
        if named[1]:
            i = stack.innermost((tag,))
            # An inline end tag doesn't close the blocks around it.
            if i and (tag not in _INLINE or i > stack.blocks[-1]):
                stack.close(i)
            continue
        if tag in _ENDS_P and stack.nodes[stack.blocks[-1]].tag == "p":
            stack.close(stack.blocks[-1])
        if tag in _SELF_CLOSING:
            closed, within = _SELF_CLOSING[tag]
            i = stack.innermost(closed.split())
            if i > stack.innermost(within):
                stack.close(min(stack.at[t][-1] for t in closed.split() if stack.at.get(t) and stack.at[t][-1] > stack.innermost(within)))
        node = _open(tag, attributes)
        if node.bad == "header":  # an article's own header has its title
            node.bad = not (stack.at.get("article") or stack.at.get("main"))
        stack.nodes[-1].kids.append(node)
        if tag in _RAW:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if end:
                node.kids.append(html[at : end.start()])
                close = html.find(">", end.end())
                at = close + 1 if close >= 0 else len(html)
            elif tag in _SWALLOWS:
                at = len(html)
            else:
                unclosed.add(tag)
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            stack.push(node)
    return root


def _measure(root: _Node) -> None:
    """Each subtree's hashes, text and links, from the leaves up, without recursion.

    ``drawn`` is one of its text pieces, by a hash that favours long ones: near copies mostly draw the same.
    """
    todo = [(root, False)]
    while todo:
        n, ready = todo.pop()
        if not ready:
            todo.append((n, True))
            todo.extend((k, False) for k in n.kids if not isinstance(k, str))
            continue
        below, forms, n.chars, n.linked, n.links, n.drawn = [], [], 0, 0, int(n.tag == "a"), (math.inf, 0)
        for k in n.kids:
            if isinstance(k, str):
                flat = " ".join(k.split())
                below.append(flat)
                if flat and not n.bad:
                    n.chars += len(flat)
                    h = _hash(flat)
                    n.drawn = min(n.drawn, (-math.log((h + (1 << 63) + 1) / ((1 << 64) + 2)) / len(flat), h))
            else:
                below.append(f"\x1e{k.digest:x}")
                if not forms or forms[-1] != k.form:
                    forms.append(k.form)
                n.chars, n.linked, n.links = n.chars + k.chars, n.linked + k.linked, n.links + k.links
                if not k.bad:
                    n.drawn = min(n.drawn, k.drawn)
        n.linked = n.chars if n.tag == "a" else n.linked
        n.digest = _hash(f"{n.tag}\x1f{n.mark}\x1f" + "\x1f".join(below))
        n.form = _hash(f"form\x1f{n.tag}\x1f{n.mark}\x1f" + ",".join(map(str, forms)))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def _candidates(root: _Node) -> Iterator[tuple[_Node, list[int]]]:
    """Elements that may be a template's, with the hashes they may be known by: no text of an article, and not most of the page.

    What names itself furniture is counted too, but not what lies inside it.
    """
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        for k in n.kids:
            if isinstance(k, str):
                continue
            if k.tag not in ("html", "body", "head", "article", "main") and k.tag not in _VOID and not (inside and k.tag in _TEXT) and 2 * k.chars <= root.chars:
                menu = not inside and (k.bad or k.links >= LINKS and k.linked >= LINKED * k.chars)
                yield k, [k.digest, k.form] if menu else [k.digest]
            if not k.bad:
                todo.append((k, inside))


def subtree_hashes(html: str | None) -> tuple[int, list[int]]:
    """The hash of the text piece that stands for a page, and the distinct hashes of its candidate elements."""
    root = parse(html or "")
    _measure(root)
    return root.drawn[1], sorted({h for _, hashes in _candidates(root) for h in hashes})


def extract(html: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's main text: blocks in page order, joined by one space."""
    root = parse(html or "")
    if template:
        _measure(root)
        for n, hashes in list(_candidates(root)):
            n.bad = n.bad or not template.isdisjoint(hashes)

    def mains(n: _Node) -> list[_Node]:
        found, todo = [], [n]
        while todo:
            x = todo.pop()
            if x.tag in ("article", "main"):
                found.append(x)
            else:
                # A page's own header and whatever is furniture has no article to offer.
                todo.extend(k for k in reversed(x.kids) if not isinstance(k, str) and not k.bad)
        return found

    tops = mains(root)
    inside = bool(tops)
    pieces: list[str] = []
    todo: list = list(reversed(tops)) if tops else [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            pieces.append(n)
        elif not n.bad and (inside or n.tag != "header"):
            if n.tag in _INLINE:
                todo.extend(reversed(n.kids))
            else:
                todo.append(" ")
                todo.extend(reversed(n.kids))
                todo.append(" ")
    return " ".join(entities.unescape("".join(pieces)).split())


def page_hashes(pages: DataFrame) -> DataFrame:
    """host, page (a hash of the html), drawn and hashes (see ``subtree_hashes``) of each different page of a host (columns url, html)."""
    host, _ = split_url(F.col("url").cast("string"))
    rows = pages.select(host.alias("host"), F.xxhash64("html").alias("page"), F.col("html").cast("string"))

    def hashed(htmls: list) -> list:
        made = [subtree_hashes(h) for h in htmls]
        return [[d for d, _ in made], [h for _, h in made]]

    return add_columns(rows, "html", "drawn long, hashes array<long>", hashed).drop("html").dropDuplicates(["host", "page"])


def site_templates(hashed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """host, digest: the template subtrees of each host, of the table that ``page_hashes`` makes. Near copies count as one page."""
    hashed = hashed.groupBy("host", "drawn").agg(F.min_by("hashes", "page").alias("hashes"))
    # The row without a hash counts the host's pages.
    rows = hashed.select("host", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("digest"))
    counts = staged(rows.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("digest").isNull() | (F.col("n") >= min_pages)), "subtrees")
    totals = counts.where("digest is null").select(F.col("host").alias("on"), F.col("n").alias("pages"))
    recurring = counts.where("digest is not null").join(totals, F.col("host") == F.col("on"))
    return recurring.where((F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= many)).select("host", "digest")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """page_id, url, text of every page (columns page_id, url, html)."""
    hashed = staged(page_hashes(pages), "hashed")
    templates = staged(site_templates(hashed, min_pages, min_share, many), "templates")
    host, _ = split_url(F.col("url").cast("string"))
    keyed = pages.select("page_id", "url", F.col("html").cast("string"), host.alias("host"), F.xxhash64("html").alias("page"))
    if templates.count() <= BROADCAST_ROWS:
        side = templates.groupBy(F.col("host").alias("on")).agg(F.collect_list("digest").alias("hashes"))
        met = keyed.join(F.broadcast(side), F.col("host") == F.col("on"), "left")
    else:
        own = hashed.select("host", "page", F.explode("hashes").alias("digest")).join(templates, ["host", "digest"])
        own = staged(own.groupBy(F.col("host").alias("on"), F.col("page").alias("of")).agg(F.collect_list("digest").alias("hashes")), "own")
        met = keyed.join(own, (F.col("host") == F.col("on")) & (F.col("page") == F.col("of")), "left")

    def extracted(rows: list) -> list:
        known: dict[str, tuple[list, frozenset[int]]] = {}
        texts = []
        for r in rows:
            hashes = r["hashes"] or ()
            if r["host"] not in known or known[r["host"]][0] != hashes:
                known[r["host"]] = (hashes, frozenset(hashes))
            texts.append(extract(r["html"], known[r["host"]][1]))
        return [texts]

    return add_columns(met.select("page_id", "url", F.struct("host", "html", "hashes").alias("page")), "page", "text string", extracted).drop("page")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
