"""Main text of web pages by a site style tree (operator 3).

The pages of a host are merged into one tree of style nodes: a node is a path of tags with their classes and role. A page adds to each node the
styles of its children there (in what order which elements follow) and its content (text, in small letters, with digits, addresses
and the host's name made alike, so that what differs by a date or a count is the same). Two entropies over the host's
different pages make a node important:

- presentation: how much the children's styles differ from page to page. What is written for a page differs (paragraphs, lists, quotes in any
  number), templates do not. It is measured against the host's most varied node, and what lies within a varied node shares it.
- content: one minus the normalised entropy of the pages that carry the same content, as templates repeat and articles do not.

Their product, times the share of characters outside links, is the importance. Where a host has few different pages, entropies tell little: there
the importance also has a prior from what elements are called (``prior``), whose weight falls with the number of pages. A
branch of low importance is removed from each page.

1. ``branches``: for each page a row for each of its style nodes; pages of a host with the same blocks are one.
2. ``importance``: host, node, its two entropies and the share of links.
3. ``extract``: each page again, without its unimportant branches.

Defined cases: null and empty pages have an empty text; so have pages without any kept block. Pages whose url is null or names no
host have no site: the prior alone decides there. A node seen on fewer than LEAST_PAGES pages of a host is judged by the prior and by what it lies within.
Copies of a page on a host count once, as they say nothing of its templates. Broken mark-up is read to its end; unclosed tags end with their parent.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_chars
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BROADCAST_BYTES, durable, stored_bytes

LEAST_PAGES = 4
#: A node is removed if it is less important than this.
LEAST_IMPORTANCE = 0.4
#: What a node keeps that is presented alike on all pages of a host, where others are not.
ALIKE = 0.1
#: Pages at which the prior has half its weight, and the weight that it keeps.
PRIOR_PAGES, LEAST_PRIOR = 40, 0.35
#: Presentation tells nothing where not even the most varied node of a host reaches this.
LEAST_VARIED = 0.05
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_VARIES = re.compile(r"https?://\S+|\S+@\S+|\d+")
#: Elements by how HTML defines them (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NAMELESS, MOST_PLACES = frozenset("div section td th center".split()), 5
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
CONTENT_TAGS = frozenset(("article", "main"))
#: Never part of an article's text, whatever the site.
NEVER = frozenset("form button menu dialog label head".split())
OTHER_TAGS = frozenset("nav header footer aside search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert form".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that leave the meaning of another in a class as it is (fixed values).
PLAIN_WORDS = frozenset("area bar bottom box content container global inner left line links list main page post primary right secondary section site sticky top wrap wrapper block".split())


def _told(name: str) -> bool:
    """Whether a class or id names surroundings: all its words do, or leave the meaning as it is."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in OTHER_WORDS for w in words) and all(w in OTHER_WORDS or w in PLAIN_WORDS for w in words)


class Element(NamedTuple):
    """A tag, its classes and role as its style, whether its names tell of surroundings, and whether it never is text."""

    tag: str
    style: str
    other: bool
    never: bool


@functools.lru_cache(1 << 14)
def prior(path: tuple[Element, ...]) -> float:
    """What the names of a path's elements say of its text: 1 for an article or main part, 0.8 if nothing, 0.05 for surroundings. A header within
    an article is part of it by its headings."""
    out, article = 0.8, False
    for e in path:
        if e.tag in ("html", "body"):
            continue
        if e.tag == "header" and article and any(x.tag in HEADINGS for x in path):
            continue
        if e.tag in OTHER_TAGS or e.other:
            out = 0.05
        elif e.tag in CONTENT_TAGS:
            article = True
            out = max(out, 1.0) if out > 0.05 else out
    return out


class Block(NamedTuple):
    path: tuple[Element, ...]
    text: str
    link: int
    size: int


class Page:
    """A page's blocks in order, and the styles of each element's children."""

    def __init__(self, html: str | None):
        self.blocks: list[Block] = []
        #: For each path of styles: the children's styles of each element there, in order.
        self.children: dict[tuple[Element, ...], list[list[str]]] = defaultdict(list)
        if html:
            self._read(html)

    def _read(self, page: str) -> None:
        path: list[Element] = []
        open_: list[list[str]] = []
        parts: list[str] = []
        where: tuple[Element, ...] = ()
        link = size = at = 0
        end = len(page)

        def flush():
            nonlocal link, size
            if parts:
                if text := _SPACE.sub(" ", html_chars.unescape("".join(parts))).strip():
                    self.blocks.append(Block(where, text, link, size))
                parts.clear()
            link = size = 0

        def add(raw: str):
            nonlocal link, size, where
            if raw and not any(e.never for e in path):
                if not parts or not size:
                    where = tuple(path)
                parts.append(raw)
                n = len(raw) - raw.count(" ")
                size += n
                if any(e.tag == "a" for e in path):
                    link += n

        def close(i: int):
            while len(path) > i:
                self.children[tuple(path)].append(open_.pop())
                path.pop()

        while at < end:
            m = _TOKEN.search(page, at)
            if m is None:
                add(page[at:])
                break
            add(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if m["cdata"]:
                add(m["cdata"])
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag not in VOID:
                    for i in range(len(path) - 1, -1, -1):
                        if path[i].tag == tag:
                            if tag in BLOCKS:
                                flush()
                            close(i)
                            break
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            if tag in BLOCKS:
                flush()
                # An unclosed paragraph, item or cell ends here, with what is open within it.
                for i in range(len(path) - 1, -1, -1):
                    t = path[i].tag
                    if t in ENDS and tag in ENDS[t]:
                        close(i)
                        break
                    if t in BLOCKS:
                        break
            if tag in VOID or m["attrs"].endswith("/>"):
                continue
            element = _element(tag, m["attrs"])
            if element.style in NAMELESS:
                # Parts of a page that have no name are told apart by their place.
                place = sum(s.partition(":")[0] == tag for s in open_[-1]) if open_ else 0
                element = element._replace(style=f"{tag}:{min(place, MOST_PLACES)}")
            if open_:
                open_[-1].append(element.style)
            path.append(element)
            open_.append([])
        flush()
        close(0)


@functools.lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> Element:
    names, style, hidden = [], [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names += value.split()
        if name in ("class", "role"):
            style.append(re.sub(r"\d+", "", value))
        if name == "role" and value in OTHER_ROLES:
            names.append("nav")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
    return Element(tag, f"{tag}.{' '.join(style)}" if style else tag, any(map(_told, names)), hidden or tag in NEVER)


def host(url):
    """The host of a url; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(errors="surrogatepass"), digest_size=8).digest(), signed=True)


@functools.lru_cache(1 << 15)
def nodes(path: tuple[Element, ...]) -> tuple[int, ...]:
    """The style nodes on the way to a path, outermost first; elements that only shape text, and those that every page has, are none."""
    out, way = [], ""
    for e in path:
        if e.tag in BLOCKS and e.tag != "html":
            way += "/" + e.style
            out.append(_hash(way))
    return tuple(out)


def _branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["host", "node", "content", "style", "links", "page"]
    for batch in batches:
        rows = []
        for number, site, html in zip(batch["id"], batch["host"], batch["html"], strict=True):
            page = Page(html)
            texts, sizes, styles = defaultdict(list), defaultdict(lambda: [0, 0]), defaultdict(list)
            for b in page.blocks:
                if own := nodes(b.path):
                    texts[own[-1]].append(_VARIES.sub("0", b.text.lower().replace(site, "")))
                    for n in own:
                        sizes[n][0] += b.link
                        sizes[n][1] += b.size
            for path, children in page.children.items():
                if own := nodes(path):
                    styles[own[-1]].append(" ".join("|".join(c) for c in children))
            # Pages whose main node (that with the most text) says the same are copies, whatever surrounds it.
            most = max(texts, key=lambda n: sum(map(len, texts[n])), default=None)
            whole = _hash(*texts[most]) if most is not None else 0
            for n in sizes:
                content = _hash(*texts[n]) if n in texts else None
                rows.append((number, n, content, _hash(*styles[n]), int(100 * sizes[n][0] / max(1, sizes[n][1])), whole))
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype({"content": "Int64"})


def branches(pages: DataFrame) -> DataFrame:
    """host, node, content (null where a node has no text of its own), style, links (percent), page: hashes, one row for each different page of a host and its nodes."""
    rows = pages.select(F.xxhash64(host(F.col("url"))).alias("id"), host(F.col("url")).alias("host"), "html").where("host is not null").mapInPandas(_branches, "host long, node long, content long, style long, links int, page long")
    return rows.groupBy("host", "node", "page").agg(F.min("content").alias("content"), F.min("style").alias("style"), F.max("links").alias("links"))


def importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, content, varied, links: for each style node on LEAST_PAGES different pages one minus its contents' normalised entropy, its
    styles' entropy as a share of the host's greatest, and its share of characters within links."""
    each = F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.col("content").alias("value")), F.struct(F.lit("s").alias("kind"), F.col("style").alias("value"))))
    counted = branches(pages).select("host", "node", "links", each.alias("x")).groupBy("host", "node", "x.kind", "x.value").agg(F.count("*").alias("n"), F.sum("links").alias("links"))
    # The entropy of counts n that add up to m is log m less the sum of n log n over m.
    sums = counted.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == "s", F.col("n") * F.log("n"))).alias("styles"),
        F.sum(F.when((F.col("kind") == "c") & F.col("value").isNotNull(), F.col("n"))).alias("told"),
        F.sum(F.when((F.col("kind") == "c") & F.col("value").isNotNull(), F.col("n") * F.log("n"))).alias("contents"),
        F.sum(F.when(F.col("kind") == "s", F.col("links"))).alias("links"),
    )
    own = sums.where(F.col("pages") >= LEAST_PAGES).select(
        "host", "node", "pages",
        F.when(F.col("told") >= LEAST_PAGES, 1 - F.col("contents") / F.col("told") / F.log("told")).otherwise(1.0).alias("content"),
        (F.log("pages") - F.col("styles") / F.col("pages")).alias("entropy"),
        (F.col("links") / F.col("pages") / 100).alias("links"),
    )
    # Links and repeated contents vary too, in menus; they are no measure for what is written.
    most = own.groupBy("host").agg(F.max(F.col("entropy") * F.col("content") * (1 - F.col("links"))).alias("most"), F.max("pages").alias("all"))
    share = F.when(F.col("most") >= LEAST_VARIED * F.log("all"), F.least(F.col("entropy") / F.col("most"), F.lit(1.0))).otherwise(1.0)
    return own.join(most, "host").select("host", "node", "pages", "content", share.alias("varied"), "links")


def weigh(path: tuple[Element, ...], known: dict[int, tuple[float, float, float]], pages: int, use_prior: bool = True) -> float:
    """The importance of a path on a host with so many different pages, whose nodes' content, varied and links are known."""
    told = prior(path)
    if not use_prior:
        told = 1.0
    weight = max(LEAST_PRIOR, PRIOR_PAGES / (PRIOR_PAGES + pages)) if pages >= LEAST_PAGES else 1.0
    way = nodes(path)
    if pages < LEAST_PAGES or not way or way[-1] not in known:
        return told**weight
    content, _, links = known[way[-1]]
    # Headings are presented alike everywhere; what they say alone tells. Few pages vary by chance, where names tell more.
    varied = 1.0 if any(e.tag in HEADINGS for e in path) else max(known[n][1] for n in way if n in known)
    if use_prior:
        varied += (1 - varied) * told * weight
    return content * (ALIKE + (1 - ALIKE) * varied) * (1 - links) * told**weight


def main_text(html: str | None, known: dict[int, tuple[float, float, float]] | None = None, pages: int = 0, least: float = LEAST_IMPORTANCE, use_prior: bool = True) -> str:
    """A page's text without its unimportant branches."""
    known = known or {}
    return "\n".join(b.text for b in Page(html).blocks if weigh(b.path, known, pages, use_prior) >= least)


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, use_prior: bool = True) -> DataFrame:
    """pages (url, html and more; names that begin with an underscore are kept for this) with the column main_text, which replaces one of that name."""
    # A host's row has its nodes of LEAST_PAGES pages or more, so it grows with the site's templates and not with its pages.
    own = importance(pages).groupBy("host").agg(F.collect_list("node").alias("_nodes"), F.flatten(F.collect_list(F.array("content", "varied", "links"))).alias("_figures"), F.max("pages").alias("_pages"))
    sites = durable(own.withColumnRenamed("host", "_host"), "style-nodes")
    side = F.broadcast(sites) if stored_bytes(sites) * 8 <= BROADCAST_BYTES else sites
    rows = pages.withColumn("_host", F.xxhash64(host(F.col("url")))).join(side, "_host", "left")

    def text(html, nodes_of, figures, n):
        kept: dict[int, tuple] = {}

        def known(ids, values):
            # A host's lists come as one array for each row; they are made a look-up once for each batch.
            if (found := kept.get(key := (len(ids), int(ids[0]), int(ids[-1]), float(values[0])))) is None:
                found = kept[key] = dict(zip(ids.tolist(), map(tuple, values.reshape(-1, 3).tolist()), strict=True))
            return found

        out = []
        for h, ids, values, k in zip(html, nodes_of, figures, n, strict=True):
            out.append(main_text(h, None if ids is None else known(ids, values), 0 if ids is None else int(k), least, use_prior))
        return pd.Series(out, dtype=object)

    text.__annotations__.clear()
    return rows.withColumn("main_text", F.pandas_udf(text, "string")("html", "_nodes", "_figures", "_pages")).select(*(c for c in pages.columns if c != "main_text"), "main_text")
