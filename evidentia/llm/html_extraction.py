"""Main-text extraction by consensus paths of a host.

Each page's containers are scored by the text they hold outside links and outside
parts that their tag or class marks as furniture. The page votes for the generalised
tag-class path of its best container; votes are counted per host in Spark, already
summed in each task, so a host with a third of all pages sends few rows. Every page is
then extracted again from the nodes on its host's winning paths, in the order of votes;
a page that has none of them, or only far smaller text on them, falls back to its own
best container.

Blocks are the runs of text between block tags; white space in a block becomes one
space, blocks are joined in page order by one space.

Defined cases: null and empty html give an empty text. A null url votes under the empty
host. Pages without tags are one block. Repeated rows are extracted alike. Other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sent, materialise, small_batches, table

#: Paths kept for each host; a page with none of them has its own best container.
PATHS = 5
#: Hosts up to which the winning paths are sent to every task; beyond, they are joined.
BROADCAST_HOSTS = 100_000
#: Pieces that a host's pages are dealt into in that join.
SALTS = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_RAW = frozenset("script style noscript template textarea title iframe svg select object".split())
_VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
_CONTAINER = frozenset("html body article main section div td table tr tbody ul ol dl aside nav header footer form figure center blockquote fieldset details dialog menu".split())
_BLOCK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr address th caption figcaption thead tfoot summary".split())
_NEVER = frozenset("nav footer aside form script style noscript template textarea title iframe svg select object button head menu dialog".split())
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side "
    "aside widget footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search form "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations pagination pager tags "
    "tagcloud copyright legal disclaimer toolbar topbar teaser skip".split()
)
#: Never furniture by their classes.
_BODY = frozenset("html body article main".split())
#: A class that says what a container has or lacks, and one that names a part of the article.
_SAYS = re.compile(r"(?:has|with|without|no|not)[-_]")
_OF_ARTICLE = re.compile(r"(?:article|entry|post|story|page|content)[-_]+(?:header|masthead|banner)$")
#: Shares of a page's text: from it on a container is no furniture by a class piece; of its own best container's text, under it a path's text is passed over.
MOST, FAR_SMALLER = 0.75, 0.25
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    __slots__ = ("tag", "path", "bad", "piece", "own", "link", "h1", "kids", "parts")

    def __init__(self, tag: str, path: str, bad: bool):
        self.tag, self.path, self.bad = tag, path, bad
        self.piece = False  # furniture by a piece of a class alone
        self.own = self.link = 0
        self.h1 = False
        self.kids: list[Node] = []
        self.parts: list[str | Node] = []  # text, "\0" for a block border, nodes


def _classes(attrs: str) -> list[str]:
    out: list[str] = []
    for m in _CLASS.finditer(attrs):
        out += (m[1] or m[2] or m[3] or "").lower().split()
    return out


def _is_furniture(tag: str, classes: list[str], in_article: bool) -> tuple[bool, bool]:
    """Whether a container is furniture by its tag or a whole class, and by a piece of a class."""
    if tag in _NEVER or tag == "header" and not in_article:
        return True, False
    if tag in _BODY:
        return False, False
    if any(c in _FURNITURE for c in classes):
        return True, False
    return False, any(not (_SAYS.match(c) or _OF_ARTICLE.match(c) or _FURNITURE.isdisjoint(re.split(r"[-_\d]+", c))) for c in classes)


def _settle(root: Node) -> None:
    """Make furniture of containers marked by a class piece, unless they hold MOST of the page's text, and of all that furniture holds."""
    order, size = [root], {}
    for x in order:
        order += x.kids
    for x in reversed(order):
        size[id(x)] = 0 if x.bad else max(0, x.own - 2 * x.link) + sum(size[id(k)] for k in x.kids)
    for x in order:
        x.bad = x.bad or x.piece and size[id(x)] < MOST * size[id(root)]
        if x.bad:
            for k in x.kids:
                k.bad = True


def parse(html: str) -> Node:
    """The tree of containers, each with its path and the parts it holds in order."""
    root = Node("", "", False)
    stack: list[tuple[str, Node]] = [("", root)]  # open tags with the container that their text goes to
    at, n, links = 0, len(html), 0
    low = None
    for_ = _TAG.search(html, 0)
    while at < n:
        m = for_
        end = m.start() if m else n
        if end > at:
            node, text = stack[-1][1], html[at:end]
            size = len(text.strip())
            node.parts.append(text)
            node.own += size
            if links:
                node.link += size
            elif size and any(t == "h1" for t, _ in stack[-3:]):
                node.h1 = True
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if tag and m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
            if tag in _BLOCK:
                stack[-1][1].parts.append("\0")
        elif tag in _RAW:
            low = low if low is not None else html.lower()
            k = low.find(f"</{tag}", at)
            stop = html.find(">", k) if k >= 0 else -1
            at = stop + 1 if stop >= 0 else n if tag in ("script", "style", "textarea", "title") else at
        elif tag:
            if tag in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _CLOSES[tag]:
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in _CONTAINER and stack[k][0] not in ("tr", "td"):
                        break
            elif tag in _CONTAINER and tag not in ("tr", "td", "tbody"):
                for k in range(len(stack) - 1, 0, -1):  # a container closes an open paragraph
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in _CONTAINER:
                        break
            inside = stack[-1][1]
            if tag in _BLOCK:
                inside.parts.append("\0")
            if tag in _VOID:
                pass
            elif tag in _CONTAINER or tag in ("head", "button"):
                classes = _classes(m[3]) if m[3] else []
                kind = ".".join(sorted({_DIGITS.sub("#", c) for c in classes}))
                article = inside.path.find("/article") >= 0 or inside.path.find("/main") >= 0
                node = Node(tag, f"{inside.path}/{tag}" + (f".{kind}" if kind else ""), False)
                node.bad, node.piece = _is_furniture(tag, classes, article)
                inside.kids.append(node)
                inside.parts.append(node)
                stack.append((tag, node))
            else:
                stack.append((tag, inside))
                links += tag == "a"
        for_ = _TAG.search(html, at)
    _settle(root)
    return root


def _weigh(node: Node, weights: dict[int, int]) -> int:
    """Text outside links and furniture, of each node with its kids."""
    todo, order = [node], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.kids
    for x in reversed(order):
        weights[id(x)] = 0 if x.bad else max(0, x.own - 2 * x.link) + sum(weights[id(k)] for k in x.kids)
    return weights[id(node)]


def best(root: Node) -> Node:
    """The deepest container that holds nearly all text of the page, its heading included."""
    weights: dict[int, int] = {}
    _weigh(root, weights)
    node = root
    while True:
        kid = max(node.kids, key=lambda k: weights[id(k)], default=None)
        if kid is None or weights[id(kid)] == 0 or node.h1 or weights[id(kid)] < 0.75 * weights[id(node)]:
            return node
        if any(k is not kid and not k.bad and k.h1 for k in node.kids):
            return node
        node = kid


def text_of(nodes: list[Node]) -> str:
    out: list[str] = []
    todo: list[str | Node] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.bad:
            todo.append("\0")
            todo += reversed(x.parts)
            todo.append("\0")
    blocks = (" ".join(entities.unescape(b).split()) for b in "".join(out).split("\0"))
    return " ".join(b for b in blocks if b)


def on_path(root: Node, path: str) -> list[Node]:
    """Outermost nodes on the path, in page order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.path == path:
            if not x.bad:
                out.append(x)
        elif path.startswith(x.path):
            todo += reversed(x.kids)
    return out


def extract(html: str | None, paths: list[str]) -> str:
    if not html:
        return ""
    root = parse(html.replace("\0", " "))
    own = text_of([best(root)])
    for p in paths:
        if (text := text_of(on_path(root, p))) and len(text) >= FAR_SMALLER * len(own):
            return text
    return own


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)"


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, paths: for each host at most PATHS paths by votes."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: Counter = Counter()
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if h := html.as_py():
                    votes[host, best(parse(h.replace("\0", " "))).path] += 1
        if votes:
            hosts, paths = zip(*votes, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(paths), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])

    ballots = pages.select(_host(), "html").mapInArrow(run, "host string, path string, votes long")
    counted = ballots.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    top = counted.withColumn("r", rank).where(F.col("r") <= PATHS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host")


_OUT = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    winners = materialise(winning_paths(pages), "paths")
    few = winners.count() <= BROADCAST_HOSTS
    own = {r["host"]: r["paths"] for r in winners.collect()} if few else {}
    shared = Sent(pages.sparkSession, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                extract(h.as_py(), (p if p is not None else shared.value.get(host)) or [])
                for host, h, p in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", _host(), "html")
    if few:
        rows = rows.withColumn("paths", F.lit(None).cast("array<string>"))
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
        rows = rows.select("page_id", "url", "host", "html", "paths")
    return rows.mapInArrow(run, _OUT)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
