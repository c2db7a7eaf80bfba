"""Main text of web pages by site style trees.

The DOMs of one host are merged by the path of their blocks (tag with class and id, digits masked). For each merged node
the shapes of its children over the host's pages give a presentation importance, and the texts that stand in it a
content importance, both by entropy: what looks or reads alike on all pages is worth little, what differs is worth
much. Pages of one main text count once, so that copies are not taken for boilerplate. A branch is worth as much as
the best node with text in it, so removing branches of low importance from each page of the host is removing the texts
of such nodes, wherever they stand. A text that comes back on pages of a host in ever other surroundings is a branch of
its own: its importance falls with the number of different texts before it and after it, so that a notice among an article's
paragraphs goes while these stay, and what near copies of one page share is no notice. Two more things are evidence: elements and class words that declare menus, notices
and the like, and landmarks (article or main), whose outside is worth nothing. What neither declares nor repeats stays:
on a host of one distinct page every node has importance 1.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field as own

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, pieces, str_texts, write_shared

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements whose content is never main text.
NEVER = frozenset("script style noscript template head title nav footer aside form menu button select option textarea input label iframe object svg math canvas audio video dialog noembed noframes xmp".split())
LANDMARKS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of those, the ones that are kept if a page's landmarks are in them.
_CONTAINERS = frozenset("form dialog".split())
#: Words of a class, id or role that say the same.
SAYS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead header comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay search complementary contentinfo".split())
#: Beginnings of such a word, as in ad-slot or cookie-bar.
SAYS_FIRST = ("ad-", "ads-", "advert-", "sponsored-", "cookie-", "gdpr-", "newsletter-")
#: Parts of such a word, between hyphens or underscores, as in comment-list, user-comments or site-footer, and parts that deny them.
PART_SAYS = frozenset("comment comments footer breadcrumb breadcrumbs newsletter disqus".split())
_DENIES = frozenset("no has with without".split())
#: Whole words with such parts that say header.
SAYS_TOP = frozenset("site-header page-header global-header top-header".split())
#: Words that may name what holds the text as well; they are passed over where nothing else is left of a landmark.
AMBIGUOUS = frozenset("alert banner discussion login modal notice notices overlay promo promotion recommended related respond search share sharing signup social subscribe subscription widget widgets".split())
#: Words that say header; one that holds the title (an h1) is kept.
SAYS_HEADER = frozenset("header masthead banner".split()) | SAYS_TOP
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


_DIGITS = re.compile(r"\d+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    gone: bool  # not text, whatever it holds
    says: bool  # declared to be no main text
    header: bool  # declared by words for a header alone
    mark: bool  # a landmark
    parent: Node | None
    perhaps: bool = False  # declared by ambiguous words alone
    children: list[Node | str] = own(default_factory=list)
    marks: int = 0  # landmarks in it that aren't declared themselves, itself included
    titles: int = 0
    buried: bool = False  # inside something declared


_PARTS = re.compile(r"[-_]")


def _says(word: str) -> bool:
    """Whether a word of a class, id or role declares that its element is no main text."""
    if word in SAYS or word in SAYS_TOP or word.startswith(SAYS_FIRST):
        return True
    parts = _PARTS.split(word)
    return len(parts) > 1 and not PART_SAYS.isdisjoint(parts) and parts[0] not in _DENIES


def _label(tag: str, attributes: str) -> tuple[str, set[str], str, bool]:
    """Tag with class and id (digits masked), the words that declare it, its role, and whether it is hidden."""
    said, words, role, hidden = tag, set(), "", False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            said += f".{value}"
            words |= {w for w in value.split() if _says(w)}
            role = value if name == "role" else role
        else:
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return _DIGITS.sub("#", said), words, role, hidden


class _Open:
    """The open elements, with the places of each tag, so that no step walks them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], defaultdict(list), [0]

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)


def parse(source: str) -> Node:
    """A lenient DOM: void and raw elements, implied ends of p, li and table parts, stray end tags passed over."""
    root = Node("", xxhash.xxh64_intdigest(b""), False, False, False, False, None)
    at, stack, nodes = 0, _Open(root), [root]
    for m in iter(lambda: _TOKEN.search(source, at), None):
        here = stack.nodes[-1]
        if m.start() > at:
            here.children.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if (place := stack.last(tag)) > 0:
                stack.close(place)
            continue
        if tag in _ENDS_P and (place := stack.last("p")) > stack.blocks[-1]:
            stack.close(place)
        if tag in _SIBLINGS and (place := stack.last(*_SIBLINGS[tag])) > stack.last(*_SCOPE[tag]):
            stack.close(place)
        here = stack.nodes[-1]
        attributes = m[3] or m[6] or ""
        label, words, role, hidden = _label(tag, attributes)
        path = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), here.path) if tag in BLOCKS or tag in _RAW else here.path
        inside = stack.last(*LANDMARKS) > 0
        declared = bool(words) and tag not in ("html", "body")
        soft = tag in _CONTAINERS
        gone = hidden or tag in NEVER and not soft or tag == "header" and not inside
        node = Node(tag, path, gone, declared or soft, declared and words <= SAYS_HEADER and not soft, tag in LANDMARKS or role in LANDMARKS, here, declared and not soft and words <= AMBIGUOUS)
        here.children.append(node)
        nodes.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.push(node)
    if at < len(source):
        stack.nodes[-1].children.append(source[at:])
    _declare(nodes)
    return root


def _declare(nodes: list[Node]) -> None:
    """Settle what is declared to be no main text.

    A declared element stays if all the page's landmarks are in declared elements and it holds one (unless a title
    stands outside them, which shows where the main text is), or, without a landmark, all titles are and it holds one.
    An element that words declare a header stays if it holds a title.
    """
    for x in nodes[1:]:
        x.buried = x.parent.buried or x.parent.says or x.parent.gone
    for x in reversed(nodes):
        if not x.gone:
            x.marks += x.mark and not x.says
            x.titles += x.tag == "h1"
            if x.parent is not None:
                x.parent.marks += x.marks
                x.parent.titles += x.titles
    open_mark = any(x.mark and not (x.says or x.buried or x.gone) for x in nodes)
    open_title = any(x.tag == "h1" and not (x.says or x.buried or x.gone) for x in nodes)
    by_mark = nodes[0].marks > 0 and not open_mark and not open_title
    by_title = nodes[0].marks == 0 and not open_title
    for x in nodes:
        if x.says and (x.header and x.titles or by_mark and x.marks or by_title and x.titles):
            x.says = False


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ROOT = _signed(xxhash.xxh64_intdigest(b""))


def _blocks(root: Node, declared: bool = True, perhaps: bool = False) -> Iterator[tuple[Node, str]]:
    """Each block of the landmarks, or of the page without one, in page order, and its text; what is declared is passed
    over (not so what may be declared, if perhaps)."""
    scope, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.mark:
            scope.append(x)
        else:
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node) and c.marks and not (c.gone or c.says))
    for top in scope or [root]:
        held: list[str] = []
        block, walk = top, [top]
        while walk:
            x = walk.pop()
            if isinstance(x, str):
                held.append(x)
                continue
            if isinstance(x, tuple):  # the end of a block: what follows is its parent's
                yield block, "".join(held)
                held, block = [], x[0]
                continue
            if x is not top and (x.gone or declared and x.says and not (perhaps and x.perhaps)):
                continue
            if x.tag == "br":
                held.append(" ")
                continue
            if x is not top and x.tag in BLOCKS:
                yield block, "".join(held)
                walk.append((block,))
                held, block = [], x
            walk.extend(reversed(x.children))
        yield block, "".join(held)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _told(root: Node) -> list[tuple[Node, str]]:
    """The blocks with text. Where declarations leave a page without a landmark nothing at all, they are passed over;
    where they leave a landmark nothing but titles, those by ambiguous words are."""
    out = [(x, t) for x, raw in _blocks(root) if (t := _clean(raw))]
    if root.marks and all(x.tag == "h1" for x, _ in out):
        return [(x, t) for x, raw in _blocks(root, perhaps=True) if (t := _clean(raw))]
    if out or root.marks:
        return out
    return [(x, t) for x, raw in _blocks(root, False) if (t := _clean(raw))]


def _hashed(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


#: Kinds of features: the shape of a node's children, a text in a node, the text before a text, the text after one.
SHAPE, CONTENT, BEFORE, AFTER = range(4)


def _text_key(x: Node, text: str) -> int:
    """The branch of a text alone in a node."""
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), x.path))


def features(root: Node) -> tuple[int, set[tuple[int, int, int]]]:
    """A digest of the page's declared main text; and for each block of it path (or the key of its text), kind and
    feature. The root has the shape of the page. Headings have no surroundings."""
    told = _told(root)
    hashed = [0, *(_hashed(t) for _, t in told), 0]
    out = {(_signed(x.path), CONTENT, h) for (x, _), h in zip(told, hashed[1:], strict=False)}
    for i, (x, t) in enumerate(told):
        if x.tag not in HEADINGS:
            key = _text_key(x, t)
            out |= {(key, BEFORE, hashed[i]), (key, AFTER, hashed[i + 2])}
    seen: set[int] = set()
    for x, _ in told:
        while x is not None and id(x) not in seen:
            seen.add(id(x))
            if x is root or x.tag in BLOCKS:
                shape = [c.path for c in x.children if isinstance(c, Node) and c.tag in BLOCKS]
                out.add((_signed(x.path), SHAPE, _signed(xxhash.xxh64_intdigest(np.array(shape, np.uint64).tobytes()))))
            x = x.parent
    if id(root) not in seen:
        out.add((_ROOT, SHAPE, 0))
    return _hashed("\n".join(t for _, t in told)), out


def main_text(root: Node, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the landmarks, or of the page without one, less branches of low importance. low: paths of those,
    and keys of texts.

    A title (h1) stays. Where nothing but titles would be left the host's pages are copies of each other, of which
    importance tells nothing, and all stays.
    """
    told = _told(root)
    left = [(x, t) for x, t in told if x.tag == "h1" or _signed(x.path) not in low and (x.tag in HEADINGS or _text_key(x, t) not in low)] if low else told
    if not any(x.tag != "h1" for x, _ in left):
        left = told
    return "\n".join(t for _, t in left)


def _host(url: str | None) -> str:
    _, found, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].translate(_LOWER) if found else ""


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each page under the digest of its main text; copies of a slice fold."""
    for whole in batches:
        for batch in pieces(whole, "html", 2 << 20):
            seen: set[tuple] = set()
            for url, source in zip(batch.column("url").to_pylist(), str_texts(batch.column("html")), strict=True):
                told, found = features(parse(source))
                host = _host(url)
                seen.update((host, told, *x) for x in found)
            rows = list(zip(*seen, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["host", "page", "path", "kind", "feature"])


def merged_nodes(pages: DataFrame) -> DataFrame:
    """host, path, kind and, over the host's pages of distinct main text, m (features), kinds (distinct ones), nlogn and logn
    (sums over these), written to the shared folder; and pages, how many of these the host has."""
    seen = pages.select("url", "html").mapInArrow(_merged, "host string, page long, path long, kind int, feature long")
    names = ("host", "path", "kind", "feature")
    once = seen.distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    merged = write_shared(once.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum(F.log("n")).alias("logn")))
    sizes = merged.filter((F.col("kind") == SHAPE) & (F.col("path") == _ROOT)).select("host", F.col("m").alias("pages"))
    return merged.join(sizes, "host")


def importance(pages: DataFrame) -> DataFrame:
    """host, path, pages (of distinct main text) of the host and importance (0 to 1) of each merged node that has text.

    With m pages, the presentation importance is the entropy to the base m of the shapes of a node's children, and the
    content importance is one less the mean over its texts of the entropy to the base m of the pages each is on; a node
    has the larger of the two. On a host of one page all nodes have 1. Pages without text count as one; null urls are
    of the host without a name; an empty table gives no rows. Repeated rows change nothing.
    """
    return _of_nodes(merged_nodes(pages))


def _of_nodes(merged: DataFrame) -> DataFrame:
    spread = F.log("m") - F.col("nlogn") / F.col("m")
    likeness = F.col("logn") / F.col("kinds")
    content = F.col("kind") == CONTENT
    value = F.when(F.col("pages") <= 1, 1.0).otherwise(F.when(content, 1 - likeness / F.log("pages")).otherwise(spread / F.log("pages")))
    return merged.filter(F.col("kind") <= CONTENT).groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(value).alias("importance"), F.max(content).alias("has_text")).filter("has_text").drop("has_text")


def _of_texts(merged: DataFrame, least: int) -> DataFrame:
    """host, path (the key of a text in its node) and importance: one less the entropy to the base m of the surroundings it
    has, as if all were alike in number; the smaller number of texts before it and after it counts, so that what stands beside the
    one place in which near copies differ stays, as does a text that always begins or ends the page. Hosts of under `least` pages
    have none."""
    return merged.filter((F.col("kind") >= BEFORE) & (F.col("pages") >= least)).groupBy("host", "path").agg((1 - F.min(F.log("kinds") / F.log("pages"))).alias("importance"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "html", 2 << 20):
            texts = [main_text(parse(s), set(low or ())) for s, low in zip(str_texts(batch.column("html")), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, threshold: float = 0.3, most_sent: int = 1_000_000, least: int = 4) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html; further columns are left alone).

    Branches under `threshold` are removed on every host, inside landmarks as outside, and on hosts of `least` distinct
    pages or more also texts under it (headings left out) in ever other surroundings. Blocks are joined in page order
    by one line end, white space inside a block is one space, character references are decoded. A null or empty html
    gives an empty text; rows without a host in their url are merged as one host; repeated rows each give a row; an
    empty table gives none. The low branches are written to the shared folder and counted: up to most_sent of them are
    sent to all tasks, more are joined by host, which shuffles the pages and leaves a common host to the adaptive
    splitting of skewed joins.
    """
    pages = pages.select("page_id", "url", "html")
    merged = merged_nodes(pages)
    worth = _of_nodes(merged).select("host", "path", "importance").unionByName(_of_texts(merged, least))
    low = write_shared(worth.filter(F.col("importance") < threshold).groupBy("host").agg(F.collect_list("path").alias("low")))
    n = low.agg(F.sum(F.size("low"))).first()[0] or 0
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    side = F.broadcast(low) if n <= most_sent else low.hint("merge")
    rows = pages.withColumn("host", host).join(side, "host", "left").select("page_id", "url", "html", "low")
    return rows.mapInArrow(_texts, T.StructType([field(pages, "page_id"), field(pages, "url"), T.StructField("text", T.StringType())]))
