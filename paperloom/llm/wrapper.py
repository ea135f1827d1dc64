"""Main text of web pages by wrapper induction.

Pages of one host share a template.  Each host has a reference page; every
other page's DOM tree is aligned with the reference's by simple tree matching,
and the reference's nodes collect votes: aligned, aligned with equal text, and
the part of the page's own text (neither equal to the reference's nor in links)
that lies below.  Nodes constant over most pages are template.  The main slot
is the deepest node that holds most of the varying text on the host's pages;
what lies beside it (menus, notices, adverts, footers) is not main text, however
it varies.  A page's text is what varies within its main slot, without the parts
that their element or its class names as menus, notices, adverts, forms or
reader comments.

Where no main slot stands out, as on hosts of one or two pages, element and
class names find the article.  `names=False` leaves all telling names out.

What the reference lacks is found by place: a text at the same label path on
most of the host's pages is template too, whatever page has it.

A page that repeats most of the reference's text (a copy), or of the texts that
most pages share, is no evidence for a template and does not vote.  Votes are
summed by host and node after partial aggregation, so a host may have any share
of the pages.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node is template if this share of at least MIN_VOTES voting pages agrees.
AGREE, MIN_VOTES = 0.6, 3
#: Main or content blocks with less than this share of the body's text are not the article.
SHARE = 0.5
#: The main slot's share of the varying text of a host's pages, each weighted by the root of its length.
MAIN = 0.6
#: Kid lists whose lengths multiply to more than SMALL_TABLE are matched row by row with numpy, beyond LARGE_TABLE by halves in linear memory.
SMALL_TABLE, LARGE_TABLE = 1 << 10, 1 << 22
#: A page with this many tags whose quotes do not close is read on without regard to quotes.
OPEN_QUOTES = 64
#: References below this many bytes in all are broadcast; else they are joined by host.
BROADCAST_BYTES = 64 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split()
)
_CLOSES_P = _BLOCK - frozenset("body html head title td th tr tbody thead tfoot legend summary".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_BARRIER = frozenset("ul ol dl table article section div body main aside nav header footer form blockquote".split())
#: What is not shown as text, and elements named after parts that are not main text.
_UNSHOWN = frozenset("script style noscript template iframe object embed svg canvas button select textarea input head title audio video map datalist".split())
_FURNITURE = frozenset("nav footer aside form menu dialog".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary".split())
#: Words of class and id attributes that name what is not main text.
_DROP_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|banner|breadcrumbs?|comments?|respond|reply|replies|disqus|consent|cookies?|gdpr|notice|notification|disclaimer|footer|masthead|menu|nav|navbar|navigation|newsletter|pagination|pager|popup|modal|overlay|promo\w*|recommended|related|share|sharing|sidebar|side-bar|skip-link|skip|social|sponsor\w*|subscribe|subscription|teaser|toolbar|widget|site-header|page-header|topbar|login|signup)(?:$|[\s_-])",
    re.I,
)
_CONTENT_CLASS = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|content|entry|entry-content|post|post-content|story|main)(?:$|[\s_-])", re.I)
#: A comment's, a marked section's or a declaration's start, or a tag up to its end or to a quote that does not close.
_TAG = re.compile(r"""<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>?))""")
#: The same without regard to quotes.
_PLAIN_TAG = re.compile(r"""<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>?))""")
_ENDS = {"!--": "-->", "![CDATA[": "]]>", "!": ">", "?": ">"}
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class Node:
    """An element: tag, class and id, ordered parts (text or nodes); `drop`: not main text, `named`: a telling name for main text."""

    __slots__ = ("tag", "cls", "drop", "named", "parts", "label", "own", "kids", "index", "up", "chars", "loose", "path", "codes")

    def __init__(self, tag: str, attrs: str = "", names: bool = True):
        self.tag, self.parts, self.cls, self.codes = tag, [], "", None
        self.drop = tag in _UNSHOWN or names and tag in _FURNITURE
        self.named = names and tag in ("article", "main")
        if attrs and not attrs.isspace():
            got = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
            self.cls = " ".join(got[k] for k in ("class", "id") if k in got)
            self.drop = self.drop or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
            if not names:
                return
            role = got.get("role", "").lower()
            if self.cls and not self.drop:
                self.drop = bool(_DROP_CLASS.search(self.cls)) and tag not in ("body", "html")
            self.drop = self.drop or role in _DROP_ROLE
            if role == "main":
                self.tag = "main"
            self.named = not self.drop and (self.tag in ("article", "main") or tag in ("div", "section", "td") and bool(self.cls and _CONTENT_CLASS.search(self.cls)))


def parse(text: str, names: bool = True) -> Node:
    """The tree of a page, however deep; whatever the markup, every character of text is in some node.

    A tag that nothing closes takes the rest of the page.
    """
    root = Node("#root")
    stack, at, deepest, failed, pattern = [root], 0, 0, 0, _TAG
    open_: dict[str, int] = {}

    def close(i: int) -> None:
        for n in stack[i:]:
            open_[n.tag] -= 1
        del stack[i:]

    while m := pattern.search(text, at):
        start = m.start()
        if start > at:
            stack[-1].parts.append(text[at:start])
        at = m.end()
        other, closing, tag, attrs, ended = m.groups()
        if other:
            mark = _ENDS[other]
            end = text.find(mark, at)
            at = end + len(mark) if end >= 0 else len(text)
            continue
        if not ended:
            end = text.find(">", at)
            attrs, at = text[m.end(3) : end if end >= 0 else len(text)], end + 1 or len(text)
            failed += 1
            if failed == OPEN_QUOTES:
                pattern = _PLAIN_TAG
        tag = tag.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "article") and tag not in ("table", "body", "html", "main", "tr", "tbody"):
                    break
            continue
        if tag in _CLOSES_P or tag in _SAME:
            same = _SAME.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if open_.get("p") or any(open_.get(t) for t in same) else ():
                own = stack[i].tag
                if own in same or own == "p" and tag in _CLOSES_P:
                    close(i)
                    break
                if own in _BARRIER:
                    break
        node = Node(tag, attrs, names)
        stack[-1].parts.append(node)
        if tag in _RAW:
            closed = _RAW_END[tag].search(text, at)
            node.parts.append(text[at : closed.start() if closed else len(text)])
            at = (text.find(">", closed.end()) + 1 or len(text)) if closed else len(text)
        elif tag not in _VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
            open_[node.tag] = open_.get(node.tag, 0) + 1
            deepest = max(deepest, len(stack))
    if at < len(text):
        stack[-1].parts.append(text[at:])
    _deep(deepest)
    return root


def _deep(levels: int) -> None:
    """Let functions over trees of so many levels call themselves."""
    if sys.getrecursionlimit() < 8 * levels + 1000:
        sys.setrecursionlimit(8 * levels + 1000)


def _inline(node: Node, out: list[str], linked: list[str], inside: bool = False) -> None:
    """Own text of a node with its inline descendants, and of it what is in links."""
    for part in node.parts:
        if isinstance(part, str):
            out.append(part)
            if inside:
                linked.append(part)
        elif part.tag not in _BLOCK and not part.drop:
            if part.tag == "br":
                out.append(" ")
            _inline(part, out, linked, inside or part.tag == "a")


def _clean(parts: list[str]) -> str:
    return " ".join(_html.unescape("".join(parts)).split())


def _kids(node: Node, kids: list[Node]) -> None:
    for part in node.parts:
        if isinstance(part, str):
            continue
        if part.tag in _BLOCK:
            kids.append(part)
        else:
            _kids(part, kids)


def outline(root: Node) -> list[Node]:
    """Block nodes in page order.

    Each has label, path (hash of the labels down to it), own (hash of its text,
    0 if none), chars (0 in dropped parts), loose (chars outside links), kids,
    index and up (its parent's).
    """
    found: list[Node] = []
    todo = [(root, False, 0, -1)]
    while todo:
        node, dropped, path, up = todo.pop()
        dropped = dropped or node.drop
        node.index, node.up = len(found), up
        found.append(node)
        words = [w for w in node.cls.split() if w.isascii() and not any(c.isdigit() for c in w)]  # numbered names differ by page
        node.label = f"{node.tag}.{' '.join(words)}" if words else node.tag
        node.path = zlib.crc32(f"/{node.label}".encode("utf-8", "surrogatepass"), path)
        texts: list[str] = []
        linked: list[str] = []
        _inline(node, texts, linked)
        text = "" if node.tag in _UNSHOWN else _clean(texts)
        node.own = zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1 if text else 0
        node.chars = 0 if dropped else len(text)
        node.loose = max(0, len(text) - len(_clean(linked))) if linked else len(text)
        node.kids = []
        _kids(node, node.kids)
        todo += [(kid, dropped, node.path, node.index) for kid in reversed(node.kids)]
    return found


def places(nodes: list[Node]) -> dict[int, list[Node]]:
    """The text nodes outside dropped parts by place: label path, text and how often the page has it there."""
    same: dict[tuple[int, int], list[Node]] = {}
    for node in nodes:
        if node.own and node.chars:
            same.setdefault((node.path, node.own), []).append(node)
    return {(zlib.crc32(b"%d" % len(found), path) << 32 | own) - (1 << 63): found for (path, own), found in same.items()}


def skeleton(root: Node) -> str:
    """The outline of a reference as JSON: labels, own texts, parents and telling names by node."""
    nodes = outline(root)
    return json.dumps([[n.label for n in nodes], [n.own for n in nodes], [n.up for n in nodes], [int(n.named) for n in nodes]], separators=(",", ":"))


class Reference:
    """A reference's outline as nodes in page order."""

    __slots__ = ("root", "nodes")

    def __init__(self, packed: str):
        self.nodes: list[Node] = []
        depth = []
        for i, (label, own, up, named) in enumerate(zip(*json.loads(packed))):
            node = Node.__new__(Node)
            node.label, node.own, node.index, node.up, node.named, node.kids, node.codes = label, own, i, up, bool(named), [], None
            node.tag = label.split(".", 1)[0]
            self.nodes.append(node)
            depth.append(depth[up] + 1 if up >= 0 else 0)
            if up >= 0:
                self.nodes[up].kids.append(node)
        _deep(max(depth))
        self.root = self.nodes[0]

    def main_slot(self, weights: dict[int, int]) -> int | None:
        """The deepest node that holds MAIN of the varying text, no paragraph and nothing below a node named main text; null above all blocks of the body."""
        at, least = self.root, MAIN * weights.get(0, 0)
        while least and not (at.named and at.tag not in ("html", "body")):
            heavy = [k for k in at.kids if weights.get(k.index, 0) >= least and (k.kids or k.tag not in _PROSE)]
            if not heavy:
                break
            at = heavy[0]
        return None if at.tag in ("#root", "html", "body") else at.index


def _weigh(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the most nodes that match in order and level; equal texts count double."""
    if a.label != b.label:
        return 0
    own = 1 + (a.own == b.own != 0)
    if not a.kids or not b.kids:
        return own
    key = (a.index, b.index)
    got = memo.get(key)
    if got is None:
        if len(a.kids) * len(b.kids) <= SMALL_TABLE:
            best = _table(a.kids, b.kids, memo)[-1][-1]
        else:
            best = int(_row(a.kids, b.kids, memo)[-1])
        got = memo[key] = own + best
    return got


def _table(xs: list[Node], ys: list[Node], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row, last = rows[-1], [0], 0
        label, own, leaf = x.label, x.own, not x.kids
        for j, y in enumerate(ys):
            best = above[j + 1]
            if last > best:
                best = last
            if y.label == label:
                w = above[j] + (1 + (own == y.own != 0) if leaf or not y.kids else _weigh(x, y, memo))
                if w > best:
                    best = w
            row.append(best)
            last = best
        rows.append(row)
    return rows


def _coded(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the labels, hashes of the texts, whether there are kids."""
    labels = np.array([zlib.crc32(n.label.encode("utf-8", "surrogatepass")) for n in nodes], np.int64)
    return labels, np.array([n.own for n in nodes], np.int64), np.array([bool(n.kids) for n in nodes])


def _weights(x: Node, ys: list[Node], coded, memo: dict) -> np.ndarray:
    """_weigh of x and every y, as numbers; what differs in label weighs nothing."""
    labels, owns, inner = coded
    same = labels == zlib.crc32(x.label.encode("utf-8", "surrogatepass"))
    w = same * (1 + (owns == x.own) * (x.own != 0))
    if x.kids:
        for j in np.flatnonzero(same & inner).tolist():
            w[j] = _weigh(x, ys[j], memo)
    return w


def _row(xs: list[Node], ys: list[Node], memo: dict, coded=None, back: bool = False) -> np.ndarray:
    """Last row of the table of xs against ys (`back`: of both read backwards, places still those of ys)."""
    coded = coded or _coded(ys)
    row = np.zeros(len(ys) + 1, np.int64)
    for x in reversed(xs) if back else xs:
        w = _weights(x, ys, coded, memo)
        new = np.zeros_like(row)
        if back:
            new[:-1] = np.maximum(row[:-1], row[1:] + w)
            row = np.maximum.accumulate(new[::-1])[::-1]
        else:
            new[1:] = np.maximum(row[1:], row[:-1] + w)
            row = np.maximum.accumulate(new)
    return row


def _matched(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of a maximum matching of two lists of siblings."""
    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= LARGE_TABLE or b - a == 1:
            part, other = xs[a:b], ys[c:d]
            if (b - a) * (d - c) <= SMALL_TABLE:
                t = _table(part, other, memo)
            else:
                coded, t = _coded(other), [np.zeros(d - c + 1, np.int64)]
                for x in part:
                    new = np.zeros_like(t[-1])
                    new[1:] = np.maximum(t[-1][1:], t[-1][:-1] + _weights(x, other, coded, memo))
                    t.append(np.maximum.accumulate(new))
            i, j = b - a, d - c
            while i and j:
                if t[i][j] == t[i - 1][j]:
                    i -= 1
                elif t[i][j] == t[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((part[i], other[j]))
            continue
        middle = (a + b) // 2
        coded = _coded(ys[c:d])
        split = c + int(np.argmax(_row(xs[a:middle], ys[c:d], memo, coded) + _row(xs[middle:b], ys[c:d], memo, coded, back=True)))
        todo += [(a, middle, c, split), (middle, b, split, d)]
    return out


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of a maximum simple tree matching."""
    memo: dict = {}
    out, todo = [], [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.kids and y.kids:
            todo += _matched(x.kids, y.kids, memo)
    return out


def votes(root: Node, reference: Reference) -> list[tuple[int, bool, bool, int]]:
    """(reference node, both have text, equal text, weight of the varying text below) of the aligned nodes; none if the page mostly repeats the reference."""
    nodes = outline(root)
    matched = align(root, reference.root)
    prose = [(a.chars, a.own == b.own) for a, b in matched if a.own and b.own and a.tag in _PROSE]
    if sum(n for n, equal in prose if equal) * 2 > sum(n for n, _ in prose):
        return []
    below = [n.loose for n in nodes]
    for a, b in matched:
        if a.own == b.own:
            below[a.index] = 0
    for n in reversed(nodes):
        if n.up >= 0:
            below[n.up] += below[n.index]
    total = max(1, below[0])
    unit = 1000 * math.isqrt(total)
    return [(b.index, bool(a.own and b.own), a.own == b.own != 0, below[a.index] * unit // total) for a, b in matched]


def _articles(root: Node) -> list[list[Node]]:
    """Places of the main text, best first: the outermost article elements that are not reader comments; main; content blocks; the body."""
    articles, mains, blocks, bodies = [], [], [], []

    def visit(node: Node, article: bool, main: bool, block: bool, body: bool) -> None:
        for part in node.parts:
            if isinstance(part, str):
                continue
            comment = part.drop and part.tag in ("article", "section", "aside", "div", "ul", "ol", "li") and re.search(r"comment|repl|respond|related|recommended|teaser", part.cls, re.I)
            if comment or part.tag in ("script", "style", "head"):
                continue
            own_article = part.tag == "article" and not part.drop
            own_block = part.tag in ("div", "section", "td") and bool(part.cls) and not part.drop and bool(_CONTENT_CLASS.search(part.cls))
            for own, inside, found in ((own_article, article, articles), (part.tag == "main", main, mains), (own_block, block, blocks), (part.tag == "body", body, bodies)):
                if own and not inside:
                    found.append(part)
            visit(part, article or own_article, main or part.tag == "main", block or own_block, body or part.tag == "body")

    visit(root, False, False, False, False)
    if articles:
        return [articles]
    return [found for found in (mains, blocks) if found] + [bodies or [root]]


def extract(root: Node, template: set[int], slots: list[Node] | None = None, nodes: list[Node] | None = None, names: bool = True) -> str:
    """Main text of a parsed page; `template`: id() of nodes whose own text is template; `slots`: its main slot, if its host has one; `nodes`: its outline.

    A main slot without a telling name brings the headline above it along,
    unless it begins with it.
    Without names, what has no main slot is read as a whole.  With them, a
    nameless slot, or main and content blocks all together, count where they
    hold SHARE of the body's text.
    """
    blocks: list[str] = []

    def walk(node: Node, held: list[str], header: bool) -> None:
        own = id(node) not in template
        for part in node.parts:
            if isinstance(part, str):
                if own or node.tag not in _BLOCK:
                    held.append(part)
            elif part.drop:
                held.append(" ")
            elif part.tag == "br" or part.tag == "hr":
                held.append(" ")
            elif part.tag in _BLOCK:
                flush(held)
                if not (part.tag == "header" and not header):
                    walk(part, held, header)
                flush(held)
            elif id(node) not in template or node.tag not in _BLOCK:
                walk(part, held, header)

    def flush(held: list[str]) -> None:
        text = _clean(held)
        held.clear()
        if text:
            blocks.append(text)

    def read(tops: list[Node], header: bool | None = None) -> str:
        blocks.clear()
        for top in tops:
            held: list[str] = []
            walk(top, held, top.tag in ("article", "main") if header is None else header)
            flush(held)
        return "\n\n".join(blocks)

    if slots:
        found = read(slots, True)
        if any(s.named for s in slots):
            return found
        first = found.partition("\n\n")[0]
        found = "\n\n".join([*(h for h in _headlines(nodes[: slots[0].index], template) if h != first), *([found] if found else [])])
        if not names or len(found) >= SHARE * len(read(_articles(root)[-1])):
            return found
    if not names:
        return read([root], True)
    texts = [read(tops) for tops in _articles(root)]
    return next(t for t in texts if len(t) >= SHARE * len(texts[-1]))


def _headlines(nodes: list[Node], template: set[int]) -> list[str]:
    """Of the blocks before a main slot the varying ones that are first-level headings or begin the page's title."""
    title, out = "", []
    for node in nodes:
        if node.tag == "title" or any(isinstance(p, Node) and p.tag == "title" for p in node.parts):
            title = title or _clean([t for p in ([node] if node.tag == "title" else node.parts) if isinstance(p, Node) and p.tag == "title" for t in p.parts if isinstance(t, str)])
        elif node.own and node.chars and node.loose == node.chars and id(node) not in template and not node.kids:
            texts: list[str] = []
            _inline(node, texts, [])
            text = _clean(texts)
            if node.tag == "h1" or len(text) > 2 and title.startswith(text):
                out.append(text)
    return out


def main_nodes(pairs: list[tuple[Node, Node]], nodes: list[Node], main: int) -> list[Node]:
    """The page's node aligned with the main slot, and those siblings of its kind that are aligned with nothing."""
    top = next((a for a, b in pairs if b.index == main), None)
    if top is None or top.drop:
        return []
    met = {id(a) for a, _ in pairs}
    return [k for k in nodes[top.up].kids if k is top or k.label == top.label and id(k) not in met]


def host_of(url):
    """Host of a URL, lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _references(pages: DataFrame, names: bool) -> DataFrame:
    """(host, skeleton): of each host's pages a short one, ties by hash; hosts of one page have none."""
    from .shared import materialise

    size = F.greatest(F.length("html"), F.lit(2000))
    hashed = F.xxhash64("page_id", "html")
    chosen = pages.where("host is not null and html is not null").groupBy("host").agg(F.min(F.struct(size.alias("size"), hashed.alias("hash"))).alias("ref"), F.count("*").alias("n")).where("n > 1")
    chosen = materialise(chosen.select(F.col("host").alias("h"), F.col("ref.size").alias("s"), F.col("ref.hash").alias("x")))
    bytes_ = chosen.agg(F.sum(F.length("h") + 64)).first()[0] or 0  # small enough, it goes to the pages and no page moves
    asked = F.broadcast(chosen) if bytes_ <= BROADCAST_BYTES else chosen
    found = pages.join(asked, (F.col("host") == F.col("h")) & (size == F.col("s")) & (hashed == F.col("x"))).select("host", "html").dropDuplicates(["host"])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([skeleton(parse(t, names)) for t in batch.column(1).to_pylist()], pa.string())], names=["host", "skeleton"])

    return found.mapInArrow(run, "host string, skeleton string")


def _with_hosts(pages: DataFrame, hosts: DataFrame, size: int) -> DataFrame:
    return pages.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left")


def _common(pages: DataFrame, names: bool) -> DataFrame:
    """(host, common): the places of each host that most of its pages have, by the votes of pages that are mostly their own."""
    from .shared import materialise

    def read(batches):
        for batch in batches:
            hosts, keys, chars, rest = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                nodes = outline(parse(text, names))
                held = places(nodes)
                keys.append(list(held))
                chars.append([sum(n.chars for n in found if n.tag in _PROSE) for found in held.values()])
                rest.append(sum(n.chars for n in nodes if n.own and n.tag in _PROSE))
            yield pa.RecordBatch.from_arrays([hosts, pa.array(keys, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32())), pa.array(rest, pa.int64())], names=["host", "keys", "chars", "prose"])

    told = materialise(pages.where("host is not null and html is not null").select("host", "html").mapInArrow(read, "host string, keys array<long>, chars array<int>, prose long"))

    def shared(counted: DataFrame, totals: DataFrame) -> DataFrame:
        # At most 1 / AGREE times the places of one page are left of a host.
        few = counted.where(F.col("n") >= MIN_VOTES).join(totals, "host").where(F.col("n") >= AGREE * F.col("total"))
        return materialise(few.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("common")))

    totals = told.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= MIN_VOTES)
    candidates = shared(told.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")), totals)

    def vote(batches):
        voters: Counter = Counter()
        tally: Counter = Counter()
        for batch in batches:
            for host, keys, chars, prose, common in zip(*(batch.column(i).to_pylist() for i in range(5))):
                known = set(common)
                if 2 * sum(n for k, n in zip(keys, chars) if k in known) <= prose:
                    voters[host] += 1
                    tally.update((host, k) for k in keys if k in known)
            if len(tally) > 200_000:
                yield emit(voters, tally)
                voters.clear(), tally.clear()
        yield emit(voters, tally)

    def emit(voters, tally):
        rows = [(h, None, n) for h, n in voters.items()] + [(h, k, n) for (h, k), n in tally.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "key", "n"])

    size = 8 * (candidates.agg(F.sum(F.size("common").cast("long"))).first()[0] or 0)
    asked = _with_hosts(told, candidates, size).where("common is not null").select("host", "keys", "chars", "prose", "common")
    counted = materialise(asked.mapInArrow(vote, "host string, key long, n long").groupBy("host", "key").agg(F.sum("n").alias("n")))
    return shared(counted.where("key is not null"), counted.where("key is null").select("host", F.col("n").alias("total")))


def induce(pages: DataFrame, names: bool = True) -> tuple[DataFrame, int]:
    """(host, skeleton, constant, main, common): the template of each host, and the bytes of them all."""
    from .shared import materialise

    references = materialise(_references(pages, names))
    size = references.agg(F.sum(F.length("skeleton"))).first()[0] or 0

    def run(batches):
        cache: dict[str, Reference] = {}
        tally: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for host, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if host not in cache:
                    if len(cache) >= 256:
                        cache.clear()
                    cache[host] = Reference(packed)
                for node, both, equal, weight in votes(parse(text, names), cache[host]):
                    sums = tally.setdefault((host, node), [0, 0, 0, 0])
                    for i, more in enumerate((1, both, equal, weight)):
                        sums[i] += more
            if len(tally) > 200_000:
                yield emit(tally)
                tally.clear()
        yield emit(tally)

    def emit(tally):
        columns = zip(*tally.values()) if tally else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], names=["host", "node", "pages", "met", "equal", "weight"])

    sums = ["pages", "met", "equal", "weight"]
    seen = _with_hosts(pages.where("html is not null"), references, size).where("skeleton is not null").select("host", "html", "skeleton")
    counted = seen.mapInArrow(run, "host string, node int, " + ", ".join(f"{c} long" for c in sums)).groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in sums])
    # A row a node of the host's reference: as large as that page.
    told = references.join(counted.groupBy("host").agg(F.collect_list(F.struct("node", *sums)).alias("told")), "host")

    def judge(batches):
        for batch in batches:
            constant, main = [], []
            for packed, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                constant.append(sorted(r["node"] for r in rows if r["met"] >= MIN_VOTES and r["equal"] >= AGREE * r["met"]))
                voters = max(r["pages"] for r in rows)
                main.append(Reference(packed).main_slot({r["node"]: r["weight"] for r in rows}) if voters >= MIN_VOTES else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(constant, pa.list_(pa.int32())), pa.array(main, pa.int32())], names=["host", "constant", "main"])

    judged = told.select("host", "skeleton", "told").mapInArrow(judge, "host string, constant array<int>, main int")
    templates = materialise(references.join(judged, "host", "left").join(_common(pages, names), "host", "left"))
    held = F.greatest(F.size("common"), F.lit(0)).cast("long") + F.greatest(F.size("constant"), F.lit(0))
    return templates, size + 8 * (templates.agg(F.sum(held)).first()[0] or 0)


def extract_main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`.

    A null or empty html gives an empty text.  A page whose url is null or has
    no host belongs to no template and is judged by its own elements, as is a
    host's only page.  Repeated rows give equal rows; an empty table gives
    none; other columns are ignored.  `names`: element and class names may tell
    what is main text; otherwise the template alone decides.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    templates, size = induce(pages, names)

    def run(batches):
        cache: dict[str, Reference] = {}
        for batch in batches:
            ids, urls, texts = batch.column(0), batch.column(1), []
            for host, text, packed, constant, main, common in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
                root = parse(text or "", names)
                template: set[int] = set()
                slots: list[Node] = []
                nodes = outline(root) if constant or common or main is not None else []
                if constant or main is not None:
                    if host not in cache:
                        if len(cache) >= 256:
                            cache.clear()
                        cache[host] = Reference(packed)
                    known = set(constant or ())
                    pairs = align(root, cache[host].root)
                    template = {id(a) for a, b in pairs if b.index in known and a.own == b.own}
                    slots = main_nodes(pairs, nodes, main) if main is not None else []
                if common:
                    held = places(nodes)
                    template |= {id(n) for k in held.keys() & set(common) for n in held[k]}
                texts.append(extract(root, template, slots, nodes, names))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = _with_hosts(pages, templates, size).select("page_id", "url", "host", "html", "skeleton", "constant", "main", "common")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
