"""Main text of HTML pages by composite text density (operator 4).

A page becomes a tree of its block elements.  For every node the characters
per tag are counted and adjusted for links (text inside links, link tags); a
node's density sum adds up the composite densities of its child blocks.  The
subtree with the largest sum is the main text, with the whole article element
around it if there is one.  The smallest density on the path from the body to it
is the threshold that other blocks beside that path must reach to belong to it
too (inside the outermost article or main element around it); headings and blocks
of plain text in the containers on the path (below the body), further articles in
the same main element and, without an article, text between the chosen blocks
belong to it as well, but for blocks that are mostly links.  Elements that
cannot be main text - scripts, styles, forms, menus, footers, sidebars, adverts,
notices, reader comments, by element, role, class or id - are left out of the
tree.  A class or id marks an element by its first or last word
("reader-comments", "ad-top"; not "no-sidebar", "ad-free"), words that are also
topics or states ("legal", "skip") not by themselves inside article and main, and
what holds the article or main element with the most text always stays.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by an empty line.  Null or empty html, or html without
text: the empty text, 0 characters.  Unclosed elements end with their parent or
the page; markup cut off at the end of the page is dropped.  Repeated rows: a
result each.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import slices

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_SPACES = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAG_END = re.compile(r"([\s/]*)>")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe object textarea title svg math".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog fieldset input audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "nav ol p pre section table ul".split())
#: An element of the key ends open elements of the value, up to the given container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class, id or role that mark what is not main text.
MARKS = frozenset("ad ads adsbygoogle advert advertisement adverts advertising sponsor sponsored promo promotion banner "
                  "cookie cookies consent gdpr notice notices notification notifications alert menu nav navbar navigation "
                  "breadcrumb breadcrumbs sidebar sidenav aside complementary footer footnav contentinfo masthead share "
                  "sharing social related recommended recommendations comment comments commentlist disqus replies respond "
                  "newsletter subscribe subscription signup login search popup modal overlay widget pagination pager "
                  "copyright legal toolbar skip tags".split())
HEADERS = frozenset("header banner topbar".split())
#: Of these words, those that inside article or main rather name a topic or a state, unless words of BESIDE stand with them.
TOPICS = frozenset("legal skip alert search menu promotion consent respond widget".split())
BESIDE = frozenset("site global page main js box bar list item items link links button buttons btn icon icons container "
                   "wrapper wrap section block area panel slot unit form inner outer row group top bottom".split())
#: The header of one of these is its title.
OWNERS = frozenset("post posts entry article articles story stories blog user".split())
#: A mark after one of these, or before one of the others, says that there is none.
DENIED, FREE = frozenset("no not non has have with without hide hidden".split()), frozenset("free less".split())
#: Elements that are text by themselves.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 header ul ol dl blockquote pre table figure".split())


class Node:
    """A block element: its content in order is text and child blocks."""

    __slots__ = ("name", "parent", "children", "content", "chars", "tags", "link_chars", "link_tags", "density", "sum",
                 "cut", "is_main")

    def __init__(self, name: str, parent: Node | None, cut: bool = False, is_main: bool = False):
        self.name, self.parent, self.children, self.content = name, parent, [], []
        self.cut, self.is_main = cut, is_main
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """A tag's attributes by whole name (the first of a name counts), whether it
    closes itself, and its end; the end is -1 if the page ends before it."""
    found: dict[str, str] = {}
    while not (end := _TAG_END.match(page, at)):
        m = _ATTRIBUTE.match(page, at)
        if not m:
            return found, False, -1
        value = m[2] or ""
        if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1]:
            value = value[1:-1]
        found.setdefault(m[1].lower(), value)
        at = m.end()
    return found, "/" in end[1], end.end()


def _marked(name: str, inside_main: bool) -> bool:
    """Whether one class, id or role says that its element is not main text: its
    first or last word is a mark ("reader-comments", "ad-top"), which no word
    denies ("no-sidebar", "ad-free")."""
    words = [w for w in _WORD.findall(name) if len(w) > 1]
    if not words or words[-1] in FREE or DENIED.intersection(words[:-1]):
        return False
    for w in {words[0], words[-1]}:
        if w in HEADERS and (inside_main or OWNERS.intersection(words)):
            continue
        if inside_main and w in TOPICS and (len(words) == 1 or not all(x in BESIDE or x in MARKS for x in words)):
            continue
        if w in MARKS or w in HEADERS:
            return True
    return False


def _marks(attributes: dict[str, str], inside_main: bool) -> bool:
    return any(_marked(x, inside_main) for key in ("class", "id", "role")
               for x in attributes.get(key, "").lower().split())


def _left_out(name: str, attributes: dict[str, str], inside_main: bool) -> bool:
    if name in DROPPED or (name == "header" and not inside_main):
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    return ("hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
            or bool(_NOT_SHOWN.search(attributes.get("style", ""))) or _marks(attributes, inside_main))


def _prune(root: Node) -> None:
    """Take out the parts to leave out, but not those around the article or main
    element that has the most text outside links."""
    order = [root]
    for x in order:
        order.extend(x.children)
    if not any(x.cut for x in order):
        return
    if any(x.is_main for x in order):
        free = {id(x): x.chars - x.link_chars for x in order}
        for x in reversed(order):
            if x.parent is not None:
                free[id(x.parent)] += free[id(x)]
        within: set[int] = set()
        for x in order:
            if x.cut or (x.parent is not None and id(x.parent) in within):
                within.add(id(x))
        # of equal ones, one outside the parts to leave out
        x = max((x for x in order if x.is_main), key=lambda x: (free[id(x)], id(x) not in within))
        while x is not None:
            x.cut = False
            x = x.parent
    for x in order:
        if any(c.cut for c in x.children):
            x.children = [c for c in x.children if not c.cut]
            x.content = [c for c in x.content if isinstance(c, str) or not c.cut]


def tree(page: str) -> Node:
    """The page's block tree, without what cannot be main text."""
    root = Node("body", None)
    node, stack, links, main_depth = root, [], 0, 0
    # stack: (name, node before it or None if inline, whether it is article or main)
    at, n, open_ended = 0, len(page), set()

    def text(s: str) -> None:
        if s:
            s = entities.unescape(s) if "&" in s else s
            node.content.append(s)
            size = len(s) - s.count(" ") - s.count("\n")
            node.chars += size
            if links:
                node.link_chars += size

    def pop(index: int) -> None:
        nonlocal node, links, main_depth
        while len(stack) > index:
            name, before, is_main = stack.pop()
            main_depth -= is_main
            if name == "a":
                links = max(0, links - 1)
            if before is not None:
                node = before

    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(page, at)
        if not tag:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        closing, name = tag[1], tag[2].lower()
        attributes, closed, at = _attributes(page, tag.end())
        if at < 0:
            break  # cut off at the end of the page
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end does not close blocks
            continue
        if name in RAW:
            if closed or name in open_ended:
                continue
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not close:
                open_ended.add(name)  # nor do later ones have an end
            if name in ("noscript", "object", "svg", "math"):
                at = close.end() if close else at
            else:
                at = close.end() if close else n
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in SIBLINGS:
            ends, container = SIBLINGS[name]
            found = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in container:
                    break
                if stack[i][0] in ends:
                    found = i
            if found is not None:
                pop(found)
        node.tags += 1
        if name in VOID:
            if name in ("br", "hr"):
                node.content.append(" ")
            continue
        if closed and name not in INLINE and name not in CLOSES_P:
            continue
        if name in ("html", "body"):
            continue
        cut = _left_out(name, attributes, main_depth > 0)
        is_main = name in ("article", "main")
        if name == "a":
            links += 1
            node.link_tags += 1
        if name in INLINE and not cut:
            stack.append((name, None, False))
        else:
            # an article that is itself a comment or a teaser is not the page's
            child = Node(name, node, cut, is_main and not _marks(attributes, False))
            node.children.append(child)
            node.content.append(child)
            stack.append((name, node, is_main))
            node = child
        main_depth += is_main
    _prune(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Sum the counts upwards and set densities; the nodes, parents first."""
    order = [root]
    for x in order:
        order.extend(x.children)
    for x in reversed(order):
        if x.parent is not None:
            for name in ("chars", "tags", "link_chars", "link_tags"):
                setattr(x.parent, name, getattr(x.parent, name) + getattr(x, name))
    body_links = root.link_chars / max(1, root.chars)
    for x in reversed(order):
        if x.chars:
            chars, tags = x.chars, max(1, x.tags)
            link_chars, link_tags = max(1, x.link_chars), max(1, x.link_tags)
            free = max(1, chars - x.link_chars)
            base = math.log(chars / free * x.link_chars + body_links * chars + math.e)
            ratio = chars / link_chars * tags / link_tags
            x.density = chars / tags * math.log(max(ratio, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else (
                chars / tags * math.log(max(ratio, 1.0)))
        if x.parent is not None:
            x.parent.sum += x.density
        if not x.children:
            x.sum = max(x.sum, x.density)
    return order


def _blocks(nodes, stop=frozenset()) -> list[str]:
    """Texts of the blocks below the nodes, in page order."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        s = _SPACES.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if s:
            out.append(s)

    for top in nodes:
        todo = [iter(top.content)]
        while todo:
            item = next(todo[-1], None)
            if item is None:
                todo.pop()
                flush()
            elif isinstance(item, str):
                buffer.append(item)
            else:
                flush()
                todo.append(iter(item.content))
        flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    order = _measure(tree(page))
    best = order[0]
    for x in order:
        if x.sum > best.sum:  # parents come first: a tie goes to the larger subtree
            best = x
    if not best.children and best.parent is not None and best.name != "article":
        best = best.parent  # a single block is read with the blocks beside it
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    mains = [i for i, x in enumerate(path) if x.name in ("article", "main")]
    # an article stays whole; without one, the subtree itself
    start, end = (mains[0], mains[-1]) if mains else (0, len(path) - 1)
    chosen = {id(path[start])}
    for inner, outer in zip(path[start:end], path[start + 1:end + 1]):
        held = outer.parent is not None  # the body may hold anything
        for c in outer.children:
            if c is not inner and _is_text(c):
                if c.density >= threshold or (held and c.name in TEXTS) or re.fullmatch("h[1-6]", c.name):
                    chosen.add(id(c))
                elif mains:
                    chosen |= {id(x) for x in _descendants(c) if x.name == "article" and _is_text(x)}
    return "\n\n".join(_blocks(_kept(path[end], chosen, bool(mains))))


def _is_text(x: Node) -> bool:
    """Whether a subtree has text and no more than half of it in links."""
    return x.chars > 0 and 2 * x.link_chars <= x.chars


def _descendants(x: Node) -> list[Node]:
    order = [x]
    for y in order:
        order.extend(y.children)
    return order


def _kept(top: Node, chosen: set[int], only_chosen: bool) -> list[Node]:
    """The chosen subtrees in page order and, unless ``only_chosen``, what text lies
    between the first and the last of them."""
    holds: set[int] = set()  # nodes with a chosen one below them
    order = _descendants(top)
    for x in reversed(order):
        if x.parent is not None and (id(x) in chosen or id(x) in holds):
            holds.add(id(x.parent))
    found, todo = [], [top]
    while todo:
        x = todo.pop()
        if id(x) in chosen:
            found.append((x, True))
        elif id(x) in holds:
            todo.extend(reversed(x.children))
        elif not only_chosen and _is_text(x):
            found.append((x, False))
    at = [i for i, (_, own) in enumerate(found) if own]
    return [x for x, _ in found[at[0]:at[-1] + 1]] if at else []


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                      F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
