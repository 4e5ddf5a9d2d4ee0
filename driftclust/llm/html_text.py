"""Main text of web pages by scoring the tree of their elements."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import own_columns

# Names of elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head script style noscript template iframe textarea title nav footer aside button input select option label legend dialog menu search svg annotation annotation-xml canvas object embed audio video noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tooltip".split())
FORMS = frozenset("form fieldset".split())
PARAGRAPH = frozenset("p pre blockquote td dd li".split())
#: An opening tag on the left ends open elements named on the right, up to the nearest element in its third part.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class and id names for what isn't the article, and beginnings of such words.
ROLES = frozenset("ad ads adbox adslot adunit banner consent gdpr notice notices sidebar sidebars sidenav side nav navbar navigation footer foot header masthead topbar discussion discussions respond reply replies reviews share sharing social related popup modal overlay login signin signup register pager pagination widget widgets toolbar toc copyright legal disclaimer skip search outbrain taboola alert tags hidden menu menus submenu".split())
ROLE_BEGINS = ("advert", "adsense", "sponsor", "promo", "cookie", "comment", "newsletter", "subscri", "breadcrumb", "disqus", "recommend")
#: Words that leave such a name what it is: ``related-posts`` names no article, ``related-work`` may.
NEUTRAL = frozenset(
    "box block area section list lists item items wrapper wrap container inner outer top bottom left right site page global primary secondary bar link links post posts article articles entry story stories content body panel holder thread threads form button buttons icons icon row col column group unit slot zone space place frame view region module component js the my user users reader readers visitor main fixed sticky floating mini small large big mobile desktop new latest more count title heading head text msg message messages inline embedded in above below after before under strip card cards grid feed control controls policy settings plugin app div wp a b c x and".split()
)
ARTICLE = frozenset("article entry post story".split())
LIKELY = frozenset("article articles content entry main body post story text page".split())
#: Share of a page's points from which an element isn't what its name says. Comments, which may well be longer than an article, go whatever they hold.
MISNAMED = 0.95
#: Elements that end the search for open paragraphs when a block begins; and those whose contents an inline end tag doesn't leave.
BOUNDS = frozenset("table article section div main body aside blockquote ul ol".split())
CONTAINERS = frozenset("article section div td body main".split())
INLINE_ENDS = frozenset("p b i em strong a span".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "score", "chars", "linked", "commas", "own", "points", "passed")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.score = self.passed = 0.0


#: What a tag on the left ends, and up to which open elements besides BOUNDS.
_ENDED = {t: frozenset(ENDS.get(t, ((), ()))[0]) | ({"p"} if t in BLOCK else set()) | (HEADINGS if t in HEADINGS else set()) for t in BLOCK | set(ENDS)}
_SCOPE = {t: frozenset(ENDS.get(t, ((), ()))[1]) - BOUNDS for t in _ENDED}


class _Open:
    """The open elements, the root at 0, and the places of each kind among them, so that no tag has to climb to find one."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.bounds, self.containers = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        place = len(self.nodes)
        self.places.setdefault(node.tag, []).append(place)
        self.nodes.append(node)
        if node.tag in BOUNDS:
            self.bounds.append(place)
        if node.tag in CONTAINERS:
            self.containers.append(place)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside of it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()
        for some in (self.bounds, self.containers):
            while some[-1] >= place:
                some.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost element of a kind, 0 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def ended_by(self, tag: str) -> int:
        """The place of the outermost open element that a tag ends, 0 if it ends none."""
        bound = self.bounds[-1]
        for t in _SCOPE[tag]:
            bound = max(bound, self.last(t))
        outermost = 0
        for t in _ENDED[tag]:
            places = self.places.get(t)
            if places and places[-1] > bound:
                place = places[bisect_right(places, bound)]
                outermost = min(outermost or place, place)
        return outermost


def parse(page: str) -> Node:
    """A tree of elements and strings. Ends that HTML leaves out are put in; end tags without a start are ignored. The time is that of reading the page,
    however deep its elements or wrong its tags."""
    root = Node("html", {}, None)
    opened = _Open(root)
    at, stop = 0, len(page)
    while at < stop:
        m = _TAG.search(page, at)
        if not m:
            opened.nodes[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            opened.nodes[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3]
        if not name:
            if m[1]:
                opened.nodes[-1].children.append(m[1])
            continue
        tag = name.lower()
        if m[2]:
            place = opened.last(tag)
            if place and not (tag in INLINE_ENDS and opened.containers[-1] > place):  # an inline end doesn't close a container
                opened.close(place)
            continue
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])} if m[4].strip(" /\t\r\n") else {}
        if tag == "html":
            root.attributes |= attributes
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}>", re.I).search(page, at)
            at = end.end() if end else stop
            continue
        if tag in _ENDED and (place := opened.ended_by(tag)):
            opened.close(place)
        node = Node(tag, attributes, opened.nodes[-1])
        opened.nodes[-1].children.append(node)
        if tag not in VOID:
            opened.push(node)
    return root


def named_role(node: Node) -> str | None:
    """The role that a class or id names, where one consists of role words and neutral ones only; None for names of articles and others.

    ``comments-list`` and ``adBox2`` name roles; ``related-work``, ``notice-board`` and ``has-sidebar`` don't, nor does ``entry-header``.
    """
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        roles = [w for w in words if w in ROLES or w.startswith(ROLE_BEGINS)]
        if roles and all(w in roles or w in NEUTRAL or w.isdigit() for w in words) and not (set(roles) <= {"header"} and ARTICLE & set(words)):
            return roles[0]
    return None


def _likely(node: Node) -> bool:
    names = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"
    return any(w.lower() in LIKELY for w in _NAME.findall(names))


def _outside(node: Node, inside: frozenset[str]) -> bool:
    """Whether an element is no part of any article by its kind, role or state; ``inside`` names the articles and mains around it."""
    a = node.attributes
    if node.tag in DROPPED or node.tag == "header" and not ("article" in inside or "main" in inside and any(isinstance(c, Node) and c.tag in HEADINGS for c in node.children)):
        return True
    return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or node.tag not in ("body", "article", "main", "html") and a.get("role", "").lower() in DROPPED_ROLES or bool(_HIDDEN.search(a.get("style", ""))))


def _drop(root: Node, gone: Callable[[Node, frozenset[str]], bool]) -> bool:
    """Take out the elements for which ``gone`` holds, given the articles and mains around them; whether there were any."""
    stack, found = [(root, frozenset())], False
    while stack:
        node, inside = stack.pop()
        if node.tag == "article" or node.tag == "main":
            inside |= {node.tag}
        below = [c for c in node.children if isinstance(c, Node)]
        kept = [c for c in below if not gone(c, inside)]
        if len(kept) < len(below):
            out = {id(c) for c in below} - {id(c) for c in kept}
            node.children = [c for c in node.children if id(c) not in out]
            found = True
        stack += [(c, inside) for c in kept]
    return found


def prune(root: Node) -> list[Node]:
    """Take out what stands outside of articles: by kind, role and state first; then forms, and elements whose name says so, unless they hold nearly
    all points of the page; last, comments of readers, whatever they hold, if any text stands outside of them. Returns the nodes, measured."""
    _drop(root, _outside)
    order = _measure(root)
    points, comments = root.points, []
    if _drop(root, lambda node, inside: _misplaced(node, points)):
        order = _measure(root)
    stack, elsewhere = [(root, frozenset())], False
    while stack:
        node, inside = stack.pop()
        if node.tag == "article" or node.tag == "main":
            inside |= {node.tag}
        elsewhere = elsewhere or any(isinstance(c, str) and c.strip() for c in node.children)
        for c in node.children:
            if isinstance(c, Node):
                if _comments(c, inside):
                    comments.append(id(c))
                else:
                    stack.append((c, inside))
    if elsewhere and comments:
        comments = set(comments)
        _drop(root, lambda node, inside: id(node) in comments)
        order = _measure(root)
    return order


def _misplaced(node: Node, points: float) -> bool:
    if node.tag in FORMS:
        return node.points <= 0.5 * points  # some pages are a single form
    if node.tag in ("body", "article", "main", "html"):
        return False
    role = named_role(node)
    return role is not None and not role.startswith("comment") and node.points <= points * MISNAMED


def _comments(node: Node, inside: frozenset[str]) -> bool:
    """Whether an element is named as comments; of articles, one inside of another or of a main."""
    if node.tag in ("body", "main", "html") or node.tag == "article" and not inside:
        return False
    return (named_role(node) or "").startswith("comment")


def _measure(root: Node) -> list[Node]:
    """Characters, commas, linked characters and points of every subtree; the nodes, each after those below it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        chars = commas = linked = 0
        points = 0.0
        for c in node.children:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
                commas += c.count(",") + c.count("、") + c.count("，") + c.count("،")
            else:
                chars, commas, linked, points = chars + c.chars, commas + c.commas, linked + c.linked, points + c.points
        node.chars, node.commas, node.linked = chars, commas, chars if node.tag == "a" else linked
        node.own = _own_points(node)
        node.points = points + node.own
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


_OWN_TEXT = frozenset("div section article main body span td center form".split())


def _own_points(node: Node) -> float:
    """Points of a paragraph: one, one for each comma, one for each 100 characters up to three, a fifth of that if it is short, times the share that
    isn't links. Containers with text of their own count as paragraphs; 0 for other elements."""
    if not node.chars or not (node.tag in PARAGRAPH or node.tag in _OWN_TEXT):
        return 0.0
    own = any(isinstance(c, str) and c.strip() for c in node.children)
    if not own and node.tag not in PARAGRAPH:
        return 0.0
    if not own and any(isinstance(c, Node) and c.tag in PARAGRAPH and c.chars for c in node.children):
        return 0.0
    return (1 + node.commas + min(node.chars // 100, 3)) * (1 if node.chars >= 25 else 0.2) * (1 - _density(node))


def _start(node: Node) -> float:
    base = {"article": 25, "main": 15, "section": 5, "div": 5, "blockquote": 3, "td": 3, "pre": 3}.get(node.tag, -3 if node.tag in ("ul", "ol", "dl", "li", "address") else 0)
    return base + (25 if _likely(node) else 0)


def best_container(order: list[Node]) -> Node:
    """Paragraphs pass points for their length and commas to their ancestors: all to the parent, half to its parent, and a third of what the one
    below has got from each further down to each above; each container's sum is discounted by the share of its text that is links. Elements and
    names of articles start with points of their own. One pass over the measured nodes, from the leaves up."""
    best, most = order[-1], None
    for node in order:
        near, far = 0.0, 0.0  # from paragraphs here, and from those further down
        for c in node.children:
            if isinstance(c, Node):
                if c.tag in PARAGRAPH:
                    near += c.own
                far += c.passed
        if node.tag not in PARAGRAPH or node.parent is None:
            near += node.own
        node.passed = near / 2 + far / 3
        if near or far:
            node.score = _start(node) + near + far
            worth = node.score * (1 - _density(node))
            if most is None or worth > most:
                best, most = node, worth
    return best


def _beside(node: Node, best: Node, article: bool) -> bool:
    """Whether a sibling of the best container, or of an ancestor inside the same article, is a part of the article. Inside an ``article`` or ``main``
    any text that isn't mostly links is; elsewhere it takes a share of the best score, a heading or a paragraph of running text."""
    dense = _density(node)
    if not node.chars:
        return False
    if article:
        return dense < 0.5 or node.tag in HEADINGS or node.tag in PARAGRAPH
    same = node.attributes.get("class") and node.attributes.get("class") == best.attributes.get("class")
    return node.score + (best.score * 0.2 if same else 0) >= max(10.0, best.score * 0.2) and dense < 0.5 or node.tag in HEADINGS or node.tag == "p" and (dense < 0.25 if node.chars > 80 else dense == 0)


def _kept(best: Node) -> list[Node | str]:
    """The best container and the parts of the same article beside it, in page order: level by level up to the outermost ``article``, or else ``main``,
    around it, or beside the container alone."""
    top, up = None, best
    while up is not None:
        if up.tag == "article" or up.tag == "main" and (top is None or top.tag == "main"):
            top = up
        up = up.parent
    before, after = [], []  # level by level, from the container outwards
    node = best
    while node.parent is not None and node is not top and node.tag not in ("body", "html"):
        article = top is not None
        at = next(i for i, c in enumerate(node.parent.children) if c is node)
        beside = lambda c: isinstance(c, Node) and _beside(c, best, article) or isinstance(c, str) and article  # noqa: B023, E731
        before.append([c for c in node.parent.children[:at] if beside(c)])
        after.append([c for c in node.parent.children[at + 1 :] if beside(c)])
        if not article:
            break
        node = node.parent
    return [*chain(*reversed(before)), best, *chain(*after)]


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks in page order, white space as single spaces. Inline elements don't part a word; blocks and ``br`` do."""
    out, held = [], []

    def end():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    for top in nodes:
        if isinstance(top, str):
            held.append(top)
            continue
        if top.tag in BLOCK:
            end()
        stack: list = [top]
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                held.append(node)
            elif node.tag == "br":
                held.append("\n")
            else:
                if node.tag in BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(node.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: see ``extract_text``."""
    if not page:
        return ""
    root = parse(page)
    return " ".join(blocks(_kept(best_container(prune(root)))))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of whole pages: page_id, url, text, n_chars (code points); a row for each row.

    The article without menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers and
    markup; character references decoded, white space (Unicode's, as ``str.split`` has it) inside a block as one space, blocks joined by a
    space in page order. Only elements outside of articles by kind, role or state go before points are counted; a form, or an element whose class
    or id names such a thing, stays if it holds nearly all points of the page. Elements named as comments go whatever they hold, unless no text is left
    outside of them. Pages of any depth and with any tags take time in proportion to their length. A null or empty page, or one without text, gives an empty
    text. A page without an article gives what scores best, at least the body.
    Null and repeated ids return as they are; other columns are ignored.
    """
    rows = own_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
