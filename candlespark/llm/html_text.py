"""Main text of web pages by tree scoring.

A tolerant sweep over the markup builds a tree of block elements; inline tags
only tell link text from other text.  Every paragraph passes points for its
length and its commas to its parent, half of them to the grandparent and a
third to the next; a container's points are discounted by its share of link
text.  The best container and those of its siblings that look like prose are
kept.  Menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles, hidden parts and reader comments are cut beforehand, by
element, role, or the words of class and id.  A part is cut by a name only if
all words of the name are unwanted and it holds no article, or if it holds
neither an article nor a paragraph; otherwise the name discounts its points.
Pages that are left with little text, or an article with only its headings,
are scored again without cuts by name.
Inside an article nothing is dropped for being links.

Pages are independent, so the job is one map over the table; a page is held
whole by one task and nothing else is.

Defined results: null, empty and markup-only html give an empty text with
``n_chars`` 0; ties between containers go to the first in page order; repeated
rows are extracted row by row; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from candlespark.llm.common import shipped

# Element names of the HTML standard by how they are treated here.
RAW = "script style noscript template textarea title svg math iframe object canvas audio video select".split()
CUT = frozenset("head nav aside footer form button dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open elements of these names, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCE = frozenset("ul ol dl table article section main div body html aside nav".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that mark parts which are not the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs "
    "comment comments disqus respond replies reply discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login footer foot masthead menu menus nav navbar navigation navigator pager pagination related recommended "
    "recommendations share sharing social sidebar rail skip toolbar widget widgets hidden topbar".split()
)
#: Words that add nothing to the others of a name, and words of names that the article bears.
PLAIN = frozenset("area bar block bottom box button buttons container form group icon icons inner item items left link links list outer panel right row slot top wrap wrapper".split())
ARTICLE = frozenset("article body content entry main page post story".split())
#: Unwanted words that are titles of ordinary sections as well.
TOPICS = frozenset("advertising alert banner cookies discussion menu menus navigation notice notices promotion recommendations related share sharing social".split())
#: Elements of single texts, which only a name that is unwanted as a whole cuts.
SINGLE = frozenset("p pre li dt dd tr td th caption figcaption blockquote".split()) | HEADINGS
LONG = 25  #: characters of a text that counts as a paragraph
LITTLE = 250  #: a page that is left with less is scored again

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    items: list = field(default_factory=list)  #: blocks of text and nodes, in page order
    doubt: int = 0  #: by class and id: 0 none, 1 some words are unwanted, 2 all words of a name
    trust: float = 1.0  #: what doubts of it and the nodes around leave of its points
    prose: bool = False  #: whether a paragraph, an article, a long text or link is below
    article: bool = False
    long: bool = False
    points: float = 0.0
    length: int = 0  #: characters of text below, and of link text
    linked: int = 0


@dataclass(eq=False)
class Text:
    text: str
    linked: int
    links: int = 0

    def long(self) -> bool:
        """Whether it says more than a list of short links."""
        return len(self.text) - self.linked >= LONG or self.links > 0 and self.linked >= LONG * self.links


def unwanted(tag: str, attrs: str) -> bool:
    """Whether an element is cut by its name, role or visibility."""
    if tag in CUT:
        return True
    if not attrs:
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and NO_SHOW.search(value):
            return True
    return False


def doubted(tag: str, attrs: str) -> int:
    """0 to 2 as in ``Node.doubt``.  The id of a heading is an anchor; so may be that of a section."""
    if not attrs or tag in ("html", "body", "main"):
        return 0
    names = []
    for kind, value in ATTRIBUTE.findall(attrs):
        kind = kind.lower()
        if kind == "class" or kind == "id" and tag not in HEADINGS:
            names += [(kind, set(WORD.findall(CAMEL.sub("-", x).lower()))) for x in value.strip("\"'").split()]
    bad = [(kind, words) for kind, words in names if not UNWANTED.isdisjoint(words)]
    if not bad or any(words <= ARTICLE | PLAIN and not ARTICLE.isdisjoint(words) for _, words in names):
        return 0
    section = tag == "section" or any("section" in words for _, words in names)
    for kind, words in bad:
        if words <= UNWANTED | PLAIN and not (section and kind == "id" and words <= TOPICS | PLAIN):
            return 2
    return 0 if tag in SINGLE or section and all(kind == "id" and words.isdisjoint(UNWANTED - TOPICS) for kind, words in bad) else 1


class Tree:
    """Builds the tree of blocks in one sweep."""

    def __init__(self, page: str, by_name: bool = True):
        self.root = self.node = Node("html", None)
        self.by_name = by_name  #: whether inline parts are cut by class and id
        self.pieces: list[str] = []
        self.links = self.linked = self.anchors = 0
        self.skip: list[str] = []  #: open elements below the one that is cut, itself first
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at and not self.skip:
                self.say(page[at : m.start()])
            at = m.end()
            tag = m.group("tag")
            if m.group("raw"):
                self.say(" ")
            elif tag:
                self.tag(tag.lower(), bool(m.group("close")), m.group("attrs"))
        if not self.skip:
            self.say(page[at:])
        self.flush()

    def say(self, text: str) -> None:
        self.pieces.append(text)
        if self.links:
            self.linked += len(text)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.node.items.append(Text(text, min(self.linked, len(text)), self.anchors))
            self.pieces, self.linked, self.anchors = [], 0, 0

    def tag(self, tag: str, close: bool, attrs: str) -> None:
        if self.skip:
            if close:
                if tag in self.skip:
                    while self.skip.pop() != tag:
                        pass
                elif tag in ("article", "main", "body"):
                    self.skip.clear()  # a part that was never closed ends with its container
                    self.close(tag)
            elif tag in ("article", "main") and self.skip[0] in ("nav", "head", "footer", "form"):
                self.skip.clear()
                self.open(tag, attrs)
            elif tag == "body" and self.skip[0] == "head":
                self.skip.clear()
                self.open(tag, attrs)
            elif tag in BLOCK and tag not in ("p", "li") and not attrs.endswith("/"):
                self.skip.append(tag)
            return
        if tag not in BLOCK:
            if not close and tag in ("span", "a", "img", "ins") and tag not in VOID and attrs and (unwanted(tag, attrs) or self.by_name and doubted(tag, attrs) == 2):
                self.skip = [tag]
                self.say(" ")
            elif tag == "a":
                self.links = max(0, self.links + (-1 if close else 1))
                self.anchors += not close
            elif tag == "br" or tag in VOID:
                self.say(" ")
            return
        if close:
            self.close(tag)
        elif unwanted(tag, attrs) or tag == "header" and not inside(self.node, "article", "main"):
            self.flush()
            if tag == "p" or self.node.tag == "p":
                self.close("p")
            if not attrs.endswith("/"):
                self.skip = [tag]
        else:
            self.open(tag, attrs)

    def open(self, tag: str, attrs: str = "") -> None:
        self.flush()
        self.links = 0
        if self.node.tag == "p" or self.node.tag in HEADINGS:
            self.node = self.node.parent
        ends, node = ENDS.get(tag, ()), self.node
        while ends and node.parent and node.tag not in FENCE:
            if node.tag in ends:
                self.node = node.parent
                break
            node = node.parent
        if tag in ("html", "body") and self.node is self.root:
            return
        self.node.items.append(child := Node(tag, self.node, doubt=doubted(tag, attrs)))
        self.node = child

    def close(self, tag: str) -> None:
        self.flush()
        self.links = 0
        node = self.node
        while node.parent and node.tag != tag:
            if tag in ("p", "li", *HEADINGS) and node.tag in FENCE:
                return
            node = node.parent
        if node.parent:
            self.node = node.parent


def below(node: Node) -> list[Node]:
    """The node and all below it, parents before children."""
    nodes, stack = [], [node]
    while stack:
        nodes.append(top := stack.pop())
        stack.extend(x for x in reversed(top.items) if isinstance(x, Node))
    return nodes


def weeded(root: Node, by_name: bool) -> int:
    """Cuts the parts that their names and contents speak against; how many characters were cut."""
    gone, cut = 0, set()
    nodes = below(root)
    size = dict.fromkeys(nodes, 0) if by_name else {}
    for n in reversed(nodes):
        for x in n.items:
            if isinstance(x, Text):
                n.long = n.long or x.long()
                n.prose = n.prose or n.tag not in HEADINGS and len(x.text) >= LONG and 2 * x.linked < len(x.text)
        if by_name:
            size[n] += sum(len(x.text) for x in n.items if isinstance(x, Text))
        n.article = n.article or n.tag == "main" or n.tag == "article" and not n.doubt
        up = n.parent
        if by_name and up and n.doubt and not n.article and (n.doubt == 2 or not n.prose):
            cut.add(n)
            gone += size[n]
        elif up:
            up.long, up.prose, up.article = up.long or n.long, up.prose or n.prose, up.article or n.article
            if by_name:
                size[up] += size[n]
    for up in {n.parent for n in cut}:
        up.items = [x for x in up.items if x not in cut]
    return gone


def inside(node: Node | None, *tags: str) -> bool:
    while node:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def measured(node: Node, nodes: list[Node]) -> None:
    """Lengths below every node, and the points of its paragraphs; parents come before children in ``nodes``."""
    nodes += below(node)
    for n in nodes:
        around = n.parent.trust if n.parent and n.tag not in ("article", "main") else 1.0
        n.trust = around / (1, 2, 4)[n.doubt]
    for n in reversed(nodes):
        own = [x for x in n.items if isinstance(x, Text)]
        n.length += sum(len(x.text) for x in own)
        n.linked += sum(x.linked for x in own)
        for x in own:
            if len(x.text) >= LONG and n.tag not in HEADINGS:
                gift = (1 + x.text.count(",") + min(len(x.text) / 100, 3)) * (1 - x.linked / len(x.text))
                to, share = n.parent if n.tag in ("p", "pre", "li", "td", "blockquote") and n.parent else n, 1
                while to and share <= 3:
                    to.points += gift / share
                    to, share = to.parent, share + 1
        if n.parent:
            n.parent.length += n.length
            n.parent.linked += n.linked


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def prose(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container belongs to the text; beside an article only another article does."""
    if best.tag in ("article", "main") and node.tag != best.tag or node.doubt == 2:
        return False
    if node.tag in HEADINGS:
        return node.length > 0
    if node.points * (1 - density(node)) * node.trust >= max(10, 0.2 * best.points * best.trust):
        return True
    return node.tag == "p" and density(node) < 0.25 and (node.length > 80 or density(node) == 0 and node.length > 0)


def kept_text(node: Node, out: list[str]) -> None:
    """The blocks below ``node``; outside an article without menus, that is, parts of mostly links with short texts only."""
    stack = list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, Text):
            out.append(x.text)
        elif node.tag == "article" or x.long or not (x.tag in ("ul", "ol", "dl", "table", "div", "section") and x.length and density(x) > 0.6):
            stack.extend(reversed(x.items))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = Tree(page).root
    gone = weeded(root, True)
    text, best = best_text(root)
    framed = best.tag in ("article", "main")
    if len(text) < min(LITTLE, gone) and not (framed and says(best)):
        root = Tree(page, False).root
        weeded(root, False)
        text = max(text, best_text(root, framed)[0], key=len)
    return text


def says(node: Node) -> bool:
    """Whether there is text besides headings."""
    return any(isinstance(x, Text) for n in below(node) if n.tag not in HEADINGS for x in n.items)


def best_text(root: Node, framed: bool = False) -> tuple[str, Node]:
    """The text of the best container, if ``framed`` of the best in an article, and the container."""
    nodes: list[Node] = []
    measured(root, nodes)
    best, most = None, 0.0
    for n in nodes:
        value = n.points * (1 - density(n)) * n.trust
        if value > most and n.tag not in ("p", "li", "tr", "td") and (not framed or inside(n, "article", "main")):
            best, most = n, value
    if best is None:
        best = next((n for n in nodes if n.tag in ("article", "main") and n.length), root)
    up = best
    while up:  # the article around the best part, if there is one
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    out: list[str] = []
    for x in best.parent.items if best.parent else [best]:
        if x is best or isinstance(x, Node) and prose(x, best):
            kept_text(x, out)
    return "\n\n".join(out), best


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""

    def texts(batches):
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column("html")]
            ids = batch.column("page_id").cast(pa.int64())
            size = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column("url").cast(pa.string()), pa.array(found, pa.string()), size], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


shipped(__name__)
