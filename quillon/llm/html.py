"""Main text of web pages by tree scoring.

A page becomes a tree; menus, page headers and footers, side bars, notices, adverts, forms, comments and code are cut off. What a
block is called counts only if its whole class or id is made of such words; headings and paragraphs are never judged by it, and
words that texts use as well (discussion, related, comment) need a second sign: links, form controls, writers and dates.
Each paragraph passes points for its length and commas to its ancestors, all to the parent, half to the grandparent, less
further up, discounted by the share of its text that stands in links. The container with the most points, discounted by its
own link density, is kept, with siblings that score well or are parts of the same divided text, here and further up; an
enclosing ``article`` or ``main`` element counts as container.

Null and empty pages have an empty text. Pages are parsed whole, however long or deep (no recursion). Truncated pages and
unclosed tags are parsed as far as they go. Pages without a scored paragraph fall back to what is left of the body.
Of containers with equal points the first counts. Repeated rows are extracted each by itself; an empty table gives an empty
result; extra columns pass through, but for one named like the output, which is replaced.
"""

from __future__ import annotations

import html as references
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quillon.llm.common import small_batches

TAG = re.compile(r"<!--(?s:.*?)(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BETWEEN = {"pre", "blockquote", "table", "ul", "ol", "dl", "p", "figure", "math"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes if it is open, and the element that shields it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"})}
#: Elements that never hold main text.
NEVER = set("aside audio button canvas dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title video".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Whole classes and ids that mark what isn't main text, wherever a block has them.
PLAIN = set("""ad ads adbox adslot advert adverts advertisement advertising adsense breadcrumb breadcrumbs byads comments commentlist consent
    cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter outbrain overlay pager pagination popup promo share sharing
    sidebar signup snackbar sponsor sponsored subscribe taboola toast toolbar topbar""".split())
#: Those that also name parts of texts: in a text, a block with one goes if there is another sign.
VAGUE = set("""aside banner comment copyright discussion form header login modal notice notices notification promoted promotion recommend recommended
    related replies reply respond responses search social subscription widget""".split())
#: Words that stand beside marks in compounds, such as site-header or comment-list-2.
FILLER = set("""and area bar block bottom box btn button buttons col column container content desktop entry global group inner inline item items left
    line link links list main mobile outer page panel post primary right row secondary section site slot small the thread top unit wide wrap wrapper""".split())
#: Compounds of menu words, such as mainnav or sidebarlinks.
MENU = re.compile(r"(?:top|main|site|sub|side|foot|left|right|bottom|header|footer|global|primary|secondary|page)?(?:nav|navi|navbar|navigation|menu|sidebar)(?:links?|list|items?|bar|box)?")
#: Words of wrappers around the whole page, whose other words say what they hold beside the text (page-with-sidebar).
WRAPS = set("container content has layout main no page post wrapper wrap with without".split())
#: Elements that are text by themselves: headings, paragraphs and the like aren't judged by what they are called.
TEXT = HEADINGS | set("p blockquote pre table tbody tr td th figure figcaption em strong b i span a code li dt dd body html".split())
#: Who wrote a contribution of readers, and when.
WRITER, WHEN = set("author avatar by byline commenter name nick nickname poster user username vcard".split()), set("ago date datetime posted time timestamp when".split())


def marks(names: list[str]) -> tuple[bool, bool]:
    """Whether a class or id marks a block for certain, or perhaps. All words of a compound must be marks or fillers."""
    sure = vague = False
    for name in names:
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x]
        own = [x for x in parts if x in PLAIN or x in VAGUE or MENU.fullmatch(x)]
        if own and all(x in own or x in FILLER for x in parts):
            certain = any(x in PLAIN or MENU.fullmatch(x) for x in own)
            sure, vague = sure or certain, vague or not certain
    return sure, vague


class Node:
    __slots__ = ("above", "below", "doubtful", "kind", "letters", "linked", "name", "points", "role", "sure", "tokens", "useless", "vague")

    def __init__(self, name: str, above: Node | None, text: str = ""):
        self.name, self.above, self.below = name, above, []
        self.points, self.letters, self.linked, self.useless, self.doubtful = 0.0, 0, 0, False, False
        self.tokens, self.role, self.kind, self.sure, self.vague = set(), "", "", False, False
        if text:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}
            self.kind = found.get("class", "")
            names = self.kind.split() + found.get("id", "").split()
            self.tokens = {x for x in re.split(r"[^a-z0-9]+", " ".join(names).lower()) if x}
            if name not in TEXT:
                self.sure, self.vague = marks(names)
            elif name in ("p", "li", "table", "span", "figure"):
                self.sure = marks(self.kind.split())[0]
            self.role = found.get("role", "").lower()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
            self.useless = bool(hidden)


def parse(page: str) -> Node:
    """The page's tree; text stands in ``below`` as strings, with character references decoded."""
    root = here = Node("html", None)
    opened: dict[str, int] = {}
    at = 0

    def close(upto: Node) -> Node:
        node = here
        while True:
            opened[node.name] -= 1
            if node is upto:
                return node.above
            node = node.above

    def nearest(names: set[str], shields: set[str]) -> Node | None:
        if not any(opened.get(n) for n in names):
            return None
        node = here
        while node is not root:
            if node.name in names:
                return node
            if node.name in shields:
                return None
            node = node.above
        return None

    for m in TAG.finditer(page):
        if m.start() < at:  # inside an element of raw text
            continue
        if m.start() > at:
            here.below.append(references.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if node := nearest({name}, set()):
                here = close(node)
            continue
        if name in BLOCK and (node := nearest({"p"}, {"td", "th", "table", "button"})):
            here = close(node)
        if name in CLOSES and (node := nearest(*CLOSES[name])):
            while node is not None:
                here = close(node)
                node = nearest(*CLOSES[name])
        if name in ("html", "body") and opened.get(name):
            continue
        node = Node(name, here, m[3] or "")
        here.below.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (m[3] or "").endswith("/") or name in BLOCK and name not in VOID:
            here, opened[name] = node, opened.get(name, 0) + 1
    if at < len(page):
        here.below.append(references.unescape(page[at:]))
    return root


def ordered(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, wait = [], [root]
    while wait:
        node = wait.pop()
        out.append(node)
        wait += [x for x in reversed(node.below) if isinstance(x, Node)]
    return out


def prune(nodes: list[Node]) -> None:
    """Mark what isn't main text. A class or id doesn't cut off the elements that hold an article, main part or most of the text; a vague one only with another sign."""
    holders, seen = set(), set()
    raw, linked, parts = {}, {}, {}  # letters, letters in links, and the form controls and writers below a node
    for node in reversed(nodes):
        own = raw.get(id(node), 0) + sum(len(x.strip()) for x in node.below if isinstance(x, str))
        raw[id(node)] = own
        inside = linked[id(node)] = own if node.name == "a" else linked.get(id(node), 0)
        signs = parts.get(id(node), (0, 0, 0))
        signs = (signs[0] + (node.name in ("input", "textarea", "select", "button", "form")), signs[1] + bool(node.tokens & WRITER), signs[2] + (node.name == "time" or bool(node.tokens & WHEN)))
        parts[id(node)] = signs
        if node.above is not None:
            up = id(node.above)
            raw[up], linked[up] = raw.get(up, 0) + own, linked.get(up, 0) + inside
            parts[up] = tuple(x + y for x, y in zip(parts.get(up, (0, 0, 0)), signs))
    most = raw[id(nodes[0])] / 2
    for node in nodes:
        if node.tokens & WRAPS and raw[id(node)] > most:
            holders.add(id(node))
        if node.name in ("article", "main") or node.role in ("article", "main"):
            up = node.above
            while up is not None and id(up) not in seen:
                seen.add(id(up))
                up = up.above
    holders |= seen
    inside: set[int] = set()  # nodes within an article or main part
    for node in nodes:
        if node.above is not None and (id(node.above) in inside or node.above.name in ("article", "main")):
            inside.add(id(node))
        if node.above is not None:
            node.useless = node.useless or node.above.useless
            node.doubtful = node.above.doubtful
        if node.useless:
            continue
        wraps = node.name == "form" and (id(node) in holders or raw[id(node)] > most)  # a form around the whole page
        if node.name in NEVER and not wraps or node.role in ROLES or node.name == "header" and id(node) not in inside:
            node.useless = True
            continue
        outer = (node.name in ("article", "main") or node.role in ("article", "main")) and id(node) not in inside
        if (not node.sure and not node.vague) or id(node) in holders or outer and raw[id(node)] > most:
            continue
        letters, controls, writers, times = raw[id(node)], *parts[id(node)]
        told = linked[id(node)] > 0.4 * letters or controls > 0 or min(writers, times) > 0 or max(writers, times) > 1
        told = told or "copyright" in node.tokens and letters < 300 or alike(node) or not letters
        node.useless = node.sure and not outer or told
        node.doubtful = node.doubtful or node.vague


def alike(node: Node) -> bool:
    """Whether most of what a block holds are marked blocks, as a list of comments does."""
    below = [x for x in node.below if isinstance(x, Node) and x.name not in HEADINGS]
    while len(below) == 1 and below[0].name in ("ul", "ol", "div", "section") and not below[0].vague:
        below = [x for x in below[0].below if isinstance(x, Node)]
    return sum(x.vague or x.sure or (x.name == "li" and any(marks(x.kind.split()))) for x in below) > max(0, len(below) / 2 - 0.5)


def weigh(nodes: list[Node]) -> None:
    """Letters and linked letters of each node, from the leaves up, and the points of paragraphs, passed to ancestors."""
    for node in reversed(nodes):
        if node.useless:
            continue
        own = sum(len(x.strip()) for x in node.below if isinstance(x, str))
        node.letters += own
        if node.name == "a":
            node.linked = node.letters
        if node.above is not None:
            node.above.letters += node.letters
            node.above.linked += node.linked
    for node in nodes:
        if node.useless or node.above is None or not node.letters:
            continue
        direct = "".join(x for x in node.below if isinstance(x, str)).strip()
        if node.name not in ("p", "pre", "td", "blockquote") and not (node.name in BLOCK and node.name not in HEADINGS and len(direct) >= 25):
            continue
        text = direct + "".join(y for x in node.below if isinstance(x, Node) and x.name not in BLOCK for y in x.below if isinstance(y, str))
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - node.linked / node.letters)
        up, share = node.above, 1.0
        for level in range(6):
            if up is None:
                break
            up.points += points * share
            up, share = up.above, 0.5 if not level else 1 / (3 * (level + 1))


def density(node: Node) -> float:
    return node.linked / node.letters if node.letters else 0.0


def prose(node: Node) -> bool:
    """Whether a block looks like a part of a text: paragraphs that have points, few links, and some length or a heading."""
    if node.useless or node.doubtful or not node.letters or density(node) >= 0.25:
        return False
    return node.points > 0 and (node.letters > 80 or any(x.name in HEADINGS for x in node.below if isinstance(x, Node)))


def siblings(node: Node, least: float, first: bool) -> list[Node | str]:
    """What stays of the children of ``node``'s parent: the node, siblings that score well, and parts of the same divided text."""
    below, kept = node.above.below, []
    for at, x in enumerate(below):
        if x is node:
            kept.append(at)
        elif isinstance(x, Node) and not x.useless and not x.doubtful and x.letters and density(x) < 0.25:
            strong = x.points * (1 - density(x)) >= least
            part = x.name == node.name and x.kind == node.kind and x.name in ("div", "section") and (x.kind != "" or prose(x))
            if node.name == "article":
                fits = strong or x.name == "article" and part
            else:
                fits = strong or part or first and (x.name in HEADINGS or x.name == "p" and (x.letters > 80 or not x.linked) or x.name in ("div", "section") and prose(x))
            if fits:
                kept.append(at)
    # between kept siblings, blocks that score nothing by themselves (code, quotations, tables, lists, headings) belong to the text
    out = []
    for at in range(kept[0], kept[-1] + 1):
        x = below[at]
        if at in kept or isinstance(x, Node) and (x.name in BETWEEN or x.name in HEADINGS) and not x.useless and not x.doubtful and density(x) < 0.25:
            out.append(x)
    return out


def chosen(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container and the siblings to keep, in page order."""
    scored = [n for n in nodes if not n.useless and n.points > 0]
    best = max([n for n in scored if not n.doubtful] or scored, key=lambda n: n.points * (1 - density(n)), default=None)
    if best is None:
        for name in ("article", "main", "body"):
            if found := next((n for n in nodes if n.name == name and not n.useless), None):
                return [found]
        return [root]
    node = best
    while node is not None and node.name not in ("article", "main") and node.role not in ("article", "main"):
        node = node.above
    best = node or best
    if best.above is None or best.name in ("body", "main"):
        return [best]
    least = max(2.0, 0.2 * best.points * (1 - density(best)))
    kept = siblings(best, least, True)
    # a text that is divided further up goes on in the siblings of what holds it
    while best.name != "article" and best.above.name not in ("body", "html", "article", "main") and best.above.above is not None:
        best = best.above
        more = siblings(best, least, False)
        at = next(n for n, x in enumerate(more) if x is best)
        kept = more[:at] + kept + more[at + 1 :]
    return kept


def blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space folded, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    wait: list = [x for top in reversed(tops) for x in (None, top)]
    while wait:
        x = wait.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.useless:
            if x.name in ("br", "wbr"):
                line.append(" " if x.name == "br" else "")
            elif x.name in BLOCK:
                end()
                wait.append(None)
            wait += reversed(x.below)
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    nodes = ordered(root)
    prune(nodes)
    weigh(nodes)
    return "\n".join(blocks(chosen(root, nodes)))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each page; pages never leave their row."""
    small_batches(pages.sparkSession)

    @pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.withColumn(text, texts(F.coalesce(F.col(html).cast("string"), F.lit(""))))
