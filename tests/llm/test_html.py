"""Main text: no text is lost by what it is called, divided texts stay whole, and an independent scorer agrees."""

import re
from html.parser import HTMLParser

import pytest

from quillon.llm import html

LONG = "A paragraph, with some commas, that goes on for long enough to be scored as the text of a page."
SHORT = "A short one."


def test_names_of_headings_and_sections_lose_no_text():
    page = f"""<body><article><h1>Trees</h1><p>{LONG}</p><h2 id="related-work">Related work</h2><p>{LONG} 2</p>
        <section id="discussion"><h2>Discussion</h2><p>{LONG} 3</p></section><h2 id="search-trees">Search trees</h2><p id="copyright-law">{LONG} 4</p>
        <p class="comment-on-text">{SHORT}</p><h2 id="notice-period">Notice period</h2><section class="related-work"><p>{SHORT} 5</p></section></article></body>"""
    want = ["Trees", LONG, "Related work", f"{LONG} 2", "Discussion", f"{LONG} 3", "Search trees", f"{LONG} 4", SHORT, "Notice period", f"{SHORT} 5"]
    assert html.main_text(page).split("\n") == want
    assert html.main_text(page.replace("article>", "div>")).split("\n") == want
    assert html.main_text(page.replace("<article>", "<main>").replace("</article>", "</main>")).split("\n") == want


@pytest.mark.parametrize("junk", [
    '<div class="ad">Buy, buy, buy!</div>', '<div class="ad-banner"><p>Buy, buy!</p></div>', '<div id="cookie-notice">We use cookies, really.</div>', '<ul class="share-buttons"><li>Share</li></ul>',
    '<section class="comments"><h3>Comments</h3><p>I disagree, as a reader, with all of it.</p></section>', '<div id="discussion"><form><textarea></textarea></form><p>Say something.</p></div>',
    '<div class="comment"><span class="author">Ann</span> <time>today</time><p>I disagree, as a reader, with all of it.</p></div>',
    '<section class="discussion"><div class="comment"><p>I disagree.</p></div><div class="comment"><p>I agree.</p></div></section>',
    '<div class="related"><h3>Related</h3><ul><li><a href="/a">One more text</a></li><li><a href="/b">And another one</a></li></ul></div>', '<div class="newsletter-signup">Sign up.</div>',
    '<article class="comment"><b class="user">Bo</b><span class="date">May</span><p>Nice, as ever, and a bit long.</p></article>', '<nav>Menu</nav>', '<aside>Beside</aside>', '<div class="copyright">(c) somebody</div>',
    '<div hidden>Hidden, and not for readers.</div>', '<form><p>Your name</p><input></form>', '<p class="advert">Buy this, and that.</p>', '<div class="sidebarLinks"><p>Elsewhere</p></div>',
])
def test_what_is_named_goes_inside_a_text(junk):
    inner = f"<h1>Title</h1><p>{LONG}</p>{junk}<p>{LONG} 2</p>"
    for page in (f"<article>{inner}</article>", f"<body><div>{inner}</div></body>", f"<body><main>{inner}</main></body>", f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG} 2</p>{junk}</article></body>"):
        assert html.main_text(page).split("\n") == ["Title", LONG, f"{LONG} 2"], page


def test_divided_texts_stay_whole():
    menu = '<div class="top"><a href="/">Home</a> <a href="/b">News</a></div>'
    foot = '<div class="bottom"><a href="/x">Terms</a></div>'
    parts = f'<div class="part"><p>{LONG}</p><p>{LONG} 2</p></div><div class="part"><p>{SHORT}</p></div><div class="part"><h2>Head</h2><p>{LONG} 3</p></div>'
    want = [LONG, f"{LONG} 2", SHORT, "Head", f"{LONG} 3"]
    assert html.main_text(f"<body>{menu}{parts}{foot}</body>").split("\n") == want
    assert html.main_text(f"<body>{menu}<div id=page>{parts}</div>{foot}</body>").split("\n") == want
    nested = re.sub(r'<div class="part">(.*?)</div>', r'<div class="row"><div class="col">\1</div></div>', parts)
    assert html.main_text(f"<body>{menu}<div id=page>{nested}</div>{foot}</body>").split("\n") == want
    named = f'<div class="intro"><p>{LONG}</p></div><div class="text"><p>{LONG} 2</p><p>{LONG} 3</p></div><div class="end"><h2>End</h2><p>{SHORT}</p></div>'
    assert html.main_text(f"<body>{menu}<div>{named}</div>{foot}</body>").split("\n") == [LONG, f"{LONG} 2", f"{LONG} 3", "End", SHORT]


class Tree(HTMLParser):
    """A plain tree of lists: [name, parent, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = ["root", None, []]

    def handle_starttag(self, tag, attrs):
        node = self.here
        if tag in ("p", "div", "h1", "ul", "li", "nav", "footer"):
            at = node
            while at is not None and at[0] not in ("p", "div"):
                at = at[1]
            node = at[1] if at is not None and at[0] == "p" else node
        new = [tag, node, []]
        node[2].append(new)
        self.here = node if tag in ("br", "meta") else new

    def handle_endtag(self, tag):
        at = self.here
        while at is not None and at[0] != tag:
            at = at[1]
        if at is not None:
            self.here = at[1]

    def handle_data(self, data):
        self.here[2].append(data)


GONE = ("script", "style", "title", "nav", "footer", "head")


def letters(node, linked=False):
    """Letters of a node, or those in links."""
    if isinstance(node, str):
        return 0 if linked else len(node.strip())
    return 0 if node[0] in GONE else sum(letters(x, linked and node[0] != "a") for x in node[2])


def text_of(node):
    return node if isinstance(node, str) else "" if node[0] in GONE else " " if node[0] == "br" else "".join(map(text_of, node[2]))


def score(node, found):
    """Points of a node from the paragraphs below it, by recursion: all of a paragraph's points to its parent, half of them to the next."""
    own = 0.0
    if isinstance(node, str) or node[0] in GONE:
        return []
    passed = []
    for x in node[2]:
        passed += score(x, found)
    own = sum(p * (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12, 1 / 15)[level] for p, level in passed if level < 6)
    size = letters(node)
    found.append((own * (1 - letters(node, True) / size) if size else 0.0, len(found), node))
    onward = [(p, level + 1) for p, level in passed]
    if node[0] == "p" and size:
        whole = text_of(node).strip()
        onward.append(((1 + whole.count(",") + min(len(whole) / 100, 3)) * (1 - letters(node, True) / size), 0))
    return onward


def lines(node, out):
    for x in node[2]:
        if isinstance(x, str):
            out[-1] += x
        elif x[0] == "br":
            out[-1] += " "
        elif x[0] in ("p", "h1", "div", "li", "ul"):
            out.append("")
            lines(x, out)
            out.append("")
        elif x[0] not in GONE:
            lines(x, out)
    return out


def test_pages_without_article_equal_a_recursive_scorer():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        page = re.sub("(</?)article>", r"\1div>", page)
        tree, found = Tree(), []
        tree.feed(page)
        tree.close()
        score(tree.root, found)
        best = max(found, key=lambda x: (x[0], -x[1]))[2]
        want = [" ".join(x.split()) for x in lines(best, [""])]
        assert html.main_text(page) == "\n".join(x for x in want if x)
