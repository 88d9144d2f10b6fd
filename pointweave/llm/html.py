"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of the blocks
before and after it, and what its enclosing elements announce: the landmark elements of HTML and the words in class, id
and role attributes. A decision tree, trained when first used on the small labelled tables below, says which blocks are
content: it looks at link density first, takes what elements announce next, and where they announce nothing decides by
words and links of the block and its neighbours. A page without landmarks and class names thus keeps its article and
loses its link lists; a short notice or footer line without a link looks like text there, and stays. Scripts, styles, forms, comments and other parts that never show as text are no blocks.

Character references are decoded, white space inside a block becomes one space, and the blocks that are content are
joined in page order by one line end. Null html counts as empty and gives the empty text. Markup that is cut off or
never closed is read as far as it goes: an unclosed paragraph ends at the next block, an unfinished tag at the end of
the page is dropped; a quote inside an unquoted attribute value is part of it. Nothing is dropped or capped for its
length or depth, and the work is linear in the page. Other columns are carried as asked for; equal rows give equal rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import session, ship

#: Elements without text of the page, with all they hold.
HIDDEN = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "head", "title", "select", "textarea", "button", "canvas", "audio", "video"}
#: Elements whose content is not markup: only their own end tag ends them.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Elements that begin and end a block.
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that announce content or the lack of it.
LANDMARKS = {"nav": -1, "footer": -1, "aside": -1, "form": -1, "menu": -1, "dialog": -1, "search": -1, "header": -1, "article": 1, "main": 1}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|contact|cookies?|copyright|disclaimer|footer|gdpr|header|legal|login|masthead|menu\w*|"
    r"modal|nav\w*|newsletter|notices?|pager|pagination|popup|privacy|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar\w*|signup|social|sponsor\w*|"
    r"subscribe|tags|toolbar|topbar|widgets?)(?:$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article(?:[\s_-]?(?:body|content|text))?|content|entry|main|post(?:[\s_-]?(?:body|content))?|story)(?:$|[\s_-])", re.I)
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}

#: Parts of class lists that tell of a page's make-up or of a post's subject, not of the element itself.
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|tag|category)-\S+", re.I)

#: An attribute's value: quotes count only right after the equals sign, as in HTML.
_VALUE = r"""=\s*(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]|{_VALUE})*+(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))""")
_SAYING = {"class", "id", "role", "itemprop"}
_SPACE = re.compile(r"\s+")
#: Elements that an open paragraph can hold; elements whose start ends others of their kind.
INLINE = set("a abbr b big cite code em font i label mark q s small span strong sub sup tt u".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Labelled blocks: words, link density, words and link density of the block before, of the block after, what the
#: enclosing elements announce (-1 no content, 0 nothing, 1 content), heading (1) or not, and whether it is content.
LABELLED = """
1 1.0 0 0.0 1 1.0 -1 0 0
1 1.0 1 1.0 1 1.0 -1 0 0
2 1.0 1 1.0 1 1.0 -1 0 0
1 1.0 1 1.0 8 0.0 -1 0 0
3 1.0 2 1.0 12 0.0 -1 0 0
8 0.0 1 1.0 9 0.0 -1 0 0
10 0.0 1 1.0 10 0.0 -1 0 0
7 0.0 0 0.0 11 0.0 -1 0 0
30 0.0 1 1.0 9 0.0 -1 0 0
45 0.0 6 0.0 80 0.0 -1 0 0
14 0.1 120 0.0 0 0.0 -1 0 0
12 0.0 60 0.0 0 0.0 -1 0 0
9 0.0 6 0.0 0 0.0 -1 0 0
70 0.0 12 0.0 0 0.0 -1 0 0
120 0.02 90 0.0 40 0.0 -1 0 0
25 0.4 40 0.0 25 0.4 -1 0 0
4 0.0 0 0.0 3 0.0 -1 1 0
6 0.0 50 0.0 30 0.0 -1 1 0
9 0.0 8 0.0 10 0.0 1 1 1
3 0.0 12 0.0 1 0.0 1 1 1
11 0.0 9 0.0 20 0.0 1 0 1
1 0.0 9 0.0 30 0.0 1 0 1
2 0.0 40 0.0 60 0.0 1 0 1
5 0.0 70 0.0 12 0.0 1 0 1
60 0.0 11 0.0 90 0.0 1 0 1
90 0.05 60 0.0 3 0.0 1 0 1
300 0.01 90 0.0 12 0.0 1 0 1
25 0.3 80 0.0 40 0.1 1 0 1
12 0.45 60 0.0 30 0.0 1 0 1
7 0.0 1 0.0 9 0.0 1 0 1
40 0.0 7 0.0 12 0.0 1 0 1
15 0.0 0 0.0 0 0.0 1 0 1
1 1.0 60 0.0 40 0.0 1 0 1
6 1.0 70 0.0 50 0.0 1 0 1
4 1.0 3 1.0 5 1.0 1 0 0
2 1.0 80 0.0 2 1.0 1 0 0
60 0.0 50 0.0 40 0.0 0 0 1
35 0.05 9 0.0 60 0.0 0 0 1
120 0.0 20 0.0 15 0.0 0 0 1
22 0.0 70 0.0 30 0.0 0 0 1
12 0.0 60 0.0 80 0.0 0 0 1
10 0.0 40 0.0 45 0.0 0 0 1
6 0.0 10 0.0 70 0.0 0 1 1
8 0.0 2 1.0 90 0.0 0 1 1
3 0.0 45 0.0 60 0.0 0 1 1
18 0.0 16 0.0 25 0.0 0 0 1
5 0.0 2 1.0 1 1.0 0 0 0
3 0.0 1 1.0 0 0.0 0 0 0
2 1.0 1 1.0 3 1.0 0 0 0
1 1.0 2 1.0 1 1.0 0 0 0
6 0.6 3 0.5 5 0.8 0 0 0
9 0.0 0 0.0 2 1.0 0 0 0
4 0.0 3 0.0 5 0.0 0 0 1
15 0.9 14 0.8 16 0.9 0 0 0
30 0.8 10 0.9 25 0.8 0 0 0
7 0.4 6 0.3 0 0.0 0 0 0
8 0.0 6 0.5 0 0.0 0 0 0
4 0.0 6 0.0 3 1.0 0 1 0
3 0.0 4 0.0 5 0.0 0 0 1
6 0.0 5 0.0 4 0.0 0 0 1
9 0.0 3 0.0 8 0.0 0 0 1
2 0.0 3 0.0 2 0.0 0 0 1
5 0.0 9 0.0 6 0.0 0 0 1
8 0.0 4 0.0 3 0.0 0 0 1
1 0.0 2 0.0 1 0.0 0 0 1
7 0.0 7 0.0 9 0.0 0 0 1
4 0.0 8 0.0 2 0.0 0 0 1
3 0.0 2 0.0 7 0.0 0 0 1
4 0.0 60 0.0 200 0.0 1 0 1
8 0.0 200 0.0 5 0.0 1 0 1
3 0.0 90 0.0 100 0.0 1 0 1
2 0.0 5 0.0 3 0.0 1 0 1
4 0.0 11 0.0 14 0.0 1 0 1
13 0.0 200 0.0 120 0.0 1 0 1
6 0.0 30 0.0 6 0.0 1 0 1
5 0.0 10 0.0 12 0.0 1 0 1
16 0.0 3 0.0 250 0.0 1 0 1
200 0.0 1 0.0 2 0.0 1 0 1
1 0.0 150 0.0 13 0.0 1 0 1
22 0.0 1 1.0 60 0.0 1 0 1
8 0.2 7 1.0 5 0.0 1 0 1
11 0.0 0 0.0 0 0.0 1 1 1
60 0.0 0 0.0 0 0.0 0 0 1
25 0.0 0 0.0 0 0.0 0 0 1
15 0.0 0 0.0 20 0.0 0 0 1
40 0.0 0 0.0 50 0.0 0 0 1
90 0.1 2 1.0 1 1.0 0 0 1
5 0.0 0 0.0 0 0.0 0 0 1
200 0.0 80 0.0 60 0.0 -1 0 0
60 0.0 0 0.0 0 0.0 -1 0 0
11 0.0 200 0.0 0 0.0 -1 0 0
13 0.0 3 0.0 0 0.0 -1 0 0
10 0.0 1 0.0 0 0.0 -1 0 0
9 0.0 1 1.0 4 0.0 -1 0 0
5 0.0 90 0.0 0 0.0 -1 0 0
90 0.0 200 0.0 150 0.0 -1 0 0
6 0.0 0 0.0 60 0.0 -1 0 0
16 0.0 25 0.0 22 0.0 -1 0 0
3 0.0 4 0.0 5 0.0 -1 0 0
150 0.0 0 0.0 60 0.0 -1 0 0
3 0.0 40 0.0 0 0.0 1 0 1
1 0.0 0 0.0 0 0.0 1 0 1
5 0.0 60 0.0 0 0.0 1 0 1
2 0.0 4 0.0 0 0.0 1 0 1
8 0.0 90 0.0 0 0.0 1 0 1
7 0.0 2 0.0 0 0.0 1 0 1
2 1.0 1 1.0 2 1.0 1 0 0
3 1.0 2 1.0 1 1.0 1 0 0
2 1.0 2 1.0 0 0.0 1 0 0
3 1.0 4 1.0 40 0.0 1 0 0
5 0.9 4 1.0 60 0.0 1 0 0
8 1.0 30 0.0 7 0.9 1 0 0
12 0.8 6 1.0 9 1.0 1 0 0
3 1.0 60 0.0 0 0.0 1 0 1
9 0.9 40 0.0 25 0.2 1 0 1
7 0.3 5 1.0 6 1.0 1 0 1
30 0.4 3 1.0 2 1.0 1 0 1
6 0.0 4 1.0 5 1.0 1 0 1
6 0.0 7 0.0 0 0.0 0 0 1
12 0.0 60 0.0 0 0.0 0 0 1
4 0.0 35 0.0 0 0.0 0 0 1
9 0.0 12 0.0 11 0.0 0 0 1
5 0.0 25 0.0 4 0.0 0 0 1
14 0.0 8 0.0 6 0.0 0 0 1
7 0.0 0 0.0 9 0.0 0 0 1
8 0.0 1 1.0 7 0.0 0 0 1
5 0.0 2 1.0 12 0.0 0 0 1
11 0.0 9 0.0 1 1.0 0 0 1
6 0.0 30 0.0 2 1.0 0 0 1
17 0.0 50 0.0 3 1.0 0 0 1
4 0.0 3 1.0 2 1.0 0 0 0
8 0.0 1 1.0 1 1.0 0 0 0
9 0.0 5 0.9 4 1.0 0 0 0
6 0.0 4 1.0 0 0.0 0 0 0
9 0.0 2 1.0 0 0.0 0 0 0
3 0.0 0 0.0 1 1.0 0 0 0
6 0.0 0 0.0 3 1.0 0 0 0
1 0.0 0 0.0 0 0.0 0 0 0
8 0.0 0 0.0 0 0.0 0 0 1
3 1.0 20 0.0 4 1.0 0 0 0
5 1.0 4 1.0 30 0.0 0 0 0
12 0.8 40 0.0 9 0.9 0 0 0
3 0.0 2 1.0 1 1.0 1 0 1
2 0.0 0 0.0 1 1.0 1 0 1
8 0.0 1 1.0 2 1.0 1 0 1
4 0.0 5 0.9 0 0.0 1 0 1
1 0.0 4 1.0 3 1.0 1 0 1
2 0.0 0 0.0 3 0.0 1 0 1
6 0.0 0 0.0 0 0.0 1 0 1
3 0.0 9 1.0 8 1.0 1 1 1
9 0.0 60 0.0 2 1.0 1 0 1
5 0.0 2 1.0 0 0.0 1 0 1
7 0.1 1 1.0 1 1.0 1 0 1
2 0.0 3 0.9 4 1.0 1 0 1
1 0.0 0 0.0 2 1.0 1 0 1
3 0.0 0 0.0 0 0.0 1 0 1
1 0.0 2 1.0 0 0.0 1 0 1
4 0.0 0 0.0 2 0.0 1 0 1
9 0.0 8 1.0 2 1.0 1 0 1
6 0.0 3 1.0 1 1.0 1 0 1
2 1.0 0 0.0 0 0.0 0 0 0
4 1.0 20 0.0 30 0.0 0 0 0
6 0.9 0 0.0 9 0.0 0 0 0
3 1.0 12 0.0 8 0.0 0 0 0
8 0.8 5 0.0 0 0.0 0 0 0
2 1.0 60 0.0 0 0.0 0 0 0
2 0.0 0 0.0 4 0.0 0 0 1
5 0.0 0 0.0 3 0.0 0 0 1
8 0.0 0 0.0 2 0.0 0 0 1
3 0.0 7 0.0 0 0.0 0 0 1
5 0.0 2 1.0 3 0.0 0 0 1
7 0.0 1 1.0 2 0.0 0 0 1
4 1.0 20 0.0 15 0.0 1 0 1
2 1.0 12 0.0 30 0.0 1 0 1
6 0.9 9 0.0 8 0.0 1 0 1
3 1.0 5 0.0 6 0.0 1 0 1
8 0.7 0 0.0 20 0.0 1 0 1
5 1.0 30 0.0 4 0.0 1 0 1
10 0.8 18 0.1 12 0.0 1 0 1
12 1.0 6 0.0 0 0.0 1 0 1
30 0.9 25 0.0 20 0.0 1 0 1
4 1.0 90 0.0 5 1.0 1 0 0
6 1.0 15 0.0 3 1.0 1 0 0
3 1.0 5 1.0 90 0.0 1 0 0
20 0.9 12 1.0 14 1.0 1 0 0
40 0.0 1 1.0 1 1.0 0 0 1
70 0.0 3 1.0 2 1.0 0 0 1
30 0.1 2 1.0 0 0.0 0 0 1
4 0.0 3 0.0 0 0.0 0 0 1
5 0.0 5 0.0 0 0.0 0 0 1
2 0.0 4 0.0 0 0.0 0 0 1
1 0.0 6 0.0 0 0.0 0 0 1
3 0.0 2 0.0 0 0.0 0 0 1
2 0.0 1 0.0 1 0.0 0 0 1
1 0.0 3 0.0 1 0.0 0 0 1
2 0.0 0 0.0 1 0.0 0 0 1
4 0.0 0 0.0 1 0.0 0 0 1
2 0.0 0 0.0 0 0.0 0 0 0
"""
#: Labelled pages, one a line, as they come on the web: for each block its words, the percentage of them in links, what
#: the enclosing elements announce (+ content, - no content, nothing), h for headings, ! for content; n* stands for n
#: such blocks. Neighbours are those on the line. Most pages announce nothing, so that words and links have to decide.
PAGES = """
6*1:100- 8- 10+h! 10+! 45+! 60+! 80+! 12-
8*2:100- 12+h! 4+! 90+! 120+! 30:5+! 5*2:100- 9-
5*1:100- 9+h! 150+! 200+! 3+! 70+! 14- 6*3:100-
7*1:100- 20- 8+h! 30+! 25:20+! 40+! 9+! 4*4:100- 40- 60- 11-
6*1:100 10h! 10! 45! 60! 80! 5*2:100
9*2:100 12h! 4! 90! 120! 30:5! 6*2:100
4*1:100 8h! 60! 40! 3*5:90 70! 12! 8*3:100
12*1:100 9h! 150! 200! 3! 70! 35:10!
5*3:100 4:50 11h! 20! 18! 6! 44! 10*2:100
7*2:100 25! 90! 30:60 16! 14! 4*6:95 3*2:100
6*1:100 7h! 9! 12! 8! 22! 6*1:100
10*2:80 40! 55! 20:5! 12*2:100
3*8:100 30! 28! 60:15! 9:70 5*8:100
15*2:100 80! 100! 120! 4*2:100 2:50 6*2:100
"""
_BLOCK = re.compile(r"(?:(\d+)\*)?(\d+)(?::(\d+))?([+-]?)(h?)(!?)")
#: Depth of the tree and the fewest labelled blocks that a leaf stands for.
DEPTH, LEAST = 12, 1
#: The features, as the tree numbers them.
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "announced", "heading")


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the labelled blocks, those of the pages and the single ones."""
    rows = [[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()]
    for line in PAGES.strip().splitlines():
        page = []
        for times, words, links, said, heading, content in (_BLOCK.fullmatch(token).groups() for token in line.split()):
            page += [(float(words), float(links or 0) / 100, {"+": 1.0, "-": -1.0, "": 0.0}[said], float(heading == "h"), float(content == "!"))] * int(times or 1)
        around = [(0.0, 0.0), *(b[:2] for b in page), (0.0, 0.0)]
        rows += [[*b[:2], *around[i], *around[i + 2], *b[2:]] for i, b in enumerate(page)]
    table = np.array(rows)
    return table[:, :-1], table[:, -1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A classification tree by Gini impurity: (feature, threshold, at most it, above it), or a class at a leaf."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = (float("inf"), 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in ((values[:-1] + values[1:]) / 2).tolist():
            low = x[:, f] <= t
            n = int(low.sum())
            if min(n, len(y) - n) < LEAST:
                continue
            p, q = y[low].mean(), y[~low].mean()
            gini = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if gini < best[0] - 1e-12:
                best = (gini, f, t)
    if best[0] == float("inf"):
        return int(y.mean() >= 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


_tree: list = []


def tree():
    if not _tree:
        _tree.append(grow(*labelled()))
    return _tree[0]


def classify(features: tuple, node) -> int:
    while not isinstance(node, int):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def announce(name: str, tag: str) -> int:
    """What an element's name and attributes say of its content: -1 no content, 1 content, 0 nothing; -2 and 2 where an
    element or role of HTML says so. The classes of body and html tell of the page, and say nothing."""
    said = 2 * LANDMARKS.get(name, 0)
    if "=" in tag and name not in ("body", "html"):
        bad = False
        for key, a, b, c in _ATTR.findall(tag):
            value = a or b or c
            if key.lower() not in _SAYING:
                continue
            if key.lower() == "role":
                said = -2 if value.lower() in _BAD_ROLES else 2 if value.lower() in ("main", "article") else said
            elif _BAD.search(value := _STATE.sub(" ", value)):
                bad = True
            elif said == 0 and _GOOD.search(value):
                said = 1
        if bad:
            return min(said, -1)
    return -1 if name == "form" and said == -2 and "role" not in tag.lower() else said


class Open:
    """The open elements, each with what all up to it say together, so that no step looks through them."""

    def __init__(self):
        self.names: list[str] = []
        self.states: list[tuple[int, bool]] = []  # what is said, whether an article is open
        self.below: list[int] = []  # the nearest element below that is not inline
        self.count: dict[str, int] = {}

    def push(self, name: str, own: int) -> None:
        """No content, once one element says so; but an article or main overrides the classes around it, and a form,
        which may hold a whole page, unless these lie in an article themselves."""
        said, inside = self.states[-1] if self.states else (0, False)
        if own < 0:
            said = min(said, own)
        elif own == 2 and (said == 0 or said == -1 and not inside):
            said = 1
        elif own > 0 and said == 0:
            said = 1
        last = len(self.names) - 1
        self.below.append(last if last < 0 or self.names[last] not in INLINE else self.below[last])
        self.names.append(name)
        self.states.append((said, inside or name == "article"))
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, keep: int) -> None:
        for name in self.names[keep:]:
            self.count[name] -= 1
        del self.names[keep:], self.states[keep:], self.below[keep:]

    def close(self, name: str) -> None:
        """The end tag of the innermost element of that name also ends what is open in it; without one it does nothing."""
        if self.count.get(name):
            i = len(self.names) - 1
            while self.names[i] != name:
                i -= 1
            self.cut(i)

    def start(self, name: str) -> None:
        """A block of that name ends an open paragraph, and a list item, cell or row another one, whatever they announce."""
        i, keep, kinds = len(self.names) - 1, len(self.names), ENDS.get(name, ())
        while i >= 0:
            if self.names[i] == "p" or self.names[i] in kinds:
                keep = i
                i -= 1
            elif self.names[i] in INLINE:
                i = self.below[i]
            else:
                break
        self.cut(keep)

    @property
    def said(self) -> int:
        return max(-1, self.states[-1][0]) if self.states else 0

    @property
    def linked(self) -> bool:
        return bool(self.count.get("a"))


class Block:
    __slots__ = ("text", "words", "linked", "said", "heading")

    def __init__(self, text, words, linked, said, heading):
        self.text, self.words, self.linked, self.said, self.heading = text, words, linked, said, heading


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; the work is linear in the page, however its tags nest."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened = Open()
    unclosed: set[str] = set()  # hidden elements without an end tag in the rest of the page
    said, heading, at, n = 0, 0, 0, len(page)

    def end():
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                words = text.count(" ") + 1
                in_links = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(text, words, min(in_links, words), said, heading))
            parts.clear()
            linked.clear()

    def say(text: str):
        if text:
            parts.append(text)
            if opened.linked:
                linked.append(text + " ")

    def after(name: str, at: int) -> int:
        """Where a hidden element ends; one that holds markup and is never closed hides nothing."""
        close = None
        if name not in unclosed:
            close = re.compile("</head\\s*>|<body" if name == "head" else f"</{re.escape(name)}\\s*>", re.I).search(page, at)
        if close is None:
            unclosed.add(name)
            return n if name in RAW else at
        return close.start() if close[0].lower() == "<body" else close.end()

    for m in iter(lambda: _TOKEN.search(page, at), None):
        say(page[at : m.start()])
        tag, at = m[0], m.end()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name in BLOCKS:
                end()
            opened.close(name)
            if name in BLOCKS:
                said, heading = opened.said, 0
            continue
        if name in HIDDEN:
            at = after(name, at)
            continue
        if name in BLOCKS:
            end()
        if name in VOID or tag.endswith("/>"):
            continue
        if name in BLOCKS:
            opened.start(name)
        opened.push(name, announce(name, tag))
        if name in BLOCKS:
            said = opened.said
            heading = int(len(name) == 2 and name[0] == "h" and name[1].isdigit())
    rest = page[at:]
    say(re.sub(r"<[a-zA-Z/!?][^>]*\Z|<\Z", "", rest))
    end()
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    t = tree()
    edge = (0, 0.0)
    near = [edge, *((b.words, b.linked / b.words) for b in found), edge]
    keep = [b.text for i, b in enumerate(found) if classify((*near[i + 1], *near[i], *near[i + 2], b.said, b.heading), t)]
    return "\n".join(keep)


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, the main text of every page's html, and its number of code points."""
    ship(session(pages))

    def run(batches):
        from pointweave.llm.html import extract

        for b in batches:
            text = [extract(p.as_py()) for p in b.column("_html")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(run, f"{schema}, text string, n_chars long")
