"""Web pages as trees of blocks, and the alignment of two such trees.

A page becomes a tree of its block elements with runs of inline text as leaves.  What markup itself calls a menu, form,
advert and the like is noted on the way.  For alignment, neighbours of one shape are folded into one node, so that a list
of any length is one slot; simple tree matching then finds the largest set of pairs that keeps order and descent.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Elements that stay within a run of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var nobr wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen command frame".split())
#: Elements whose content is no markup; all but the first two are read as text by browsers and shown in no article.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are never part of an article.
NEVER = frozenset(
    "head nav footer aside noscript template svg object applet audio video canvas map button select datalist menu "
    "dialog optgroup option fieldset legend meter progress".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist tooltip "
    "status feed".split()
)
#: Words of a class, id or label that name something other than the article.
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner sponsor sponsors sponsored "
    "promo promos promoted promotion promotions nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs "
    "sidebar sidebars aside footer footers masthead toolbar cookie cookies consent gdpr ccpa notice notices notification "
    "notifications alert popup popups modal overlay lightbox newsletter subscribe subscription signup login signin "
    "register comment comments commentlist disqus reply replies respond discussion reactions related recommended "
    "recommendations suggested trending popular share shares sharing social follow pagination pager paging widget "
    "widgets searchbox search skip copyright colophon topbar bottombar toc form paywall".split()
)
#: Words before which the others say that a page has such a thing, not that this is one.
HAVING = frozenset("has have with no not without is open show hide hides supports".split())
#: What may call itself a header and still belong to the article.
OWN = frozenset("article post entry story content section chapter".split())
#: Words of a class or id that name the article, if nothing else does.
MAIN = frozenset("article story post entry content main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Levels of the tree; what lies deeper counts as of the last level, as in browsers.
DEPTH = 150
#: Children of a node from which unlike neighbours are folded, too.
WIDE = 64

_OTHER = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
_TAG = r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{})>"
_TOKEN = re.compile(_OTHER + _TAG.format(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"), re.DOTALL)
#: From the first tag on whose quotes never close, quotes are not heeded: each would be looked for to the page's end.
_LOOSE = re.compile(_OTHER + _TAG.format(r"[^>]*"), re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_MAY_MATTER = re.compile(r"class|id|hidden|role|style|data-ad|aria-|item", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: What a start tag ends if it is open, and within which elements that is looked for.
_IMPLIED = {
    **{t: (frozenset({"p"}), frozenset("table td th caption button".split())) for t in _CLOSES_P},
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu dir table".split())),
    **{t: (frozenset("dt dd p".split()), frozenset({"dl", "table"})) for t in ("dt", "dd")},
    **{t: (frozenset("td th".split()), frozenset({"tr", "table"})) for t in ("td", "th")},
    "tr": (frozenset("tr".split()), frozenset({"table"})),
    **{t: (frozenset("thead tbody tfoot".split()), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "a": (frozenset("a"), frozenset("p div li td th table article section".split())),
}
#: Elements out of which an end tag of something else does not reach.
_SCOPE = frozenset("table td th caption".split())
_NO_TABLE, _NOTHING = frozenset({"table"}), frozenset()
_TABLE = frozenset("table td th caption tr thead tbody tfoot html body".split())


class Node:
    """A block element, or a run of text (tag ``#``) with the characters of its links."""

    __slots__ = ("tag", "label", "kids", "text", "links", "junk", "main")

    def __init__(self, tag: str, label: str = "#", junk: str = "", main: int = 0):
        self.tag, self.label, self.junk, self.main = tag, label, junk, main
        self.kids: list[Node] = []
        self.text, self.links = "", 0


def _names_junk(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    for k, word in enumerate(words):
        if word in HAVING:
            return False
        if word in JUNK:
            return True
        if word == "header" and not OWN & set(words[:k]):
            return True
    return False


@lru_cache(maxsize=50_000)
def about(tag: str, rest: str) -> tuple[str, str, int]:
    """Of a start tag: its label, what speaks against it (``tag``, ``class`` or nothing) and for it (0 to 3)."""
    got: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(rest):
        got.setdefault(key.lower(), unescape(value.strip("\"'")))
    names = got.get("class", "").split() + got.get("id", "").split()
    plain = sorted({re.sub(r"\d+", "", n) for n in names})
    label = ".".join((tag, *plain))
    role, style = got.get("role", "").lower(), re.sub(r"\s", "", got.get("style", "").lower())
    landmark = tag in ("article", "main") or role in ("main", "article")
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    if hidden or tag in NEVER or role in ROLES or any(k == "data-ad" or k.startswith("data-ad-") for k in got):
        return label, "tag", 0
    kind = f"{got.get('itemprop', '')} {got.get('itemtype', '').rsplit('/', 1)[-1]}".lower()
    if "comment" in kind:
        return label, "tag", 0
    if tag in ("html", "body") or landmark:
        junk = any(n.lower() in JUNK for n in names) and tag not in ("html", "body", "main")
        return label, "class" * junk, (3 if tag == "main" or role == "main" else 2) * landmark * (not junk)
    if tag == "form" or tag == "header":
        return label, tag, 0
    if any(map(_names_junk, [*names, got.get("aria-label", "")])):
        return label, "class", 0
    if "articlebody" in kind:
        return label, "", 2
    words = {w.lower() for n in names for w in _WORDS.findall(n)}
    return label, "", int(tag in ("div", "section", "td", "body") and bool(words & MAIN))


def parse(html: str) -> Node:
    """The tree of a page; broken markup is closed as browsers do in the common cases."""
    root = Node("html", "html")
    stack: list[tuple[str, Node, int]] = [("html", root, 0)]  # tag, the block it is or lies in, that block's level
    opened: dict[str, int] = {}
    run: list[str] = []
    links, at, token = 0, 0, _TOKEN

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Node("#")
                leaf.text, leaf.links = text, min(links, len(text))
                stack[-1][1].kids.append(leaf)
            run.clear()
            links = 0

    def pop() -> None:
        tag, _, _ = stack[-1]
        if tag not in INLINE or stack[-1][1] is not stack[-2][1]:
            flush()
        stack.pop()
        opened[tag] -= 1

    def say(text: str) -> None:
        nonlocal links
        text = unescape(text)
        run.append(text)
        if opened.get("a"):
            links += len(text.strip())

    def close(tags: frozenset[str], scope: frozenset[str], all_: bool = True) -> None:
        """End what of ``tags`` is open within the scope: all of it, or the innermost one."""
        if not any(opened.get(t) for t in tags):
            return
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                found = k
                if not all_:
                    break
            elif stack[k][0] in scope:
                break
        if found:
            while len(stack) > found:
                pop()

    while True:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        m = token.match(html, lt)
        if m is None and token is _TOKEN and html[lt + 1 : lt + 3].strip("/")[:1].isalpha():
            token = _LOOSE
            m = token.match(html, lt)
        if m is None:
            if html.find(">", lt) < 0:
                say(html[at:])
                break
            say(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            say(html[at:lt])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        rest = m["rest"]
        if m["end"]:
            if tag == "br":
                run.append(" ")
            elif tag != "html" and (opened.get(tag) or tag in HEADINGS):
                scope = _SCOPE if tag not in _TABLE else _NO_TABLE if tag != "table" else _NOTHING
                close(HEADINGS if tag in HEADINGS else frozenset({tag}), scope, all_=False)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            if end is None:
                break
            close_at = html.find(">", end.end())
            at = len(html) if close_at < 0 else close_at + 1
            continue
        if tag in ("html", "br", "wbr") or tag in VOID:
            if tag in ("br", "input", "embed"):
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag == "body":
            close(frozenset({"head"}), frozenset())
        _, inside, level = stack[-1]
        opened[tag] = opened.get(tag, 0) + 1
        if tag in INLINE and not _MAY_MATTER.search(rest):
            stack.append((tag, inside, level))
            continue
        label, junk, main = (about if len(rest) < 500 else about.__wrapped__)(tag, rest)
        if not junk and (tag in INLINE or level >= DEPTH):
            if tag not in INLINE:
                flush()
            stack.append((tag, inside, level))
            continue
        flush()
        node = Node(tag, label, junk, main)
        inside.kids.append(node)
        stack.append((tag, node, level + 1))
    flush()
    return root


# --- shapes and alignment -------------------------------------------------------------------------------------------


class Fold:
    """A node of the folded tree: the page's leaves it stands for are in ``leaves`` (of text nodes only)."""

    __slots__ = ("label", "kids", "leaves", "shape", "size")

    def __init__(self, label: str, kids: list[Fold], leaves: list[Node], shapes: Shapes):
        self.label, self.kids, self.leaves = label, kids, leaves
        self.shape, self.size = shapes.of(label, kids), 1 + sum(k.size for k in kids)


class Shapes:
    """Numbers for shapes (a label and the shapes below it), and the matching of pairs of shapes."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, label: str, kids: list[Fold]) -> int:
        return self.known.setdefault((label, *(k.shape for k in kids)), len(self.known))

    def table(self, a: list[Fold], b: list[Fold]) -> list[list[int]]:
        """Simple tree matching of two lists of siblings: the best total of the first i and j."""
        rows = [[0] * (len(b) + 1)]
        for x in a:
            above, row = rows[-1], [0]
            for j, y in enumerate(b):
                best = max(above[j + 1], row[j])
                if x.label == y.label:
                    best = max(best, above[j] + self.score(x, y))
                row.append(best)
            rows.append(row)
        return rows

    def score(self, a: Fold, b: Fold) -> int:
        """Pairs in the best matching of two trees."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = a.shape, b.shape
        if key not in self.scores:
            self.scores[key] = 1 + self.table(a.kids, b.kids)[-1][-1]
        return self.scores[key]

    def pairs(self, a: Fold, b: Fold) -> list[tuple[Fold, Fold]]:
        """The matched nodes; roots match by being roots."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            out.append((a, b))
            if a.shape == b.shape:
                todo += zip(a.kids, b.kids, strict=True)
                continue
            rows, i, j = self.table(a.kids, b.kids), len(a.kids), len(b.kids)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((a.kids[i], b.kids[j]))
        return out


def _merged(alike: list[Fold], shapes: Shapes) -> Fold:
    """Nodes of one shape as one."""
    if len(alike) == 1:
        return alike[0]
    kids = [_merged(list(group), shapes) for group in zip(*(f.kids for f in alike), strict=True)]
    return Fold(alike[0].label, kids, [x for f in alike for x in f.leaves], shapes)


def _joined(alike: list[Fold], label: str, shapes: Shapes) -> Fold:
    """Nodes of one label and several shapes as one."""
    kids = fold_list([k for f in alike for k in f.kids], shapes)
    return Fold(label, kids, [x for f in alike for x in f.leaves], shapes)


def fold_list(kids: list[Fold], shapes: Shapes) -> list[Fold]:
    """Siblings with runs of one shape folded; of too many, those of one shape, label or element anywhere."""
    runs: list[list[Fold]] = []
    for k in kids:
        if runs and runs[-1][0].shape == k.shape:
            runs[-1].append(k)
        else:
            runs.append([k])
    out = [_merged(run, shapes) for run in runs]
    if len(out) > WIDE:
        groups: dict[int, list[Fold]] = {}
        for k in out:
            groups.setdefault(k.shape, []).append(k)
        out = [_merged(g, shapes) for g in groups.values()]
    for by in (str, lambda label: label.split(".", 1)[0]):
        if len(out) > WIDE:
            named: dict[str, list[Fold]] = {}
            for k in out:
                named.setdefault(by(k.label), []).append(k)
            out = [g[0] if len(g) == 1 else _joined(g, n, shapes) for n, g in named.items()]
    return out


def fold(node: Node, shapes: Shapes) -> Fold:
    """The folded tree of a page; below what markup itself excludes nothing is kept."""
    if node.tag == "#":
        return Fold("#", [], [node], shapes)
    kids = [] if node.junk == "tag" else fold_list([fold(k, shapes) for k in node.kids], shapes)
    return Fold(node.label, kids, [], shapes)


def plain(tree: Fold) -> list:
    """Labels alone, as nested lists."""
    return [tree.label, [plain(k) for k in tree.kids]]


def from_plain(tree: list, shapes: Shapes) -> Fold:
    return Fold(tree[0], [from_plain(k, shapes) for k in tree[1]], [], shapes)


def order(tree: Fold) -> list[Fold]:
    """The nodes in document order."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out
