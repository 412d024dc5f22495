"""Main text of web pages by wrapper induction.

For each host a few pages of its commonest kinds serve as trees of reference.  Every page of the host is aligned with the
nearest of them by simple tree matching, and what stands at each of its nodes is counted over all pages.  Text that comes
back at one node in many pages is template; nodes whose text varies are slots, and hold content.  What markup itself
names (menus, forms, adverts, comments) is left out wherever it stands.

Only counts are shuffled; they are summed in each task first, so that a host with any share of the pages is counted by all
tasks.  A host's wrapper has at most ``REFERENCES`` trees and, as a template text has a share of its node's pages, a
bounded number of texts a node.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm import dom
from gleanspark.llm.common import broadcast_small, fresh, stash

#: Trees a host's pages are aligned with.
REFERENCES = 4
#: Shares of a node's pages from which a text is template, outside and inside what markup calls the article.
SHARE, INNER_SHARE = 0.1, 0.5
#: Articles (told apart by their longest text) that a template text must stand beside, outside and inside.
ARTICLES, INNER_ARTICLES = 2, 3
#: Share of an article that the wrapper may take away, and of a block's characters in links from which it is a menu.
MOST, LINKED = 0.5, 0.6
#: Share of a page's text that its article holds, where no wrapper and no markup names it.
HOLDS = 0.85
#: Counts, shapes and hosts that a worker holds before it hands them on or forgets them.
HELD, SHAPES, HOSTS = 200_000, 200_000, 5_000
#: Bits of the sketch that counts articles.
BITS = 63
#: A node for the page as a whole, and the text for all texts of a node.
PAGE, ANY = -1, 0


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1)
    return F.lower(found)


def kind_of(html: Column) -> Column:
    """A number for the set of elements in a page."""
    return F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))))


def text_hash(text: str) -> int:
    """63 bits that are never ANY."""
    return (xxhash.xxh3_64_intdigest(text) >> 1) or 1


# --- a page ---------------------------------------------------------------------------------------------------------


class Page:
    """A parsed page: its leaves outside of what markup excludes, with the strongest article each stands in."""

    def __init__(self, html: str | None):
        self.root = dom.parse(html or "")
        self.excused = _excused(self.root)
        self.leaves: list[dom.Node] = []
        self.within: list[tuple[dom.Node, ...]] = []
        todo: list[tuple[dom.Node, tuple[dom.Node, ...], str]] = [(self.root, (), "")]
        while todo:
            node, above, head = todo.pop()
            if node.tag == "#":
                if head != "header":
                    self.leaves.append(node)
                    self.within.append(above)
                continue
            if node.junk == "header" and any(n.main > 1 for n in above):
                head = "header"  # of an article: its headings stay
            elif node.junk and id(node) not in self.excused:
                continue
            if head == "header" and node.tag in dom.HEADINGS:
                head = ""
            below = (*above, node)
            todo += [(k, below, head) for k in reversed(node.kids)]

    def article(self) -> int:
        """Of the page's leaves, a number for the longest."""
        longest = max((x.text for x in self.leaves), key=len, default="")
        return text_hash(longest)


def _weight(node: dom.Node) -> Counter:
    """Characters below each node that are in paragraphs and headings, not in links, by identity."""
    out: Counter = Counter()
    order, todo = [], [(node, False)]
    while todo:
        n, prose = todo.pop()
        prose = prose or n.tag == "p" or n.tag in dom.HEADINGS
        order.append(n)
        if n.tag == "#":
            out[id(n)] = (len(n.text) - n.links) * prose
        todo += [(k, prose) for k in n.kids if not k.junk or k.junk in ("form", "header", "class")]
    for n in reversed(order):
        out[id(n)] += sum(out[id(k)] for k in n.kids)
    return out


def _excused(root: dom.Node) -> set[int]:
    """Elements named like something else that still hold the article: a form or wrapper around the whole page.

    Such an element holds a main element, or over half of the page's prose and an article or heading of first rank.
    """
    doubtful, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.junk in ("form", "class", "header"):
            doubtful.append(n)
        todo += [k for k in n.kids if k.junk != "tag"]
    if not doubtful:
        return set()
    weight = _weight(root)
    out = set()
    for n in doubtful:
        if n.tag in ("article", "header"):
            continue
        best, titled, inner = 0, False, [n]
        while inner:
            k = inner.pop()
            best, titled = max(best, k.main), titled or k.tag == "h1"
            inner += [x for x in k.kids if x.junk != "tag"]
        if best == 3 or (best == 2 or titled or n.junk == "form") and 2 * weight[id(n)] > weight[id(root)] > 0:
            out.add(id(n))
    return out


def _chars(leaves: Iterable[dom.Node]) -> int:
    return sum(len(x.text) for x in leaves)


def _named(page: Page) -> list[dom.Node] | None:
    """The leaves of what markup calls the article; None if it names none that holds text."""
    by: dict[int, list[dom.Node]] = defaultdict(list)
    rank: dict[int, int] = {}
    for leaf, above in zip(page.leaves, page.within, strict=True):
        inner = ""
        for n in above:
            if n.main > 1 and not (n.main == 2 and inner == "article"):
                by[id(n)].append(leaf)
                rank[id(n)] = n.main
                inner = "article" if n.main == 2 else inner
    for most in (2, 3):  # an article within a main element is nearer to the text
        found = {k: v for k, v in by.items() if rank[k] == most}
        if not found:
            continue
        largest = max(map(_chars, found.values()))
        chosen = {id(x) for v in found.values() if 2 * _chars(v) >= largest for x in v}
        if most == 2 and any(3 * largest < _chars(v) for k, v in by.items() if rank[k] == 3):
            continue  # a few cards in a long main text
        return [x for x in page.leaves if id(x) in chosen]
    soft: dict[int, list[dom.Node]] = defaultdict(list)
    for leaf, above in zip(page.leaves, page.within, strict=True):
        for n in above:
            if n.main == 1:
                soft[id(n)].append(leaf)
    least = [v for v in soft.values() if 2 * _chars(v) >= _chars(page.leaves)]
    return min(least, key=_chars) if least else None


def _is_menu(leaf: dom.Node) -> bool:
    return leaf.links >= LINKED * len(leaf.text)


def _densest(page: Page, leaves: list[dom.Node]) -> list[dom.Node]:
    """The leaves below the lowest node that holds most text outside of links, and headings of first rank before it."""
    kept = {id(x) for x in leaves}
    mass: Counter = Counter()
    path: dict[int, tuple[dom.Node, ...]] = {}
    for leaf, above in zip(page.leaves, page.within, strict=True):
        if id(leaf) in kept:
            path[id(leaf)] = above
            for n in above:
                mass[id(n)] += len(leaf.text) - leaf.links
    total = mass[id(page.root)]
    lowest, todo = page.root, [page.root]
    while todo:
        n = todo.pop()
        for k in n.kids:
            if k.tag not in ("#", "p") and mass[id(k)] >= HOLDS * total:
                lowest, todo = k, [k]
    inside = [x for x in leaves if lowest in path[id(x)]]
    started = id(inside[0]) if inside else None
    titles = []
    for x in leaves:
        if id(x) == started:
            break
        titles += [x] * any(n.tag == "h1" for n in path[id(x)])
    return titles + inside


def main_text(page: Page, share: dict[int, tuple[float, int]], known: int) -> str:
    """The article's blocks, joined by spaces.

    ``share``: of leaves by identity, the share of their node's pages that have the text, and the articles it stands
    beside.  ``known``: articles of the host.
    """

    def template(leaf: dom.Node, least: float, articles: int) -> bool:
        part, beside = share.get(id(leaf), (0.0, 0))
        return part >= least and beside >= articles

    named = _named(page)
    if named is not None:
        kept = [x for x in named if not template(x, INNER_SHARE, INNER_ARTICLES)]
        if _chars(kept) < MOST * _chars(named):
            kept = named
    else:
        kept = [x for x in page.leaves if not _is_menu(x) and not template(x, SHARE, ARTICLES)]
        if known < INNER_ARTICLES and kept:
            kept = _densest(page, kept)
    return " ".join(x.text for x in kept)


# --- a host's wrapper -----------------------------------------------------------------------------------------------


class Wrappers:
    """The reference trees of the hosts that a worker meets."""

    def __init__(self) -> None:
        self.shapes, self.known = dom.Shapes(), {}

    def of(self, host: str, trees: list[str]) -> list[tuple[dom.Fold, dict[int, int]]]:
        """Each tree, and the number of each of its nodes in document order."""
        if len(self.shapes.known) + len(self.shapes.scores) > SHAPES or len(self.known) > HOSTS:
            self.__init__()
        if host not in self.known:
            folded = [dom.from_plain(json.loads(t), self.shapes) for t in trees]
            self.known[host] = [(t, {id(n): k for k, n in enumerate(dom.order(t))}) for t in folded]
        return self.known[host]

    def slots(self, page: Page, host: str, trees: list[str]) -> list[tuple[int, int, list[dom.Node]]]:
        """Tree, node and the page's leaves there, for each matched node with text; the nearest tree is taken."""
        references = self.of(host, trees)
        if not references:
            return []
        tree = dom.fold(page.root, self.shapes)
        near = [2 * self.shapes.score(tree, r) / (tree.size + r.size) for r, _ in references]
        k = near.index(max(near))
        reference, number = references[k]
        return [(k, number[id(b)], a.leaves) for a, b in self.shapes.pairs(tree, reference) if a.leaves]


def _tree(html: str) -> str:
    return json.dumps(dom.plain(dom.fold(dom.parse(html), dom.Shapes())))


_COUNTS = "host string, tree int, node int, text long, n long, beside long"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages, and a sketch of articles, by host, tree, node and text; summed until there are too many."""
    wrappers, n, beside = Wrappers(), Counter(), defaultdict(int)

    def rows() -> pd.DataFrame:
        out = [(*k, n[k], beside[k]) for k in n]
        n.clear(), beside.clear()
        return pd.DataFrame(out, columns=["host", "tree", "node", "text", "n", "beside"])

    for batch in batches:
        for host, html, trees in zip(batch["host"], batch["html"], batch["trees"], strict=True):
            page = Page(html)
            if not page.leaves:
                continue
            bit = 1 << page.article() % BITS
            open_ = {id(x) for x in page.leaves}
            keys = {(host, 0, PAGE, ANY)}
            for tree, node, leaves in wrappers.slots(page, host, list(trees)):
                texts = {text_hash(x.text) for x in leaves if id(x) in open_}
                keys |= {(host, tree, node, t) for t in texts | ({ANY} if texts else set())}
            for key in keys:
                n[key] += 1
                beside[key] |= bit
            if len(n) > HELD:
                yield rows()
    yield rows()


def induce(rows: DataFrame, *, references: int = REFERENCES) -> DataFrame:
    """host, trees (JSON), template (structs of tree, node, text, share, beside) and known of each host; stored.

    ``rows`` has host and html.  References are the first pages, by hash, of the host's commonest kinds (sets of
    elements).
    """
    kinds = rows.filter(F.length("html") > 0).select("host", kind_of(F.col("html")).alias("kind"), F.xxhash64("html").alias("h"))
    best = Window.partitionBy("host").orderBy(F.desc("n"), "kind")
    counted = kinds.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"))
    chosen = counted.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= references)
    chosen = stash(chosen.select("host", "k", "h"), "reference-pages")
    tree = F.pandas_udf(lambda s: s.map(_tree), "string")
    on = [rows["host"] == chosen["host"], F.xxhash64(rows["html"]) == chosen["h"]]
    pages = rows.join(broadcast_small(chosen), on).groupBy(chosen["host"], "k").agg(F.min("html").alias("html"))
    trees = pages.select("host", F.struct("k", tree("html").alias("tree")).alias("x"))
    trees = trees.groupBy("host").agg(F.array_sort(F.collect_list("x")).alias("x"))
    trees = stash(trees.select("host", F.transform("x", lambda x: x["tree"]).alias("trees")), "reference-trees")
    joined = rows.join(broadcast_small(trees), "host")
    counts = joined.select("host", "html", "trees").mapInPandas(_count, _COUNTS)
    key = ["host", "tree", "node"]
    counts = counts.groupBy(*key, "text").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("beside")).alias("beside"))
    counts = stash(counts.filter((F.col("text") == ANY) | (F.col("beside") >= ARTICLES)), "node-texts")
    totals = counts.filter(F.col("text") == ANY).select(*key, F.col("n").alias("pages"))
    texts = counts.filter(F.col("text") != ANY).join(totals, key)
    part = texts.withColumn("share", F.col("n") / F.col("pages")).filter(F.col("share") >= SHARE)
    template = part.groupBy("host").agg(F.collect_list(F.struct("tree", "node", "text", "share", "beside")).alias("template"))
    known = counts.filter(F.col("node") == PAGE).select("host", F.col("beside").cast("int").alias("known"))
    out = trees.join(template, "host", "left").join(known, "host", "left")
    return stash(out, "wrappers")


def extract(
    pages: DataFrame,
    *,
    url_col: str = "url",
    html_col: str = "html",
    references: int = REFERENCES,
    into: str = "main",
) -> DataFrame:
    """``pages`` with the struct ``into``: host and text (the article's blocks in page order, joined by one space).

    Character references are decoded; white space within a block becomes one space.  A null or empty page, or one
    without an article, has an empty text.  Pages without a host form one host.  A host's repeated pages and copies of
    an article count once as evidence of template; a host of one page, or of copies only, has no template, and the
    article is then what markup names, or the densest part.  Very long pages are read whole; elements beyond the 150th
    level count as of that level.  All rows stay, repeated ones too.  A column named like ``into`` is replaced, all
    others stay as they are, whatever their names.  An empty table gives none.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    wrappers = induce(rows, references=references)
    host, trees, template, known = fresh(pages, "_host", "_trees", "_template", "_known")
    named = wrappers.toDF(host, trees, template, known)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held = Wrappers()
        texts: dict[str, dict[tuple[int, int], dict[int, tuple[float, int]]]] = {}
        for batch in batches:
            out = []
            for site, html, trees_, template_, known_ in zip(*batch, strict=True):
                page = Page(html)
                if site not in texts:
                    if len(texts) > HOSTS:
                        texts.clear()
                    mine = texts[site] = defaultdict(dict)
                    for x in template_ if template_ is not None else ():
                        mine[x["tree"], x["node"]][x["text"]] = x["share"], x["beside"]
                share = {}
                if texts[site] and page.leaves:
                    for tree, node, leaves in held.slots(page, site, list(trees_)):
                        at = texts[site].get((tree, node), {})
                        share.update((id(x), at[t]) for x in leaves if (t := text_hash(x.text)) in at)
                out.append(main_text(page, share, 0 if pd.isna(known_) else int(known_)))
            yield pd.Series(out, dtype=object)

    joined = pages.withColumn(host, host_of(F.col(url_col))).join(broadcast_small(named), host, "left")
    text = text_of(host, F.coalesce(html_col, F.lit("")), trees, template, known)
    return joined.withColumn(into, F.struct(F.col(host).alias("host"), text.alias("text"))).drop(host, trees, template, known)
