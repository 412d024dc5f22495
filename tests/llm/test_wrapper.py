"""HTML extraction: parsing and matching against plain recursion, hosts with and without landmarks, odd pages."""

import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanspark.llm import dom, wrapper

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def run(spark, pages):
    """Texts by page_id of (url, html) rows."""
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.main.text for r in wrapper.extract(df).collect()}


def test_whole_table(spark):
    """Every page of the smallest table, against its article element cut out by an expression."""
    import html
    import re

    from gleanspark.llm.queries import op13_html_extraction

    got = {r.page_id: r for r in op13_html_extraction(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article.replace("<b>", ""))).split())
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


TREES = st.recursive(
    st.sampled_from("abc").map(lambda t: (t, ())),
    lambda kids: st.tuples(st.sampled_from("abc"), st.lists(kids, max_size=4).map(tuple)),
    max_leaves=14,
)


@lru_cache(maxsize=None)
def matching(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0

    @lru_cache(maxsize=None)
    def lists(i, j):
        if not i or not j:
            return 0
        return max(lists(i - 1, j), lists(i, j - 1), lists(i - 1, j - 1) + matching(a[1][i - 1], b[1][j - 1]))

    return 1 + lists(len(a[1]), len(b[1]))


def folded(t, shapes):
    return dom.Fold(t[0], [folded(k, shapes) for k in t[1]], [], shapes)


@settings(max_examples=300, deadline=None)
@given(TREES, TREES)
def test_matching_equals_its_definition(a, b):
    shapes = dom.Shapes()
    x, y = folded(a, shapes), folded(b, shapes)
    pairs = shapes.pairs(x, y)
    assert shapes.score(x, y) == matching(a, b)
    if a[0] == b[0]:
        assert len(pairs) == matching(a, b) and all(p.label == q.label for p, q in pairs)
        at, bt = ({id(n): k for k, n in enumerate(dom.order(t))} for t in (x, y))
        order = sorted((at[id(p)], bt[id(q)]) for p, q in pairs)
        assert order == sorted(order, key=lambda t: t[1])


def blocks(html):
    return [x.text for x in wrapper.Page(html).leaves]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b>c <i>d</i><p>e<br>f", ["abc d", "e f"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
        ("x<script>var a='<p>no</p>'</script >y<style>p{}</STYLE>z<!-- <p>no --> w", ["xyz w"]),
        ("a<!-->b<!-- c", ["ab"]),
        ("<textarea><p>no</textarea><title>no</title><p title='>'>yes", ["yes"]),
        ("1 < 2 <3 &lt;b&gt; &copy &am; &#233;&#x41; a&nbsp;&nbsp;b", ["1 < 2 <3 <b> © &am; éA a b"]),
        ("<p class=\"x'>a</p><p>b", ["a", "b"]),
        ("<NAV>no</NAV><P>yes</P><div hidden>no</div><div style='Display : none'>no</div>", ["yes"]),
        ("<div class='cookie-notice'>no</div><div class=has-sidebar>yes</div><p>x <span class=ad>no</span> y", ["yes", "x", "y"]),
        ("<div id=adBox>no</div><div class='roadside'>yes</div><div role=navigation>no</div>", ["yes"]),
        ("<article><header><h1>T</h1><div>by me</div></header><p>x<footer>no</footer></article>", ["T", "x"]),
        ("<section id=comments><article><p>no</article></section><main><p>yes</main>", ["yes"]),
        ("<form id=f><main><h1>t</h1><p>text</main></form>", ["t", "text"]),
        ("<p>a</p><script>never closed <p>no", ["a"]),
        ("a<svg><text>no</text></svg>b", ["a", "b"]),
        ("<h1>a</h2>b<", ["a", "b<"]),
    ],
)
def test_blocks(html, want):
    assert blocks(html) == want


def shop(rng, k, menu, article, comments=2):
    """A page without any landmark or telling name; its promotion rotates."""
    said = "".join(f"<div class=comment><b>u{c}</b> {words(rng, 9)}</div>" for c in range(comments))
    promo = ["Buy now and save", "Sign here today", "Best in town, really"][k % 3]
    return (
        f"<html><body><div class=x1><div class=x2>{menu}</div></div><div class=x7>{promo}</div>"
        f"<div class=x3><h1>{article[0]}</h1>" + "".join(f"<p>{p}</p>" for p in article[1:]) + "<p>Share this story</p></div>"
        f"<div class=x4>{said}</div><div class=x5>Copyright {menu[:5]} company</div></body></html>"
    )


def test_template_of_a_host_without_landmarks(spark):
    rng = random.Random(3)
    articles = [[words(rng, 6), *(words(rng, rng.randint(8, 60)) for _ in range(rng.randint(2, 30)))] for _ in range(24)]
    pages = [(f"http://Shop.example/{k}", shop(rng, k, "Home Goods About us", a)) for k, a in enumerate(articles)]
    copies = [("http://shop.example/c", shop(rng, k, "Home Goods About us", articles[0])) for k in range(20)]
    got = run(spark, [*pages, *copies, ("http://one.example/", shop(rng, 1, "Start", articles[1]))])
    for k, a in enumerate(articles):
        assert got[k] == " ".join(a)
    assert all(got[24 + k] == " ".join(articles[0]) for k in range(20))  # copies don't make an article template
    assert got[44].startswith(" ".join(articles[1]))  # a host of one page: the densest part


def test_article_with_constant_parts(spark):
    rng = random.Random(5)
    articles = [[words(rng, 30) for _ in range(4)] for _ in range(12)]
    note = "This page is part of our series."
    page = "<nav>x</nav><article><p>{}</p><p>{}</p><p>{n}</p><p>{}</p><p>{}</p></article><aside>{s}</aside>"
    pages = [(f"https://a.b/{k}", page.format(*a, n=note, s=words(rng, 50))) for k, a in enumerate(articles)]
    got = run(spark, pages)
    assert [got[k] for k in range(12)] == [" ".join(a) for a in articles]
    same = run(spark, [(f"https://a.b/{k}", page.format(*articles[0], n=note, s="s")) for k in range(6)])
    assert set(same.values()) == {" ".join([*articles[0][:2], note, *articles[0][2:]])}


def test_odd_rows(spark):
    deep, long = "<div>" * 5_000 + "deep" + "</div>" * 5_000, "<p>wörd &amp; " * 60_000
    bold = "<p>x" + "<b>" * 20_000 + "y</p><p>z"
    pages = [(None, None), ("no url", ""), ("http://h/1", None), ("http://h/2", "<nav>a</nav>"), (None, "<p>text")]
    pages += [("http://h/3", deep), ("http://h/4", long), ("http://h/5", bold), ("http://h/4", long), ("http://H/6", "\x00<\x00p>")]
    schema = "page_id long, url string, html string, host string, _host string, trees int, text string"
    df = spark.createDataFrame([(k, *p, "own", "own", 1, "own") for k, p in enumerate(pages)], schema)
    rows = wrapper.extract(df).collect()
    got = {r.page_id: r.main.text for r in rows}
    assert len(rows) == len(pages) and {r.host + r._host + r.text for r in rows} == {"ownownown"}
    assert [got[k] for k in range(6)] == ["", "", "", "", "text", "deep"]
    assert got[6] == got[8] == " ".join(["wörd &"] * 60_000) and got[7] == "xy z"
    assert wrapper.extract(df.limit(0)).count() == 0 and wrapper.extract(df).columns == [*df.columns, "main"]


def test_result_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    one = {(r.page_id, r.main.text) for r in wrapper.extract(df.coalesce(1)).collect()}
    assert one == {(r.page_id, r.main.text) for r in wrapper.extract(df.repartition(7)).collect()}
