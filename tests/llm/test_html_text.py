"""Operator 2: every page of the table against its article element, and pages made for single rules."""

import html
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import html_text, queries  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.01"
P = "<p>A long paragraph of prose that says something about rivers and the people who live on their banks, year after year.</p>"
T = P[3:-4]


def test_query(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    rows = queries.op2_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id] or "", re.S)
        inner = re.sub(r"<[^>]*$", "", inner[1]) if inner else ""
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner))
        assert r.text == "\n".join(filter(None, parts)), r.page_id
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words &amp; more", "plain words & more"),
        (f"<body><div id=menu><a href=/>Home</a></div><div class='content'>{P}{P}</div><div class=sidebar>{P}</div></body>", f"{T}\n{T}"),
        (f"<body><main><h1>T</h1>{P}<script>if (a < b) '<p>x</p>'</script>{P}<section id='comments'>{P}</section></main><footer>{P}</footer>", f"T\n{T}\n{T}"),
        (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{P}<ul><li><a href=x>see this</a><li><a href=y>see that</a></ul>{P}</article>", f"Title\n{T}\n{T}"),
        (f"<article><p>one <b>two<br>three<p>&eacute;&#233;&nbsp;x {P}<table><tr><td>a<td>b<tr><td>c</table>", f"one two three\néé x\n{T}\na b\nc"),
        (f"<body><form>{P}</form>", T),
        (f"<article>{P}<p>cut &am", f"{T}\ncut &am"),
        (f"<article>{P}<p clas", T),
        (f'<article>{P}<a title="open>quote</a><p>rest</p></article>', None),
        ("<div>" * 5000 + P + "</div>" * 5000, T),
    ],
)
def test_rules(page, text):
    got = html_text.extract(page)
    assert got == text if text is not None else got.startswith(T)


def prose(*sizes, tag="section"):
    """Sections of so many numbered paragraphs, and their text."""
    lines, out = [], []
    for n in sizes:
        own = [f"Paragraph {len(lines) + k} of a longer piece on rivers and the people who live on their banks, every year." for k in range(n)]
        lines += own
        out.append(f"<{tag}>" + "".join(f"<p>{x}</p>" for x in own) + f"</{tag}>")
    return "".join(out), "\n".join(lines)


NAV = "<nav><a href=/>Home</a> <a href=/b>About us</a></nav>"


@pytest.mark.parametrize("sizes", [(4, 2), (2, 4), (6, 2, 6), (3, 3), (1, 5, 1), (9, 1), (5, 5, 5, 5)])
@pytest.mark.parametrize("around", ["<div>{}</div>", "<main>{}</main>", "{}", "<div><div>{}</div></div>"])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_parts_of_any_size_stay(sizes, around, tag):
    body, text = prose(*sizes, tag=tag)
    page = f"<html><body>{NAV}{around.format(body)}<footer>Imprint and so on</footer></body></html>"
    assert html_text.extract(page) == text


BODY, TEXT = prose(5)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div>Site name</div><form>{BODY}</form></body>", TEXT),
        (f"<body><form><label>Search</label><input name=q></form>{BODY}<form class=x><p>Write to us about this page.</p></form></body>", TEXT),
        (f"<body>{NAV}<aside>{BODY}</aside></body>", TEXT),
        (f"<body>{NAV}<aside><article>{BODY}</article></aside></body>", TEXT),
        (f"<body><article>{prose(3)[0]}</article><article>{BODY}</article></body>", prose(3)[1] + "\n" + TEXT),
        (f"<body><div class=notice>{P}</div><article>{BODY}</article></body>", TEXT),
        (f"<body><article><div class='alert alert-info'>{P}</div>{BODY}</article></body>", TEXT),
        (f"<body><div class=notice>{P}</div><div>{BODY}</div></body>", TEXT),
        (f"<body><div id=cookie-banner>{prose(12)[0]}</div><article>{BODY}</article></body>", TEXT),
        (f"<body><div id=cookie-banner>{prose(12)[0]}</div><div>{BODY}</div></body>", TEXT),
        (f"<body><article>{BODY}<aside>{P}</aside></article></body>", TEXT),
        (f"<body><div class=cookie-recipes>{BODY}</div></body>", TEXT),
    ],
)
def test_what_surrounds_the_article(page, text):
    assert html_text.extract(page) == text


def test_random_pages_without_an_article_element():
    """Blocks of prose in random containers between menus, adverts and comments: all prose in order and nothing else."""
    rng = random.Random(11)
    for _ in range(150):
        parts, lines, total = [], [], rng.randrange(4, 12)
        while len(lines) < total:
            own = [f"Sentence {len(lines) + k} tells of rivers and of the people who have lived along their banks for many years." for k in range(rng.randrange(1, 4))]
            lines += own
            inner = "".join(f"<p>{x}</p>" for x in own)
            parts.append(rng.choice([inner, f"<div>{inner}</div>", f"<section>{inner}</section>"]))
        between = [f"<div class=ad><a href=x>{'Buy this now '*3}</a></div>", "<ul class=related>" + "<li><a href=y>Another page to read</a>" * 4 + "</ul>"]
        parts.insert(rng.randrange(len(parts)), rng.choice(between))
        around = rng.choice(["<div id=content>{}</div>", "<main>{}</main>", "<div><div class=post>{}</div></div>"])
        page = f"<html><head><title>x</title></head><body><header>Site</header>{NAV}{around.format(''.join(parts))}<div id=comments><p>I liked this.</p><p>So did I.</p></div><footer>Imprint</footer></body></html>"
        assert html_text.extract(page) == "\n".join(lines), page


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, P, 2), (None, "<p>", 3)], "page_id long, html string, _text int").withColumn("n_chars", F.lit("x"))
    out = html_text.extract_text(df).collect()
    assert [(r.page_id, r._text, r._n_chars, r.n_chars) for r in out] == [(1, "", 0, "x"), (1, T, len(T), "x"), (None, "", 0, "x")]
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content has-sidebar", "post-body with-comments", "no-banner", "elementor-widget elementor-widget-text-editor", "widget-content", "share-enabled", "page-with-ads", "hasSidebar", "ad-layout", "sidebar-open main-col"])
def test_names_do_not_lose_the_article(name):
    """A word of the class or id does not drop what holds the page's text; small parts and menus of that name go."""
    words = "This is a sentence of the article, with some words in it. " * 8
    page = f'<body><div class="menu"><a href="/">Home page</a> <a href="/x">Other page</a></div><{{0}} class="{name}"><p>{words}</p><p>{words}</p><div class="ad">Buy this now</div><p>{words}</p></{{0}}><div class="sidebar">Some few words</div></body>'
    want = "\n".join([words.strip()] * 3)
    assert html_text.extract(page.format("div")) == want
    assert html_text.extract(page.format("section").replace("class", "id")) == want


def test_names_on_every_part():
    """Where names would leave out nearly all text, density alone decides."""
    parts = [f"Part {i} of the article has a sentence of its own, and then another one." for i in range(6)]
    page = "<body><div class='x'>" + "".join(f"<div class='promo-{i}'><p>{p}</p></div>" for i, p in enumerate(parts)) + "</div></body>"
    assert html_text.extract(page) == "\n".join(parts)


@pytest.mark.parametrize("attribute", ["class='has-sidebar'", "class='post no-comments'", "class='content-header-wrap'", "class='market-share-report'", "data-id='menu'", "title='the hidden door'", "data-class='nav' id=x"])
def test_attributes_are_read_as_pairs(attribute):
    page = f"<html><body><div class=nav><a href=x>home</a></div><div {attribute}>{P}{P}{P}</div><div class='footer'>copy</div></body></html>"
    assert html_text.extract(page) == "\n".join([T] * 3)


def test_siblings_of_any_class_stay():
    page = f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div class='a'>{P}{P}</div><div class='b'>{P}{P}{P}</div><h2>End</h2><p>Last.</p><ul><li><a href=c>Imprint</a></ul></body>"
    assert html_text.extract(page).split("\n")[:5] == [T] * 5
    assert "Home" not in html_text.extract(page)


@pytest.mark.parametrize("page", ["<p>text</p>" + "<span>" * 20000 + "x" + "</b>" * 20000, "<div><p>x" * 20000, "<b>" * 20000 + "x" + "</i></b>" * 20000, "<li>x" * 20000, "<table><tr><td>" * 7000 + "x", "<p " + "a=b " * 20000 + ">x"])
def test_hostile_nesting_is_not_quadratic(page):
    began = time.process_time()
    assert "x" in html_text.extract("<html><body>" + page)
    assert time.process_time() - began < 3


def test_density_by_brute_force():
    """Random trees without an article element: every node's figures against a recursion over the tree."""
    rng = random.Random(3)
    for _ in range(200):
        nodes, pieces = [(-1, "#", ""), (0, "body", "")], []
        for i in range(2, rng.randint(3, 25)):
            nodes.append((rng.randint(1, i - 1), rng.choice(["div", "p", "a", "span", "td"]), ""))
            pieces.append((i, rng.choice([" ", "word", "some words " * rng.randint(1, 30)])))
        children = {i: [j for j in range(len(nodes)) if nodes[j][0] == i] for i in range(len(nodes))}

        def below(i):
            return [i, *(x for j in children[i] for x in below(j))]

        def figures(i):
            own = below(i)
            linked = {x for j in own if nodes[j][1] == "a" for x in below(j)}
            count = lambda some: sum(len(t.strip()) for j, t in pieces if j in some)
            return count(own), len(own), count(linked), len(linked)

        of_body = figures(1)[2] / max(figures(1)[0], 1)

        def density(i):
            c, t, lc, lt = figures(i)
            if not c:
                return 0.0
            top = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1))
            return c / t * top / max(math.log(math.log(c * lc / max(c - lc, 1) + of_body * c + math.e)), 0.5)

        _, _, got, sums = html_text.densities(nodes, pieces, 1)
        want = [density(i) for i in range(len(nodes))]
        assert got == pytest.approx(want)
        assert sums == pytest.approx([sum(want[j] for j in children[i]) for i in range(len(nodes))])
