"""Main text of web pages by composite text density.

Every node of a page has the characters C and tags T of its subtree and those inside links, LC and LT. Its density is
C / T * log(C / LC * T / LT) / log(log(C * LC / (C - LC) + LCb / Cb * C + e)), with LCb / Cb those of the body: many
characters for each tag count, links count against. A node's density sum is the sum of its children's. The node of the
largest sum is the core; the smallest density on the path from the body to it is the threshold. The text is the subtree of
the core (or of the article element around it, with other article elements of a tenth of its text), without parts whose
characters are mostly links and whose density is below the threshold, and with neighbours of the nodes on the path: of any
tag and class if they hold a tenth of the text of the node they stand beside and they or a child have half of the threshold
(a shorter part is less dense), and headings, paragraphs, lists, tables and elements of the same name that reach the threshold itself.

Elements that are no article by their tag, or are hidden (menus, headers, footers, scripts, styles), are left out before.
Those whose class, id or role says so (sidebars, adverts, notices, comments of readers), and asides and forms, are left out where they are
mostly links, hold at most half of the page's text outside links, or stand beside an article element (else a main one) of a
tenth of their text; where less than a tenth of that text would stay, only
those that are mostly links; notices on cookies are left out whatever their size, as long as a tenth of the page stays. Words after has, with, without and no in a name say nothing. Character references are decoded, white space in a
block becomes one space, blocks are joined by line feeds.

Pages are parsed one by one in Arrow batches, with a stack and no recursion; a page is the unit that a task must hold.

Defined cases: null, empty and text-free pages give an empty text; a page cut off in a tag loses that tag only; missing end
tags are closed as the element around them ends; other columns pass through, those named like an added one are replaced.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of elements and of their roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
NO_ARTICLE = frozenset("head nav footer header button select option dialog menu template svg math canvas object audio video datalist".split())
#: Elements that are no article where they are small or mostly links, as if their names said so.
MAYBE_ARTICLE = frozenset("aside form fieldset label".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - frozenset("tbody tfoot thead tr caption body html head".split())
#: An element that begins ends an open one of these, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_ARTICLE_WORDS = frozenset("ad ads advert adverts advertisement adverting advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr popup modal overlay comment comments disqus respond replies sharing social related recommended recommendation recommendations teaser newsletter subscribe subscription signup login search pagination pager toolbar copyright disclaimer complementary contentinfo skip notice notices alert alerts".split())
#: What these name is never the article while a tenth of the page's text stands elsewhere.
NEVER_ARTICLE_WORDS = frozenset("cookie cookies consent gdpr".split())
#: What follows these in a name does not tell what the element is.
NOT_OWN = frozenset("has have with without no not".split())
NEVER_LEFT_OUT = frozenset("html body main article h1 h2 h3 p".split())

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|[!?/a-zA-Z][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def parsed(attributes: str) -> dict[str, str]:
    """Attributes by name; of one named twice the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def no_article(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in NO_ARTICLE and not (tag == "header" and in_article):
        return True
    if not attributes or tag in NEVER_LEFT_OUT:
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(HIDDEN_STYLE.search(attributes.get("style", "")))


def named_so(tag: str, attributes: dict[str, str], words: frozenset[str] = NO_ARTICLE_WORDS) -> bool:
    """Whether a class, id or role has one of the words, by default those of what is no article."""
    if words is NO_ARTICLE_WORDS and tag in MAYBE_ARTICLE:
        return True
    if not attributes or tag in NEVER_LEFT_OUT:
        return False
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").split():
            for w in WORD.findall(name):
                if w.lower() in NOT_OWN:
                    break
                if w.lower() in words:
                    return True
    return False


def parse(page: str) -> tuple[list[tuple[int, str, str]], list[tuple[int, str | None]], dict[int, bool]]:
    """Nodes (parent, tag, class), in page order pieces (node, text), None for a break between blocks, and nodes named like no
    article with whether that holds for any size."""
    nodes, pieces, named, stack = [(-1, "#", "")], [], {}, [0]
    at, out, articles = 0, 0, 0  # out: depth of the stack where what is left out began
    places: dict[str, list[int]] = {}  # depths of the open elements of each tag
    blocks: list[int] = []  # depths of the open blocks

    def shut(depth):
        """Close all elements from a depth of the stack on; each is closed once, so this costs no more than opening."""
        nonlocal articles
        for i in stack[depth:]:
            tag = nodes[i][1]
            places[tag].pop()
            articles -= tag == "article"
            if tag in BLOCK:
                blocks.pop()
        del stack[depth:]

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not out:
            pieces.append((stack[-1], html.unescape(text) if "&" in text else text))
        if not m:
            return nodes, pieces, named
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if not places.get(tag) or tag not in BLOCK and blocks and blocks[-1] > places[tag][-1]:
                continue
            depth = places[tag][-1]
            shut(depth)
            out = 0 if out >= depth else out
        else:
            if tag in ENDS_P or tag in SIBLINGS:
                ends, within = SIBLINGS.get(tag, ((), ()))
                last = lambda names: max((places[x][-1] for x in names if places.get(x)), default=0)
                close = 0
                if ends:  # the outermost open one within the container
                    edge = last(within)
                    close = min((d for x in ends for d in places.get(x, ())[bisect.bisect(places.get(x, ()), edge) :]), default=0)
                if tag in ENDS_P and places.get("p"):
                    p = places["p"][-1]
                    wall = last(within) if ends else next((d for d in reversed(blocks) if nodes[stack[d]][1] != "p"), 0)
                    if p > wall:
                        close = min(close or p, p)
                if close:
                    shut(close)
                    out = 0 if out >= close else out
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
                continue
            if tag == "br":
                if not out:
                    pieces.append((stack[-1], " "))
                continue
            if tag not in VOID and not (tag in ("html", "body") and places.get(tag)):
                attributes = parsed(m[3]) if m[3] and "=" in m[3] or "hidden" in m[3] else {}
                nodes.append((stack[-1], tag, attributes.get("class", "")))
                stack.append(len(nodes) - 1)
                places.setdefault(tag, []).append(len(stack) - 1)
                if tag in BLOCK:
                    blocks.append(len(stack) - 1)
                if not out and no_article(tag, attributes, articles > 0):
                    out = len(stack) - 1
                if not out and named_so(tag, attributes):
                    named[stack[-1]] = named_so(tag, attributes, NEVER_ARTICLE_WORDS)
                articles += tag == "article"
        if not out:
            if tag in BLOCK:
                pieces.append((stack[-1], None))
            elif tag in ("td", "th"):
                pieces.append((stack[-1], " "))


def without_named(nodes, pieces, named):
    """The pieces outside of the elements that their names and their share of the page's text leave out."""
    chars, links, anchor = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    for i in range(1, len(nodes)):
        anchor[i] = nodes[i][1] == "a" or anchor[nodes[i][0]]
    for i, text in pieces:
        if text:
            n = len(text.strip())
            chars[i] += n
            links[i] += n * anchor[i]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i][0]] += chars[i]
        links[nodes[i][0]] += links[i]
    plain = [c - x for c, x in zip(chars, links)]
    # text of the article elements within each node, for nodes that are in none
    kind = next((t for t in ("article", "main") if any(x[1] == t for x in nodes)), None)
    within, articles = [False] * len(nodes), [0] * len(nodes)
    for i in range(1, len(nodes)):
        up = nodes[i][0]
        within[i] = within[up] or nodes[i][1] == kind
        articles[i] = plain[i] if within[i] and not within[up] else 0
    for i in range(len(nodes) - 1, 0, -1):
        articles[nodes[i][0]] += articles[i]
    heavy = {i for i in named if 2 * links[i] > chars[i]}
    beside = {i for i in named if not within[i] and plain[i] <= 10 * (articles[0] - articles[i])}
    never = {i for i in named if named[i]}
    for left_out in ({i for i in named if 2 * plain[i] <= plain[0] - sum(plain[x] for x in never)} | beside | heavy | never, {i for i in named if 2 * plain[i] <= plain[0]} | beside | heavy, heavy):
        gone = [False] * len(nodes)
        for i in range(1, len(nodes)):
            gone[i] = i in left_out or gone[nodes[i][0]]
        if 10 * sum(plain[i] for i in left_out if not gone[nodes[i][0]]) <= 9 * plain[0]:
            break
    return [x for x in pieces if not gone[x[0]]]


def densities(nodes, pieces, body: int):
    """Characters, link characters, composite text density and density sum (of the children) of each node."""
    n = len(nodes)
    chars, tags, link_chars, link_tags = [0] * n, [1] * n, [0] * n, [0] * n
    for i, text in pieces:
        if text:
            chars[i] += len(text.strip())
    for i in range(n - 1, 0, -1):
        up = nodes[i][0]
        if nodes[i][1] == "a":
            link_chars[i], link_tags[i] = chars[i], tags[i]
        chars[up] += chars[i]
        tags[up] += tags[i]
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i]
    of_body = link_chars[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c, lc = chars[i], link_chars[i]
        if c:
            x = c * lc / max(c - lc, 1) + of_body * c + math.e
            ratio = c / max(lc, 1) * tags[i] / max(link_tags[i], 1)
            density[i] = c / tags[i] * max(math.log(ratio), 0.0) / max(math.log(math.log(x)), 0.5) if ratio > 0 else 0.0
        if i:
            sums[nodes[i][0]] += density[i]
    return chars, link_chars, density, sums


def extract(page: str | None) -> str:
    if not page:
        return ""
    nodes, pieces, named = parse(page)
    if named:
        pieces = without_named(nodes, pieces, named)
    n = len(nodes)
    body = next((i for i, x in enumerate(nodes) if x[1] == "body"), 0)
    chars, link_chars, density, sums = densities(nodes, pieces, body)
    if not chars[0]:
        return ""
    core = max(range(n), key=lambda i: (sums[i], -i))
    if not sums[core]:
        core = body
    path = [core]
    while path[-1] not in (0, body):
        path.append(nodes[path[-1]][0])
    threshold = min(density[i] for i in path)
    plain = [c - x for c, x in zip(chars, link_chars)]
    article = next((i for i in path if nodes[i][1] == "article"), None)
    if article is not None:
        # its fellows that no article holds, where they have a tenth of its text
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[nodes[i][0]] or nodes[nodes[i][0]][1] == "article"
        roots = {article} | {i for i in range(n) if nodes[i][1] == "article" and not inside[i] and 2 * link_chars[i] <= chars[i] and 10 * plain[i] >= plain[article]}
    else:
        roots, children = {core}, [[] for _ in nodes]
        for i in range(1, n):
            children[nodes[i][0]].append(i)
        # parts of the article beside the path, whatever their tag and class: mostly no links, a tenth of the text of the
        # path's node there or more, and as dense as the threshold, where half will do as a shorter part is less dense
        for at in path:
            if at in (0, body):
                break
            up = nodes[at][0]
            for i in children[up]:
                if i != at and 2 * link_chars[i] <= chars[i] and 2 * max([density[i], *(density[c] for c in children[i])]) >= threshold and (10 * plain[i] >= plain[at] or density[i] >= threshold and (nodes[i][1:] == nodes[at][1:] or nodes[i][1] in ("p", "h1", "h2", "h3", "ul", "ol", "blockquote", "pre", "table"))):
                    roots.add(i)
    kept = [False] * n
    for i in range(n):
        up = nodes[i][0]
        links = nodes[i][1] in BLOCK and 2 * link_chars[i] > chars[i] and density[i] < threshold
        kept[i] = i in roots or i > 0 and kept[up] and not links
    blocks, held = [], []
    for i, text in [*pieces, (0, None)]:
        if text is None:
            words = " ".join("".join(held).split())
            if words:
                blocks.append(words)
            held = []
        elif kept[i]:
            held.append(text)
    return "\n".join(blocks)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "_text", chars_col: str = "_n_chars") -> DataFrame:
    """The pages with their main text and its length in code points."""
    pages = pages.drop(out_col, chars_col)
    names = pages.columns

    def apply(it):
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(html_col)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, out_col, chars_col])

    return pages.mapInArrow(apply, T.StructType([*pages.schema.fields, T.StructField(out_col, T.StringType()), T.StructField(chars_col, T.LongType())]))
