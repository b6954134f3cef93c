"""Main text of web pages by composite text density.

A page is read into a tree of elements. For every element the characters, link characters, tags and link
tags of its subtree give the composite text density: characters per tag, adjusted by how much of them are
links. The density sum of an element adds the densities of its children; the element with
the greatest sum holds the article. If it stands in an article or main element, that element is the article. Else
the least density on the path from it to the body is the threshold: further children of the path's elements, the body
included, belong to the article too if they are at or above it, if they stand between two that do and are not
mostly links, or if they are headings before one that does; and so does text directly in the path's elements below the body.

Elements that are never article text (scripts, styles, navigation, headers and footers of the page, sidebars,
forms, adverts, notices, comments; by tag, role or class) are taken out before densities are computed. A class or id
that also has a word of a wrapper or state (``has-sidebar``) does not count, and what alone holds the article stays, also a
form, a dialog or a part hidden from screen readers around a whole page.
In the chosen elements nothing is dropped: character references are decoded, white space inside a block
becomes one space, blocks are joined in page order.

The work of a page is linear in its length: a tag ends at the next ``<`` at the latest, so no search for one starts over; what is not
open is not looked for among the open elements; nothing recurses. Nothing is shuffled.

Defined results: a null or empty page, and one without text outside what is taken out, gives an empty text; of equal density
sums the element that begins first wins; tags that are not closed end with their parent or
where HTML ends them; repeated rows are read each; an empty table gives an empty table; further columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul").split())
#: What is never article text.
DROPPED_TAGS = frozenset((
    "script style noscript template iframe svg math head nav aside footer form button select input textarea object embed "
    "dialog menu").split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
#: Of these, what pages put around their whole body; such an element stays if it alone holds the article.
AROUND_TAGS = frozenset("form dialog".split())
AROUND_ROLES = frozenset("form dialog alertdialog".split())
#: Ids and roles of what holds the article, besides the elements made for it.
MAIN_IDS = frozenset("main content article".split())
DROPPED_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar side aside widget widgets footer masthead comment comments "
    "disqus replies respond reply notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended toolbar pagination pager").split())
#: Parts of a class or id that make it one of a wrapper or a state, not of what its other words name.
MODIFIERS = frozenset("has with without no is wrap wrapper enabled disabled on off open closed active layout container page main content".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond reply".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Open elements that a start tag ends, by its name.
_P_ENDERS = BLOCK - {"br", "body", "html", "head", "option", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: The scopes beyond which a start tag of a block does not look for an open paragraph.
_P_SCOPE = frozenset("article aside section main div td th li table body html nav header footer form blockquote button".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: A name without a value is read as well, so that no long one is tried again from each of its characters.
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORD = re.compile(r"[a-z]+")


class Tree:
    """Elements of a page in document order. Node 0 stands above all."""

    def __init__(self):
        self.tag, self.parent, self.dropped = [""], [-1], [False]
        #: Whether an element is, or stands in, one that holds an article.
        self.in_main = [False]
        #: What the page shows, in order: (node, text), or (node, None) where a block begins or ends.
        self.shown: list[tuple[int, str | None]] = []
        #: Elements with a dropped word in class or id, and whether it is one of comments.
        self.named: dict[int, bool] = {}
        #: Forms and the like, which stay if they alone hold the article.
        self.around: set[int] = set()

    def add(self, tag: str, parent: int, attributes: str) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.in_main.append(self.in_main[parent] or tag in ARTICLE)
        self.dropped.append(self.dropped[parent] or self._drops(node, tag, attributes))
        return node

    def _drops(self, node: int, tag: str, attributes: str) -> bool:
        if tag in AROUND_TAGS:
            self.around.add(node)
        elif tag in DROPPED_TAGS or tag == "header" and not self.in_main[node]:  # an article's own header holds its title
            return True
        if not attributes or tag in ("html", "body", "article", "main"):
            return False
        named = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "role" and value in AROUND_ROLES or name == "aria-hidden" and value == "true":
                self.around.add(node)
            elif name == "role" and value in DROPPED_ROLES:
                return True
            if name == "role" and value == "main" or name == "id" and value in MAIN_IDS:
                self.in_main[node] = True
            if name in ("class", "id"):
                for token in value.split():
                    parts = set(_WORD.findall(token))
                    if MODIFIERS.isdisjoint(parts):
                        named |= parts & DROPPED_WORDS
        if named:
            self.named[node] = not named.isdisjoint(COMMENT_WORDS)
        return bool(re.search(r"(?i)(?:^|\s)hidden(?:\s|$|=)|display\s*+:\s*+none", attributes))


class Stack:
    """The open elements, and how many there are of each name."""

    def __init__(self, tree: Tree):
        self.tree, self.nodes, self.open = tree, [0], Counter()

    def push(self, node: int) -> None:
        self.nodes.append(node)
        self.open[self.tree.tag[node]] += 1

    def close(self, names: set | frozenset, scope: set | frozenset = frozenset()) -> bool:
        """Closes the innermost element of one of these names and all in it, unless one of the scope comes first."""
        if not any(self.open[n] for n in names):
            return False
        for depth in range(len(self.nodes) - 1, 0, -1):
            tag = self.tree.tag[self.nodes[depth]]
            if tag in names:
                self.open.subtract(self.tree.tag[n] for n in self.nodes[depth:])
                del self.nodes[depth:]
                return True
            if tag in scope:
                return False
        return False


def read_tree(html: str) -> Tree:
    tree, at = Tree(), 0
    stack, shown = Stack(tree), tree.shown
    while at < len(html):
        found = _TOKEN.search(html, at)
        if found is None:
            shown.append((stack.nodes[-1], html[at:]))
            break
        if found.start() > at:
            shown.append((stack.nodes[-1], html[at:found.start()]))
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag in BLOCK:
            shown.append((stack.nodes[-1], None))
        if found[1]:
            stack.close({tag})
            continue
        if tag in _P_ENDERS:
            while stack.close({"p"}, _P_SCOPE):
                pass
        if tag in _ENDS:
            while stack.close(*_ENDS[tag]):
                pass
        attributes = found[3]
        node = tree.add(tag, stack.nodes[-1], attributes)
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            # Case does not matter, and lowering may change lengths of other characters than ASCII.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^<>]*+>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.push(node)
    drop_around(tree)
    drop_named(tree)
    return tree


def _plain_characters(tree: Tree) -> list[int]:
    """Characters outside links, white space apart, of every element's subtree, what is dropped left out."""
    n = len(tree.tag)
    link, chars = [False] * n, [0] * n
    for i in range(1, n):
        link[i] = link[tree.parent[i]] or tree.tag[i] == "a"
    for node, text in tree.shown:
        if text is not None and not tree.dropped[node] and not link[node]:
            chars[node] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
    return chars


def drop_around(tree: Tree) -> None:
    """Drops forms, dialogs and parts hidden from screen readers.

    Those stay that hold an article element, if no other part of the page does; and, on a page without one, those that hold a
    paragraph and most of the page's characters outside links.
    """
    if not tree.around:
        return
    n = len(tree.tag)
    inside, holds, paragraph = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or i in tree.around
        holds[i] = tree.tag[i] in ARTICLE and not tree.dropped[i]
        paragraph[i] = tree.tag[i] in ("p", "blockquote", "pre") and not tree.dropped[i]
    left = any(holds[i] and not inside[i] for i in range(n))
    some = any(holds)
    chars = _plain_characters(tree)
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] |= holds[i]
        paragraph[tree.parent[i]] |= paragraph[i]
    for i in range(1, n):
        stays = not left and i in tree.around and (holds[i] or not some and paragraph[i] and 2 * chars[i] > chars[0])
        tree.dropped[i] = tree.dropped[i] or tree.dropped[tree.parent[i]] or i in tree.around and not stays


def drop_named(tree: Tree) -> None:
    """Drops the elements named by a dropped word.

    If the page has no article element outside of them, those that hold one stay, and so do those, comments apart,
    that hold most of the page's characters outside links.
    """
    if not tree.named:
        return
    n = len(tree.tag)
    inside, holds, chars = [False] * n, [False] * n, [0] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or i in tree.named
        holds[i] = tree.tag[i] in ARTICLE and not tree.dropped[i]
    left = any(holds[i] and not inside[i] for i in range(n))
    if not left:
        chars = _plain_characters(tree)
        for i in range(n - 1, 0, -1):
            holds[tree.parent[i]] |= holds[i]
    for i in range(1, n):
        stays = not left and i in tree.named and not tree.named[i] and (holds[i] or 2 * chars[i] > chars[0])
        tree.dropped[i] = tree.dropped[i] or tree.dropped[tree.parent[i]] or i in tree.named and not stays


def densities(tree: Tree) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite text density, density sum, characters and link characters of every node that is not dropped (others 0)."""
    n = len(tree.tag)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    inside_link = [False] * n
    for i in range(1, n):
        inside_link[i] = inside_link[tree.parent[i]] or tree.tag[i] == "a"
    for node, text in tree.shown:
        if text is not None and not tree.dropped[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if inside_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):  # children come after their parents
        if tree.dropped[i]:
            continue
        up = tree.parent[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    all_chars, all_links = max(chars[0], 1), link_chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        if tree.dropped[i] or not chars[i]:
            continue
        c, lc, t, lt = chars[i], link_chars[i], max(tags[i], 1), max(link_tags[i], 1)
        plain = max(c - lc, 1)
        base = math.log(c / plain * lc + all_links / all_chars * c + math.e)
        inner = c / max(lc, 1) * t / lt
        density[i] = c / t * (math.log(inner) / math.log(base) if base > 1.0001 and inner > 1 else 1.0)
        total[tree.parent[i]] += density[i]
    return density, total, chars, link_chars


def article_nodes(tree: Tree) -> list[bool]:
    """Which nodes belong to the article."""
    n = len(tree.tag)
    density, total, chars, links = densities(tree)
    chosen = [False] * n
    best = max(range(n), key=lambda i: (total[i], -i)) if n else 0
    if not total[best]:
        best = max(range(n), key=lambda i: (density[i], -i))
    path = [best]
    while path[-1] > 0:
        path.append(tree.parent[path[-1]])
    outer = max((k for k, i in enumerate(path) if tree.tag[i] in ARTICLE), default=None)
    chosen[best] = True
    if outer is not None:  # what an article element holds is the article
        chosen[path[outer]] = True
        for i in range(path[outer] + 1, n):
            chosen[i] = chosen[i] or chosen[tree.parent[i]]
        return chosen
    body = next((k for k, i in enumerate(path) if tree.tag[i] in ("body", "html", "")), len(path) - 1)
    path = path[:body + 1]
    threshold = min(density[i] for i in path)
    on_path = set(path)
    beside = {i: [] for i in path[1:]}
    for i in range(1, n):
        if tree.parent[i] in beside and not tree.dropped[i] and density[i] > 0:
            beside[tree.parent[i]].append(i)
    for children in beside.values():
        kept = [i in on_path or density[i] >= threshold for i in children]
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for k in range(first, last):
            kept[k] = kept[k] or 2 * links[children[k]] <= chars[children[k]]
        for k in range(len(kept) - 2, -1, -1):  # a heading belongs to what follows it
            kept[k] = kept[k] or kept[k + 1] and tree.tag[children[k]] in HEADINGS
        for i, keep in zip(children, kept):
            chosen[i] = keep and i not in on_path or chosen[i]
    for i in range(1, n):
        up = tree.parent[i]
        chosen[i] = chosen[i] or i not in on_path and chosen[up]
    for i in path[:-1]:
        chosen[i] = True
    return chosen


def main_text(html: str | None) -> str:
    """The article of a page as one line."""
    if not html:
        return ""
    tree = read_tree(html)
    chosen = article_nodes(tree)
    out: list[str] = []
    for node, text in tree.shown:
        if text is None:
            out.append(" ")
        elif chosen[node] and not tree.dropped[node]:
            out.append(unescape(text) if "&" in text else text)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def extract_text(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: its main text and the text's length in code points."""
    import pyarrow as pa

    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    types = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"page_id {types[0]}, url {types[1]}, text string, n_chars bigint")
