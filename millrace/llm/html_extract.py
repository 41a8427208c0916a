"""Operator 6: main text of web pages by tree scoring.

One pass of a forgiving tag scanner builds the element tree of a page with the
closing tags that HTML implies, and the blocks of text between block elements.
Elements that carry no article by their kind, role or class (menus, headers and
footers of the site, sidebars, notices, adverts, forms, comments, code) are set
aside. Every other block gives points for its length and commas to its
container and, less and less, to the containers above, discounted by the share
of its text that is links. The container with most points is the article,
widened to the article or main element around it; siblings that have a fair
share of its points stay too.

Null html is empty html; a page without article gives an empty text and
n_chars 0. Of containers of equal points the outermost wins, which stands first in
the page. Pages of any length and depth are read whole, without recursion.
Extra columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
# what may stand within a paragraph without ending it
PHRASING = INLINE | frozenset("script style noscript template svg math canvas object iframe audio video map button input select textarea label embed".split())
NEVER = frozenset("head script style noscript template nav footer aside form iframe svg math canvas object embed audio video button select option textarea input dialog menu title xmp noembed noframes map datalist".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre li blockquote dt dd figcaption td th caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Words of a class or id that mark an element as no part of an article.
ASIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
    breadcrumb breadcrumbs header masthead footer sidebar aside rail notice notices cookie cookies consent gdpr alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    widget pagination pager toolbar form search skip""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion reply replies respond responses".split())
#: Words that speak for an article, whatever else a class says.
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/>]|$))", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def set_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element carries no article by its kind, role or class."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "role":
            if value.lower() in ASIDE_ROLES:
                return True
        elif tag not in ("html", "body"):
            words = set(WORDS.findall(CAMEL.sub(" ", value).lower()))
            if words & COMMENT_WORDS or (words & ASIDE_WORDS and not words & ARTICLE_WORDS and tag not in ("article", "main")):
                return True
    return False


class Page:
    """The element tree of a page and its blocks of text."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.aside: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(source)

    def _read(self, source: str) -> None:
        tags, parents, asides = self.tag, self.parent, self.aside
        stack, open_count = [0], {}
        buffer: list[tuple[str, bool]] = []
        links = articles = 0

        def flush() -> None:
            if buffer:
                text = " ".join("".join(x for x, _ in buffer).split())
                if text:
                    at = len(stack) - 1
                    while at and tags[stack[at]] in PHRASING:
                        at -= 1
                    linked = sum(len("".join(x.split())) for x, y in buffer if y)
                    self.blocks.append((stack[at], text, linked))
                buffer.clear()

        def pop_to(depth: int) -> None:
            nonlocal links, articles
            while len(stack) > depth:
                t = tags[stack.pop()]
                open_count[t] -= 1
                links -= t == "a"
                articles -= t in ("article", "main")

        def close(names: frozenset[str], limit: frozenset[str]) -> None:
            if not any(open_count.get(n) for n in names):
                return
            found = 0
            for d in range(len(stack) - 1, 0, -1):
                t = tags[stack[d]]
                if t in limit:
                    break
                if t in names:
                    found = d
            if found:
                flush()
                pop_to(found)

        p_only, nothing = frozenset(["p"]), frozenset(["table", "td", "th", "button", "#root"])
        position, end = 0, len(source)
        while position < end:
            m = TAG.search(source, position)
            cut = m.start() if m else end
            if cut > position and not asides[stack[-1]]:
                buffer.append((entities.unescape(source[position:cut]), links > 0))
            if not m:
                break
            position = m.end()
            if not m[2]:
                continue  # comments, CDATA sections, declarations
            name = m[2].lower()
            if m[1]:
                if not open_count.get(name):
                    continue
                inline = name in PHRASING
                for d in range(len(stack) - 1, 0, -1):
                    t = tags[stack[d]]
                    if t == name:
                        if not inline:
                            flush()
                        pop_to(d)
                        break
                    if inline and t not in PHRASING:
                        break
                continue
            if name not in PHRASING:
                close(p_only, nothing)
                if name in CLOSES:
                    close(*CLOSES[name])
                flush()
            elif name == "br":
                buffer.append((" ", False))
            if name in VOID or (m[3].endswith("/") and name in ("svg", "path")):
                continue
            tags.append(name)
            parents.append(stack[-1])
            asides.append(asides[stack[-1]] or set_aside(name, m[3], articles > 0))
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, position)
                position = stop.end() if stop else end
                continue
            stack.append(len(tags) - 1)
            open_count[name] = open_count.get(name, 0) + 1
            links += name == "a"
            articles += name in ("article", "main")
        flush()

    def main_text(self) -> str:
        tags, parents, n = self.tag, self.parent, len(self.tag)
        points, size, linked, link_blocks = [0.0] * n, [0] * n, [0] * n, [0] * n
        blocks = [b for b in self.blocks if not self.aside[b[0]]]
        if not blocks:
            return ""
        for element, text, in_links in blocks:
            size[element] += len(text)
            linked[element] += min(in_links, len(text))
            link_blocks[element] += in_links > 0
        for e in range(n - 1, 0, -1):  # children come after their parents
            size[parents[e]] += size[e]
            linked[parents[e]] += linked[e]
            link_blocks[parents[e]] += link_blocks[e]
        for element, text, in_links in blocks:
            length = len(text)
            worth = (1 + text.count(",") + min(length / 100, 3) if length >= 25 else length / 100) * (1 - min(in_links, length) / length)
            if worth <= 0:
                continue
            at, level = (parents[element] if tags[element] in PARAGRAPHS else element), 0
            while at > 0:
                points[at] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                at, level = parents[at], level + 1
        best, most = 0, 0.0
        for e in range(1, n):
            if points[e] and not self.aside[e] and tags[e] not in PARAGRAPHS:
                score = points[e] * (1 - linked[e] / size[e])
                if score > most:
                    best, most = e, score
        at = best
        while at > 0:
            if tags[at] in ("article", "main") and not self.aside[at]:
                best = at
            at = parents[at]
        kept = {best}
        if best and tags[best] not in ("body", "html"):
            for e in range(1, n):
                if parents[e] == parents[best] and size[e] and not self.aside[e]:
                    dense = linked[e] / size[e]
                    if points[e] * (1 - dense) >= 0.2 * max(most, points[best]) or (tags[e] in PARAGRAPHS and size[e] > 80 and dense < 0.25) or (tags[e] in HEADINGS and e < best and dense < 0.25):
                        kept.add(e)
        inside = [False] * n
        for e in range(n):
            inside[e] = e in kept or (e > 0 and inside[parents[e]])
            if inside[e] and e not in kept and tags[e] in ("ul", "ol", "div", "section", "table") and link_blocks[e] >= 3 and linked[e] > 0.75 * size[e]:
                inside[e] = False  # a menu within the article
                kept.discard(e)
        return "\n\n".join(text for element, text, _ in blocks if inside[element])


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page. A narrow plan: no shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, url_column, "text", "n_chars"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_column, url_column)}
    return df.select(id_column, url_column, html_column).mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{url_column}` {kinds[url_column]}, text string, n_chars long")
