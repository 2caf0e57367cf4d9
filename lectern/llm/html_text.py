"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and words, in one pass. A word scores by the part of the page it stands in (the
nearest enclosing element whose tag, class, id or role names a part; "other" for a box with a name that says nothing; and
whether it is in a link), a tag scores negative; both weights are log-odds of lying in the content, counted on labelled
pages (PAGES below, whose content is marked, or the caller's own). A linear scan finds the contiguous region with the
largest sum; its first and last block are taken whole. Words of other parts within the main part (an advert amid the story)
count nothing, so they do not end the region. What scores negative within it (menus, adverts, comments ...) is
left out. Boxes with unknown names score negative, as on the labelled pages; where they hold more than twice the words of the
region so found, they are scored like unnamed ones and the page is scanned again. A link in a
block of text counts as text, one that makes up half of its block or more (LINKED) as a link.

Text is decoded once (character references), white space within a block becomes one space, blocks are joined
by a line feed; nothing else is changed, dropped or capped.

Defined results: a null or empty html, or one without content, gives an empty text; a null url stays null;
repeated rows give repeated rows; broken or unclosed markup is read as far as it goes; other columns are
never read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

# Names from the HTML standard.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
SKIP = frozenset("script style textarea title iframe noembed noframes noscript template svg math object head select option datalist button canvas audio video".split())
KEEPS_P = ("button", "td", "th", "table", "caption", "object", "template", "li", "div", "section", "article", "blockquote")
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in RAW}
#: A tag from its "<" on, in one pass: quoted values may hold ">".
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same without regard to quotes, for pages with one that is never closed.
PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: Parts of a page, each with the words that name it in class, id or role.
PARTS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner adsense doubleclick dfp commercial",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses",
    "notice": "cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay paywall toast",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager paging tabs toolbar topbar skip toc tags taglist categories",
    "side": "sidebar side aside related recommended recommendations recommend popular trending widget widgets share sharing social newsletter subscribe subscription signup author-bio complementary",
    "head": "header masthead site-header page-header logo branding",
    "foot": "footer site-footer page-footer foot copyright colophon contentinfo",
    "form": "form login search searchbox",
    "main": "article main content post entry story articlebody article-body post-content entry-content story-body maincontent prose",
}
NAMED = {word: part for part, words in PARTS.items() for word in words.split()}
BY_TAG = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "article": "main", "main": "main"}
#: Containers that are a part of their own, "other", if they have a name that says nothing.
BOXES, NAME = frozenset("div section ul ol dl table".split()), re.compile(r"\b(?:class|id)\s*=\s*[\"']?\s*[^\s\"'>]", re.I)
#: Share of a block's words in links from which on they are judged as links, not as text.
LINKED = 0.5
HEADLINE = frozenset("article main section".split())


def part_of(tag: str, attributes: str, around: str) -> str | None:
    """The part that an element names, or None."""
    found = None
    if attributes:
        for _, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            for word in value.split():
                names = [NAMED[word]] if word in NAMED else [NAMED[x] for x in re.split(r"[-_]+", word) if x in NAMED]
                name = next((x for x in names if x != "main"), names[0] if names else None)
                if name and (found is None or found == "main"):
                    found = name
    own = BY_TAG.get(tag)
    if around == "main" and tag == "header":
        own = None  # the headline of an article
    if around == "main" and found == "head":
        found = None
    if tag in ("body", "html", "p", "h1", "h2", "h3", "h4", "h5", "h6", "a", "b", "i", "em", "strong", "span") and found not in ("ad", "comment", "menu"):
        found = None
    if own == "main" and found in ("head", "foot", "form", "notice", "side"):
        found = None
    if not found and not own and around == "page" and tag in BOXES and attributes and NAME.search(attributes):
        own = "other"
    return found if found and found != "main" else own or found


def tokens(source: str):
    """("w", text), ("c", text of a CDATA section) and ("t", name, attributes, closing) of a page, in one pass.

    A "<" that begins no tag is text; an unclosed comment takes the rest; where a quote in a tag is never closed, that tag
    and all after it end at the next ">"; a tag that never ends is text.
    """
    at, kind, size = 0, TAG, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            yield "w", source[at:]
            return
        after = source[start + 1 : start + 3]
        if after[:1] in ("!", "?"):
            comment, data = source.startswith("<!--", start), source.startswith("<![CDATA[", start)
            closing = "-->" if comment else "]]>" if data else ">"
            end = source.find(closing, start + (2 if comment else 1))
            stop = size if end < 0 else end + len(closing)
            if comment and end < start + 4 and end >= 0:  # <!--> and <!---> are whole
                stop = max(stop, start + 5)
            if start > at:
                yield "w", source[at:start]
            if data:
                yield "c", source[start + 9 : size if end < 0 else end]
            at = stop
            continue
        if not (after[:1].isalpha() and after[:1].isascii() or after[:1] == "/" and after[1:].isalpha() and after.isascii()):
            yield "w", source[at : start + 1]
            at = start + 1
            continue
        found = kind.match(source, start)
        if not found and kind is TAG:
            kind = PLAIN_TAG
            found = kind.match(source, start)
        if not found:
            yield "w", source[at:]
            return
        if start > at:
            yield "w", source[at:start]
        name, closing = found.group(1).lower(), source[start + 1] == "/"
        yield "t", name, found.group(2), closing
        at = found.end()
        if name in RAW and not closing:
            end = RAW_END[name].search(source, at)
            at = end.start() if end else size


class Page:
    """A page as events: (tag, closing, depth of the element) or text runs with their part and place."""

    __slots__ = ("events", "elements")

    def __init__(self, source: str):
        self.events: list[tuple] = []  # ("t", name, closing) or ("w", text, element number)
        self.elements: list[tuple] = [(-1, "#", "page", False, False, False)]  # parent, tag, part, in a link, skipped, within the main part
        stack = [0]
        places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are open

        def close(k: int) -> None:
            for element in stack[k:]:
                places[self.elements[element][1]].pop()
            del stack[k:]

        for token in tokens(source):
            if token[0] == "w":
                self.events.append(("w", " " if token[1].isspace() else token[1], stack[-1]))
                continue
            if token[0] == "c":
                self.events.append(("w", html.escape(token[1]), stack[-1]))
                continue
            _, name, attributes, closing = token
            if closing:
                if places[name]:
                    close(places[name][-1])
                self.events.append(("t", name, True))
                continue
            if name not in INLINE:
                last = lambda x: places[x][-1] if places[x] else 0
                if places["p"] and last("p") > max(map(last, KEEPS_P)):
                    close(last("p"))
                if name in ITEMS and last(name) > max(map(last, ITEMS[name])):
                    close(last(name))
            parent = stack[-1]
            _, _, part, link, skip, main = self.elements[parent]
            if name not in VOID:
                part = part_of(name, attributes, part) or part
                self.elements.append((parent, name, part, link or name == "a", skip or name in SKIP, main or part == "main"))
                if not attributes.endswith("/") or name not in ("svg", "path"):
                    places[name].append(len(stack))
                    stack.append(len(self.elements) - 1)
            self.events.append(("t", name, False))


def within(page: Page, element: int, box: int) -> bool:
    """Whether ``element`` is ``box`` or lies in it."""
    while element > box:
        element = page.elements[element][0]
    return element == box


def blocks_of(page: Page) -> list[int]:
    """For each event the number of its block; a block ends at each tag that is not inline."""
    out, block = [], 0
    for kind, x, _ in page.events:
        block += kind == "t" and x not in INLINE
        out.append(block)
    return out


def linked(page: Page, blocks: list[int]) -> set[int]:
    """The blocks whose words are in links by LINKED or more."""
    words, links = Counter(), Counter()
    for (kind, x, y), block in zip(page.events, blocks):
        if kind == "w" and x != " " and not page.elements[y][4]:
            n = len(x.split())
            words[block] += n
            if page.elements[y][3]:
                links[block] += n
    return {block for block, n in links.items() if n >= LINKED * words[block]}


def feature(page: Page, element: int, dense: bool = True) -> tuple:
    """dense: whether the block is made up of links."""
    _, _, part, link, skip, _ = page.elements[element]
    return ("skip",) if skip else (part, link and dense)


def train(pages: list[str]) -> dict:
    """Weights of words by their part, and of tags, from pages whose content is the element with data-content."""
    inside, outside = Counter(), Counter()
    for source in pages:
        page = Page(re.sub(r"<(\w+)([^>]*) data-content>", r"<\1\2><data-content>", source))
        marks = [i for i, x in enumerate(page.elements) if x[1] == "data-content"]
        if len(marks) != 1:
            raise ValueError("a labelled page has one element with data-content")
        open_ = False
        blocks = blocks_of(page)
        dense = linked(page, blocks)
        for (kind, x, y), block in zip(page.events, blocks):
            if kind == "t":
                if x == "data-content":
                    open_ = True
                elif open_ and y and x == page.elements[page.elements[marks[0]][0]][1]:
                    open_ = False
                (inside if open_ else outside)[("tag", x)] += 1
            elif not x.isspace():
                f = feature(page, y, block in dense)
                good = within(page, y, marks[0]) and f != ("skip",) and f[0] in ("main", "page", "other")
                (inside if good else outside)[f] += len(x.split())
    weights = {}
    for kind in (True, False):
        names = {x for x in (*inside, *outside) if (x[0] == "tag") is kind}
        a, b = (sum(c[x] for x in names) + len(names) for c in (inside, outside))
        for x in names:
            odds = math.log((inside[x] + 1) / a) - math.log((outside[x] + 1) / b)
            weights[x] = min(-0.1, odds / 4 - 0.5) if kind else max(-3.0, min(3.0, odds))
    weights["tag"] = -0.5
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open range with the largest sum, the first of several; (0, 0) if no score is positive."""
    best = total = 0.0
    found, start = (0, 0), 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def regions(page: Page, weights: dict, blocks: list[int], dense: set[int], other: bool) -> tuple[list[bool], int, int, int]:
    """(whether each event is a word that counts as content, the best region, and its words); other: whether boxes of unknown names count like unnamed ones."""
    weight: dict[tuple, float] = {}
    scores, good, counts = [], [], []
    for (kind, x, y), block in zip(page.events, blocks):
        n = 0
        if kind == "t":
            scores.append(weights.get(("tag", x), weights["tag"]))
            good.append(False)
        else:
            f = y, block in dense
            w = weight.get(f)
            if w is None:
                name = feature(page, *f)
                w = weight[f] = weights.get(("page", name[1]) if other and name[0] == "other" else name, -1.0)
            n = 0 if x == " " else len(x.split())
            scores.append(0.0 if w < 0 and page.elements[y][5] else w * n)
            good.append(w > 0)
        counts.append(n)
    start, end = best_region(scores)
    return good, start, end, sum(n for n, k in zip(counts[start:end], good[start:end]) if k)


def extract(source: str | None, weights: dict) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    blocks = blocks_of(page)
    dense = linked(page, blocks)
    good, start, end, words = regions(page, weights, blocks, dense, False)
    unknown = sum(len(x.split()) for (kind, x, y), block in zip(page.events, blocks) if kind == "w" and block not in dense and feature(page, y)[0] == "other")
    if 2 * words < unknown:
        good, start, end, words = regions(page, weights, blocks, dense, True)
    if not words:
        return ""
    while start > 0 and blocks[start - 1] == blocks[start]:
        start -= 1
    while end < len(blocks) and blocks[end] == blocks[end - 1]:
        end += 1
    out, block = [], []
    for (kind, x, y), positive in zip(page.events[start:end], good[start:end]):
        if kind == "t":
            if x == "br":
                block.append(" ")
            elif x not in INLINE:
                out.append("".join(block))
                block = []
        elif positive:
            block.append(x)
    out.append("".join(block))
    return "\n".join(text for x in out if (text := " ".join(html.unescape(x).split())))


_SAY = "the council met on tuesday to hear how the new bridge would be paid for and who would build it"
#: Labelled pages: the content is the element marked with data-content.
PAGES = [
    f'<html><head><title>{_SAY}</title><style>a{{}}</style><script>var a=1;</script></head><body><nav><ul><li><a href=/>home</a></li><li><a href=/n>news</a></li></ul></nav><div class="ad">{_SAY}</div><article data-content><h1>{_SAY}</h1><p>{_SAY * 3}</p><p>{_SAY} <a href=/x>as before</a> {_SAY}</p><p>{_SAY}</p></article><footer>&copy; {_SAY}</footer></body></html>',
    f'<body><header><div class="logo">{_SAY}</div><form action=/s><label>search the site</label></form></header><main data-content><h1>{_SAY}</h1><p>{_SAY * 2}</p><ul><li>{_SAY}</li><li>{_SAY}</li></ul><p>{_SAY}</p></main><aside><h3>related</h3><ul><li><a href=/a>{_SAY}</a></li><li><a href=/b>{_SAY}</a></li></ul></aside><footer><p>{_SAY}</p><a href=/c>contact us here</a></footer></body>',
    f'<body><div id="menu"><a href=/1>one page</a><a href=/2>two page</a><a href=/3>three page</a></div><div class="cookie-notice"><p>{_SAY}</p></div><div class="post-content" data-content><h2>{_SAY}</h2><p>{_SAY * 2}</p><blockquote>{_SAY}</blockquote><p>{_SAY}</p></div><div class="comments"><h3>comments</h3><p>{_SAY}</p><p>{_SAY}</p><form><textarea>say it</textarea></form></div><div class="footer">{_SAY}</div></body>',
    f'<body><div class="sidebar"><p>{_SAY}</p><ul><li><a href=/q>{_SAY}</a></li></ul></div><div data-content><h1>{_SAY}</h1><p>{_SAY * 4}</p><p>{_SAY}</p><table><tr><td>{_SAY}</td><td>{_SAY}</td></tr></table></div><div class="newsletter"><form><p>{_SAY}</p></form></div><p class="copyright">{_SAY}</p></body>',
    f'<body><section data-content><p>{_SAY * 5}</p><p>{_SAY * 2}</p></section><dialog>{_SAY}</dialog><noscript>{_SAY}</noscript><div class="share"><a href=/t>{_SAY}</a></div></body>',
    f'<body><div><a href=/1>home</a> <a href=/2>news</a></div><div class="txt" data-content><h1>{_SAY}</h1><p>{_SAY} <a href=/x>as before</a> {_SAY}</p><p>{_SAY * 2}</p><p><a href=/y>the plan</a> {_SAY}</p></div><div><a href=/3>about us</a> <a href=/4>terms of use</a> <a href=/5>contact us here</a></div></body>',
    f'<body><div class="top-strip">{_SAY}</div><div data-content><h1>{_SAY}</h1><p>{_SAY * 3}</p><p>{_SAY}</p></div><div class="zone-3"><p>{_SAY}</p></div><div id="talkback"><p>{_SAY * 2}</p><p>{_SAY}</p></div></body>',
    f'<body><div id="b7">{_SAY}</div><article data-content><h1>{_SAY}</h1><p>{_SAY * 2}</p></article><section class="opinions"><div>{_SAY * 2}</div></section></body>',
    f'<body><div><a href=/1>home</a></div><article data-content><h1><a href=/s>{_SAY}</a></h1><p>{_SAY * 2}</p><ul><li><a href=/x>{_SAY}</a></li></ul></article><div><a href=/3>about us</a></div></body>',
]
_weights: dict | None = None


def default_weights() -> dict:
    global _weights
    if _weights is None:
        _weights = train(PAGES)
    return _weights


def main_text(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    import pyarrow as pa

    weights = weights or default_weights()

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [extract(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark, sf_dir):
    from .common import table

    return main_text(table(spark, sf_dir, "pages"))
