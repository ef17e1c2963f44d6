"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf path of block elements.
Per path, text length and punctuation are summed over its blocks; both ratios (per block)
are smoothed over neighbouring paths in page order, fused and compared with a threshold.
The element that holds nearly all of the selected paths' text is the content node; its
blocks are returned, so a short heading or paragraph inside the article is never lost, but
for paths whose text is nearly all links. Elements that by name or class hold menus,
notices, forms, comments and the like count with weight zero, unless they hold the article
or, on pages without one, most of the text; ``html``, ``body``, ``main`` and ``article``
never do, and a heading in an article's own header belongs to it. Pages are independent:
one Arrow-batched pass, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and class words for what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body main section div center article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript object script select style svg template textarea title".split())
NOISE_TAGS = frozenset("aside button dialog fieldset footer form head header menu nav search".split())
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "overlay popup promo promoted promotion related replies reply share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget alert disclaimer signup login search".split()
)
NOT_THERE = frozenset("has no non not one two with without".split())
ALWAYS_NOISE = frozenset("aside button dialog footer head menu nav search".split())  # unless an article is inside
NEVER_NOISE = frozenset("html body main article".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot tr article section div body main blockquote td th".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、！？]")
SHARE, LEVEL = 0.9, 0.25
MOST_TEXT, MOST_LINKS = 0.6, 0.8


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in NEVER_NOISE:
        return False
    if tag in NOISE_TAGS:
        return True
    if not attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for token in value.split():
                words = re.split(r"[^a-z]+", token)
                if words[0] not in NOT_THERE and not NOISE_WORDS.isdisjoint(words):
                    return True
        if name == "hidden" or name == "role" and value in NOISE_ROLES:
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Page(NamedTuple):
    """Text blocks in page order as (path, text, characters in links), and what each path is.

    Path 0 is the root, children have higher numbers than their parents. ``elements`` is
    how many elements a path has, ``noise`` whether they hold no article text by name.
    """

    blocks: list[tuple[int, str, int]]
    parents: list[int]
    tags: list[str]
    elements: list[int]
    noise: list[bool]


def blocks_of(page: str) -> Page:
    """Text blocks and their paths; text of inline elements that are noise is left out."""
    parents, tags, elements, flags, numbers = [0], [""], [1], [False], {}
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, path, inline noise
    blocks: list[tuple[int, str, int]] = []
    parts: list[str] = []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                blocks.append((stack[-1][1], text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][2]:
            parts.append(text)
            linked += len(text) if in_link else 0

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not closing
        if closing:
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if open_at:
                if tag in BLOCKS:
                    flush()
                del stack[open_at:]
            elif tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1][0] == "p":
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in HOLDERS and tag not in ("tr", "td", "th") or stack[i][0] in ("table", "ul", "ol", "dl"):
                    break
            noise = _is_noise(tag, attributes)
            label = tag + (" " + attributes.strip() if attributes and (noise or tag in ("div", "section", "td")) else "")
            path = numbers.setdefault((stack[-1][1], label), len(parents))
            if path == len(parents):
                parents.append(stack[-1][1])
                tags.append(tag)
                elements.append(0)
                flags.append(noise)
            elements[path] += 1
            stack.append((tag, path, stack[-1][2]))
        elif not stack[-1][2] and _is_noise(tag, attributes):
            # An inline element is kept on the stack only where its text is to be left out.
            stack.append((tag, stack[-1][1], True))
    flush()
    return Page(blocks, parents, tags, elements, flags)


def without_noise(page: Page) -> list[tuple[int, str, int]]:
    """Blocks that no noise holds; what holds the article or most text is not noise."""
    _, parents, tags, _, noise = page
    n = len(parents)
    chars, paragraphs = [0] * n, [0] * n
    for path, text, _ in page.blocks:
        chars[path] += len(text)
        paragraphs[path] += tags[path] in HEADINGS or tags[path] == "p"
    articles = [chars[p] > 0 and tags[p] in ("article", "main") for p in range(n)]
    for p in range(n - 1, 0, -1):
        chars[parents[p]] += chars[p]
        paragraphs[parents[p]] += paragraphs[p]
        articles[p] |= chars[p] > 0 and tags[p] in ("article", "main")
        articles[parents[p]] |= articles[p]
    out, in_article, in_header = [False] * n, [False] * n, [False] * n
    for p in range(1, n):
        above = parents[p]
        in_article[p] = in_article[above] or tags[p] in ("article", "main")
        holds_most = paragraphs[p] and chars[p] >= MOST_TEXT * chars[0] and tags[p] not in ALWAYS_NOISE
        forgiven = articles[p] or holds_most and not articles[0]
        own_header = noise[p] and tags[p] == "header" and in_article[above] and not out[above]
        in_header[p] = in_header[above] or own_header and not forgiven
        out[p] = out[above] or noise[p] and not forgiven and not own_header
    headed = [False] * n
    for p in range(1, n):
        headed[p] = headed[parents[p]] or tags[p] in HEADINGS
    return [b for b in page.blocks if not out[b[0]] and (headed[b[0]] or not in_header[b[0]])]


def _smooth(values: list[float]) -> list[float]:
    """Each value with half the weight of its neighbours, edges repeated."""
    padded = [values[0], *values, values[-1]]
    return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]


def content_node(blocks: list[tuple[int, str, int]], page: Page) -> int:
    """The deepest container that holds nearly all text of the paths above the threshold.

    An article or main element ends the search, and so does a container beside whose
    successor a heading stands: the heading belongs to the text.
    """
    _, parents, tags, elements, _ = page
    order = list(dict.fromkeys(p for p, _, _ in blocks))
    length, marks, count = dict.fromkeys(order, 0), dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for path, text, _ in blocks:
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
    text_ratio = _smooth([length[p] / count[p] for p in order])
    mark_ratio = _smooth([marks[p] / count[p] for p in order])
    # Smoothing spreads the ratios; each path keeps its own text as weight.
    fused = [t * (1 + m) for t, m in zip(text_ratio, mark_ratio, strict=True)]
    bar = LEVEL * max(fused)
    selected = {p: length[p] for p, score in zip(order, fused, strict=True) if score >= bar}
    below = [0] * len(parents)
    for p, n in selected.items():
        below[p] += n
    for p in range(len(parents) - 1, 0, -1):  # children have higher numbers
        below[parents[p]] += below[p]
    children: list[list[int]] = [[] for _ in parents]
    for p in range(1, len(parents)):
        children[parents[p]].append(p)
    headed = {parents[p] for p in order if tags[p] in HEADINGS}
    node, whole = 0, below[0]
    while tags[node] not in ("article", "main") and node not in headed:
        deeper = [p for p in children[node] if tags[p] in CONTAINERS and elements[p] == 1 and below[p] >= SHARE * whole]
        if not deeper:
            break
        node = deeper[0]
    return node


def link_paths(blocks: list[tuple[int, str, int]], tags: list[str]) -> set[int]:
    """Paths of several blocks, no headings or paragraphs, that are nearly all links."""
    chars, linked, count = Counter(), Counter(), Counter()
    for path, text, n in blocks:
        chars[path] += len(text)
        linked[path] += n
        count[path] += 1
    return {p for p, n in linked.items() if count[p] > 1 and n >= MOST_LINKS * chars[p] and tags[p] != "p" and tags[p] not in HEADINGS}


def main_text(html_text: str | None) -> str:
    page = blocks_of(html_text or "")
    blocks = without_noise(page)
    links = link_paths(blocks, page.tags)
    blocks = [b for b in blocks if b[0] not in links]
    if not blocks:
        return ""
    node = content_node(blocks, page)
    inside = [False] * len(page.parents)
    inside[node] = True
    for p in range(node + 1, len(page.parents)):
        inside[p] = inside[page.parents[p]]
    return "\n\n".join(text for path, text, _ in blocks if inside[path])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: the id and url columns, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by an empty line. Null and empty pages, and pages without text outside
    noise, give the empty text. Unclosed and truncated markup is read to the end of the
    page. Repeated rows each get their row; other columns are left out.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    texts = pages.select(F.col(id_col), F.col(url_col), read(F.col(html_col)).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
