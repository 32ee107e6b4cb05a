"""HTML extraction by tag-path ratios: text and punctuation per root-to-leaf path, smoothed, fused and thresholded."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, declaration or tag. A "<" that starts none of these is text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is not text of the page.
_RAW = frozenset("script style noscript template textarea title iframe object svg math select xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements and words of class, id or role that mark what is not the article.
_ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|aside|footer|header|"
    r"masthead|cookies?|consent|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|comments?|replies|disqus|"
    r"widget|toolbar|pagination|pager|copyright|legal|disclaimer|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Of these words, the ones that also rule over an article inside the element: comments and teasers are articles themselves.
_OTHERS = re.compile(r"(?:^|[\s_-])(?:related|recommended|comments?|replies|disqus|widget|promo(?:tion)?s?|sponsor(?:ed|s)?|ads?|adverts?|advertisement|advertising)(?:$|[\s_-])", re.I)
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the whole page, so content in them is no element of its own.
_PAGE = frozenset(("", "html", "body"))
_CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = ("ul", "ol", "dl", "table", "tbody", "div", "article", "section", "td", "body")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？«»\"“”]")
#: Standard deviations of the ratios that a content path needs, the reach of the smoothing in blocks, and the linked share of a menu's path.
SPREAD, REACH, LINKS = 1.0, 1, 0.85


@dataclass(slots=True)
class Block:
    """A run of text between block elements."""

    path: int
    node: int
    text: str
    linked: int
    main: bool
    aside: bool


@dataclass
class Page:
    """The blocks of a page in order. A path is the number of a root-to-leaf tag path, a node that of an element; node 0 is the page."""

    blocks: list[Block]
    tags: list[str]
    parents: list[int]


def parse(page: str) -> Page:
    """The blocks of a page with their paths and elements. Inline elements are not part of a path; white space is one space."""
    stack: list[tuple[str, int, int, bool, str]] = []  # tag, path, node, whether in main content, why it is aside
    tags, parents, paths = [""], [0], {}
    out: list[Block] = []
    words: list[str] = []
    linked = depth_a = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            _, path, node, main, aside = stack[-1] if stack else ("", 0, 0, False, "")
            out.append(Block(path, node, text, linked, main, aside != ""))
        words.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            words.append(text)
            linked += len(text) if depth_a else 0

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    while True:
        token = _TOKEN.search(page, at)
        add(page[at : token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        ending, name = token[1] == "/", token[2].lower()
        if name in _INLINE:
            depth_a = max(0, depth_a + (-1 if ending else 1)) if name == "a" else depth_a
            words.append(" " if name == "br" else "")
            continue
        flush()
        if ending:
            depth_a = 0
            close(name)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k][0]
                if tag in _SAME[name]:
                    del stack[k:]
                    break
                if tag in _STOPS:
                    break
        if name in _VOID:
            continue
        marks = " ".join(next(filter(None, m), "") for m in _MARK.findall(token[3] or ""))
        _, path, node, main, aside = stack[-1] if stack else ("", 0, 0, False, "")
        if name in _MAIN and not main and aside == "layout":
            aside = ""
        if name in _ASIDE and not (name == "header" and main):
            aside = "element"
        elif aside != "element" and name not in ("body", "html", *_MAIN) and _NOISE.search(marks):
            aside = "element" if main or _OTHERS.search(marks) else aside or "layout"
        label = name + ("." + marks.split()[0] if marks.split() else "")
        tags.append(name)
        parents.append(node)
        stack.append((name, paths.setdefault((path, label), len(paths) + 1), len(tags) - 1, main or name in _MAIN, aside))
    flush()
    return Page(out, tags, parents)


def _smooth(values: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Each value with its neighbours, weighted by distance."""
    weights = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def content_paths(found: list[Block]) -> np.ndarray:
    """Whether each block lies on a content path.

    Of every path, the unlinked text and the punctuation are added up over its blocks; text per block x (1 + punctuation) is its ratio. The ratios are
    handed to the blocks, smoothed in page order, averaged per path again, and fused with the path's own (geometric mean), so that neither a
    short path beside the story nor a lone long one counts as much as the story. Content are the paths that reach SPREAD standard
    deviations of the blocks' fused ratios.
    """
    _, index, count = np.unique([b.path for b in found], return_inverse=True, return_counts=True)
    mean = lambda x: np.bincount(index, x, len(count)) / count
    length = mean(np.array([max(0, len(b.text) - b.linked) for b in found], float))
    own = length * (1 + np.bincount(index, [len(_PUNCTUATION.findall(b.text)) for b in found]))
    fused = np.sqrt(own * mean(_smooth(own[index])))
    return (fused >= SPREAD * fused[index].std())[index]


def container(page: Page, nodes: list[int]) -> tuple[int, bool]:
    """(the deepest element around the parents of these elements, whether it is one of those parents)."""
    above = list(dict.fromkeys(page.parents[n] for n in nodes))

    def chain(node: int) -> Iterator[int]:
        while True:
            yield node
            if node == 0:
                return
            node = page.parents[node]

    common = list(chain(above[0]))
    depth = {node: k for k, node in enumerate(common)}
    top = 0
    for node in above[1:]:
        for up in chain(node):
            if up in depth:
                top = max(top, depth[up])
                break
    return common[top], common[top] in above


def main_text(page: str | None) -> str:
    """The main text of a page.

    The content paths are found by their ratios (``content_paths``) among the blocks outside menus, page headers and footers, sidebars, forms, adverts,
    notices and comments. They lead to the content's element, whose other blocks (headings, lists, tables) belong to the text as well:
    the article and main elements if these hold half of the content, else the element around the content. Where that element is
    the whole page or holds content only inside further elements, the text reaches from the first content block (and the headings right before it) to the last.
    Paths of links are left out. Words in classes and ids never rule out an article in a mere layout element.
    """
    parsed = parse(page or "")
    found = [b for b in parsed.blocks if not b.aside]
    if not found:
        return ""
    chosen = content_paths(found)
    mass = np.array([max(0, len(b.text) - b.linked) for b in found], float) * chosen
    in_main = np.array([b.main for b in found])
    if in_main.any() and 2 * mass[in_main].sum() >= mass.sum():
        kept = in_main
    else:
        kept = np.zeros(len(found), bool)
        around, direct = container(parsed, [b.node for b, c in zip(found, chosen, strict=True) if c])
        if direct and parsed.tags[around] not in _PAGE:
            inside = _within(parsed, around)
            kept[:] = [inside[b.node] for b in found]
        else:
            first, last = np.flatnonzero(chosen)[[0, -1]]
            while first > 0 and parsed.tags[found[first - 1].node] in _HEADINGS:
                first -= 1
            kept[first : last + 1] = True
    _, index = np.unique([b.path for b in found], return_inverse=True)
    size, linked = (np.bincount(index, [f(b) for b in found]) for f in (lambda b: len(b.text), lambda b: min(b.linked, len(b.text))))
    kept = kept & (linked <= LINKS * size)[index]
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def _within(page: Page, node: int) -> np.ndarray:
    """Whether each element is the given one or lies in it; parents come before their children."""
    inside = np.zeros(len(page.tags), bool)
    inside[node] = True
    for k in range(node + 1, len(page.tags)):
        inside[k] = inside[page.parents[k]]
    return inside


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages; repeated rows and rows with a null id or url each keep their own.

    A null or empty page has an empty text; nothing is cut, whatever its length. An empty table has no rows. Only the three named columns
    are read, so others may have any name, those of the result included.
    """

    def extract(pages: pd.Series) -> pd.DataFrame:
        texts = [main_text(p) for p in pages]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    found = F.pandas_udf(extract, "text string, n_chars bigint").asNondeterministic()
    rows = pages.select(F.col(f"`{id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), found(F.col(f"`{page}`")).alias("found"))
    return rows.select("page_id", "url", "found.text", "found.n_chars")
