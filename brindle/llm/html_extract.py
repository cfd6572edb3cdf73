"""HTML extraction: the main text of a page by tag-path ratios.

A page is cut into text blocks, each with the path of tags from the root. Per path, text
length and punctuation are summed over its blocks; the ratios are smoothed over paths that
are neighbours in the page, fused with the ratio of the section that holds them, and paths
below a threshold drop out with all their blocks. What names say (nav, footer, class "ad",
article) is a prior on the ratios.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from brindle.llm.common import map_frames, ship

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?。，…¿¡]")

#: Their content isn't text of the page.
_RAW = frozenset("script style title textarea noscript template iframe svg math canvas object audio video xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul legend select option button".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table select body article section div main".split())
#: Elements that are never part of an article.
_FURNITURE = frozenset("head nav footer aside form menu dialog select button fieldset search".split())
#: Words in a class, id or role that mean the same.
_FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements adsense advertising banner banners sponsor sponsored promo promos promotion popup modal overlay cookie cookies consent gdpr notice notices notification notifications alert alerts menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer sidebar rail widget widgets comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations teaser newsletter subscribe signup login toolbar pagination pager copyright disclaimer complementary contentinfo tags hidden".split()
)
_ROOTS = frozenset(("html", "body"))
_CONTENT = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2"))

#: Share of the largest fused ratio that a path has to reach.
THRESHOLD = 0.1
#: What being in an article multiplies a path's fused ratio by.
ARTICLE = 4.0
#: And what a part of a longer name does, such as share in "share-price".
PART_OF_NAME = 0.1
PART, NAMED, HIDDEN = 1, 2, 3


def _boilerplate(tag: str, attributes: str, inside: bool) -> int:
    """What an element is by its names: 0 text, PART (a part of a longer name says so), NAMED furniture, or HIDDEN."""
    if tag in _FURNITURE:
        return NAMED
    plain = NAMED if tag == "header" and not inside else 0
    if not attributes.strip() or tag in _ROOTS:
        return plain
    words: set[str] = set()
    whole: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words.update(x.lower() for x in _NAME_PARTS.findall(value))
            whole.update(value.lower().split())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HIDDEN
    if inside:
        words.discard("header")
        whole.discard("header")
    return NAMED if whole & _FURNITURE_WORDS else max(plain, PART if words & _FURNITURE_WORDS else 0)


def text_blocks(page: str) -> list[tuple[str, str, int, int, bool]]:
    """Blocks in page order: path, text, characters of it in links, furniture (0, PART or more), in an article.

    A name says nothing of an element that holds the largest article, or over half of the text.
    """
    out: list[tuple[str, str, int, tuple, tuple]] = []
    # name, path, (number, kind) of the elements around that are furniture, numbers of the articles around
    stack: list[tuple[str, str, tuple, tuple]] = [("", "", (), ())]
    number = 0
    parts: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((stack[-1][1], text, min(linked, len(text)), *stack[-1][2:]))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        flush()
        del stack[k:]

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece)

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if not ending and tag in _RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = found.end() if found else size
            continue
        if tag in _VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link = not ending
        if tag not in _BLOCKS:
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        flush()
        if stack[-1][0] == "p" or stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[0] == "h" and tag in _BLOCKS:
            close(len(stack) - 1)
        if tag == "body" and any(x[0] == "head" for x in stack):
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if ends := _CLOSED_BY.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    if tag != "tr" or stack[-1][0] != "tr":
                        break
                elif stack[k][0] in _SCOPES:
                    break
        _, path, marks, articles = stack[-1]
        number += 1
        if kind := _boilerplate(tag, m[3], bool(articles)):
            marks = (*marks, (number, kind))
        stack.append((tag, f"{path}/{tag}", marks, (*articles, number) if tag in _CONTENT else articles))
    flush()
    sizes: dict[int, int] = {}
    around: dict[int, tuple] = {}
    for _, text, _, marks, articles in out:
        for k in (*(k for k, _ in marks), *articles):
            sizes[k] = sizes.get(k, 0) + len(text)
        for k in articles:
            around[k] = tuple(x for x in marks if x[0] < k)
    largest = max(around, key=lambda k: (sizes[k], -k), default=None)
    half = sum(len(x[1]) for x in out) / 2
    holds = {k for k, _ in around.get(largest, ())} | {k for k, n in sizes.items() if n > half}
    return [(path, text, linked, max((kind for k, kind in marks if kind == HIDDEN or k not in holds), default=0), bool(articles)) for path, text, linked, marks, articles in out]


def _section(path: str) -> str:
    """The path of the element that holds the blocks of a path."""
    return path.rpartition("/")[0]


def path_scores(blocks: list[tuple[str, str, int, int, bool]]) -> dict[tuple[str, int, bool], float]:
    """Fused ratio per path, its prior included."""
    totals: dict[tuple[str, int, bool], list[float]] = {}
    for path, text, linked, bad, good in blocks:
        t = totals.setdefault((path, bad, good), [0, 0, 0, 0])
        t[0] += len(text)
        t[1] += len(_PUNCTUATION.findall(text))
        t[2] += linked
        t[3] += 1
    keys = list(totals)
    # Text and punctuation a block, less what is in links.
    raw = [(t[0] - t[2]) / t[3] * (1 + t[1] / t[3]) for t in totals.values()]
    smooth = [(2 * raw[k] + raw[max(k - 1, 0)] + raw[min(k + 1, len(raw) - 1)]) / 4 for k in range(len(raw))]
    section: dict[tuple[str, int, bool], float] = {}
    for key, x in zip(keys, raw, strict=True):
        s = (_section(key[0]), *key[1:])
        section[s] = max(section.get(s, 0.0), x)
    fused = {}
    for key, x, own in zip(keys, smooth, raw, strict=True):
        path, bad, good = key
        # Blocks of one section stand or fall together: a heading is short, its paragraphs aren't.
        score = max(min(x, 2 * own), section[(_section(path), bad, good)])
        # In an article a path counts for more, but has to reach the threshold like any other.
        fused[key] = 0.0 if bad > PART else score * (ARTICLE if good else 1.0) * (PART_OF_NAME if bad else 1.0)
    return fused


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; empty for null, empty and textless pages."""
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    scores = path_scores(blocks)
    least = THRESHOLD * max(scores.values())
    kept = {k for k, v in scores.items() if v >= least and v > 0}
    return "\n".join(text for path, text, _, bad, good in blocks if (path, bad, good) in kept)


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars.

    Rows map one to one, equal and repeated ones too; null ids and urls stay. Null, empty and
    textless pages have an empty text, never a null one. Long pages are read whole, tag by
    tag, in time linear in their length; other columns aren't read. Of paths with equal ratios
    all stay or all go.
    """
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame.columns = ["id", "url", "page"]
            texts = [main_text(x) for x in frame["page"]]
            yield pd.DataFrame({id_column: frame["id"], url: frame["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    kind = pages.schema[id_column].dataType.simpleString()
    return map_frames(pages.select(id_column, url, page), run, f"`{id_column}` {kind}, `{url}` string, text string, n_chars long")
