"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into flat blocks at block-level tags. A block knows its words, the share of
them inside links, whether it is a heading or a list item, where it stands (inside a part
that names itself navigation, advert, form, comments ..., inside the article, or neither),
and the words and link share of its neighbours. A small decision tree, grown from the
labelled blocks of ``LABELLED``, says which blocks are main text. Nothing else is dropped.

Scripts, styles, titles, form fields and comments in the markup hold no text. Character
references are decoded, white space inside a block becomes one space, blocks are joined by
an empty line in page order. A null or empty page, or one without such blocks, has empty
text. Formulas, drawings, objects, frames and ``noscript`` parts are inline: their text counts as
text of its block. Unclosed or stray tags are harmless; an unclosed script hides the rest of its page.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclog.llm import text as X

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*|[^<>]*)>"
    r"|<[!?/][^>]*>", re.S | re.I)

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr input br "
                    # formulas, drawings and embedded parts, whose text stands inside its block
                    "math mfenced mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics "
                    "annotation svg circle defs desc ellipse g line lineargradient path polygon polyline rect stop symbol text tspan use "
                    "object embed param iframe noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PARTS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())

#: What a part says of itself by its tag, or by a word of its class, id or role.
_SIDE = frozenset("nav menu aside footer form dialog".split())
_MAIN = frozenset("article main".split())
_SIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|"
                        r"aside|widget|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|search|social|shar(?:e|ing)|"
                        r"related|recommended|pagination|pager|tags?|comments?|comment-\w+|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

SIDE, OUTSIDE, INSIDE = -1, 0, 1

#: Labelled pages, block by block: words, linked words, place, 1 for a heading and 2 for a list item, main text or not.
LABELLED = (
    ((1, 1, SIDE, 2, 0), (1, 1, SIDE, 2, 0), (2, 2, SIDE, 2, 0), (8, 0, SIDE, 0, 0), (7, 0, INSIDE, 1, 1), (45, 0, INSIDE, 0, 1), (2, 0, INSIDE, 0, 1),
     (80, 3, INSIDE, 0, 1), (1, 0, INSIDE, 0, 1), (12, 0, SIDE, 0, 0)),
    ((3, 3, SIDE, 2, 0), (1, 0, INSIDE, 0, 1), (9, 0, SIDE, 0, 0)),
    ((30, 0, SIDE, 0, 0), (6, 0, INSIDE, 1, 1), (120, 0, INSIDE, 0, 1), (40, 0, SIDE, 0, 0), (60, 2, INSIDE, 0, 1), (25, 25, INSIDE, 0, 1),
     (15, 0, INSIDE, 2, 1), (4, 0, INSIDE, 2, 1), (70, 0, SIDE, 0, 0), (55, 0, SIDE, 0, 0)),
    ((2, 2, OUTSIDE, 0, 0), (3, 3, OUTSIDE, 2, 0), (2, 2, OUTSIDE, 2, 0), (8, 0, OUTSIDE, 1, 1), (50, 0, OUTSIDE, 0, 1), (35, 2, OUTSIDE, 0, 1),
     (6, 0, OUTSIDE, 0, 1), (75, 1, OUTSIDE, 0, 1), (5, 5, OUTSIDE, 0, 0), (4, 4, OUTSIDE, 2, 0), (9, 2, OUTSIDE, 0, 0)),
    ((4, 4, OUTSIDE, 0, 0), (10, 0, OUTSIDE, 1, 1), (28, 0, OUTSIDE, 0, 1), (40, 4, OUTSIDE, 0, 1), (3, 0, OUTSIDE, 1, 1), (22, 0, OUTSIDE, 0, 1),
     (12, 10, OUTSIDE, 2, 0), (11, 9, OUTSIDE, 2, 0), (6, 0, OUTSIDE, 0, 0)),
    ((6, 6, OUTSIDE, 2, 0), (5, 5, OUTSIDE, 2, 0), (5, 0, OUTSIDE, 0, 0), (4, 3, OUTSIDE, 0, 0), (3, 0, OUTSIDE, 0, 0)),
    ((2, 2, OUTSIDE, 0, 0), (40, 0, OUTSIDE, 0, 1), (60, 0, OUTSIDE, 0, 1), (50, 1, OUTSIDE, 0, 1), (2, 2, OUTSIDE, 0, 0)),
    ((5, 5, OUTSIDE, 0, 0), (35, 0, OUTSIDE, 0, 1), (14, 0, OUTSIDE, 0, 1), (44, 2, OUTSIDE, 0, 1), (8, 8, OUTSIDE, 0, 0), (52, 0, OUTSIDE, 0, 1)),
    ((6, 0, INSIDE, 1, 1), (2, 0, INSIDE, 0, 1), (1, 0, INSIDE, 0, 1), (1, 1, INSIDE, 0, 1), (3, 3, INSIDE, 0, 1), (2, 2, INSIDE, 0, 1), (1, 0, INSIDE, 0, 1)),
    ((1, 0, INSIDE, 1, 1), (1, 0, INSIDE, 0, 1), (5, 5, INSIDE, 2, 1), (2, 0, INSIDE, 2, 1), (3, 1, SIDE, 2, 0), (60, 0, SIDE, 0, 0), (50, 0, SIDE, 0, 0)),
    ((9, 0, INSIDE, 1, 1), (2, 1, INSIDE, 0, 1), (1, 0, INSIDE, 0, 1), (6, 6, INSIDE, 0, 1), (45, 0, SIDE, 0, 0), (35, 1, SIDE, 0, 0), (2, 2, INSIDE, 0, 1)),
    ((9, 9, OUTSIDE, 2, 0), (9, 9, OUTSIDE, 2, 0), (33, 0, OUTSIDE, 0, 1), (21, 1, OUTSIDE, 0, 1), (24, 20, OUTSIDE, 0, 0)),
    ((18, 0, OUTSIDE, 0, 1), (64, 0, OUTSIDE, 0, 1), (31, 0, OUTSIDE, 0, 1)),
    ((2, 0, OUTSIDE, 0, 0), (3, 3, OUTSIDE, 0, 0), (4, 0, SIDE, 1, 0), (38, 0, SIDE, 0, 0), (33, 1, SIDE, 0, 0), (9, 0, INSIDE, 1, 1), (5, 0, INSIDE, 0, 1),
     (7, 0, INSIDE, 0, 1), (6, 0, SIDE, 0, 0), (20, 0, SIDE, 2, 0)),
)

FEATURES = ("words", "links", "place", "kind", "words_before", "links_before", "words_after", "links_after")


def features(blocks: list[tuple[int, int, int, int]]) -> np.ndarray:
    """One row for each block (words, linked words, place, kind) of a page; outer neighbours have no words."""
    own = np.array(blocks, float).reshape(-1, 4)
    words, links = own[:, 0], own[:, 1] / np.maximum(own[:, 0], 1)
    shifted = lambda x, k: np.concatenate([np.zeros(1), x[:-1]]) if k < 0 else np.concatenate([x[1:], np.zeros(1)])
    return np.stack([words, links, own[:, 2], own[:, 3], shifted(words, -1), shifted(links, -1), shifted(words, 1), shifted(links, 1)], axis=1)


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 2) -> tuple:
    """Decision tree by Gini impurity: (feature, threshold, up to it, above it), or a leaf's share of main text."""
    share = float(labels.mean())
    if share in (0.0, 1.0) or len(labels) < 2 * least:
        return (share,)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in ((values[:-1] + values[1:]) / 2).tolist():
            low = rows[:, f] <= cut
            n = int(low.sum())
            if min(n, len(low) - n) < least:
                continue
            a, b = labels[low].mean(), labels[~low].mean()
            impurity = n * a * (1 - a) + (len(low) - n) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return (share,)
    _, f, cut, low = best
    return f, cut, grow(rows[low], labels[low], least), grow(rows[~low], labels[~low], least)


@functools.cache
def tree() -> tuple:
    rows = np.concatenate([features([b[:4] for b in page]) for page in LABELLED])
    return grow(rows, np.array([b[4] for page in LABELLED for b in page], float))


def judge(row: np.ndarray, node: tuple) -> bool:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0] >= 0.5


def _place(name: str, attributes: str, place: int) -> int:
    """Where the text of a part stands; the innermost part that says so counts."""
    if name in _MAIN:
        return INSIDE
    if name in _SIDE or (name == "header" and place != INSIDE):
        return SIDE
    if attributes:
        for match in _NAMES.finditer(attributes):
            if _SIDE_NAME.search(match[1] or match[2] or match[3] or ""):
                return SIDE
    return place


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Flat blocks in page order: text, words, linked words, place, kind."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int]] = []
    place, kind, linked = OUTSIDE, 0, 0
    parts: list[str] = []
    in_links: list[str] = []

    def flush() -> None:
        nonlocal parts, in_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                links = len(html.unescape(" ".join(in_links)).split()) if in_links else 0
                out.append((text, words, min(links, words), place, kind))
        parts, in_links = [], []

    at = 0
    for match in _TAG.finditer(page):
        if match.start() > at:
            text = page[at:match.start()]
            parts.append(text)
            if linked:
                in_links.append(text)
        at = match.end()
        name = (match[3] or "").lower()
        if not name:
            continue
        closing = bool(match[2])
        if name == "a":
            linked = 0 if closing else 1
        if name in _INLINE:
            if name in ("br", "img", "input", "wbr"):
                parts.append(" " if name != "wbr" else "")
            continue
        flush()
        linked = 0
        if closing:
            kind = 0
            if name in _PARTS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        place = stack[i][1]
                        del stack[i:]
                        break
            continue
        kind = 1 if re.fullmatch("h[1-6]", name) else 2 if name in ("li", "dd", "dt") else 0
        if name in _PARTS:
            stack.append((name, place))
            place = _place(name, match[4] or "", place)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    node = tree()
    rows = features([b[1:] for b in found])
    return "\n\n".join(b[0] for b, row in zip(found, rows) if judge(row, node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in X.slices(batch, "html"):
                texts = [main_text(x) for x in rows.column(2).to_pylist()]
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
