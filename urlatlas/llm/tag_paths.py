"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks of text, each with the number of its path of
block elements from the root. Blocks of one path are aggregated: their mean
text length and mean number of punctuation marks are the path's ratios, so a
short paragraph of the article counts like its long neighbours, and a menu
entry like the other entries. The ratios are smoothed along the page and
fused. The fused ratio spreads in the tree: an element has the mean of the
text inside it, and hands it on to what lies in it, less by every container
between (a heading counts like the article it stands in). Names, classes,
ids, roles and states of the elements on the path are factors of a block's
weight, and blocks whose weight reaches a share of the page's mean weight are
content: no element is chosen or ruled out beforehand. All of it is linear in
the size of the page, however deep its elements lie.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the mean weight that content reaches.
SPREAD = 0.5

#: Factors: inside an article or main element; elements and states that are seldom content, and words that say
#: so; names of which only a part says so.
ARTICLE, SELDOM, PARTLY = 4.0, 0.02, 0.8
#: What a container takes of its parent's ratio: outside articles, in them, and an article in another one or in main.
OUTSIDE, WITHIN, NESTED = 0.45, 0.8, 0.4
#: A block's weight is at least this share of the mean ratio before factors, so that a page of menus has no text.
FLOOR = 0.1

#: Fixed values of the HTML syntax: elements whose content is no markup, and block elements.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup p pre
section select summary table tbody td template tfoot th thead tr ul""".split())
#: An opening tag of the first closes open elements of the second, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
          "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
          "body": ({"head"}, set())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that belong to the text around them.
PARTS = HEADINGS | frozenset("blockquote caption dd dl dt figcaption figure hgroup li ol p pre table tbody td tfoot th thead tr ul".split())

#: Elements that are seldom part of the article, and words of classes, ids and roles that say so.
ASIDE = frozenset("aside button footer form head menu nav noscript select template".split())
BOILERPLATE = frozenset("""ad ads advert advertisement advertisements adverts alert alertdialog banner breadcrumb breadcrumbs
complementary comment comments consent contentinfo cookie cookies dialog discussion disqus footer login masthead menu menubar
modal nav navbar navigation newsletter notice notices pagination pager popup promo promos promoted related replies reply search
share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets""".split())
#: Words that may stand beside those and say nothing.
NEUTRAL = frozenset("""area articles bar block body bottom box buttons container content form group header icons inner item items
left link links list main message page panel post posts right row section site stories text thread top wrap wrapper""".split())
#: Words that say what a page has or lacks, not what an element is.
STATE = frozenset("has no with without".split())
#: Words that an article element inside does not outweigh: articles of others.
OTHER_ARTICLES = frozenset("ad advert comment comments promo related replies reply sponsored teaser".split())

TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"""
                   r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")


class Tree:
    """Elements of a page in order of their start, the root first; one list per property."""

    def __init__(self) -> None:
        self.names, self.parent, self.path = [""], [-1], [0]
        self.fixed = [1.0]  # factors of names and states on the path
        self.words = [1.0]  # factors of words that an article element outweighs
        self.inside = [False]  # whether an article or main element is on the path
        self.step = [0.0]  # what the element takes of its parent's ratio
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, name: str, attributes: str) -> int:
        fixed, words = self.fixed[parent], self.words[parent]
        hard, soft = _factors(name, attributes, self.inside[parent])
        centre = name in ("article", "main") and hard == 1
        self.step.append(1.0 if name in PARTS else NESTED if name == "article" and self.inside[parent]
                         else WITHIN if self.inside[parent] else OUTSIDE)
        self.names.append(name)
        self.parent.append(parent)
        self.path.append(self._paths.setdefault((self.path[parent], name), len(self._paths) + 1))
        self.fixed.append(fixed * hard)
        self.words.append(soft if centre else words * soft)
        self.inside.append(self.inside[parent] or centre)
        return len(self.names) - 1


def _factors(name: str, attributes: str, inside: bool) -> tuple[float, float]:
    """The factor of an element's name and state with words that always count, and that of its other words."""
    hard, soft = (SELDOM if name in ASIDE or name == "header" and not inside else 1.0), 1.0
    if not attributes.strip(" \t\n\r/") or name in ("html", "body"):
        return hard, soft
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        hard *= SELDOM
    if name == "main":
        return hard, soft
    keys = ("class", "role") if name in HEADINGS else ("class", "id", "role")  # a heading's id is an anchor
    boilerplate = BOILERPLATE | OTHER_ARTICLES if name == "article" else BOILERPLATE
    for token in " ".join(given.get(k, "") for k in keys).split():
        parts = re.findall(r"[a-z]+", token)
        if not parts or parts[0] in STATE:
            continue
        if parts == ["header"] and not inside:
            soft = min(soft, SELDOM)
        telling = [p for p in parts if p not in NEUTRAL]
        marked = [p for p in telling if p in boilerplate]
        if not marked or name == "article" and OTHER_ARTICLES.isdisjoint(marked):
            continue  # an article element may be named after what the page has beside it
        factor = SELDOM if len(marked) == len(telling) else PARTLY
        if OTHER_ARTICLES.isdisjoint(marked):
            soft = min(soft, factor)
        else:
            hard = min(hard, factor)
    return hard, soft


def parse(page: str) -> tuple[Tree, list[tuple[int, str]]]:
    """The elements of a page, and its text blocks in order, each with its innermost block element."""
    tree, stack, blocks, text = Tree(), [0], [], []
    places: dict[str, list[int]] = {}  # where on the stack a name is open

    def cut(k: int) -> None:
        """Closes the elements from place ``k`` of the stack on."""
        for e in reversed(stack[k:]):
            places[tree.names[e]].pop()
        del stack[k:]

    def flush() -> None:
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
        text.clear()
        if joined:
            blocks.append((stack[-1], joined))

    def nearest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at:m.start()])
        at = m.end()
        name, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not name:
            continue
        if m[1] or m[4]:  # an end tag closes the nearest element of its name
            if places.get(name):
                flush()
                cut(places[name][-1])
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                gone = page.find(">", end.start()) if end else -1
                at = gone + 1 if gone >= 0 else len(page)
            continue
        if name == "br":
            text.append(" ")
        if name not in BLOCK:
            continue
        flush()
        top = tree.names[stack[-1]]
        if top == "p" or top in HEADINGS and name in HEADINGS:
            cut(len(stack) - 1)
        shuts, until = CLOSES.get(name, (set(), set()))
        limit = nearest(until)
        first = min((places[n][-1] for n in shuts if places.get(n) and places[n][-1] > limit), default=0)
        if first:
            cut(first)
        if name == "hr":
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(tree.add(stack[-1], name, attributes))
    flush()
    return tree, blocks


def _smoothed(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over a place and its neighbours."""
    kernel = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid")


def path_ratios(paths: np.ndarray, texts: list[str]) -> np.ndarray:
    """The fused ratio of every block: its path's mean length and punctuation, smoothed along the page."""
    _, of = np.unique(paths, return_inverse=True)
    length = np.array([len(t) for t in texts], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in texts], dtype=float)
    nodes = np.bincount(of)
    by_length, by_marks = ((np.bincount(of, x) / nodes)[of] for x in (length, marks))
    return _smoothed(by_length) * np.log1p(_smoothed(by_marks) + 1)


def content_weights(tree: Tree, blocks: list[tuple[int, str]]) -> tuple[np.ndarray, float]:
    """The weight of every block, and the mean weight that thresholds are shares of.

    Both means weigh a block by its length and its own value, so they are
    those of the page's text, however many small blocks stand around it.
    """
    where = np.array([e for e, _ in blocks])
    length = np.array([len(t) for _, t in blocks], dtype=float)
    ratio = path_ratios(np.array([tree.path[e] for e, _ in blocks]), [t for _, t in blocks])
    factor = np.array([tree.fixed[e] * tree.words[e] * (ARTICLE if tree.inside[e] else 1.0) for e, _ in blocks])
    size = np.bincount(where, factor * length, len(tree.names))
    mass = np.bincount(where, factor * length * ratio, len(tree.names))
    for e in range(len(tree.names) - 1, 0, -1):  # children come after their parents
        size[tree.parent[e]] += size[e]
        mass[tree.parent[e]] += mass[e]
    spread = np.divide(mass, size, out=np.zeros_like(mass), where=size > 0)
    for e in range(1, len(tree.names)):
        spread[e] = max(spread[e], tree.step[e] * spread[tree.parent[e]])
    weight = factor * np.maximum(ratio, spread[where])
    mean = float((weight * weight * length).sum() / (weight * length).sum())
    plain = float((ratio * ratio * length).sum() / (ratio * length).sum())
    return weight, max(mean, FLOOR * plain)


def main_text(page: str | None, spread: float = SPREAD) -> str:
    """The content blocks, joined by newlines; empty if the page has none.

    Character references are decoded, white space inside a block becomes one
    space. Null or empty pages, pages of markup only and unclosed or cut
    markup give what text there is.
    """
    tree, blocks = parse(page or "")
    if not blocks:
        return ""
    weight, mean = content_weights(tree, blocks)
    return "\n".join(t for (_, t), w in zip(blocks, weight) if w >= spread * mean)


def page_text() -> Callable[[Column], Column]:
    """A function of an html column giving its main text."""
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    extract.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(extract, "string")
