"""Main text of web pages: flat text blocks, described by themselves and their neighbours, sorted by a decision tree.

A page is cut into blocks at block-level tags. Subtrees that are menus, footers, forms, adverts or comments by element or by name go
as a whole. Each block that is left has its word count and link density, those of the blocks around it, whether it stands in the
article that holds most of the text, and a few flags. A small tree, trained on the blocks of the labelled pages below, keeps or drops
each block; headings and short paragraphs between kept text then stay with it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.batches import slim

# Element names.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_HOLDERS = frozenset("article aside details dialog div dl fieldset figure footer form header label main menu nav ol section select button table ul".split())
_BOILER = frozenset("aside button dialog fieldset footer form label menu nav select".split())
# Words of class, id and role that mark what is not the article.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "comment comments commentlist reply replies respond discussion disqus feedback kommentar kommentare kommentarer commentaire commentaires comentario comentarios commenti reacties bio biography authorbox cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription "
    "signup login paywall footer masthead topbar toolbar share sharing social related recommended recommendations trending widget widgets search form copyright complementary contentinfo skip".split()
)
# Words that go with a hint in a name without changing what it says: "cookie-box" is a cookie notice, "notice-of-award" is no notice.
_PLAIN = frozenset(
    "area bar bars block blocks body bottom box button buttons card cards column container content entry group head header heading inner icons item items left link links list main "
    "module outer panel post posts reader readers right section site slot stories story tools top unit user users author authors wrap wrapper".split()
)
# Elements whose content is no text.
_RAW = frozenset("script style noscript template svg math iframe object textarea title canvas audio video map".split())
# Possessive quantifiers: a tag is read once or not at all.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "place", "named", "heading", "item", "sentence", "notice")
#: An article holds the text if it has this share of the unlinked words that are left.
HOLDS = 0.3
#: Unlinked words below which a page whose blocks all have marked names is read as if it had no names.
FEW = 10
# Words of notices that tell more than their counts.
_NOTICE = re.compile(r"\bcookies?\b|\u00a9|\bcopyright\b|\ball rights reserved\b|\bnewsletter\b|\bsubscribe\b|\bprivacy policy\b", re.I)
# The labelled pages. "<div.name>" opens an element with a class and "</>" closes it; "+p:40/4." is a block of the main
# text in a p of 40 words, 4 of them linked, that ends like a sentence; "-" is a block that does not belong to it; "c" is a notice.
LABELLED = """
<nav> -li:1/1 -li:1/1 -li:2/2 </> <article> +h1:6 +p:60. +p:45. </> <footer> -p:9c </>
<nav> -li:1/1 -li:1/1 </> -div:8. <article> +h1:9 +p:40. +p:1. +p:80. +p:2. </> <footer> -p:12c </>
<article> +h1:4 +p:1. </>
<article> +h2:3 +p:12. +h2:3 +p:70/6. +h3:2 +li:8 +li:5. +li:14/2. +p:30. </>
<article> +p:150/3. +p:5/5 +p:90. +td:2 +td:1 +td:3 +p:20/6. </>
<article> +h1:5 +p:50. +p:7/3. +p:65. -li:5/5 -li:6/6 -li:4/4 </>
<article> +h1:7 +p:6. +p:80. +p:9. -p:3/3 </> -p:40. -p:12/12
<article> +h1:6 +p:44. +p:38. -p:2/2 -p:3/3 </>
<article> +p:33. </> -p:27.c
<article> +h1:4 +p:40. +p:3.c +p:9. </>
<article> +h1:5 +p:9. +p:3.c </> <footer> -p:6c </>
<article> +p:82. +p:3.c </> -p:9.c
-p:27.c <article> +h1:8 +p:51. +p:19. </>
-p:22. <article> +h1:5 +p:40. +p:60. </> -h3:3 -p:25. -p:18/18
<main> +h1:4 +p:60. +div:45/2. </> -h2:2 -li:8/8 -li:7/7
<main> <article> +h1:5 +p:80. +p:70. </> <article> -h3:4/4 -p:12. </> </>
<header> -p:3 -li:1/1 </> +h1:5 +p:37. +p:37. <footer> -li:1/1 </>
<nav> -a:1/1 </> +h1:4 +p:37. +p:25. +p:3.
<nav> -li:1/1 </> +h1:3 +p:90. +p:60. +p:5. -p:2/2
+h1:6 +p:45. +p:30. +p:6. -p:3/3 -p:2/2 -p:2/2
-div:1/1 -div:1/1 -div:2/2 +h1:7 +p:4. +p:60. +p:35/3. -div:2/2 -div:3/3
-li:1/1 -li:2/2 -li:1/1 +h1:5 +p:8. +p:52. +h2:3 +p:41. +h2:2 +p:66. -li:4/4 -li:6/6 -li:5/5
-td:1/1 -td:1/1 -td:2/2 +td:70. +p:40. -td:2/2 -td:9c
-p:5 -p:1/1 -p:1/1 +h2:6 +p:55. +p:48. +p:2. +p:61. -p:8c
+p:80. +p:45/4. +p:33. -p:3/3 -p:4/4
+p:60.
+h1:4 +p:26.
+h1:5 +h2:9 +p:45. +p:52. +li:6. +li:9. +li:7 +p:22.
-p:4/4 -p:3/3 +h1:6 +p:3 +p:75. +p:42/5. +h3:4 +p:8. +p:57. -h3:2 -li:6/6 -li:7/7 -p:10c
-p:24.c +h1:5 +p:48. +p:51. -p:11.c
+h1:6 +p:58. +p:47. -h3:3 -p:12/10 -p:14/12 -p:11/11
-h3:2 -li:3/3 -li:4/4 -li:3/3 +h1:8 +p:62. +p:18. +p:73. -h3:2 -li:3/3 -li:5/5
-p:2/2 -p:2/2 +p:39. +h2:3 +p:58. +p:4. +p:44. -p:6/6
-li:2/2 -li:1/1 -li:1/1 -li:3/3
-p:4/4 -p:6/6 -p:12/12 -p:9c
-div:1/1 -div:1/1 +h1:5 +div:4 +div:120/8. +div:95. -div:1/1 -div:2/2
+h1:3 +p:12. +p:9. +p:15. +p:7. +p:20.
-li:1/1 -li:1/1 +h1:3 +p:11. +p:8. +p:14. -p:2/2
+h1:4 +p:38. +li:12. +li:15. +li:9. +p:41. -p:5/5
-p:3 -p:1/1 -p:2/2 +h1:7 +p:2 +p:66. +p:59. -p:3/3 -p:6c
<div.post-comments-count> +p:30. +p:44. </> -p:2/2
<div.notice-of-award> +h1:3 +p:42. +p:38. </>
<article> +p:40. <section.notice-of-award> +h3:2 +p:36. </> +p:20. </>
<article> +p:50. <div.award-notice-list> +li:6 +li:8. </> +p:25. </>
"""


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each piece of markup in page order; what is no tag has an empty name.

    The time is linear in the page, however broken it is: each search for an end that fails is the last of its kind. Where some
    quote never closes before the end of the page, quotes are no longer minded from that tag on. Markup that is never closed goes
    on to the end of the page.
    """
    at, size, tag, endings = 0, len(page), _TAG, {}
    while (start := page.find("<", at)) >= 0:
        following = page[start + 1 : start + 2]
        if following.isascii() and following.isalpha() or following == "/" and page[start + 2 : start + 3].isalpha():
            m = tag.match(page, start)
            if m is None and tag is _TAG:
                tag = _BARE
                m = tag.match(page, start)
            if m is None:
                yield start, size, "", False, ""
                return
            name, closing = m[2].lower(), bool(m[1])
            at = m.end()
            if name in _RAW and not closing:
                if name not in endings:
                    endings[name] = re.compile(rf"</{name}\s*+>", re.I)
                end = endings[name].search(page, at)
                at = end.end() if end else size
                name = ""
            yield start, at, name, closing, m[3]
        elif following in ("!", "?", "/") and following:
            end = page.find("-->", start + 4) if page.startswith("<!--", start) else page.find(">", start)
            at = size if end < 0 else end + (3 if page.startswith("<!--", start) else 1)
            yield start, at, "", False, ""
        else:  # a sign in the text
            at = start + 1


@cache
def _hint(word: str) -> int:
    """How surely a class, id or role word marks what is not the article: 0 not, 1 if a part of it does, 2 if it says nothing else."""
    parts = [w.lower() for w in _WORDS.findall(word)]
    if not any(w in _HINTS for w in parts):
        return 0
    return 2 if all(w in _HINTS or w in _PLAIN for w in parts) else 1


def _marks(attributes: str) -> int:
    """What class, id and role say, 0 to 2; 3 if the element is hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    found = 0
    for m in _MARKED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").split():
            found = max(found, (_hint if len(word) < 100 else _hint.__wrapped__)(word))  # long words are rare and stay out of the cache
    return 3 if _HIDDEN.search(attributes) else found


class _Holder:
    """An open element that holds blocks. What depends on its ancestors is kept, so that deep pages take linear time."""

    __slots__ = ("article", "bad", "boiler", "gone", "holds", "level", "name", "parent")

    def __init__(self, name: str, bad: int, parent: _Holder | None) -> None:
        self.name, self.bad, self.parent, self.holds, self.level = name, bad, parent, False, 0
        self.article = name in ("article", "main") or (parent is not None and parent.article)  # in one, whatever it is marked as
        self.boiler = (bad > 0 and name in _BOILER) or (parent is not None and parent.boiler)
        self.gone = bad == 3 or (parent is not None and parent.gone)  # by element or hidden, whatever the names


class Block(NamedTuple):
    """A block's text, words and linked words; the outermost unmarked article that it stands in, by number, or -1; gone (by element, or hidden); named (what names around it say, 0 to 2); and flags of its tag."""

    text: str
    words: int
    linked: int
    article: int
    gone: bool
    named: int
    heading: bool
    item: bool


def blocks(page: str) -> list[Block]:
    """All blocks in page order."""
    out: list[tuple] = []  # text, words, linked words, holder, tag, hidden
    parts: list[str] = []
    linked: list[str] = []
    holders: list[_Holder] = []  # the open ones
    every: list[_Holder] = []
    opened: dict[str, int] = {}
    anchors, kind, hidden, at, in_head = 0, "", False, 0, False

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = len(text.split(" "))
                links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append((text, n, min(n, links), holders[-1] if holders else None, kind, hidden))
            parts.clear()
            linked.clear()

    for start, end, name, closing, attributes in tags(page):
        if start > at and not in_head:
            piece = page[at:start]
            parts.append(piece)
            if anchors:
                linked.append(piece)
        at = end
        if name == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        elif name == "br":
            parts.append(" ")
        elif name == "head":
            in_head = not closing
        elif name in _BLOCK:
            close()
            in_head, anchors = False, 0
            kind = "" if closing else name
            hidden = not closing and name not in _HOLDERS and _marks(attributes) == 3
            if name not in _HOLDERS:
                continue
            if closing:
                while opened.get(name):
                    last = holders.pop()
                    opened[last.name] -= 1
                    if last.name == name:
                        break
            elif not attributes.endswith("/"):
                parent = holders[-1] if holders else None
                bad = 3 if name in _BOILER or (name == "header" and not (parent and parent.article)) else _marks(attributes)
                if name in ("article", "main") and not bad:
                    h = parent
                    while h and not h.holds:  # a wrapper of the article is none of the rest, whatever its class
                        h.holds, h = True, h.parent
                holders.append(_Holder(name, bad, parent))
                every.append(holders[-1])
                opened[name] = opened.get(name, 0) + 1
    if at < len(page) and not in_head:
        parts.append(page[at:])
    close()
    numbers: dict[_Holder, int] = {}
    for h in every:  # outer ones first
        h.level = max(h.parent.level if h.parent else 0, h.bad if not h.holds and h.bad < 3 else 0)
        above = numbers.get(h.parent, -1)
        numbers[h] = above if h.name not in ("article", "main") or h.bad else len(numbers) if above < 0 or h.parent.name == "main" and h.name == "article" else above
    return [
        Block(text, n, links, numbers.get(h, -1), hidden or bool(h and h.gone), h.level if h else 0, tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("li", "td", "th", "dd", "dt", "option"))
        for text, n, links, h, tag, hidden in out
    ]


def candidates(found: list[Block]) -> list[int]:
    """Places of the blocks that stand in no subtree of boilerplate. Where names leave hardly a word, they are not minded."""
    left = [i for i, b in enumerate(found) if not b.gone]
    named = [i for i in left if found[i].named < 2]
    return named if sum(found[i].words - found[i].linked for i in named) >= FEW or any(found[i].article >= 0 for i in named) else left


def features(found: list[Block], which: list[int]) -> np.ndarray:
    """FEATURES of some blocks, which are each other's neighbours."""
    chosen = [found[i] for i in which]
    out = np.zeros((len(chosen), len(FEATURES)))
    if not chosen:
        return out
    out[:, 0] = [b.words for b in chosen]
    out[:, 1] = [b.linked / b.words for b in chosen]
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    # 1 in an article that holds the text, -1 beside one, 0 where there is none.
    plain: dict[int, int] = {}
    for b in chosen:
        plain[b.article] = plain.get(b.article, 0) + b.words - b.linked
    total = sum(plain.values())
    holding = {a for a, n in plain.items() if a >= 0 and n >= HOLDS * total}
    if holding:
        out[:, 6] = [1 if b.article in holding else -1 for b in chosen]
    out[:, 7] = [b.named == 1 for b in chosen]
    out[:, 8] = [b.heading for b in chosen]
    out[:, 9] = [b.item for b in chosen]
    out[:, 10] = [b.text.rstrip("\"'\u201d\u00bb)").endswith((".", "!", "?", "\u2026", ":", "\u3002")) for b in chosen]
    out[:, 11] = [b.words < 60 and _NOTICE.search(b.text) is not None for b in chosen]
    return out


def sketched(line: str) -> tuple[str, list[int]]:
    """The page of a line of LABELLED, and the label of each of its blocks."""
    page, labels, opened = [], [], []
    for token in line.split():
        if token == "</>":
            page.append(f"</{opened.pop()}>")
        elif token.startswith("<"):
            name, _, mark = token[1:-1].partition(".")
            opened.append(name)
            page.append(f'<{name} class="{mark}">')
        else:
            keep, tag, words, linked, flags = re.fullmatch(r"([+-])(\w+):(\d+)(?:/(\d+))?([.c]*)", token).groups()
            texts = ["word"] * (int(words) - int(linked or 0)) + [f"<a>{' '.join(['link'] * int(linked or 0))}</a>"] * bool(linked)
            texts = (["cookies"] if "c" in flags else []) + texts[1 if "c" in flags else 0 :]
            name = "div" if tag == "a" else tag
            page.append(f"<{name}>{' '.join(texts)}{'.' * ('.' in flags)}</{name}>")
            labels.append(int(keep == "+"))
    return "".join(page), labels


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of the blocks of all labelled pages that are left to the tree."""
    rows, classes = [], []
    for line in LABELLED.strip().splitlines():
        page, labels = sketched(line)
        found = blocks(page)
        which = candidates(found)
        rows.append(features(found, which))
        classes += [labels[i] for i in which]
    return np.concatenate(rows), np.array(classes)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (feature, cut, below, above), or (class,) at a leaf."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return (int(y.mean() >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            impurity = sum(len(s) * (1 - (s.mean() ** 2 + (1 - s.mean()) ** 2)) for s in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return (int(y.mean() >= 0.5),)
    _, f, cut, low = best
    return (f, float(cut), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    low = x[:, tree[0]] < tree[1]
    return np.where(low, classify(tree[2], x), classify(tree[3], x))


@cache
def trained() -> tuple:
    return grow(*labelled())


def kept(found: list[Block], tree: tuple) -> list[int]:
    """Places of the blocks of the main text."""
    which = candidates(found)
    x = features(found, which)
    keep = classify(tree, x)
    # Headings and short paragraphs between kept text belong to it, if they are not made of links.
    own = np.flatnonzero(keep)
    if len(own):
        between = (np.arange(len(which)) > own[0]) & (np.arange(len(which)) < own[-1])
        keep |= between & (x[:, 1] < 0.5) & (x[:, 6] >= 0) & (x[:, 11] == 0)
    return [i for i, k in zip(which, keep, strict=True) if k]


def main_text(page: str | None, tree: tuple | None = None) -> str:
    found = blocks(page) if page else []
    return "\n\n".join(found[i].text for i in kept(found, tree or trained()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty page, and one without main text, gives the empty text. Repeated rows are repeated. Other columns of the
    input are left out, whatever their names. The tree is trained once, here, and sent with the tasks: it has a few dozen nodes.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    ids = dict(pages.dtypes)
    return slim(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {ids['page_id']}, url {ids['url']}, text string, n_chars bigint")
