"""Main text of web pages: flat text blocks, told apart by a decision tree over their own and their neighbours' shape.

Tags cut a page into a flat list of blocks; inline tags don't cut, `<br>` is white space. A block has its number
of words, its link density (the share of words in links), the same of the block before and after, and what
encloses it: an article, page furniture (menus, headers, footers, sidebars), something beside the text (adverts,
notices, forms, comments), a heading, a list. A decision tree, grown on the labelled table below, says which
blocks are main text. Character references are decoded, white space becomes one space, blocks are joined in
page order by a line end.

Null, empty and text-free pages give an empty text. A tag or comment that is never closed ends with the page;
a `<` that opens no tag is text. Pages that repeat give the same text each time. No page is cut off.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from workloom.llm.frames import map_batches

#: Elements whose content is no text of the page.
_RAW = "script|style|template|noscript|svg|math|title|textarea|select|object|iframe|canvas|audio|video"
_OPENER = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_RAW_OPENER = re.compile(rf"<({_RAW})\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split("|")}
_QUOTE_OR_END = re.compile("[\"'>]")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr nobr".split())
_CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl menu table figure blockquote "
                        "dialog details fieldset button center body head".split())
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: What an element's tag or the words of its class, id and role say about its text.
ARTICLE, FURNITURE, BESIDE = 1, 2, 4
_BY_TAG = {"article": ARTICLE, "main": ARTICLE, "nav": FURNITURE, "header": FURNITURE, "footer": FURNITURE, "aside": FURNITURE,
           "menu": FURNITURE, "head": BESIDE, "form": BESIDE, "button": BESIDE, "dialog": BESIDE, "fieldset": BESIDE}
_BY_WORD = {**dict.fromkeys("article content main post story entry".split(), ARTICLE),
            **dict.fromkeys("nav navbar menu header masthead footer sidebar aside widget widgets toolbar pager pagination "
                            "toc breadcrumb breadcrumbs topbar contentinfo navigation complementary skip".split(), FURNITURE),
            **dict.fromkeys("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
                            "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
                            "login share sharing social related recommended comment comments commentlist reply replies respond disqus "
                            "discussion feedback search form disclaimer".split(), BESIDE)}
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "in_article", "in_furniture", "beside", "heading", "listed")


def _kind(tag: str, attributes: str) -> int:
    kind = _BY_TAG.get(tag, 0)
    if attributes and tag not in ("body", "main", "article"):  # whose names speak of the whole page's layout
        if "=" in attributes:
            for found in _NAMED.finditer(attributes):
                for word in _PARTS.findall(found[1] or found[2] or found[3] or ""):
                    kind |= _BY_WORD.get(word.lower(), 0)
        if _HIDDEN.search(attributes):
            kind |= BESIDE
    return kind


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag; what else is no text has an empty name.

    One pass: a quote from which no tag end was found is not followed again, and no tag is sought behind the last `>`.
    """
    last, at, open_ended = html.rfind(">") + 1, 0, set()

    def tag_end(at: int) -> int:
        """The place behind the first `>` outside quotation marks, or -1."""
        passed = []
        while found := _QUOTE_OR_END.search(html, at, last):
            mark = found.start()
            if html[mark] == ">":
                return mark + 1
            if mark in open_ended:
                break
            passed.append(mark)
            at = html.find(html[mark], mark + 1) + 1
            if not at:
                break
        open_ended.update(passed)
        return -1

    while found := _OPENER.search(html, at):
        start, at = found.span()
        if found[1]:
            at = html.find("-->", at) + 3
            at = at if at > 2 else len(html)
            yield start, at, "", "", ""
        elif start < last:
            end = tag_end(found.end()) if found[3] else -1
            raw = _RAW_OPENER.match(html, start) if end > 0 else None
            if end < 0:  # a declaration, or a tag whose quotation marks don't close
                at = html.find(">", start) + 1
                yield start, at, "", "", ""
            elif raw:
                close = None if html[end - 2] == "/" else _RAW_END[raw[1].lower()].search(html, end)
                at = end if html[end - 2] == "/" else close.end() if close else len(html)
                yield start, at, "", "", ""
            else:
                at = end
                yield start, at, found[2], found[3].lower(), html[found.end():end - 1]


def blocks(html: str) -> list[tuple[str, int, int, int, bool, bool]]:
    """The page's text blocks: text, words, words in links, enclosing kinds, whether a heading, whether listed."""
    found = []
    stack: list[tuple[str, int]] = [("", 0)]
    depth: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    at, linked, heading, listed = 0, False, False, False

    def end() -> None:
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                anchors = sum(len(unescape(p).split()) for p, inside in parts if inside)
                found.append((text, len(text.split()), anchors, stack[-1][1], heading, listed))
            parts.clear()

    for start, behind, slash, tag, attributes in _tags(html):
        if start > at:
            parts.append((html[at:start], linked))
        at = behind
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                linked = not slash
            continue
        if tag == "br":
            parts.append((" ", linked))
            continue
        end()
        if slash:
            if depth.get(tag):
                while (closed := stack.pop()[0]) != tag:
                    depth[closed] -= 1
                depth[tag] -= 1
            heading = False
            listed = listed and tag != "li"
        else:
            kind = _kind(tag, attributes)
            if tag in _CONTAINERS:
                linked = False
                if tag == "body":
                    stack[1:] = []
                    depth.clear()
                if not attributes.endswith("/"):
                    stack.append((tag, stack[-1][1] | kind))
                    depth[tag] += 1
            elif kind & (FURNITURE | BESIDE) and tag in ("p", "span", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
                # Marked text that is no container counts for itself: a container of one block.
                while stack[-1][0] == "*":
                    stack.pop()
                stack.append(("*", stack[-1][1] | kind))
                heading, listed = tag[0] == "h", tag == "li"
                continue
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            listed = tag in ("li", "dt", "dd", "td", "th", "option")
        while stack[-1][0] == "*":
            stack.pop()
    if at < len(html):
        parts.append((html[at:], linked))
    end()
    return found


def features(page: list[tuple[str, int, int, int, bool, bool]]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(page)
    x = np.zeros((n, len(FEATURES)))
    words = np.array([b[1] for b in page], float)
    density = np.array([b[2] for b in page], float) / np.maximum(words, 1)
    kinds = np.array([b[3] for b in page])
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    for i, kind in enumerate((ARTICLE, FURNITURE, BESIDE)):
        x[:, 6 + i] = kinds & kind > 0
    x[:, 9] = [b[4] for b in page]
    x[:, 10] = [b[5] for b in page]
    return x


_SHORT, _LINE = "More words", "The harbour was quiet in the early hours of that day"
_LONG = " ".join([_LINE + " and nobody had yet come down to the boats,"] * 3)
_LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/n">News today</a></li><li><a href="/c">Contact</a></li></ul>'
#: The labelled table: pages, and for each block in order whether it is main text.
LABELLED = [
    (f"<nav>{_LINKS}</nav><div class=ad>{_LINE}</div><article><h1>{_LINE}</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LINE}</p></article>"
     f"<footer>{_LINE}</footer>", "0000" "1111" "0"),
    (f"<header>{_SHORT}{_LINKS}</header><main><h1>{_SHORT}</h1><p>{_LONG}</p><h2>{_SHORT}</h2><p>{_LONG}</p><ul><li>{_LINE}</li>"
     f"<li>{_SHORT}</li></ul><aside>{_LONG}</aside></main><footer>{_LONG}</footer>", "0000" "111111" "0" "0"),
    (f"<article><p>{_SHORT}</p><div class=advert>{_LONG}</div><p>{_SHORT}</p><blockquote>{_LINE}</blockquote><p><a href=x>{_SHORT}</a></p>"
     f"<section class=comments><h3>{_SHORT}</h3><p>{_LONG}</p><p>{_LINE}</p></section></article>", "1" "0" "111" "000"),
    (f"<div id=sidebar><h3>{_SHORT}</h3>{_LINKS}<p>{_LONG}</p></div><div><h1>{_LINE}</h1><p>{_LONG}</p><p>{_LONG}</p><p>{_LINE}</p></div>"
     f"<div>{_LINKS}</div><p>{_SHORT}</p>", "00000" "1111" "000" "0"),
    (f"<div>{_LINKS}</div><p>{_LONG}</p><p>{_LONG}</p><p>{_LINE}</p><p>{_LONG}</p><div><a href=x>{_SHORT}</a></div><div><a href=y>{_LINE}</a></div>",
     "000" "1111" "00"),
    (f"<div class=cookie-notice><p>{_LONG}</p><button>{_SHORT}</button></div><form><p>{_LINE}</p><label>{_SHORT}</label></form>"
     f"<article><header><h1>{_LINE}</h1><p>{_SHORT}</p></header><p>{_LINE}</p><p>{_LONG}</p><form><p>{_LINE}</p></form></article>",
     "00" "00" "00" "11" "0"),
    (f"<div>{_SHORT}</div><div>{_SHORT}</div><div>{_LINKS}</div><h2>{_LINE}</h2><p>{_LONG}</p><p>{_LONG}</p><div>{_SHORT}</div>{_LINKS}",
     "00000" "111" "0" "000"),
    (f"<div class=content><p>{_LONG}</p><p>{_SHORT}</p><p>{_LINE}</p><table><tr><td>{_SHORT}</td><td>{_LINE}</td></tr></table></div>"
     f"<div class=related><p>{_LONG}</p>{_LINKS}</div>", "11111" "0000"),
    (f"<article><p>{_LINE} <a href=x>{_LINE}</a></p><ul><li><a href=x>{_LINE}</a></li><li><a href=x>{_SHORT}</a></li></ul><p>{_LONG}</p></article>",
     "1111"),
    (f"<article><p>{_SHORT}</p></article><nav><p>{_LONG}</p></nav><div class=notice><p>{_LONG}</p></div>", "1" "0" "0"),
]


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8):
    """A decision tree by Gini impurity: a leaf is a share of ones, a node (feature, bound, at or below, above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best, cut = len(y) * share * (1 - share) - 1e-12, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        rest = t[-1] - t[:-1]
        impure = t[:-1] * (1 - t[:-1] / n) + rest * (1 - rest / (len(y) - n))
        impure[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(np.argmin(impure))
        if impure[i] < best:
            best, cut = impure[i], (j, (v[i] + v[i + 1]) / 2)
    if cut is None:
        return share
    low = x[:, cut[0]] <= cut[1]
    return cut[0], float(cut[1]), grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1)


def train(labelled: list[tuple[str, str]] = LABELLED):
    """The tree for a table of pages with a 0 or 1 for each block."""
    rows, marks = [], []
    for html, labels in labelled:
        page = blocks(html)
        if len(page) != len(labels):
            raise ValueError(f"{len(page)} blocks but {len(labels)} labels: {html[:80]}")
        rows.append(features(page))
        marks += [float(c) for c in labels]
    return grow(np.concatenate(rows), np.array(marks))


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, bound, low, high = tree
    out, below = np.empty(len(x)), x[:, j] <= bound
    out[below], out[~below] = decide(low, x[below]), decide(high, x[~below])
    return out


def main_text(html: str | None, tree) -> str:
    page = blocks(html) if html else []
    if not page:
        return ""
    kept = decide(tree, features(page)) >= 0.5
    return "\n".join(b[0] for b, k in zip(page, kept) if k)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, into: str = "text",
            labelled: list[tuple[str, str]] = LABELLED) -> DataFrame:
    """The `keep` columns of `pages` (all but `into` by default) and the main text as column `into`."""
    keep = [c for c in pages.columns if c != into] if keep is None else keep
    tree = train(labelled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), tree) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    carried = [f"__{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    body = pages.select(*[pages[c].alias(f"__{i}") for i, c in enumerate(keep)], pages[html].cast("string").alias("__html"))
    made = map_batches(body, work, ", ".join([*carried, "text string"]))
    return made.select(*[made[f"__{i}"].alias(c) for i, c in enumerate(keep)], made["text"].alias(into))
