"""Main text of web pages by boosted trees over DOM nodes.

A page is parsed into its block elements.  Each gets features of its subtree (text length,
density of links, tags and punctuation), of its tag and attribute tokens and those above
it, of its depth, and of its siblings.  Boosted trees give the probability that an element
holds main text, and decoding picks the most probable set of elements in which everything
kept hangs below kept ancestors: a dropped element drops all of its descendants, and a kept
one keeps its ancestors.  The text of kept elements is cut into blocks in page order.

The trees learn from at most ``SAMPLE_PAGES`` pages that mark their article (``article`` or
``main``), picked by hash.  Into each such page containers of the kinds that surround
articles are put, and every element is learnt from several times: as it is, without its
semantic tags, without attribute tokens, and without both.  So no single hint decides.

Character references are decoded, white space within a block becomes one space, blocks are
joined by an empty line, and nothing is cut off.  A head without end tag ends where HTML ends
it: at the body, or at the first tag or text that a head cannot hold.  Null, empty and tag-free input is fine: a
page without elements keeps all of its text, a page without text gives an empty text.  A
null key or url stays null, repeated rows each give a row, other columns are not used.
Nesting of any depth and pages of any length are handled without recursion.  If no sampled
page marks an article, or the trees would keep nothing of a page, elements are judged by
their tag and attribute tokens alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.llm import boosting, scratch

SAMPLE_PAGES = 300

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style head title template iframe svg textarea button select".split())
_OF_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: an opening tag closes these while they are the innermost open block, and any ``p``
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_MAIN = frozenset({"article", "main"})
_AROUND = frozenset("nav aside footer header form menu dialog fieldset".split())
_GOOD = re.compile(r"article|content|main|post|story|entry|body|text|page")
_BAD = re.compile(r"(?<![a-z])(?:ads?|adv|advert\w*)(?![a-z])|nav|menu|side|foot|head|banner|cookie|notice|comment|"
                  r"relat|share|social|promo|subscri|newsletter|login|sign|form|search|crumb|widget|popup|modal|"
                  r"consent|sponsor|discuss|repl|toolbar|hidden|recommend|alert|disclaim")


class Page(HTMLParser):
    """Block elements in page order; element 0 is the page itself."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth, self.tokens, self.mark = ["#page"], [-1], [0], [""], [None]
        self.chars, self.link_chars, self.tags, self.stops = [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = []  # every open tag, and its block element
        self._in = 0
        self._unseen: list[str] = []
        self._links = 0
        self._text: list[str] = []
        self.feed(source)
        self.close()
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.blocks.append((self._in, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._unseen[:1] == ["head"] and (tag == "body" or self._unseen[-1] == "head" and tag not in _OF_HEAD):
            self._unseen.clear()  # the end tag of a head may be left out
        if self._unseen:
            if tag not in _VOID:
                self._unseen.append(tag)
            return
        if tag in _UNSEEN:
            self._unseen.append(tag)
            return
        self.tags[self._in] += 1
        if tag not in _BLOCK:
            if tag == "br":
                self._text.append(" ")
            if tag == "a":
                self._links += 1
            if tag not in _VOID:
                self._open.append((tag, self._in))
            return
        while self.tag[self._in] == "p" or self.tag[self._in] in _CLOSES.get(tag, ()):
            self._leave(self.tag[self._in])
        self._flush()
        if tag in _VOID:
            return
        self.tag.append(tag)
        self.parent.append(self._in)
        self.depth.append(self.depth[self._in] + 1)
        values = dict(attrs)
        self.tokens.append(" ".join(values.get(k) or "" for k in ("class", "id", "role", "aria-label")).lower())
        self.mark.append(values.get("data-training"))
        for counts in (self.chars, self.link_chars, self.tags, self.stops):
            counts.append(0)
        self._in = len(self.tag) - 1
        self._open.append((tag, self._in))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _leave(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all that is open within."""
        if not any(t == tag for t, _ in self._open):
            return
        self._flush()
        while self._open:
            t, _ = self._open.pop()
            if t == "a":
                self._links = max(0, self._links - 1)
            if t == tag:
                break
        self._in = next((i for t, i in reversed(self._open) if t in _BLOCK), 0)

    def handle_endtag(self, tag: str) -> None:
        if self._unseen:
            if tag in self._unseen:
                while self._unseen.pop() != tag:
                    pass
            return
        if tag in _BLOCK:
            self._leave(tag)
        else:
            for k in range(len(self._open) - 1, -1, -1):
                t, _ = self._open[k]
                if t == tag:
                    del self._open[k]
                    if tag == "a":
                        self._links = max(0, self._links - 1)
                    break
                if t in _BLOCK:
                    break

    def handle_data(self, data: str) -> None:
        if self._unseen == ["head"] and data.strip():
            self._unseen.clear()
        if self._unseen:
            return
        self._text.append(data)
        n = len(data.strip())
        self.chars[self._in] += n
        self.stops[self._in] += sum(map(data.count, ".,;:!?"))
        if self._links:
            self.link_chars[self._in] += n


FEATURES = ["main", "around", "heading", "para", "list", "in_main", "in_around", "holds_main", "good", "bad", "above_good",
            "above_bad", "chars", "link_share", "tag_rate", "stop_rate", "depth", "siblings", "place",
            "share_of_parent", "like_siblings", "own_share", "holds_bad"]
_SEMANTIC = [FEATURES.index(f) for f in ("main", "around", "in_main", "in_around", "holds_main")]
_TOKENS = [FEATURES.index(f) for f in ("good", "bad", "above_good", "above_bad", "holds_bad")]


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent = np.array(page.parent)
    total = {k: np.array(getattr(page, k), float) for k in ("chars", "link_chars", "tags", "stops")}
    own = total["chars"].copy()
    main = np.array([t in _MAIN for t in page.tag], float)
    around = np.array([t in _AROUND for t in page.tag], float)
    good = np.array([len(set(_GOOD.findall(t))) for t in page.tokens], float)
    bad = np.array([len(set(_BAD.findall(t))) for t in page.tokens], float)
    holds, holds_bad = main.copy(), bad.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        for v in total.values():
            v[p] += v[i]
        holds[p] = max(holds[p], holds[i])
        holds_bad[p] = max(holds_bad[p], holds_bad[i])
    above = {"in_main": main.copy(), "in_around": around.copy(), "good": good.copy(), "bad": bad.copy()}
    for i in range(1, n):
        for v in above.values():
            v[i] = max(v[i], v[parent[i]])
    up = np.maximum(parent, 0)
    siblings, place = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        place[i] = siblings[parent[i]]
        siblings[parent[i]] += 1
    like: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        like[page.parent[i], page.tag[i]] = like.get((page.parent[i], page.tag[i]), 0) + 1
    chars = np.maximum(total["chars"], 1)
    out = np.column_stack([
        main, around, [t[0] == "h" and t[1:].isdigit() for t in page.tag], [t == "p" for t in page.tag],
        [t in ("ul", "ol", "li", "dl") for t in page.tag], above["in_main"], above["in_around"], holds,
        good, bad, above["good"][up] * (parent >= 0), above["bad"][up] * (parent >= 0),
        np.log1p(total["chars"]), total["link_chars"] / chars, total["tags"] / chars, total["stops"] / chars,
        page.depth, siblings[up], place / np.maximum(siblings[up], 1), total["chars"] / chars[up],
        [like.get((p, t), 1) for p, t in zip(page.parent, page.tag)], own / chars, holds_bad,
    ]).astype(float)
    return out


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """The most probable choice in which every kept element's ancestors are kept."""
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log(1 - p)
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


def _judged(rows: np.ndarray, trees: boosting.Boosted | None) -> np.ndarray:
    if trees is not None:
        return trees.probability(rows)
    f = {name: rows[:, i] for i, name in enumerate(FEATURES)}
    return np.where((f["around"] + f["bad"] + f["in_around"] > 0) & (f["holds_main"] == 0), 0.05, 0.8)


def main_texts(sources: list[str | None], trees: boosting.Boosted | None) -> list[str]:
    """The main text of each page; the elements of all pages are judged together."""
    parsed = [Page(s or "") for s in sources]
    rows = [features(p) for p in parsed]
    at = np.cumsum([len(r) for r in rows])[:-1]
    out = []
    for page, row, p in zip(parsed, rows, np.split(_judged(np.vstack(rows), trees), at)):
        kept = decode(page.parent, p)
        if trees is not None and page.blocks and not any(kept[i] for i, _ in page.blocks):
            kept = decode(page.parent, _judged(row, None))  # a page unlike any that was learnt from
        out.append("\n\n".join(text for i, text in page.blocks if kept[i]))
    return out


def main_text(source: str | None, trees: boosting.Boosted | None) -> str:
    return main_texts([source], trees)[0]


# --- training -------------------------------------------------------------------------

#: containers put around and into sampled articles: (tag, attribute tokens)
SURROUNDINGS = [("aside", "sidebar"), ("div", "sidebar"), ("div", "cookie-notice"), ("section", "comments"),
                ("div", "comment-list"), ("form", "subscribe"), ("div", "related-posts"), ("header", "site-header"),
                ("div", "share-buttons"), ("div", "advert"), ("div", "ad"), ("div", "footer-links"), ("ul", "menu"),
                ("div", "newsletter promo"), ("div", "banner notice"), ("nav", "breadcrumbs"), ("footer", "footer"),
                *((tag, "") for tag in ("aside", "nav", "header", "footer", "form") for _ in range(2))]


def with_surroundings(source: str, seed: int) -> str:
    """``source`` with containers before, in and behind its article, of its own words."""
    pick = random.Random(seed)
    words = re.sub(r"<[^>]*>", " ", source).split()[:4000] or ["text"]

    def container() -> str:
        tag, token = pick.choice(SURROUNDINGS)
        parts = []
        for _ in range(pick.randint(1, 4)):
            at, n = pick.randrange(len(words)), pick.randint(3, 40)
            said = " ".join(words[at:at + n])
            parts.append(f"<a href='#'>{said}</a>" if pick.random() < 0.3 else f"<p>{said}</p>")
        return f"<{tag} class='{token}' data-training='0'>{''.join(parts)}</{tag}>"

    def insert(text: str, pattern: str, behind: bool) -> str:
        found = re.search(pattern, text, re.I)
        at = (found.end() if behind else found.start()) if found else len(text)
        return text[:at] + container() + text[at:]

    out = insert(source, r"<(?:article|main)\b", False)
    out = insert(out, r"</(?:article|main)>", True)
    return insert(out, r"</(?:article|main)>", False)


def labels(page: Page) -> list[int]:
    """1: within the article, or holds it."""
    main = next(iter([i for i, t in enumerate(page.tag) if t in _MAIN]), None)
    if main is None:
        return []
    inside, out = [False] * len(page.tag), [0] * len(page.tag)
    for i, t in enumerate(page.tag):
        p = page.parent[i]
        inside[i] = i == main or (p >= 0 and inside[p] and out[p] == 1)
        if inside[i] and page.mark[i] != "0" and not (i != main and (t in _AROUND or _BAD.search(page.tokens[i]))):
            out[i] = 1
    while main >= 0:
        out[main] = 1
        main = page.parent[main]
    return out


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> boosting.Boosted | None:
    n = pages.count()
    rows = pages.select(F.col(html).cast("string").alias("html"))
    if n > sample:
        rows = rows.where(F.abs(F.xxhash64("html") % 1_000_000) < int(1_000_000 * sample / n))
    schema = ", ".join(f"{f} double" for f in [*FEATURES, "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("html").to_pylist():
                if not source:
                    continue
                for variant in (source, with_surroundings(source, len(source))):
                    page = Page(variant)
                    y = labels(page)
                    if not y:
                        continue
                    x = features(page)
                    bare, plain = x.copy(), x.copy()
                    bare[:, _SEMANTIC] = 0
                    plain[:, _TOKENS] = 0
                    both = bare.copy()
                    both[:, _TOKENS] = 0
                    table = np.column_stack([np.vstack([x, bare, plain, both]), np.tile(y, 4)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], names=[*FEATURES, "label"])

    # one task's order of rows decides nothing, but few partitions keep training jobs short
    return boosting.fit(scratch.stage(rows.mapInArrow(run, schema).coalesce(4), "html-sample"),
                        FEATURES, "label", trees=15, depth=4)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            trees: boosting.Boosted | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    trees = fit(pages, html) if trees is None else trees
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = main_texts(part.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                    names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
