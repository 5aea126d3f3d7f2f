"""The main text of a web page: blocks labelled by a minimum cut."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by what they do.
UNSEEN = set("script style noscript template head title svg math iframe object canvas audio video select option datalist button input textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = set("nav header footer aside form menu dialog fieldset".split())
CONTENT = set("article main".split())
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in a class, id or role that name boilerplate or content.
BAD_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies consent disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
GOOD_WORDS = set("article articlebody content entry main post story".split())
#: Of these, the words of what lists other articles: an article inside is one of its items.  And how a name begins that says what the page has beside the element.
LISTS = set("comment comments commentlist disqus modal popup promo related replies reply sponsor sponsored widget".split())
_BESIDE = re.compile(r"(?:^|\s)(?:(?:has|no|with|without)[-_]\S+|\S+[-_](?:enabled|disabled|open|closed|on|off)(?=\s|$))")
#: Flags of boilerplate: a name that may be that of a wrapper around the article, a name that only a main element ends, one that holds to the end.
NAMED, LISTED, FINAL = 1, 2, 3
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
#: The classifier's weights (fixed values): log-odds for content.
BIAS, IN_CONTENT, IN_BOILERPLATE, LINKED, PER_LOG_WORD, SENTENCE, PARAGRAPH = -2.0, 5.0, -9.0, -3.0, 0.5, 0.5, 1.0
#: What a cut between neighbours costs, in the same unit, and what of it remains for each step between them in the tree.
SMOOTH, SMOOTH_STEP = 0.6, 0.5
UNIT = 1000
#: Steps in the tree beyond which nothing remains of it, in units.
FAR = 12


class Open(NamedTuple):
    """An open element: in content, the flag of boilerplate, the nearest element that is not inline, how deep that is, and the numbers of
    its last ancestors with its own."""

    tag: str
    good: bool = False
    bad: int = 0
    block: str = ""
    depth: int = 0
    path: tuple = (0,)


class Blocks(HTMLParser):
    """Cuts a page into blocks: (text, linked characters, in content, in boilerplate, element, (depth, path)).  Open elements are counted by
    name, so that nothing is searched for that isn't there, however deep a page is."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open, self.count, self.unseen = [Open("")], Counter(), 0
        self.blocks, self.text, self.linked, self.serial = [], [], 0, 0
        self.feed(html)
        self.close()
        self.end_block()

    def end_block(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            e = self.open[-1]
            self.blocks.append((text, self.linked, e.good, e.bad > 0, e.block, (e.depth, e.path)))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.text.append(" ")
            if tag not in INLINE:
                self.end_block()
            return
        if tag not in INLINE:
            self.end_block()
        if tag in ENDS_PARAGRAPH:
            self.leave("p", CONTENT | BOILERPLATE | {"td", "th", "div", "section", "li"})
        elif tag in ("li", "td", "th", "tr", "dd", "dt"):
            self.leave(tag, {"ul", "ol", "table", "dl"})
        named = dict(attrs)
        names = " ".join(str(named.get(a) or "").lower() for a in ("class", "id", "role"))
        words = set(_WORD.findall(names))
        said = words & BAD_WORDS
        if said:
            said = set(_WORD.findall(_BESIDE.sub(" ", names))) & BAD_WORDS if tag not in ("html", "body", "main") else set()
            said = said & LISTS if tag == "article" else said  # an article is boilerplate as an item of a list only
        around = self.open[-1]
        bad, in_article = around.bad, self.count["article"] > 0
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        if bad == NAMED and tag in CONTENT or bad == LISTED and tag == "main":
            bad = 0  # it was a wrapper of the layout
        if hidden or tag in BOILERPLATE and (tag != "form" or in_article) or said and in_article:
            bad = FINAL
        elif said or tag == "form":  # a form may be around the whole page
            bad = max(bad, LISTED if said & LISTS else NAMED)
        good = around.good or tag in CONTENT or bool(words & GOOD_WORDS)
        self.serial += 1
        if tag in INLINE:
            self.open.append(Open(tag, good, bad, *around[3:]))
        else:
            self.open.append(Open(tag, good, bad, tag, around.depth + 1, (*around.path[-FAR:], self.serial)))
        self.count[tag] += 1
        self.unseen += tag in UNSEEN

    def shut(self, i):
        for e in self.open[i:]:
            self.count[e.tag] -= 1
            self.unseen -= e.tag in UNSEEN
        del self.open[i:]

    def leave(self, tag, within):
        """Close an open ``tag`` unless one of ``within`` is open inside it."""
        if self.count[tag]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    return self.shut(i)
                if self.open[i].tag in within:
                    return None
        return None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_block()
        if self.count[tag]:
            self.shut(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))

    def handle_data(self, data):
        if self.unseen:
            return
        self.text.append(data)
        if self.count["a"]:
            self.linked += len(data.strip())


def log_odds(block: tuple) -> float:
    text, linked, good, bad, tag, _ = block
    z = BIAS + PER_LOG_WORD * math.log1p(text.count(" ") + 1) + LINKED * min(1.0, linked / len(text))
    return z + IN_CONTENT * good + IN_BOILERPLATE * bad + SENTENCE * (text[-1] in ".!?") + PARAGRAPH * (tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "li"))


def edges_of(blocks: list[tuple]) -> list[tuple[int, int, int]]:
    """Neighbours on the page, and the next block under the same parent; the nearer in the tree, the more a cut costs."""
    out, last = {}, {}
    for i, block in enumerate(blocks):
        depth, path = block[5]
        parent = path[-2] if len(path) > 1 else 0
        for j in {i - 1, last.get(parent, -1)} - {-1}:
            other_depth, other = blocks[j][5]
            steps = _steps(depth, path, other_depth, other)
            if steps is not None:
                out[j, i] = round(UNIT * SMOOTH * SMOOTH_STEP ** max(0, steps - 1))
        last[parent] = i
    return [(a, b, c) for (a, b), c in out.items() if c]


def _steps(depth: int, path: tuple, other_depth: int, other: tuple) -> int | None:
    """Steps from the deeper of two elements up to the nearest one that is around both; None if that is far away."""
    known = set(other)
    for up, number in enumerate(reversed(path)):
        if number in known:
            return max(depth, other_depth) - (depth - up)
    return None


def minimum_cut(surplus: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source's side.  A surplus above 0 is what the source still can send to the node, below 0
    what the sink can take from it; an edge carries its capacity either way.  Flow goes along shortest paths, in phases (Dinic)."""
    n, left = len(surplus), list(surplus)
    heads, caps, out = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append(len(heads))
        heads.append(b)
        caps.append(c)
        out[b].append(len(heads))
        heads.append(a)
        caps.append(c)

    def levels() -> tuple[list[int], bool]:
        level, todo, met = [-1] * n, deque(), False
        for i in range(n):
            if left[i] > 0:
                level[i] = 0
                todo.append(i)
        while todo:
            u = todo.popleft()
            met = met or left[u] < 0
            for e in out[u]:
                if caps[e] > 0 and level[heads[e]] < 0:
                    level[heads[e]] = level[u] + 1
                    todo.append(heads[e])
        return level, met

    while True:
        level, met = levels()
        if not met:
            return [x >= 0 for x in level]
        at = [0] * n
        for source in range(n):
            path, u = [], source
            while left[source] > 0:
                if left[u] < 0:
                    flow = min([left[source], -left[u], *(caps[e] for e in path)])
                    left[source] -= flow
                    left[u] += flow
                    for e in path:
                        caps[e] -= flow
                        caps[e ^ 1] += flow
                    path, u = [], source
                elif at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if caps[e] > 0 and level[heads[e]] == level[u] + 1:
                        path.append(e)
                        u = heads[e]
                    else:
                        at[u] += 1
                elif path:
                    u = heads[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def main_text(html: str | None) -> str:
    """Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line."""
    blocks = Blocks(html or "").blocks
    inside = minimum_cut([round(UNIT * log_odds(b)) for b in blocks], edges_of(blocks))
    return "\n\n".join(b[0] for b, kept in zip(blocks, inside, strict=True) if kept)


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if there is none), n_chars (its code points).

    The whole html is read (null: empty).  Each block's log-odds are its terminal capacity, neighbours on the page and in the DOM are joined
    by smoothness edges, and the source's side of the minimum cut is the text.  Broken and cut-off markup is read as far as
    it goes.  Repeated rows are rows of their own, other columns are not looked at, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
