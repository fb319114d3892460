"""Main-text extraction by maximum-scoring subsequence.

A page becomes a sequence of words and tags.  A word scores above zero, a tag below, by weights from labelled pages; words
and tags of boilerplate elements score nothing, as they are left out of the text and so do not part what lies around them.
Kadane's linear scan finds the best contiguous region, which takes in the whole of each article that it has words of; its
words outside boilerplate elements, read in page order, are the text.

Labelled pages are those that mark their article by an ``article`` or ``main`` element; a bounded sample of about ``sample``
pages is counted.  The weight of a word, and of each kind of tag, is the log odds of meeting it inside and outside of
articles, scaled to one for a word (a tag that is no rarer inside scores next to nothing).  The same pages say for each element name and class
or id word how many words lie inside and outside; the log odds of these counts add to the fixed prior below and take from it.
Names on the article itself and on elements around it never make it boilerplate; on a page without one, an element is
no boilerplate if nearly nothing is left otherwise and it holds the heading, or, where there is none, nearly all words.

Inline tags join what they part, other tags and comments between blocks are white space; white space runs become one
blank, references are decoded.  Null and empty html give the empty text; broken and unclosed markup is read as far as it
goes; very long pages are read whole in one pass.  Of equal regions the first wins.  Rows that repeat are read each.  Without
labelled pages, as in an empty table, the prior and constant weights hold.  Other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ready, slices

SAMPLE, MIN_SEEN = 2000, 20
#: Weights where no page is labelled, and limits of learned ones.
WORD_SCORE, TAG_SCORE, LEAST_WORD, MOST_TAG, LEAST_TAG = 1.0, -0.25, 0.05, -0.01, -2.0
#: Log odds of an article's words from which a name holds nearly all of it.
WHOLE = math.log(4)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?!(?:svg|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>)(script|style|noscript|template|textarea|svg|iframe|select|object|canvas)(?![\w:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
#: Class words that say what an element has, lacks or allows, not what it is.
STATE = re.compile(r"^(?:no|non|not|has|have|with|without)[-_]|[-_](?:open|opened|closed|enabled|disabled|none|off|less)$")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open one of the same kind.
LOOSE = frozenset("p li dt dd tr td th option b i em strong".split())
#: Fixed prior: element names and class or id words of what is never main text.
BOILERPLATE = frozenset(
    "head title nav footer aside form button header menu menubar navbar navigation breadcrumb breadcrumbs sidebar ad ads adv advert adverts advertisement "
    "sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended comments comment commentlist respond replies reply disqus pagination pager "
    "toolbar widget masthead colophon skip login search complementary contentinfo".split()
)
ARTICLE = frozenset(["article", "main"])
#: Elements that stay boilerplate by their own name even around an article.
FRAME = frozenset("head title nav footer aside button menu".split())


class Model(NamedTuple):
    """What labelled pages say: names that are boilerplate, the score of a word, of each kind of tag and of other tags."""

    names: frozenset[str]
    word: float
    tags: dict[str, float]
    other: float


PRIOR = Model(BOILERPLATE, WORD_SCORE, {}, TAG_SCORE)


class Node(NamedTuple):
    """An element: index of its parent, element name, this and class, id and role words, its outermost article or -1, whether it or one around it is hidden."""

    parent: int
    name: str
    own: tuple[str, ...]
    top: int
    hidden: bool


def scan(page: str) -> tuple[list[Node], list[tuple[str, str, int]]]:
    """Elements, parents first, from a root without names; ("text" or kind of tag, content, element) in page order."""
    nodes, pieces = [Node(0, "", (), -1, False)], []
    stack, at = [0], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(("text", page[at : m.start()], stack[-1]))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            pieces.append(("!" if m[0].startswith("<!--") else "block", "", stack[-1]))
            continue
        here = stack[-1]
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].name == name:
                    here = stack[i]
                    del stack[i:]
                    break
        elif name not in VOID:
            attributes = m[4] or ""
            own, hidden = (name,), False
            if attributes:
                for key, value in ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), value.strip("\"'").lower()
                    if key in ("class", "id", "role"):
                        own += tuple(w for t in value.split() if not STATE.search(t) for w in WORDS.findall(t))
                    elif key == "hidden" and value != "until-found" or key == "aria-hidden" and value.strip() == "true" or key == "style" and NO_DISPLAY.search(value):
                        hidden = True
            if name in LOOSE and nodes[stack[-1]].name == name:
                stack.pop()
            here, top = len(nodes), nodes[stack[-1]].top
            if top < 0 and (name in ARTICLE or "main" in own and BOILERPLATE.isdisjoint(own)):
                top = here
            if name in ARTICLE or name == "header" and top >= 0:
                own = tuple(x for x in own if x != "header")
            if not attributes.rstrip().endswith("/") or name not in ("svg", "path", "object", "canvas"):
                nodes.append(Node(stack[-1], name, own, top, hidden or nodes[stack[-1]].hidden))
                stack.append(here)
            else:
                here = stack[-1]
        pieces.append(("inline" if name in INLINE else "block", name, here))
    if at < len(page):
        pieces.append(("text", page[at:], stack[-1]))
    return nodes, pieces


def around_article(nodes: list[Node], pieces: list[tuple[str, str, int]]) -> set[int]:
    """The page's article and the elements around it: whatever class, id or role words say of them, the article is text.

    The article is the outermost ``article`` or ``main`` of most words; one in a FRAME element only if there is no other.
    """
    words: dict[int, int] = {}
    for kind, content, node in pieces:
        if kind == "text" and (top := nodes[node].top) >= 0 and not nodes[node].hidden:
            words[top] = words.get(top, 0) + len(content.split())
    framed = [False]
    for node in nodes[1:]:
        framed.append(framed[node.parent] or node.name in FRAME)
    found = {i for i, node in enumerate(nodes) if node.name in ("html", "body")}
    at = max(words, key=lambda t: (not framed[t], words[t]), default=0)
    while at:
        found.add(at)
        at = nodes[at].parent
    return found


def boxes(nodes: list[Node], pieces: list[tuple[str, str, int]], out_names: frozenset[str]) -> list[bool]:
    """For each element whether it or one around it is boilerplate."""

    def judged() -> list[bool]:
        off = [False]
        for i, node in enumerate(nodes[1:], 1):
            own = node.own
            if i in free:
                own = (node.name,) if node.name in FRAME else ()
            elif node.name in ARTICLE:
                own = set(own) - borne
            off.append(off[node.parent] or node.hidden or not out_names.isdisjoint(own))
        return off

    free = around_article(nodes, pieces)
    # What the article bears, other articles of the page may bear.
    borne = {w for i in free if nodes[i].top == i for w in nodes[i].own}
    off = judged()
    if all(node.top < 0 for node in nodes) and (wrap := wrappers(nodes, pieces, off)):
        # Nearly nothing is left of a page without an article: what holds its heading or nearly all of it is no box.
        free |= wrap
        off = judged()
    return off


def wrappers(nodes: list[Node], pieces: list[tuple[str, str, int]], off: list[bool]) -> set[int]:
    """Elements around the heading, or around nearly all words if there is none, where boxes leave less than a tenth."""
    framed = [False]
    for node in nodes[1:]:
        framed.append(framed[node.parent] or node.hidden or node.name in FRAME)
    words, left = [0] * len(nodes), 0
    for kind, content, n in pieces:
        if kind == "text" and not framed[n] and (k := len(content.split())):
            words[n] += k
            left += 0 if off[n] else k
    for i in range(len(nodes) - 1, 0, -1):
        words[nodes[i].parent] += words[i]
    if 10 * left >= words[0]:
        return set()
    at = next((node.parent for i, node in enumerate(nodes) if node.name == "h1" and not framed[i]), 0)
    if not at:
        return {i for i in range(1, len(nodes)) if 5 * words[i] > 4 * words[0]}
    out = set()
    while at:
        out.add(at)
        at = nodes[at].parent
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of greatest sum, empty if no sum is above zero; one linear scan."""
    sums, best, start, region = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if sums <= 0:
            sums, start = 0.0, i
        sums += score
        if sums > best:
            best, region = sums, (start, i + 1)
    return region


def extract(page: str | None, model: Model = PRIOR) -> str:
    nodes, pieces = scan(page or "")
    off = boxes(nodes, pieces, model.names)
    scores = [0.0] * len(pieces)
    spans: dict[int, tuple[int, int]] = {}
    for i, (kind, content, node) in enumerate(pieces):
        if not off[node]:
            scores[i] = model.word * len(content.split()) if kind == "text" else model.tags.get(content, model.other)
            if (top := nodes[node].top) >= 0:
                spans[top] = (spans.get(top, (i,))[0], i + 1)
    region = best_region(scores)
    # An article that the region has words of belongs to it from its first word to its last.
    held = {nodes[n].top for kind, content, n in pieces[slice(*region)] if kind == "text" and not off[n] and content.strip()} - {-1}
    region = (min([region[0], *(spans[t][0] for t in held)]), max([region[1], *(spans[t][1] for t in held)]))
    text = "".join((" " if off[n] else content) if kind == "text" else " " if kind == "block" else "" for kind, content, n in pieces[slice(*region)])
    return " ".join(html_lib.unescape(text).split())


def _name_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, inside, outside, total) of marked pages: words by element and class names around them; total: words of the
    articles in which the name occurs.  Names that begin with "<" are tags, counted themselves; "<" alone is words."""
    for b in batches:
        seen: dict[str, list[int]] = {}
        for page in b.column("html"):
            nodes, pieces = scan(page.as_py() or "")
            if all(node.top < 0 for node in nodes):
                continue
            free = around_article(nodes, pieces)
            around = [frozenset()]
            for i, node in enumerate(nodes[1:], 1):
                around.append(around[node.parent] if i in free else around[node.parent].union(node.own))
            total, borne = 0, set()
            for kind, content, at in pieces:
                inside = nodes[at].top >= 0
                if kind != "text":
                    if content:
                        seen.setdefault(f"<{content}", [0, 0, 0])[inside] += 1
                elif not nodes[at].hidden and (n := len(content.split())):
                    seen.setdefault("<", [0, 0, 0])[inside] += n
                    total += n if inside else 0
                    for c in around[at]:
                        seen.setdefault(c, [0, 0, 0])[inside] += n
                    borne |= around[at]
            for c in borne:
                seen[c][2] += total
        names = list(seen)
        counts = [pa.array([seen[c][i] for c in names], pa.int64()) for i in (1, 0, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["name", "inside", "outside", "total"])


def weigh(counts: dict[str, tuple[int, int]]) -> tuple[float, dict[str, float], float]:
    """Scores of a word, of each kind of tag and of tags not seen, from how often each is (inside, outside of) articles."""
    if not counts.get("<"):
        return WORD_SCORE, {}, TAG_SCORE
    all_in, all_out = (sum(c[i] + 1 for c in counts.values()) for i in (0, 1))
    odds = {k: math.log((i + 1) / all_in) - math.log((o + 1) / all_out) for k, (i, o) in counts.items()}
    # Only ratios matter to the best region: a word scores one.
    word = max(LEAST_WORD, odds["<"])
    tags = {k[1:]: min(MOST_TAG, max(LEAST_TAG, v / word)) for k, v in odds.items() if k != "<"}
    return WORD_SCORE, tags, min(tags.values(), default=TAG_SCORE) / 2


def learn(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Weights, and names that are boilerplate: the prior, less what is mostly inside marked articles, plus what is nearly
    all outside.

    A prior name inside articles may still be that of a box, as of an advert: it leaves the prior only if, where it occurs
    in an article, nearly all words of the article are its own.  Elements around an article, and itself, do not count.  As
    many names come to the driver as the sampled pages have.
    """
    ready(pages.sparkSession)
    n = pages.count()
    drawn = pages.select("html").filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 20))))
    counts = drawn.mapInArrow(_name_counts, "name string, inside long, outside long, total long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"), F.sum("total").alias("t"))
    rows = counts.collect()
    found = [r for r in rows if not r.name.startswith("<") and r.i + r.o >= MIN_SEEN]
    where = {r.name: math.log((r.i + 1) / (r.o + 1)) for r in found}
    share = {r.name: math.log((r.i + 1) / (r.t - r.i + 1)) for r in found}
    neutral = {"html", "body", "div", "section", "p", "span", "table", "tr", "td", "ul", "ol", "li", "a", "h1", "h2", "h3", *ARTICLE}
    text = {c for c in where if where[c] > 0 and share[c] > WHOLE}
    names = frozenset((BOILERPLATE - text | {c for c, w in where.items() if w < -3.0}) - neutral)
    return Model(names, *weigh({r.name: (r.i, r.o) for r in rows if r.name.startswith("<")}))


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    spark = ready(pages.sparkSession)
    shared = spark.sparkContext.broadcast(learn(pages) if model is None else model)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 2):
                texts = [extract(x.as_py(), shared.value) for x in b.column("html")]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
