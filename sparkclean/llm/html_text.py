"""Main text of web pages: the best-scoring contiguous run of words and tags, then its blocks.

A page is read as a sequence of tags and runs of text. Words score positive, tags negative, by how often each kind of
them lies inside the content of labelled pages; words and tags of page furniture score negative. One linear scan finds
the run with the highest sum.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, islice
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import byte_slices, texts_of

_attributes = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
#: Elements that hold no tags and, without an end tag, run to the end of the page; others whose text is never
#: shown or is no text, where their own end tag follows; elements of the head; elements of page furniture; inline elements.
RAW = ("script", "style", "textarea", "title")
OPAQUE = frozenset("noscript template iframe svg math select object canvas video audio".split())
HEAD = frozenset("meta link base basefont bgsound noscript template".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id attributes that mark page furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted "
    "promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "widget widgets".split())
_start = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_rest = re.compile(_attributes)
_special = re.compile(r"""[>"']""")
_raw_ends = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_unquoted = re.compile(r"""=\s*[^\s"'>]+/$""")
#: Furniture even where it holds most of a page's words.
ALWAYS = frozenset("nav footer button menu".split())
#: Marks of readers' answers; each of them is often an article of its own.
ANSWERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Elements whose ids come from headings and names.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = HEADINGS | frozenset("section p dt dd".split())
_attribute = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_word = re.compile(r"[^\W\d_]+")
#: Elements that hold the content of labelled pages.
LABELS = ("article", "main")
#: Score of a word, and the least and most that a tag costs.
WORD, CHEAP, DEAR = 1.0, 0.05, 12.0
#: Score of a word of a marked element that holds most of the page's words, or an article after the first.
LOWERED = 0.5
#: Labelled pages that weights are taken from, those with the smallest hash of their id; and kinds of tags that have own weights.
SAMPLE_PAGES, KINDS = 2000, 2000


@dataclass
class Node:
    """A tag, or a run of text; `hidden` if it lies in page furniture, `lowered` if in what only looks like it."""

    kind: str
    text: str = ""
    hidden: bool = False
    tag: str = ""
    ends: bool = False
    words: int = 0
    lowered: bool = False


def marks(tag: str, attributes: str) -> set[str]:
    """Words of the whole tokens of class, id and role that mark furniture; each word of such a token does."""
    if tag in HEADINGS or tag in ("html", "body", *LABELS):
        return set()
    tokens = {k.lower(): (a or b or c).lower().split() for k, a, b, c in reversed(_attribute.findall(attributes))}
    if tag in NAMED or "section" in tokens.get("class", ()):
        tokens.pop("id", None)
    found = (set(_word.findall(t)) for k in ("class", "id", "role") for t in tokens.get(k, ()))
    return {w for words in found if words <= MARKS for w in words}


@dataclass
class Suspect:
    """An element that looks like page furniture: its tag and marks, and the nodes it spans."""

    tag: str
    marks: set[str]
    begin: int
    depth: int
    end: int = 0


def hide(nodes: list[Node], suspects: list[Suspect]) -> None:
    """Hide furniture. Not hidden are elements that hold an article or main, or most of the words of a page without others.

    Readers' answers are hidden with their articles, unless the first one of the page is among them.
    """
    labels = [i for i, n in enumerate(nodes) if n.tag in LABELS and not n.ends]
    words = list(accumulate((n.words for n in nodes), initial=0))
    reached = 0
    change = [0] * (len(nodes) + 1)
    for x in suspects:
        if x.begin < reached:
            continue
        first, last = bisect_left(labels, x.begin), bisect_left(labels, x.end)
        holds = first < last and (first == 0 or not x.marks & ANSWERS)
        most = not labels and x.tag not in ALWAYS and 2 * (words[x.end] - words[x.begin]) > words[-1]
        if not holds and not most:
            reached = x.end
        if holds and not first:
            continue
        if holds or most:
            change[x.begin] += 1
            change[x.end] -= 1
        else:
            for n in nodes[x.begin : x.end]:
                n.hidden = True
    for n, depth in zip(nodes, accumulate(change)):
        n.lowered = depth > 0


def _tag_ends(page: str, begin: int) -> tuple[list[int], list[int]]:
    """Places of > and quotes from `begin` on, and where a tag that reaches each outside of quotes ends; -1 if it never does."""
    places = [m.start() for m in _special.finditer(page, begin)]
    ends, after = [-1] * (len(places) + 1), {'"': len(places), "'": len(places)}
    for i in range(len(places) - 1, -1, -1):
        sign = page[places[i]]
        if sign == ">":
            ends[i] = places[i]
        else:
            closing = after[sign]
            ends[i] = ends[closing + 1] if closing < len(places) else -1
            after[sign] = i
    return places, ends


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Begin, end, whether it is an end tag, name in lower case and attributes of every tag; name None for comments,
    declarations and RAW elements. A tag whose > never comes is text. Goes forward only, whatever the page holds."""
    at, last = 0, page.rfind(">")
    places: list[int] = []
    ends: list[int] | None = None
    while (at := page.find("<", at)) >= 0:
        m = _start.match(page, at)
        if not m:
            at += 1
            continue
        name = m[2]
        if name is None:
            closing = page.find("-->", m.end()) if m[0] == "<!--" else -1
            if m[0] == "<!--":
                end = closing + 3 if closing >= 0 else len(page)
            elif m.end() <= last:
                end = page.find(">", m.end()) + 1
            else:
                at += 1
                continue
            yield at, end, False, None, ""
            at = end
            continue
        if m.end() > last:
            at += 1
            continue
        if ends is None:
            end = _rest.match(page, m.end()).end()
            if page[end : end + 1] != ">":
                places, ends = _tag_ends(page, m.end())  # from here on, ends are looked up
        if ends is not None:
            end = ends[bisect_left(places, m.end())]
            if end < 0:
                at += 1
                continue
        tag, attributes = name.lower(), page[m.end() : end]
        end += 1
        if tag in _raw_ends and not m[1] and (not attributes or attributes[0] in " \t\n\r\f\v/"):
            if not (attributes.endswith("/") and (attributes == "/" or attributes[-2] in " \t\n\r\f\v\"'/")):
                closed = _raw_ends[tag].search(page, end)
                end = closed.end() if closed else len(page)
            yield at, end, False, None, ""
        else:
            yield at, end, bool(m[1]), tag, attributes
        at = end


def nodes_of(page: str) -> list[Node]:
    """Tags and texts in order. An end tag closes the elements it is the end of; furniture ends with its element.

    Elements of OPAQUE that their own end tag closes leave nothing, unless they hold an article or main; others leave out
    their tags only. The head leaves nothing and ends with the first text or tag that doesn't belong to it.
    """
    out: list[Node] = []
    open_tags: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements
    labels: list[int] = []  # nodes of LABELS
    suspects: list[Suspect] = []
    open_suspects: list[Suspect] = []
    opaque: list[tuple[int, int]] = []  # place in `open_tags` and first node of open elements of OPAQUE
    head = False
    at = 0

    def text(until: int) -> None:
        nonlocal head
        if until > at:
            words = len(page[at:until].split())
            if head and not opaque:
                if not words:
                    return
                head = False
            out.append(Node("#text", page[at:until], words=words))

    closes = Counter(m.lower() for m in re.findall(r"</([a-zA-Z][a-zA-Z0-9:-]*)", page))
    for begin, end, closing, tag, attributes in tokens(page):
        text(begin)
        at = end
        if tag is None:
            continue
        if closing:
            closes[tag] -= 1
            if tag == "head":
                head = False
                continue
            if head and not opaque:
                continue
            if tag not in OPAQUE:
                if tag in LABELS:
                    labels.append(len(out))
                out.append(Node("/" + tag, "", False, tag, True))
            if places[tag]:
                place = places[tag][-1]
                while len(open_tags) > place:
                    places[open_tags.pop()].pop()
                while open_suspects and open_suspects[-1].depth > place:
                    open_suspects.pop().end = len(out)
                while opaque and opaque[-1][0] >= place:
                    own, begin = opaque.pop()
                    if own == place and (tag == "template" or not labels or labels[-1] < begin):
                        del out[begin:]
                        while labels and labels[-1] >= begin:
                            labels.pop()
                        while suspects and suspects[-1].begin >= begin:
                            suspects.pop()
            continue
        if tag == "head":
            head = True
            continue
        if head and (tag == "body" or tag not in HEAD and not opaque):
            head = False
        if tag in OPAQUE:
            if not attributes.endswith("/") or _unquoted.search(attributes):
                opaque.append((len(open_tags), len(out)))
                places[tag].append(len(open_tags))
                open_tags.append(tag)
            continue
        if head and tag in HEAD:
            continue
        if tag not in VOID:
            places[tag].append(len(open_tags))
            open_tags.append(tag)
            if closes[tag] > 0 and ((found := marks(tag, attributes)) or tag in FURNITURE):
                suspects.append(Suspect(tag, found, len(out), len(open_tags)))
                open_suspects.append(suspects[-1])
        if tag in LABELS:
            labels.append(len(out))
        out.append(Node(tag, "", False, tag))
    text(len(page))
    for x in open_suspects:
        x.end = len(out)
    hide(out, suspects)
    return out


@dataclass
class TagWeights:
    """What tags cost, by their kind: nearly nothing if they lie in content, up to DEAR if they never do."""

    cost: dict[str, float] = field(default_factory=dict)

    def score(self, node: Node) -> float:
        if node.kind == "#text":
            return -WORD * node.words if node.hidden else (LOWERED if node.lowered else WORD) * node.words
        if node.hidden:
            return -CHEAP
        return -self.cost.get(node.kind, DEAR if node.tag in ("html", "body", *LABELS) else CHEAP if node.tag in INLINE or node.tag == "p" else 0.5)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the run with the highest sum; of equal ones, the first; empty if no sum is above 0."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str, weights: TagWeights) -> str:
    """Blocks of the best run, joined by line breaks."""
    nodes = nodes_of(page)
    scores = [weights.score(n) for n in nodes]
    # Furniture inside content costs little, so it doesn't part the text on both sides of it.
    k = 0
    while k < len(nodes):
        end = k
        while end < len(nodes) and nodes[end].hidden:
            end += 1
        if end > k:
            cost = max(sum(scores[k:end]), -2.0)
            scores[k:end] = [cost / (end - k)] * (end - k)
        k = max(end, k + 1)
    begin, end = best_run(scores)
    blocks, parts = [], []
    for node in nodes[begin:end]:
        if node.kind == "#text":
            if not node.hidden:
                parts.append(html.unescape(node.text))
        elif node.tag == "br":
            parts.append(" ")
        elif node.tag not in INLINE:
            blocks.append(parts)
            parts = []
    blocks.append(parts)
    lines = (" ".join("".join(x).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def labelled_counts(page: str) -> Counter:
    """(kind of tag, inside) counts of a page whose content is marked by one of LABELS; of others nothing."""
    nodes, out = nodes_of(page), Counter()
    for label in LABELS:
        begin = next((i for i, n in enumerate(nodes) if n.kind == label), None)
        if begin is None:
            continue
        end = max((i for i, n in enumerate(nodes) if n.kind == "/" + label), default=len(nodes))
        for i, n in enumerate(nodes):
            if n.kind != "#text" and not n.hidden:
                out[n.kind, begin < i < end] += 1
        break
    return out


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> TagWeights:
    """Weights of tags from the labelled ones of a bounded sample: the logarithm of how much oftener they lie outside.

    The sample are the pages with the smallest hashes of the id. Where many pages share the last hash, as null ids do, a task reads `sample`
    pages at most. An empty table gives no weights.
    """
    hashed = F.xxhash64(id_col)
    last = pages.select(hashed.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return TagWeights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for page in islice((page for batch in byte_slices(batches, html_col) for page in texts_of(batch, html_col)), sample):
            total.update(labelled_counts(page))
        if total:
            kinds, counts = zip(*total.items())
            names, inside = zip(*kinds)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(inside, pa.bool_()), pa.array(counts, pa.int64())], ["kind", "inside", "n"])

    counted = pages.where(hashed <= last).select(html_col).mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside"))
    rows = counted.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(KINDS).collect()
    return TagWeights({r["kind"]: min(max(log((r["outside"] + 1) / (r["inside"] + 1)), CHEAP), DEAR) for r in rows})


def extract_text(df: DataFrame, weights: TagWeights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page: `id_col`, `url_col`, text, n_chars long (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line breaks.
    Null and empty pages, and pages without words, have the empty text. Every input row gives one row, repeated rows and
    null keys too; an empty table gives none; other columns are not read.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, html_col):
            found = [main_text(x, weights) for x in texts_of(batch, html_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", text string, n_chars long"
    return df.select(id_col, url_col, html_col).mapInArrow(run, schema)
