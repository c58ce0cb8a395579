"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by the block they stand in (prose positive,
blocks that are mostly links as a rule negative) and tags negative, with weights from labelled pages (those
that mark their article with an element of its own); one linear scan finds the contiguous region with
the highest sum, whose blocks are the main text. Elements whose name says that they are a menu, footer,
form and so on are left out of the sequence. A class, id or role that says so is evidence: the words of
such an element score less, its linked words least, and it is left out if its own sum is negative.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements whose content is text of no page, up to their end tag.
RAW = frozenset("script style title textarea iframe template xmp noembed noframes".split())
#: Elements that never hold main text.
APART = frozenset("head nav header footer aside form button select dialog menu audio video map".split())
#: Blocks of prose, in which a button is a word of a sentence.
PROSE = frozenset("p li td th dd dt figcaption blockquote h2 h3 h4 h5 h6".split())
#: How much a word of a class or id speaks against an element: 1 may as well be the matter of a text, 3 hardly.
MARKS = {word: level for level, words in (
    (1, "dialog menu search social"),
    (2, "alert aside banner comment discussion header notice notices recommendations recommended related reply respond share sharing widget widgets"),
    (3, "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments consent contentinfo cookie cookies disqus footer gdpr login masthead menubar modal "
        "nav navbar navigation newsletter overlay pager pagination popup promo promotion replies sidebar signup sponsor sponsored sponsors subscribe subscription toolbar topbar"),
) for word in words.split()}
#: Roles say what an element is and nothing else.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that speak for an element.
KEPT = frozenset("content article main post entry story body page text container wrapper layout".split())
#: Of these, the words of an element that is an article.
STORY = frozenset("article post entry story".split())
#: Score of a word, and of a linked word, in an element by the level of its marks; what the marks cost by themselves.
SCORES, COST = {1: (1.0, -3.0), 2: (-0.5, -3.0), 3: (-2.0, -3.0)}, 4.0
#: Level of elements that are apart by name.
NAMED = 9
#: Tags that end a block of text.
BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that mark the article on labelled pages.
ARTICLE = ("article", "main")
#: What the words of a block are counted as; those of other blocks as words of a box.
KINDS = {name: kind for kind, names in (("p", "p blockquote figcaption pre"), ("h", "h1 h2 h3 h4 h5 h6"), ("li", "li dd dt"), ("cell", "td th caption")) for name in names.split()}
#: An element that is still open ends where one of its likes begins, unless an element of the second kind was opened between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
        "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

# A quote counts where a value begins and nowhere else. Nothing is read twice, so a page is read in linear time.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)"
    r"(?P<attributes>(?:[^\s=>]++|\s++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))*+)>"
    r"|(?P<text>[^<]++|<(?!/?[A-Za-z]))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

#: Bounds of learnt weights of words and of tags; a tag within a sentence weighs the least.
WORD_LIMIT, TAG_LIMIT, LEAST = 2.0, 1.0, 0.1
#: Weights where no page is labelled, and of what labelled pages do not have; leaving an article weighs many words.
DEFAULT_WEIGHTS = {"word": 1.0, "word/linked": -1.0, "tag": -0.2, "/article": -50.0, "/main": -50.0}


@dataclass(slots=True)
class Box:
    """An element that may be apart: by name (level NAMED) or by its marks (1 to 3)."""

    level: int
    parent: int
    article: bool  # within an article
    may_hold: bool  # kept if it turns out to hold the article or a main heading
    holds: bool = False
    plain: int = 0
    linked: int = 0
    cut: bool = False


@dataclass(slots=True)
class Item:
    """A tag (with a slash if it ends) or a text, and where it stands; ``kind`` is what it is weighed as."""

    tag: str
    text: str
    box: int
    block: str
    linked: bool
    article: bool
    kind: str = ""


def marked(attributes: str) -> tuple[int, bool]:
    """The level at which class, id and role speak against an element (0 to 3), and whether they say that it is an article.

    The last word of a name decides (a post-comments box holds comments), or else the first. Words that
    speak for the element take one level off."""
    level, kept, article = 0, 0, False
    for name, value in ATTRIBUTE.findall(attributes):
        for one in entities.unescape(value.strip("\"'")).lower().split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=\d)", " ", one)) if w]
            if not words:
                continue
            if name.lower() == "role":
                level, article = max(level, 3 * (one in ROLES)), article or one in ARTICLE
                continue
            some = bool(KEPT.intersection(words))
            found = max(MARKS.get(words[-1], 0), 0 if some else MARKS.get(words[0], 0))
            if found:
                level = max(level, found - (some and found < 3))
            elif words[-1] in KEPT:
                kept, article = 1, article or words[-1] in STORY
    return max(0, level - kept), article and level < 3


def read(page: str) -> tuple[list[Item], list[Box]]:
    """All tags and texts of a page, and its boxes; box 0 is the page itself."""
    items, boxes = [], [Box(0, 0, False, False)]
    stack: list[tuple[str, int, str, bool, bool]] = [("", 0, "box", False, False)]  # name, box, block, linked, article
    opened: dict[str, list[int]] = {}  # name -> where it stands in the stack
    blocks = [0]  # where blocks stand in the stack
    at, size = 0, len(page)

    def last(*names: str) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop()[0]].pop()
        while blocks[-1] >= to:
            blocks.pop()

    while at < size:
        m = TOKEN.match(page, at)
        if m is None:  # a tag that never ends: the page was cut
            break
        at = m.end()
        _, box, block, linked, article = stack[-1]
        if m["text"] is not None:
            items.append(Item("", m["text"], box, block, linked, article))
            continue
        if m["name"] is None:
            continue
        name, attributes = m["name"].lower(), m["attributes"]
        if m["end"]:
            items.append(Item(f"/{name}", "", box, block, linked, article))
            found = last(name)
            if found > (0 if name in BLOCKS else blocks[-1]):
                close(found)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in BLOCKS and name != "br" and last("p") > 0:
            close(last("p"))
        alike, between = ENDS.get(name, ((), ()))
        if alike and last(*alike) > last(*between):
            close(last(*alike))
        _, box, block, linked, article = stack[-1]
        level, story = marked(attributes) if attributes and name not in (*ARTICLE, "html", "body") else (0, False)
        if name in APART and not (name == "header" and article) and not (name == "button" and blocks[-1] and stack[blocks[-1]][0] in PROSE):
            level = NAMED
        elif name == "noscript":
            level = max(level, 2)
        if name in ARTICLE or name == "h1":
            up = box
            while up and not boxes[up].holds:
                boxes[up].holds, up = True, boxes[up].parent
        if level and name not in VOID:
            boxes.append(Box(level, box, article, name == "form" or level < NAMED))
            box = len(boxes) - 1
        if name in BLOCKS:
            block = KINDS.get(name, block if name == "br" else "box")
        linked, article = linked or name == "a", article or story or name in ARTICLE
        items.append(Item(name, "", box, block, linked, article))
        if name not in VOID and not attributes.endswith("/"):
            if name in BLOCKS:
                blocks.append(len(stack))
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, box, block, linked, article))
    return items, boxes


def weigh(items: list[Item], boxes: list[Box]) -> None:
    """Which boxes are cut. Those within an article are kept after all where nothing else of it would be left."""
    words = [0] * len(boxes)  # within articles
    for item in items:
        if not item.tag and (n := len(item.text.split())):
            box = boxes[item.box]
            if item.linked:
                box.linked += n
            else:
                box.plain += n
            words[item.box] += n * item.article
    for box in reversed(boxes[1:]):  # inner ones come later
        if box.holds and box.may_hold:
            box.cut = False
        elif box.level == NAMED:
            box.cut = True
        else:
            plain, linked = SCORES[box.level]
            box.cut = plain * box.plain + linked * box.linked - COST <= 0
        if not box.cut:
            boxes[box.parent].plain += box.plain
            boxes[box.parent].linked += box.linked
    named = [False] * len(boxes)
    for i, box in enumerate(boxes[1:], 1):
        box.cut = box.cut or boxes[box.parent].cut
        named[i] = named[box.parent] or box.level == NAMED and not (box.holds and box.may_hold)
    if not any(n for n, box in zip(words, boxes) if not box.cut):
        for i, box in enumerate(boxes):
            if box.article and not named[i]:
                box.cut = False


def kind(tag: str) -> str:
    """Tags that HTML has keep their names, so the table of weights stays small whatever pages hold."""
    return tag if tag.lstrip("/") in BLOCKS else "tag"


def name_kinds(items: list[Item], boxes: list[Box], whole: bool = False) -> None:
    """What each item is weighed as: a word of its kind of block, linked if most of its block's words are;
    a tag by its name. Empty for what is cut (but for words, if ``whole``) and for tags of elements without content."""
    block: list[Item] = []

    def end() -> None:
        n = sum(len(i.text.split()) for i in block)
        mostly = 2 * sum(len(i.text.split()) for i in block if i.linked) > n
        for i in block:
            i.kind = f"word/{i.block}{'/linked' if mostly else ''}"
        block.clear()

    starts: list[Item] = []  # tags since the last word
    for item in items:
        cut = boxes[item.box].cut
        if not item.tag:
            if item.text.strip() and (whole or not cut):
                block.append(item)
                starts.clear()
            continue
        if item.tag.lstrip("/") not in BLOCKS:
            item.kind = "" if cut else "inline"
            continue
        end()
        item.kind = "" if cut else kind(item.tag)
        if starts and item.tag == f"/{starts[-1].tag}":
            item.kind = starts.pop().kind = ""
        elif item.tag[0] == "/":
            starts.clear()
        elif item.tag not in VOID:
            starts.append(item)
    end()


def article_span(items: list[Item]) -> tuple[int, int] | None:
    """Where a labelled page has its article; None for a page that marks none, or several."""
    for name in ARTICLE:
        starts = [i for i, item in enumerate(items) if item.tag == name]
        ends = [i for i, item in enumerate(items) if item.tag == f"/{name}"]
        if len(starts) == 1 and len(ends) == 1 and starts[0] < ends[0]:
            return starts[0], ends[0]
    return None


def tallies(page: str) -> Counter:
    """(kind, inside the article) -> number, for one labelled page: words of the whole page, but tags
    only where the scan will meet them, outside of what is cut."""
    found: Counter = Counter()
    items, boxes = read(page)
    span = article_span(items)
    if span:
        weigh(items, boxes)
        name_kinds(items, boxes, whole=True)
        for i, item in enumerate(items):
            if item.kind and item.kind != "inline" and i not in span:
                found[item.kind, span[0] < i < span[1]] += 1 if item.tag else len(item.text.split())
    return found


def learn(pages: DataFrame) -> dict[str, float]:
    """Log-odds of words (by kind of block) and of tags inside against outside the article, over all labelled pages.

    Words score within WORD_LIMIT of 0 on either side, tags from -TAG_LIMIT to -LEAST. The table has a
    row per known tag and kind of block."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in it:
            for page in b.column(0):
                if page.as_py():
                    total.update(tallies(page.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    rows = pages.select("html").mapInArrow(batches, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    n = {(r["kind"], r["inside"]): r["n"] for r in rows}
    weights = dict(DEFAULT_WEIGHTS)
    for words in (True, False):
        every = {k for k, _ in n if k.startswith("word/") == words}
        inside = sum(v for (k, i), v in n.items() if i and k in every) + len(every)
        outside = sum(v for (k, i), v in n.items() if not i and k in every) + len(every)
        for k in every - set(DEFAULT_WEIGHTS):
            odds = math.log((n.get((k, True), 0) + 1) / inside) - math.log((n.get((k, False), 0) + 1) / outside)
            weights[k] = min(WORD_LIMIT, max(-WORD_LIMIT, odds)) if words else -min(TAG_LIMIT, max(LEAST, -odds))
    return weights


def weight_of(kind_of: str, weights: dict[str, float]) -> float:
    """The weight of a word or tag; what labelled pages do not have weighs as if there were none."""
    if kind_of == "inline":
        return -LEAST
    if kind_of in weights:
        return weights[kind_of]
    if not kind_of.startswith("word"):
        return weights.get("tag", DEFAULT_WEIGHTS["tag"])
    # a sentence may be a link; a list or a box of links is a menu
    base = "word/linked" if kind_of.endswith("/linked") and kind_of.split("/")[1] in ("li", "cell", "box") else "word"
    return weights.get(base, DEFAULT_WEIGHTS[base])


def region(items: list[Item], weights: dict[str, float]) -> tuple[int, int]:
    """First and end position of the maximum-scoring subsequence, by one scan; (0, 0) if none is positive.

    It begins and ends with whole blocks: the words of a block weigh the same, and a tag within a
    sentence weighs less than a word."""
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    for i, item in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        if item.kind:
            total += weight_of(item.kind, weights) * (1 if item.tag else len(item.text.split()))
        if total > best:
            best, best_span = total, (start, i + 1)
    return best_span


def main_text(page: str | None, weights: dict[str, float] = DEFAULT_WEIGHTS) -> str:
    """The blocks of the best region, white space runs as one space, joined by one space.

    A page on which the learnt weights find nothing is scanned with the weights for unlabelled pages."""
    if not page:
        return ""
    items, boxes = read(page)
    weigh(items, boxes)
    name_kinds(items, boxes)
    start, end = region(items, weights)
    if start == end:
        start, end = region(items, DEFAULT_WEIGHTS)
    parts = [" " if i.tag.lstrip("/") in BLOCKS else "" if i.tag or boxes[i.box].cut else entities.unescape(i.text) for i in items[start:end]]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``; weights are learnt from ``pages`` if not given.

    Null or empty html gives the empty text, as does a page without words outside apart elements.
    Unclosed elements end with the page; a tag that never ends ends the page and is no text, a ``<``
    that begins no tag is text. Pages are read in linear time, whatever they hold. Repeated rows are
    extracted each; other columns are ignored; an empty table gives an empty table."""
    weights = weights or learn(pages)
    rows = pages.select("page_id", "url", "html")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = [main_text(x.as_py(), weights) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind_of = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"page_id {kind_of}, url string, text string, n_chars long")
