"""Main text of web pages by container paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelmark.llm.batches import prepare, slices, utf8
from duelmark.session import materialize

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot
    th thead tr ul""".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("""script style noscript template iframe object svg math canvas audio video map head title nav header footer
    aside form button select option textarea input label fieldset dialog menu noembed noframes xmp""".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
CLOSES_P = BLOCKS - {"br"}
SAME_LEVEL = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
              "option": ("select",)}

# words of class, id and role that mark what is not the article
BOILERPLATE = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment
    comments consent cookie cookies copyright disclaimer disqus feedback footer header masthead menu modal nav navbar navigation
    newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion
    recommended related replies reply respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe taboola
    tags toolbar toplinks widget alert gdpr complementary contentinfo search""".split())
MAIN = frozenset("article post entry content story main body text".split())
# beginnings and endings of class names that tell what a page or an article has, not what the element is
ABOUT = re.compile(r"^(?:has|with|without|no|not|is|tag|category|cat|hide|show)[-_]|[-_](?:enabled|disabled|open|closed|on|off)$", re.I)
WRAPPERS = frozenset(("form", "fieldset"))      # dropped, but some pages are one form as a whole

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)>?|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
_DIGITS = re.compile(r"\d+")
_WHITE = re.compile(r"\s+")


class Element:
    """``dropped``: not part of the article, by itself or by what is around it. ``suspect``: only its name says so."""

    __slots__ = ("tag", "path", "dropped", "container", "number", "hidden", "suspect")

    def __init__(self, tag: str, path: str, dropped: bool, container: bool, number: int = 0, hidden: bool = False, suspect: bool = False):
        self.tag, self.path, self.dropped, self.container = tag, path, dropped, container
        self.number, self.hidden, self.suspect = number, hidden, suspect


def _named(attributes: str) -> tuple[str, bool, bool]:
    """The class as it is written into paths (numbers generalised), whether the element is hidden, and whether its names mark it as not the article."""
    label, dropped, hidden = "", False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            told = " ".join(v for v in value.split() if not ABOUT.search(v))
            words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", told).lower()))
            # the header of an article holds its headline
            dropped |= bool(words & BOILERPLATE - {"header"} or "header" in words and not words & {"article", "post", "entry", "story"})
            if name == "class" and value.strip():
                label = "." + ".".join(sorted({_DIGITS.sub("#", c) for c in value.split()}))
    return label, hidden, dropped


def walk(page: str, spared: frozenset[int] = frozenset()) -> Iterator[tuple[str, Element | None, str]]:
    """Events of a page: ("open", element, ""), ("close", element, "") and ("text", innermost element, text).

    Tag soup is read as browsers do in the main: void elements, paragraphs and list items that another one ends, end
    tags without a start. Scripts and styles run to their own end tag. Suspects whose number is in ``spared`` stay.
    """
    stack = [Element("", "", False, False)]
    number = 0
    at, size = 0, len(page)
    while at < size:
        match = _PIECE.match(page, at)
        at = match.end()
        cdata, end, name, attributes, text = match.groups()
        if text is not None or cdata is not None:
            yield "text", stack[-1], text if text is not None else html.escape(cdata)
            continue
        if name is None:
            continue
        tag = name.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        yield "close", stack.pop(), ""
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break       # an inline element that a block has ended
            continue
        if tag in CLOSES_P and any(e.tag == "p" for e in reversed(stack)):
            depth = max(i for i, e in enumerate(stack) if e.tag == "p")
            if not any(e.tag in ("td", "th", "button", "object") for e in stack[depth:]):
                while len(stack) > depth:
                    yield "close", stack.pop(), ""
        if tag in SAME_LEVEL:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME_LEVEL[tag]:
                    break
                if stack[i].tag == tag or {tag, stack[i].tag} in ({"dt", "dd"}, {"td", "th"}):
                    while len(stack) > i:
                        yield "close", stack.pop(), ""
                    break
        above = stack[-1]
        label, hidden, marked = _named(attributes) if attributes.strip() else ("", False, False)
        block = tag in BLOCKS and tag not in ("p", "br", "html", "body")
        number += 1
        outright = (hidden or tag in DROPPED and tag not in WRAPPERS) and tag not in ("html", "body")
        suspect = tag in WRAPPERS or marked and tag not in ("html", "body", "main", "article")
        element = Element(tag, f"{above.path}>{tag}{label}" if block else above.path or ">body",
                          above.dropped or outright or suspect and number not in spared, tag in CONTAINERS,
                          number, above.hidden or outright, suspect)
        yield "open", element, ""
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            yield "close", element, ""
        elif tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else size
            stack.append(element)
        else:
            stack.append(element)
    while stack:
        yield "close", stack.pop(), ""


def spared_elements(page: str) -> frozenset[int]:
    """Suspects that are the page itself: they hold at least half of its unlinked text, and a headline or an article too,
    unless the page has none; then next to nothing is left without them. Reader comments below an article have neither."""
    open_now: list[Element] = []
    held: dict[int, int] = {}
    heads: set[int] = set()
    total = outside = links = 0
    headed = False              # a headline or an article that is in no suspect
    for event, element, text in walk(page):
        if event == "open":
            links += element.tag == "a"
            if element.suspect and not element.hidden:
                open_now.append(element)
                held[element.number] = 0
            elif element.tag in ("h1", "article", "main") and not element.hidden:
                heads.update(e.number for e in open_now)
                headed |= not open_now
        elif event == "close":
            links -= element.tag == "a" and links > 0
            if open_now and open_now[-1] is element:
                open_now.pop()
        elif not element.hidden and not links:
            n = len(text.strip())
            total += n
            outside += n * (not element.dropped)
            for e in open_now:
                held[e.number] += n
    return frozenset(k for k, n in held.items() if 2 * n >= total > 0 and (k in heads or not headed and 20 * outside < total))


def score_containers(page: str, spared: frozenset[int] = frozenset()) -> dict[str, float]:
    """Scores of a page's containers by generalised path: text in their own blocks, less what is linked.

    Text counts fully for the nearest container and half for the one around it, so the innermost element that
    holds most of the article wins.
    """
    scores: dict[str, float] = {}
    holders: list[Element] = []
    links = 0
    for event, element, text in walk(page, spared):
        if event == "open":
            if element.container and element.tag != "blockquote":
                holders.append(element)
            links += element.tag == "a"
        elif event == "close":
            if holders and holders[-1] is element:
                holders.pop()
            links -= element.tag == "a" and links > 0
        elif not element.dropped:
            n = len(text.strip())
            if n and holders:
                gain = n if not links else -n
                scores[holders[-1].path] = scores.get(holders[-1].path, 0.0) + gain
                if len(holders) > 1:
                    scores[holders[-2].path] = scores.get(holders[-2].path, 0.0) + gain / 2
    return {path: s * (1.2 if set(_WORD.findall(path.rpartition(">")[2].lower())) & MAIN else 1.0) for path, s in scores.items() if s > 0}


def best_path(page: str) -> str | None:
    """The path of highest score, or of the article element around it; of equal ones the longest, then the first in order."""
    scores = score_containers(page, spared_elements(page))
    if not scores:
        return None
    best = min(scores, key=lambda p: (-scores[p], -len(p), p))
    # parts of an article element belong to it
    steps = best.split(">")
    inside = [i for i, step in enumerate(steps) if step.split(".")[0] == "article"]
    return ">".join(steps[:inside[-1] + 1]) if inside else best


def extract(page: str, path: str | None) -> str:
    """Text of the elements at ``path`` without what is dropped; of the whole page for None.

    References are decoded, white space inside a block becomes one space, and blocks are joined by one space.
    """
    blocks: list[str] = []
    run: list[str] = []
    depth = 0

    def close_block():
        line = _WHITE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if line:
            blocks.append(line)

    for event, element, text in walk(page, spared_elements(page)):
        if event == "text":
            if (depth or path is None) and not element.dropped:
                run.append(text)
            continue
        if element.tag in BLOCKS:
            close_block()
        if path is not None and element.container and element.path == path:
            depth += 1 if event == "open" else -1
    close_block()
    return " ".join(blocks)


def host_of(url: str) -> Column:
    """The host part of a URL in lower case, without user, port and a leading www; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page by consensus of its host.

    Each page scores its containers and votes for its best generalised tag-class path; votes are summed per host, and
    every page is extracted again with its host's winning path. A page without that path, or with nothing there, is
    extracted by its own best path, and without any by its whole body. Votes are one row per page, so neither a host
    with a third of all pages nor a long page is gathered anywhere; winners are one row per host.

    Null and empty pages give an empty text; pages without a URL share the empty host. Repeated rows give a row each.

    Returns per row: page_id, url, text, n_chars (code points), path (that was used, null for the whole page).
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), host_of(url).alias("host"), utf8(page).alias("html"))
    kind = pages.schema[page_id].dataType.simpleString()

    def vote(batches):
        for batch in slices(batches, "html"):
            paths = [best_path(h.decode()) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = (rows.select("host", "html").mapInArrow(vote, "host string, path string").filter("path IS NOT NULL")
             .groupBy("host", "path").agg(F.count("*").alias("n")))
    rank = F.struct((-F.col("n")).alias("n"), (-F.length("path")).alias("short"), F.col("path").alias("path"))
    winners = votes.groupBy("host").agg(F.min(rank).alias("won")).select("host", F.col("won.path").alias("path"))
    winners = materialize(winners, "hosts")

    def read(batches):
        for batch in slices(batches, "html"):
            texts, used = [], []
            for data, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist()):
                data = data.decode()
                text = extract(data, path) if path else ""
                if not text:
                    path = best_path(data)
                    text = extract(data, path)
                texts.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())],
                                             ["page", "url", "text", "path"])

    found = rows.join(winners, "host", "left").select("page", "url", "html", "path").mapInArrow(
        read, f"page {kind}, url string, text string, path string")
    return found.select(F.col("page").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "path")
