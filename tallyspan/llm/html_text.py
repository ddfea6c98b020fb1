"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words, which score above zero, and tags, which score below. All scores are log odds of being
inside the content, learned from labelled pages: those that mark it themselves with one article or main element.
Words inside an element that is no content (a menu, a footer, an advert, a notice) are items of the sequence with a
score below zero. Which elements those are is learned too: each landmark element and each word of a class, id or role
is a context with log odds of its own. A list of usual names is only where the counts of a context start from, and
the page's own mark, where it has one, is a context like the others (UNMARKED). What stands inside the mark is
article text, hidden or not and whatever its names, unless it is a menu, header, footer, sidebar, notice, advert, form
or a reader's comment (OF_KIND); the names of what surrounds a page's only mark say nothing of the words in it.

One linear scan finds the contiguous run with the highest sum. Words of negative contexts inside it, such as an
advert between two paragraphs, are left out of the text like the tags.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import table

#: Labelled pages that the weights are learned from.
LABELLED_PAGES = 5_000
#: Words score at least LEAST and at most WORD_MOST, tags between -TAG_MOST and -LEAST, contexts within MOST; a context
#: of TELLING or less makes its words negative, and a run of words in it weighs as much as ITEM_WORDS words at most.
LEAST, WORD_MOST, TAG_MOST, MOST, TELLING, ITEM_WORDS = 0.05, 1.0, 1.0, 4.0, -1.0, 4
#: Words outside the content that a usual name is taken to have been seen with before any page.
PRIOR_WORDS = 30
WORD, LINKED, OTHER, UNMARKED, HIDDEN = "#word", "#linked", "#tag", "#unmarked", "#hidden"
CONTENT = {"article", "main"}
RAW = ("script", "style", "noscript", "template", "iframe", "title", "textarea", "select")
#: Elements that are contexts by their name.
LANDMARKS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset", "datalist", "section", "figure", "figcaption", "details", "address"}
USUAL = {"@nav", "@header", "@footer", "@aside", "@form", "@button", "@menu", "@dialog", "@label", "@fieldset", "@datalist", UNMARKED, HIDDEN}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "svg", "object", "canvas", "video", "audio", "math", "mi", "mn", "mo", "ms", "mrow", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "semantics",
}
#: Usual names in class, id or role of what is not article text, as whole words of the name.
NAMES = re.compile(
    r"^(ads?|adverts?|advertisements?|advertising|adsense|adbox|adunit|sponsors?|sponsored|promos?|promotions?|banners?|sidebars?|side|aside|complementary|navs?|navbars?|navigation|menus?|breadcrumbs?"
    r"|headers?|masthead|topbar|footers?|contentinfo|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|comments?|disqus|respond|replies|reply|discussion|share|sharing|social"
    r"|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|pagination|pager|widgets?|toolbar|copyright|legal|tags|metadata|byline)$"
)
#: Contexts that count inside the mark: the kinds of element that are no article text wherever they stand.
OF_KIND = re.compile(
    r"^(@(nav|footer|aside|form|button|menu|dialog|label|fieldset|datalist)"
    r"|\.(ads?|adverts?|advertisements?|advertising|adsense|adbox|adunit|sponsors?|sponsored|promos?|promotions?|banners?|sidebars?|aside|complementary|navs?|navbars?|navigation|menus?|breadcrumbs?"
    r"|masthead|topbar|footers?|contentinfo|cookies?|consent|gdpr|notices?|notifications?|popups?|modals?|overlays?|comments?|disqus|respond|replies|newsletter|subscribe|subscription|signup|login|pagination|pager|toolbar))$"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.IGNORECASE) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw text, ""), ("open", name, attributes) and ("close", name, "") in page order, raw elements as their tags."""
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if name := (m["name"] or m["name2"] or "").lower():
            if m["close"] or m["close2"]:
                yield "close", name, ""
            else:
                yield "open", name, m["attributes"] or ""
                if name in END_OF_RAW and not (m["attributes"] or "").endswith("/"):
                    at = END_OF_RAW[name].search(page, at).start()
    if at < len(page):
        yield "text", page[at:], ""


def contexts_of(name: str, attributes: str, in_content: bool) -> list[str]:
    """What an element says of the words in it; html, body and the outermost content element say nothing by their names."""
    found = [f"@{name}"] if name in LANDMARKS and not (name == "header" and in_content) else []
    if not attributes or name in CONTENT and not in_content or name in ("html", "body"):
        return found
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            found.append(HIDDEN)
        if key in ("class", "id", "role"):
            found += [f".{word}" for word in re.split(r"[\s_-]+", value) if word]
    return found


def is_usual(context: str) -> bool:
    return context in USUAL or bool(NAMES.match(context[1:]) if context[0] == "." else False)


class Item:
    """A run of words or a tag, with where it stands: frame is the innermost open element's number."""

    __slots__ = ("frame", "kind", "linked", "marked", "name", "words")

    def __init__(self, kind, name, words, marked, linked, frame):
        self.kind, self.name, self.words, self.marked, self.linked, self.frame = kind, name, words, marked, linked, frame


#: What ends an open paragraph, and items that end one of their own kind.
BLOCKS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_ENDING = {"p", "li", "dd", "dt"}


class Frame:
    """An element that says something of its words: the frame around it, its contexts, whether it stands in content, and
    whether it is an outermost content element."""

    __slots__ = ("contexts", "outermost", "parent", "within")

    def __init__(self, parent: int, contexts: list[str], within: bool = False, outermost: bool = False):
        self.parent, self.contexts, self.within, self.outermost = parent, contexts, within, outermost


def items(page: str) -> tuple[list[Item], list[Frame]]:
    """The page's sequence, references decoded, raw elements left out; and the frames, outer ones first."""
    out: list[Item] = []
    frames = [Frame(-1, [])]
    opened: list[tuple[str, int]] = []  # name, frame
    blocks: list[int] = []  # places in opened of what is not inline
    open_of: Counter = Counter()

    def close_to(place: int):
        for name, _ in opened[place:]:
            open_of[name] -= 1
        del opened[place:]
        while blocks and blocks[-1] >= place:
            blocks.pop()

    def in_content() -> bool:
        return any(open_of[c] > 0 for c in CONTENT)

    def add(kind, name, words=0):
        out.append(Item(kind, name, words, in_content(), open_of["a"] > 0, opened[-1][1] if opened else 0))

    for kind, name, attributes in tokens(page):
        if kind == "text":
            text = html.unescape(name)
            add("text", text, len(text.split()))
        elif kind == "open":
            if name in RAW:
                continue
            if blocks and (opened[blocks[-1]][0] == "p" and name in BLOCKS or opened[blocks[-1]][0] == name and name in SELF_ENDING):
                close_to(blocks[-1])
            add("tag", name)
            if name in VOID or attributes.endswith("/"):
                continue
            within = in_content()
            found, outermost = contexts_of(name, attributes, within), name in CONTENT and not within
            frame = opened[-1][1] if opened else 0
            if found or outermost:
                frames.append(Frame(frame, found, within, outermost))
                frame = len(frames) - 1
            if name not in INLINE:
                blocks.append(len(opened))
            opened.append((name, frame))
            open_of[name] += 1
        elif name not in RAW:
            if open_of[name]:
                close_to(next(k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name))
            add("tag", name)
    return out, frames


def has_mark(sequence: list[Item]) -> bool:
    return any(x.marked and x.words for x in sequence)


def has_only_mark(frames: list[Frame]) -> bool:
    return sum(f.outermost for f in frames) == 1


def lows(frames: list[Frame], weights: dict[str, float]) -> list[float]:
    """For each frame the most negative weight of a context that its words are in; 0 if none is telling."""
    only = has_only_mark(frames)
    out: list[float] = []
    for f in frames:
        found = [c for c in f.contexts if OF_KIND.match(c)] if f.within else f.contexts
        least = min((w for c in found if (w := weights.get(c, -MOST if is_usual(c) else 0.0)) <= TELLING), default=0.0)
        out.append(min(least, out[f.parent] if f.parent >= 0 and not (f.outermost and only) else 0.0))
    return out


def scores(sequence: list[Item], frames: list[Frame], weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """Each item's score, and whether its words are in a negative context. Inside a page's only mark none is below zero,
    so that a table or an advert does not cut off the words behind it."""
    low, unmarked, only = lows(frames, weights), weights.get(UNMARKED, -MOST) if has_mark(sequence) else 0.0, has_only_mark(frames)
    out, negative = [], []
    for x in sequence:
        context = min(low[x.frame], 0.0 if x.marked else unmarked)
        if x.kind == "tag":
            score = weights.get(x.name, weights.get(OTHER, -0.5))
        elif context <= TELLING:
            score = context / MOST * min(x.words, ITEM_WORDS)
        else:
            score = x.words * weights.get(LINKED if x.linked else WORD, WORD_MOST)
        out.append(max(0.0, score) if only and x.marked else score)
        negative.append(context <= TELLING)
    return out, negative


def best_run(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum, the first such; (0, 0) if none is above zero."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for n, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, n
        total += v
        if total > best:
            best, where = total, (start, n + 1)
    return where


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best run, white space as one space, joined by one space."""
    sequence, frames = items(page or "")
    values, negative = scores(sequence, frames, weights)
    start, end = best_run(values)
    parts: list[str] = []
    for x, left_out in zip(sequence[start:end], negative[start:end]):
        if x.kind == "tag":
            if x.name not in INLINE:
                parts.append(" ")
        elif not left_out:
            parts.append(x.name)
    return " ".join("".join(parts).split())


def _evidence(contexts: dict[str, float] | None):
    """Per task: how often each context (or, once these are known, each kind of word and tag in no negative one) is
    inside and outside the content of labelled pages."""

    def run(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                sequence, frames = items(page.as_py() or "")
                if sum(x.name in CONTENT and x.kind == "tag" for x in sequence) not in (1, 2):  # one element
                    continue
                if contexts is None:
                    _count_contexts(sequence, frames, inside, outside)
                else:
                    low = lows(frames, contexts)
                    for x in sequence:
                        if low[x.frame] > TELLING and not (x.kind == "tag" and x.name in CONTENT):
                            feature = x.name if x.kind == "tag" else LINKED if x.linked else WORD
                            (inside if x.marked else outside)[feature] += x.words if x.kind == "text" else 1
        names = list(inside | outside)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], ["feature", "inside", "outside"])

    return run


def _count_contexts(sequence, frames, inside: Counter, outside: Counter) -> None:
    words = [[0, 0] for _ in frames]
    for x in sequence:
        words[x.frame][x.marked] += x.words
    outside[UNMARKED] += sum(w[0] for w in words)
    inside[WORD] += sum(w[1] for w in words)
    outside[WORD] += sum(w[0] for w in words)
    for k in range(len(frames) - 1, 0, -1):  # inner frames come after outer ones
        for c in set(frames[k].contexts):
            outside[c] += words[k][0]
            inside[c] += words[k][1]
        words[frames[k].parent][0] += words[k][0]
        words[frames[k].parent][1] += words[k][1]


def learn_weights(pages: DataFrame, id_col: str = "page_id", usual: bool = True) -> dict[str, float]:
    """Scores of words, linked words, tags and contexts, from LABELLED_PAGES pages (those first in the order of a hash).

    usual: whether usual names begin with PRIOR_WORDS words outside the content; without it a context that no page has
    is none. The driver gets the features of those pages alone.
    """
    n = pages.count()
    share = min(1.0, LABELLED_PAGES / max(1, n))
    band = (F.xxhash64(id_col).cast("double") / float(2**64) + 0.5) < share
    sample = pages.where(F.coalesce(band, F.lit(True))).select("html")

    def counted(contexts: dict[str, float] | None) -> dict[str, tuple[int, int]]:
        found = sample.mapInArrow(_evidence(contexts), "feature string, inside long, outside long")
        return {r.feature: (r.i, r.o) for r in found.groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()}

    def odds(inside: float, outside: float, most: float) -> float:
        return max(-most, min(most, math.log((inside + 0.5) / (outside + 0.5))))

    seen = counted(None)
    total_in, total_out = (1 + v for v in seen.pop(WORD, (0, 0)))
    weights = {} if usual else dict.fromkeys(filter(is_usual, _every_name()), 0.0)
    for c, (i, o) in seen.items():
        # as if pages had as many words outside as inside
        weights[c] = odds(i / total_in * 1000, (o + PRIOR_WORDS * (usual and is_usual(c))) / total_out * 1000, MOST)
    for feature, (i, o) in counted(weights).items():
        if feature in (WORD, LINKED):
            weights[feature] = max(LEAST, odds(i, o, WORD_MOST))
        else:
            weights[feature] = -LEAST - (TAG_MOST - LEAST) * (o + 0.5) / (i + o + 1)
    return weights


def _every_name() -> set[str]:
    """All usual names, as contexts."""
    words = re.findall(r"[a-z]+\??", NAMES.pattern)
    return USUAL - {UNMARKED, HIDDEN} | {f".{w.rstrip('?')}" for w in words} | {f".{w[:-2]}" for w in words if w.endswith("?")}


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, and one without words, gives an empty text. Every row is read on its own account, repeated
    rows too; other columns are not read, whatever their names. An empty table gives no rows. weights: learn_weights of the
    pages by default.
    """
    known = learn_weights(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(p.as_py(), known) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
