"""Main text of web pages by the line-block distribution.

Markup is stripped to a list of lines, one for each block element.  A line's
weight is its letters and digits outside links, times a factor for what the
elements around it are called or classed: lines of menus, adverts, comments and
the like, and lines outside the page's articles, weigh a small part of their
letters.  Weights are summed over sliding windows of lines of one kind.  A stretch
of text surges where the windows rise from nothing and dives where they fall back
to it; the text between is kept if one of its windows is high enough, for the page
and in itself.  A stretch goes on behind lines of another kind in the same box.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
#: Summed letters of a window at which a stretch is text, and the share of the page's highest window.
SURGE = 60
SHARE = 0.15
#: What counts of the letters of penalised lines, of lines beside the page's articles, and of paragraphs that are all link.
PENALTY, BESIDE, LINKED = 0.05, 0.1, 0.3
#: Share of a page's letters from which articles are its text.
HELD = 0.2

# Element names and attribute words of HTML pages.
DROPPED = {"noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math",
    "mi", "mn", "mo", "mrow", "msub", "msup", "mtext", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that the next block ends where their end tag is left out.
UNCLOSED = {"p", "li", "dt", "dd", "td", "th", "tr", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
#: Penalised however much text they hold.
NEVER_MAIN = {"nav", "footer", "aside", "button", "menu", "dialog"}
CONTENT = {"article", "main"}
CONTENT_ROLES = {"main", "article"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "sponsor", "sponsors", "sponsored", "promo", "promos",
    "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "popup", "modal", "overlay", "paywall", "menu",
    "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "related", "recommended", "recommendations", "share",
    "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "toolbar", "widget", "widgets", "pagination", "pager", "copyright",
    "disclaimer", "skip", "search",
}
HEADER_WORDS = {"header", "masthead", "topbar"}
READERS = {"comment", "comments", "disqus", "reply", "replies", "respond", "responses"}
#: Words that stand beside such a word in a name ("ad-slot", "site-footer") without changing what it says.
NEUTRAL = {
    "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "center", "middle", "inner", "outer", "mobile", "desktop", "list",
    "lists", "box", "boxes", "bar", "wrap", "wrapper", "container", "area", "areas", "section", "block", "blocks", "item", "items", "link", "links", "button",
    "buttons", "btn", "form", "title", "heading", "text", "body", "content", "slot", "unit", "label", "user", "users", "reader", "readers", "post", "posts",
    "article", "articles", "story", "stories", "media", "message", "panel", "group", "row", "column", "col", "rail", "module", "component", "thread",
    "tag", "tags", "us", "my", "the", "js", "google",
}

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGNS = re.compile(r"[\W_]+")


@dataclass
class Line:
    """One block's text, its letters and digits outside links, whether an article holds it,
    whether it is penalised, the boxes around it (its own, and that one's if not the body; all articles are one),
    its letters in links, and whether it is a list item."""

    text: str
    letters: int
    content: bool = False
    penalised: bool = False
    boxes: tuple[int, ...] = (-1,)
    linked: int = 0
    item: bool = False


def _names(value: str) -> set[str]:
    """Words of a class or id: its whole tokens, and the parts of those that say nothing else."""
    out = set()
    for token in value.split():
        parts = [w.lower() for w in WORD.findall(token) if len(w) > 1]
        out.add(token.lower())
        telling = [w for w in parts if w not in NEUTRAL]
        if telling and all(w in ASIDE_WORDS or w in READERS or w in HEADER_WORDS for w in telling):
            out.update(telling)
    return out


def _says(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """What an element says it is: (no main text, a page's header, readers' comments, main text)."""
    aside, header, content = name in ASIDE, name == "header", name in CONTENT
    words: set[str] = set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words |= _names(value)
        elif key == "role":
            aside |= value.lower() in ASIDE_ROLES
            content |= value.lower() in CONTENT_ROLES
        elif key == "itemprop":
            content |= value == "articleBody"
        elif key == "aria-hidden":
            aside |= value.lower() == "true"
        elif key == "style":
            aside |= bool(NO_DISPLAY.search(value))
        elif key == "hidden":
            aside = True
    return aside or bool(words & ASIDE_WORDS), header or bool(words & HEADER_WORDS), bool(words & READERS), content


def _ends(tags: list[tuple[bool, str, str]]) -> list[int]:
    """For each start tag the number of its end tag; -1 where it has none."""
    ends = [-1] * len(tags)
    waiting: dict[str, list[int]] = {}
    block = len(tags)
    for i, (closing, name, _) in enumerate(tags):
        if closing:
            if waiting.get(name):
                ends[waiting[name].pop()] = i
        elif name not in VOID:
            waiting.setdefault(name, []).append(i)
    for i in range(len(tags) - 1, -1, -1):
        closing, name, _ = tags[i]
        if not closing and name in UNCLOSED and (ends[i] < 0 or ends[i] > block):
            ends[i] = block
        if name not in INLINE and name not in VOID:
            block = i
    return ends


def _spans(tags: list[tuple[bool, str, str]], ends: list[int], letters: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(penalised, content): start and end tags of such elements.

    ``letters``: those outside links before each tag.  An element that holds most
    of the page's is not penalised for its name, unless an article lies beside it;
    comments count for nothing there, and are exempt only where the page's articles
    or all of its text lie in them.
    """
    total = letters[-1]
    said = [None if closing or name in INLINE or name in VOID or name in ("html", "body") else _says(name, attributes) for closing, name, attributes in tags]
    articles = [i for i, s in enumerate(said) if s and s[3]]
    inside = lambda a, b: bisect_right(articles, b) - bisect_left(articles, a)
    penalised, comments = [], []
    upto = 0
    for i, s in enumerate(said):
        if s and s[2] and ends[i] >= 0 and i >= upto:
            held = inside(i, ends[i])
            all_ = total - (letters[ends[i]] - letters[i]) < min(SURGE, total)
            if not (held == len(articles) > 0 or all_):
                comments.append((i, ends[i]))
                upto = ends[i]
    lost = [0] * (len(tags) + 2)
    for a, b in comments:
        lost[a + 1] += letters[b] - letters[a]
    lost = list(accumulate(lost))

    def most(a: int, b: int) -> bool:
        mine = letters[b] - letters[a] - (lost[b] - lost[a])
        return inside(a, b) == len(articles) and 2 * mine > total - lost[-1]

    content = [(i, ends[i] if ends[i] >= 0 else len(tags)) for i in articles]
    reach, upto = [], 0
    for a, b in content:
        upto = max(upto, b)
        reach.append(upto)
    for i, s in enumerate(said):
        if not s:
            continue
        at = bisect_left(articles, i)
        within = at > 0 and reach[at - 1] > i  # in an article that opened before
        if s[0] or s[1] and not within:
            name = tags[i][1]
            b = ends[i] if ends[i] >= 0 else len(tags)
            if not s[0] and s[3] or not (name in NEVER_MAIN and ends[i] >= 0) and (most(i, b) or ends[i] < 0 and inside(i + 1, b)):
                continue
            penalised.append((i, b))
    return penalised + comments, content


def lines_of(html: str) -> list[Line]:
    """The page's lines in order."""
    html = HIDDEN.sub("", html)
    tags, pieces, letters, at, linked, total = [], [], [], 0, False, 0
    for m in TAG.finditer(html):
        pieces.append((html[at : m.start()], linked))
        at = m.end()
        tags.append((bool(m[1] or m[4]), (m[2] or m[5]).lower(), m[3] or m[6] or ""))
        if tags[-1][1] == "a":
            linked = not tags[-1][0]
    pieces.append((html[at:], linked))
    dropped, skip = set(), -1
    ends = _ends(tags)
    for i, (closing, name, _) in enumerate(tags):
        if name in DROPPED and not closing and i > skip and ends[i] >= 0:
            dropped.update(range(i + 1, ends[i] + 1))
            skip = ends[i]
    texts = []
    for i, (piece, in_link) in enumerate(pieces):
        text = "" if i in dropped else unescape(piece) if "&" in piece else piece
        texts.append(text)
        own = 0 if in_link or not text else len(SIGNS.sub("", text))
        total += own
        letters.append(total)
    penalised, content = _spans(tags, ends, letters)
    cut, gain = [0] * (len(tags) + 2), [0] * (len(tags) + 2)
    for spans, marks in ((penalised, cut), (content, gain)):
        for a, b in spans:
            marks[a + 1] += 1
            marks[b + 1] -= 1
    cut, gain = list(accumulate(cut)), list(accumulate(gain))

    out: list[Line] = []
    parts: list[str] = []
    boxes: list[int] = []
    first, block = 0, ""

    def flush(upto: int) -> None:
        if text := " ".join("".join(parts).split()):
            before = letters[first - 1] if first else 0
            own = letters[upto] - before
            out.append(Line(text, own, gain[first] > 0, cut[first] > 0, (tuple(boxes[-2:]) or (-1,)) + (-2,) * (gain[first] > 0), len(SIGNS.sub("", text)) - own, block == "li"))
        parts.clear()

    for i, text in enumerate(texts):
        if not parts:
            first = i
        parts.append(text)
        if i == len(tags):
            flush(i)
            break
        closing, name, _ = tags[i]
        if name == "br" or name in DROPPED:
            parts.append(" ")
        elif name not in INLINE:
            flush(i)
            block = "" if closing else name
            while boxes and ends[boxes[-1]] <= i:
                boxes.pop()
            if not closing and ends[i] > i and name not in VOID and name not in UNCLOSED and name not in ("html", "body"):
                boxes.append(i)
    return out


def weights(lines: list[Line], held: float = HELD) -> tuple[list[float], list[int]]:
    """(weight, kind) of each line; lines of one kind are penalised or not, and beside the articles or not.

    A line that is all link weighs nothing, unless it is a paragraph that follows
    text in its box; a line of an article never falls to nothing.  Lines are beside
    the articles where these hold the share ``held`` of the page's letters or more.
    """
    free = [x for x in lines if not x.penalised]
    inside = sum(x.letters for x in free if x.content)
    article = inside > 0 and inside >= held * sum(x.letters for x in free)
    out: list[float] = []
    kinds = [2 * x.penalised + (article and not x.content) for x in lines]
    for k, x in enumerate(lines):
        weight = float(x.letters)
        if not weight and x.linked and not x.item and k and out[-1] > 0 and kinds[k] == kinds[k - 1] and set(x.boxes) & set(lines[k - 1].boxes):
            weight = LINKED * x.linked
        weight += x.content
        out.append(weight * (PENALTY if x.penalised else 1) * (BESIDE if kinds[k] % 2 else 1))
    return out, kinds


def block_sums(weights: list[float], kinds: list[int], window: int = WINDOW) -> list[float]:
    """For each line the weights of the ``window`` lines from it on, as far as they are of its kind."""
    out = []
    for i in range(len(weights)):
        total = 0.0
        for k in range(i, min(i + window, len(weights))):
            if kinds[k] != kinds[i]:
                break
            total += weights[k]
        out.append(total)
    return out


def stretches(weights: list[float], kinds: list[int], boxes: list[tuple[int, ...]] | None = None, window: int = WINDOW) -> list[tuple[int, float, list[int]]]:
    """(kind, highest window, line numbers from surge to dive) of each stretch.

    Text surges where windows rise from nothing and dives after the last line with
    weight before they fall to it or the kind changes, or, once it was high, before a
    line that has none of the boxes around it.  It goes on behind lines of another
    kind if the next of its own has weight and one of these boxes.
    """
    sums, found = block_sums(weights, kinds, window), []
    for kind in sorted(set(kinds)):
        i = 0
        while i < len(weights):
            if kinds[i] != kind or weights[i] <= 0:
                i += 1
                continue
            j, peak, own, held, around = i, 0.0, [], 0, set()
            while j < len(weights) and kinds[j] == kind and sums[j] > 0:
                if boxes and peak >= SURGE and not around.intersection(boxes[j]):
                    break
                around.update(boxes[j] if boxes else ())
                peak = max(peak, sums[j])
                own.append(j)
                held = len(own) if weights[j] > 0 else held
                j += 1
                k = j
                while k < len(weights) and kinds[k] != kind:
                    k += 1
                if j < k < len(weights) and weights[k] > 0 and boxes and around.intersection(boxes[k]):
                    j = k
            found.append((kind, peak, own[:held]))
            i = j
    return found


def kept_lines(weights: list[float], kinds: list[int], boxes: list[tuple[int, ...]] | None = None, window: int = WINDOW) -> list[int]:
    """Line numbers of the stretches with a window of SURGE letters and of SHARE of the page's highest.

    On a page without a window of SURGE letters that isn't penalised, SHARE of the
    highest is enough for lines that aren't.
    """
    found = stretches(weights, kinds, boxes, window)
    highest = max((peak for kind, peak, _ in found if kind < 2), default=0.0)
    least = lambda kind: max(SURGE if kind >= 2 or highest >= SURGE else 0, SHARE * highest)
    return sorted(k for kind, peak, own in found if peak >= least(kind) for k in own)


def main_text(html: str, window: int = WINDOW) -> str:
    """The blocks between surge and dive points, each with white space folded, joined by a space."""
    lines = lines_of(html)
    return " ".join(lines[k].text for k in kept_lines(*weights(lines), [x.boxes for x in lines], window))


def extract(html: Column) -> Column:
    """Main text of a column of pages; null, empty and text-free pages give "".

    Row by row over the whole page, in time linear in its length: repeated rows
    and ties need no care, an empty table gives an empty one, other columns are
    not looked at, and nothing is dropped or capped within the main text.
    """

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(x.as_py() or "") for x in pages), pa.string())

    return of(F.coalesce(html, F.lit("")))
