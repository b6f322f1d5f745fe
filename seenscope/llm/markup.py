"""HTML as a sequence of start tags and runs of text, each with its place in the page.

A forgiving reader in one pass: comments, scripts and styles are skipped, a paragraph ends
where the next block begins, end tags without a start tag are ignored. Elements are known by
a hash of the way from the root to them, names with classes and ids, so a page nested to any
depth costs no more than its length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import xxhash

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
_NAME = re.compile(r"[A-Za-z]+")
_NUMBER = re.compile(r"[0-9]{3}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML element names by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
# Which open elements an element of that name ends, and where the search for them stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
# Elements that never hold the main text, and words in classes, ids and roles that say so.
ASIDE = frozenset("nav aside footer form button select menu dialog svg object canvas audio video head search".split())
MARKED = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner masthead "
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside toolbar "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "login search form comment comments disqus respond replies share sharing social related recommended "
    "recommendations pagination pager copyright disclaimer contentinfo complementary alert dialog".split()
)
COMMENTS = frozenset("comment comments disqus respond replies".split())
IN_HEAD = frozenset("html head body".split())


def _hash(place: int, text: str) -> int:
    """A signed number of 64 bits."""
    x = xxhash.xxh3_64_intdigest(f"{place}\0{text}".encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


@dataclass(slots=True)
class Frame:
    """An open element."""

    name: str
    path: int  # hash of the way to it
    depth: int
    drop: bool  # not main text
    hard: bool  # dropped by its kind
    marked: bool  # dropped by a word of its class, id or role
    headed: bool  # dropped as part of a header
    article: bool  # inside an article
    main: bool
    container: Frame | None  # the nearest one, itself included
    outer: Frame | None  # the one around it
    words: int = 0  # about as many as the text outside links in it has, when the page is read


@dataclass(slots=True)
class Page:
    """``events`` are ``(frame, text, block, link)`` in page order, ``text`` being None at a
    start tag; runs of the same ``block`` belong together."""

    events: list[tuple[Frame, str | None, int, bool]] = field(default_factory=list)
    containers: list[Frame] = field(default_factory=list)
    has_article: bool = False
    has_main: bool = False


def _words(value: str) -> set[str]:
    return {w.lower() for pattern in (_NAME, _PART) for w in pattern.findall(value)}


_PATHS: dict[tuple[int, str], int] = {}
_KEYS: dict[tuple[str, str], tuple[str, frozenset[str], frozenset[str]]] = {}


def _key(name: str, attributes: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """``(name with class and id, words of class, id and role, whole classes and roles)``."""
    if not attributes.strip():
        return name, frozenset(), frozenset()
    known = _KEYS.get((name, attributes))
    if known is None:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        classes = sorted(set(found.get("class", "").split()))
        # Ids and classes with long numbers count things; they do not name a kind of place.
        named = [c for c in [*classes, "#" + found.get("id", "")] if c != "#" and not _NUMBER.search(c)]
        roles = set(found.get("role", "").lower().split())
        words = _words(found.get("class", "")) | _words(found.get("id", "")) | roles
        known = ".".join([name, *named]), frozenset(words), frozenset({c.lower() for c in classes} | roles)
        if len(_KEYS) < 10_000:
            _KEYS[(name, attributes)] = known
    return known


def _path(up: int, key: str) -> int:
    known = _PATHS.get((up, key))
    if known is None:
        known = _hash(up, key)
        if len(_PATHS) < 10_000:
            _PATHS[up, key] = known
    return known


def _opened(name: str, attributes: str, up: Frame, page: Page) -> Frame:
    key, words, whole = _key(name, attributes)
    article, main = name == "article", name == "main" or "main" in whole
    # An article that allows comments is not a comment.
    comment = bool((whole if article else words) & COMMENTS) and not main
    outermost = name in ("html", "body")
    hard = up.hard or (name in ASIDE and not main) or (comment and not outermost)
    marked = bool(words & MARKED) and not (outermost or article or main or name in HEADINGS)
    marked, headed = marked or up.marked, name == "header" or up.headed
    if (article or main) and not hard:
        marked = headed = False
    # The title of an article may stand in a header of its own.
    titled = name in HEADINGS and (up.article or up.main) and not words & MARKED
    drop = hard or marked or (headed and not titled)
    page.has_article |= article and not drop
    page.has_main |= main and not drop
    frame = Frame(
        name,
        _path(up.path, key),
        up.depth + 1,
        drop,
        hard,
        marked,
        headed,
        (up.article or article) and not hard,
        (up.main or main) and not hard,
        up.container,
        up.container,
    )
    if name in CONTAINERS or main:
        frame.container = frame
        page.containers.append(frame)
    return frame


def read(html: str | None) -> Page:
    """The page's start tags and texts. A null page is empty."""
    page, html = Page(), html or ""
    root = Frame("", 0, 0, False, False, False, False, False, False, None, None)
    root.container = root
    page.containers.append(root)
    stack, block, link = [root], 0, False
    opened: Counter[str] = Counter()  # names on the stack, so that stray end tags cost nothing
    events = page.events
    at, end = 0, len(html)
    last = html.rfind(">") + 1  # no markup ends beyond

    def push(frame: Frame) -> None:
        stack.append(frame)
        opened[frame.name] += 1

    def pop() -> None:
        gone = stack.pop()
        opened[gone.name] -= 1
        stack[-1].words += gone.words

    def text(upto: int) -> None:
        if at < upto:
            run = html[at:upto]
            if "&" in run:
                run = unescape(run)
            events.append((stack[-1], run, block, link))
            if not link and not stack[-1].drop:
                stack[-1].words += run.count(" ") + 1

    def close(names, stops) -> None:
        """End the innermost element of these names, and what is open in it."""
        if stack[-1].name in names:
            pop()
        elif any(opened[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i].name in stops:
                    return

    while at < end:
        m = _MARKUP.search(html, at, last) if at < last else None
        if m is None:
            text(end)
            break
        text(m.start())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = end
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if name == "a":
            link = not closing
        if closing:
            if name in INLINE:
                close((name,), CLOSES_P)
            else:
                block += 1
                close(HEADINGS if name in HEADINGS else (name,), ())
        elif name in RAW:
            over = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if over or not attributes.endswith("/"):
                at = over.end() if over else end
        elif name in INLINE:
            if name not in VOID and _key(name, attributes)[1] & MARKED:
                push(_opened(name, attributes, stack[-1], page))
        else:
            block += 1
            if name in VOID:
                continue
            if name in CONTAINERS:
                link = False
            while stack[-1].name in INLINE:
                pop()
            if name in CLOSES_P and stack[-1].name == "p" or name in HEADINGS and stack[-1].name in HEADINGS:
                pop()
            if name in CLOSES:
                close(*CLOSES[name])
            if opened["head"] and name not in IN_HEAD or name == "body":
                close(("head",), ())
            push(_opened(name, attributes, stack[-1], page))
            events.append((stack[-1], None, block, False))
    while len(stack) > 1:
        pop()
    return page


def text_hash(frame: Frame, run: str) -> int:
    """A run of text in its place."""
    return _hash(frame.path, " ".join(run.split()))


def blocks(runs: list[tuple[str, int]]) -> str:
    """Runs ``(text, block)`` joined: white space becomes one space, also between blocks."""
    out, current, last = [], [], None
    for run, block in runs:
        if block != last and current:
            out += "".join(current).split()
            current = []
        current.append(run)
        last = block
    out += "".join(current).split()
    return " ".join(out)
