"""A page as its leaf blocks: runs of text between block borders, each with features of its place and of its text.

Tags are read by one regular expression; an element holds the features of all its ancestors as bits of one number, so a page
costs one pass however deep it is.  A block's text has character references decoded and its white space as single blanks.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

# A tag with quoted values; where a quote never ends, up to the next bracket.  An open tag at the end goes.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKENS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup and no text of the page.
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp svg math select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
# A new one closes an open one of these kinds up to the border.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}

_TAGS = (
    "nav header footer aside article main section form figure figcaption table td ul ol li dl blockquote pre code h1 h2 h3 h4 p "
    "address details dialog button label fieldset menu a b small time summary".split())
# Words in class, id, role and similar attributes, by what they tell.
_NAMED = {
    "navigation": "nav navigation navbar navi menu menus breadcrumb breadcrumbs pagination pager toc skip topbar tabs sitemap links crumbs",
    "heading": "header masthead branding logo banner hero site",
    "footing": "footer foot copyright colophon legal contentinfo imprint",
    "side": "sidebar side aside rail widget widgets secondary complementary column",
    "advert": "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion promoted teaser dfp",
    "notice": "cookie cookies consent gdpr notice notices alert warning popup modal overlay toast privacy notification announcement paywall",
    "comment": "comment comments reply replies discussion disqus respond reader readers responses review reviews thread commentlist",
    "form": "form newsletter subscribe subscription signup login register search contact poll survey",
    "related": "share sharing social follow related recommended recommendations more trending popular tags author byline meta next prev",
    "content": "article content post entry story body text prose main",
    "hidden": "hidden none invisible",
}
_TELLS = {
    "rights": r"©|\(c\)|copyright|all rights|alle rechte|tous droits|todos los derechos",
    "asks": r"\bcookies?\b|\bsubscribe|\bnewsletter|\bsign (?:in|up)\b|\blog ?in\b|\bprivacy\b|\badvert|\bsponsored\b|\bshare\b|\bcomments?\b|\breply\b",
}
FEATURES = [*_TAGS, *(f"named {k}" for k in _NAMED), *(f"tells {k}" for k in _TELLS), *(
    "first|after h1|beside h1|words 0|words 2|words 5|words 10|words 20|words 50|links 0|links some|links most|links all|sentence|comma|marks|digits"
    .split("|"))]
_BIT = {name: 1 << i for i, name in enumerate(FEATURES)}
_TAG_BIT = {t: _BIT[t] for t in _TAGS} | {"th": _BIT["td"], "strong": _BIT["b"], "dd": _BIT["dl"], "dt": _BIT["dl"]} | {
    h: _BIT["h4"] for h in ("h5", "h6")}
_NAME_BIT = {w: _BIT[f"named {k}"] for k, words in _NAMED.items() for w in words.split()}
_TELL = [(re.compile(p), _BIT[f"tells {k}"]) for k, p in _TELLS.items()]
_WORDS = [(50, _BIT["words 50"]), (20, _BIT["words 20"]), (10, _BIT["words 10"]), (5, _BIT["words 5"]), (2, _BIT["words 2"]), (0, _BIT["words 0"])]
LABEL = "data-label"


@dataclass(slots=True)
class Block:
    text: str
    features: int
    same_parent: bool          # stands in the same element's children as the block before
    label: str | None = None   # of a labelled page


class _Own:
    """Features and label that a tag brings by itself; the same tags come again and again."""

    LIMIT = 20_000

    def __init__(self):
        self.known: dict[tuple[str, str], tuple[int, str | None]] = {}

    def __call__(self, name: str, attributes: str) -> tuple[int, str | None]:
        found = self.known.get((name, attributes))
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            bits, label = _TAG_BIT.get(name, 0), None
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == LABEL:
                    label = value
                elif key in ("class", "id", "role", "aria-label"):
                    for word in TOKENS_OF_NAME.findall(value):
                        bits |= _NAME_BIT.get(word.lower(), 0)
                elif key == "hidden" or (key == "style" and "none" in value):
                    bits |= _BIT["named hidden"]
            found = self.known[name, attributes] = (bits, label)
        return found


_own = _Own()


def _of_text(text: str, links: int) -> int:
    words = text.count(" ") + 1
    bits = next(bit for least, bit in _WORDS if words > least)
    share = links / len(text)
    bits |= _BIT["links 0" if not links else "links all" if share > 0.9 else "links most" if share > 0.4 else "links some"]
    if text[-1] in ".!?…\"»“":
        bits |= _BIT["sentence"]
    if ", " in text:
        bits |= _BIT["comma"]
    if any(c in text for c in "|»›·•"):
        bits |= _BIT["marks"]
    if any(c in text for c in "0123456789"):
        bits |= _BIT["digits"]
    low = text.lower()
    for pattern, bit in _TELL:
        if pattern.search(low):
            bits |= bit
    return bits


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks that hold text, in page order; NULL and empty pages have none."""
    page = page or ""
    out: list[Block] = []
    # name, features, label, number of the innermost block element and of the one around it
    stack: list[tuple[str, int, str | None, int, int]] = [("", 0, None, 0, 0)]
    open_names: dict[str, int] = {}
    pieces: list[str] = []
    links = number = 0
    last_parent, h1_parent, seen = -1, -1, _BIT["first"]
    in_link = 0

    def flush() -> None:
        nonlocal links, last_parent, h1_parent, seen
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            features = stack[-1][1] | _of_text(text, min(links, len(text))) | seen
            if stack[-1][4] == h1_parent:
                features |= _BIT["beside h1"]
            out.append(Block(text, features, stack[-1][4] == last_parent, stack[-1][2]))
            last_parent = stack[-1][4]
            seen &= ~_BIT["first"]
            if features & _BIT["h1"]:
                seen |= _BIT["after h1"]
                h1_parent = stack[-1][4]
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                links += len(" ".join(text.split()))

    def close(upto: int) -> None:
        nonlocal in_link
        for name, *_ in stack[upto:]:
            open_names[name] -= 1
            in_link -= name == "a"
        del stack[upto:]

    def close_kind(kinds: tuple[str, ...], borders: tuple[str, ...]) -> None:
        if not any(open_names.get(k) for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in kinds:
                close(i)
                return
            if stack[i][0] in borders:
                return

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCK or name == "br":
            if name == "br":
                pieces.append(" ")
                continue
            flush()
        if m[1]:
            if open_names.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                close(i)
            continue
        if name in RAW:
            pieces.append(" ")
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            close_kind(("p",), ())
        if name in CLOSES:
            close_kind(*CLOSES[name])
        bits, label = _own(name, m[3])
        number += 1
        _, above, told, block, around = stack[-1]
        place = (number, block) if name in BLOCK else (block, around)
        stack.append((name, above | bits, told if label is None else label, *place))
        open_names[name] = open_names.get(name, 0) + 1
        in_link += name == "a"
    flush()
    return out
