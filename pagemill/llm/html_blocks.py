"""HTML to DOM leaf blocks: runs of text under one block-level element, with their ancestors.

The time is linear in the page: each open element knows what its ancestors
say and which elements a new tag may close, so neither a block nor a tag
walks the stack, and no search runs twice over what an earlier one has seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: A tag up to its end: quotes count after = only, as in browsers. The second form is of tags whose quotes never close.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?:!|\?|/)""")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|aria-label)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: A slash that ends the tag, not an unquoted value: after white space, a quote or the name alone.
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Element names of the HTML standard by how they are parsed.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture nobr slot".split())
MATH = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
INLINE |= MATH
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template annotation annotation-xml select xmp noembed noframes desc metadata".split())
#: Elements whose content stands in for them: part of a running text, else blocks.
FALLBACK = frozenset("noscript object canvas video audio".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
LISTS = frozenset(["ul", "ol", "dl", "table"])
SCOPES = frozenset("ul ol dl table body html article section div button object noscript".split())
#: Elements that are told apart among a block's ancestors; all others count as one.
KNOWN = frozenset(
    "html body article main section nav header footer aside form table ul ol dl blockquote figure pre details dialog address fieldset p h1 h2 h3 h4 h5 h6 li td th dd div center figcaption label button noscript object canvas".split()
)
ENDED = frozenset().union(*CLOSED_BY.values())
#: Words in class, id, role and label attributes, by what they say of an element.
GROUPS = {
    "content": "content article post entry story main text body copy prose",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sitemap",
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo outbrain taboola dfp",
    "comment": "comment comments commentlist disqus replies responses",
    "side": "sidebar rail widget widgets related recommended recommendations trending teaser teasers",
    "foot": "footer foot copyright colophon contentinfo imprint disclaimer",
    "head": "header head masthead topbar logo brand branding",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription paywall toast",
    "share": "share sharing social follow toolbar",
    "form": "form search login signin signup register",
    "meta": "meta byline author date tags tag categories category timestamp published dateline",
}
#: Words that as often name a part of the article; only the fit and the other features say what they mean.
MAYBE = {
    "menu": "tabs tab toc skip links", "advert": "promotion banner commercial", "comment": "reply respond discussion reader readers thread feedback",
    "side": "side aside popular more complementary", "foot": "legal bottom", "head": "top site", "notice": "alerts warning message announcement privacy",
    "share": "print tools actions buttons", "form": "contact input poll",
}
#: Words beside which a word of GROUPS still names its element; beside others ("alert-levels") it is one that may.
FRAME = frozenset(
    "box list area wrapper wrap container section block item bar inner outer unit slot top bottom left right main site page global js id el row col column panel group part card body content text article post primary secondary mobile desktop the module region zone holder".split()
)
#: Words that take back what stands beside them, or tell of the page's layout.
TAKEN_BACK = frozenset("no non free without has with hide enabled disabled less".split())
GROUP_OF = {word: group for group, words in GROUPS.items() for word in words.split()}
MAYBE_OF = {word: group for group, words in MAYBE.items() for word in words.split()}
NEGATIVE = frozenset(GROUPS) - {"content", "head", "meta"}
NOTHING: frozenset[str] = frozenset()


@dataclass(slots=True)
class Node:
    """An open element; tags, says and hints are also its ancestors'."""

    tag: str
    says: frozenset[str] = NOTHING
    hints: frozenset[str] = NOTHING
    tags: frozenset[str] = NOTHING
    above: frozenset[str] = NOTHING  # the ancestors' hints
    open_p: bool = False  # whether a p is open within the scope
    ends: frozenset[str] = NOTHING  # elements that a new one may close, up to the list or table


@dataclass
class Block:
    text: str
    node: Node = field(default_factory=lambda: Node("body"))
    linked: int = 0  # characters inside links


def groups_of(attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    """What an element's attributes say of it, and what they may say; short ones, which recur, are remembered."""
    return short_groups(attributes) if len(attributes) < 400 else read_groups(attributes)


def read_groups(attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    says, hints = set(), set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            says.add("hidden")
        elif name in ("class", "id", "role", "aria-label"):
            for token in value.split():
                words = [w.lower() for w in WORD.findall(token)]
                if TAKEN_BACK.intersection(words):
                    continue
                framed = all(w in FRAME or w in GROUP_OF or w in MAYBE_OF for w in words)
                for w in words:
                    if w in GROUP_OF:
                        (says if framed or GROUP_OF[w] in ("content", "advert") else hints).add(GROUP_OF[w])
                    elif w in MAYBE_OF:
                        hints.add(MAYBE_OF[w])
    return frozenset(says), frozenset(hints - says)


short_groups = lru_cache(maxsize=20_000)(read_groups)


class Reader:
    """The state while a page is read."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.root = Node("")
        self.stack = [self.root]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.link = self.linked = self.foreign = 0
        self.running = False  # whether text has a sign so far

    def flush(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined:
            self.out.append(Block(joined, self.stack[-1], min(self.linked, len(joined))))
        self.text.clear()
        self.linked, self.running = 0, False

    def add(self, raw: str) -> None:
        if raw:
            x = unescape(raw) if "&" in raw else raw
            self.text.append(x)
            self.running = self.running or not x.isspace()
            if self.link:
                self.linked += len(x.strip())

    def push(self, tag: str, says: frozenset[str], hints: frozenset[str]) -> None:
        up, known = self.stack[-1], tag if tag in KNOWN else "?"
        self.stack.append(
            Node(
                tag,
                up.says | says if not says <= up.says else up.says,
                hints,
                up.tags | {known} if known not in up.tags else up.tags,
                up.above | up.hints if not up.hints <= up.above else up.above,
                tag == "p" or (tag not in SCOPES and up.open_p),
                NOTHING if tag in LISTS else (up.ends | {tag}) if tag in ENDED and tag not in up.ends else up.ends,
            )
        )
        self.open[tag] = self.open.get(tag, 0) + 1

    def close(self, tag: str) -> bool:
        """Close the nearest open element of this name and all within it. What is passed over is closed, so each is passed once."""
        if not self.open.get(tag):
            return False
        self.flush()
        while True:
            gone = self.stack.pop()
            self.open[gone.tag] -= 1
            if gone.tag == tag:
                return True

    def begin(self, tag: str, attributes: str) -> None:
        closed = tag in VOID or ((self.foreign or tag in MATH or tag == "svg") and bool(SELF_CLOSED.search(attributes)))
        if tag in ("br", "mtr", "mtd"):
            self.text.append(" ")
            return
        if tag == "svg" or self.foreign:
            self.foreign += tag == "svg" and not closed
            if tag in ("text", "tspan"):
                self.text.append(" ")
            return
        says, hints = groups_of(attributes) if tag not in VOID and attributes.strip() else (NOTHING, NOTHING)
        if tag in INLINE and not (says & NEGATIVE or "hidden" in says):
            self.link += tag == "a"
            return
        if tag in FALLBACK and self.running:
            return
        self.flush()
        if closed:
            return
        if tag not in INLINE:
            if self.stack[-1].open_p and tag not in FALLBACK:
                self.close("p")
            self.link = 0
        while CLOSED_BY.get(tag, NOTHING) & self.stack[-1].ends:
            for other in CLOSED_BY[tag] & self.stack[-1].ends:
                self.close(other)
                break
        self.push(tag, says, hints)

    def end(self, tag: str) -> None:
        if tag == "svg":
            self.foreign = max(0, self.foreign - 1)
            return
        if self.foreign:
            return
        if tag == "a":
            self.link = 0
        if not self.close(tag) and tag == "p":  # other ends without a begin are ignored
            self.flush()


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, character references decoded, white space inside a block as single spaces."""
    page, at, n = Reader(), 0, len(html)
    last = html.rfind(">")
    unclosed: set[str] = set()  # raw elements without an end from here on
    while at < n:
        m = TAG.search(html, at) if at <= last else None
        if not m:
            cut_off = UNFINISHED.search(html, at) if at > last else None
            page.add(html[at : cut_off.start() if cut_off else n])
            break
        page.add(html[at : m.start()])
        at = m.end()
        if m[2] is None and m[5] is None:
            if html.startswith("<!--", m.start()):
                end = html.find("-->", m.start() + 2)  # <!--> is a comment as well
                at = n if end < 0 else max(at, end + 3)
            else:
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            continue
        ending, tag, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if ending:
            page.end(tag)
        elif tag in RAW and not (page.foreign and SELF_CLOSED.search(attributes)):
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            if end:
                at = end.end()
            else:
                unclosed.add(tag)
                at = n if tag in ("script", "style") else at
            page.text.append(" ")
        else:
            page.begin(tag, attributes)
    page.flush()
    return page.out
