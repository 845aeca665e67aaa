"""Main text of HTML pages by tag-path ratios (after Wu et al. 2013, "Web news extraction via path ratios").

A page is cut into text blocks at block-level tags. Each block has a root-to-leaf path of tags with their classes;
over the blocks of a path, text length and punctuation are averaged. Both ratios are smoothed along the page with a
Gaussian window, fused by multiplication, and paths above the threshold are content. The deepest container that holds
most of the content is the article (an enclosing article element, if there is one): in it, content paths stay, and
so do low ones (headings, short lists) unless most of their text is links. Between it and its main element or the
element with the page's h1, only content paths and headings of the first two ranks stay; the rest of the page goes.
Where no container below the body holds the content, the body is taken as that outer part.

Some elements never hold an article: scripts, menus, footers, hidden ones, by tag or role. Words in classes and ids
decide nothing alone: an element that they name goes only if prose is left outside it, and where the word is but a part
of a longer name (no-sidebar, social-science), only if there is at least twice as much prose outside as text inside.

Each page is one row and is handled alone, so no rows move. Defined cases: null, empty or textless pages give the
empty text and 0; unclosed or stray tags are closed as a browser would, near enough; quotes count in a tag only after
an equals sign; a `<` that opens no tag is text; very long pages are read whole, in time in proportion to their length;
repeated rows give equal rows; other columns of the table are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Elements, roles, and words of classes and ids.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template noscript textarea iframe svg title xmp noembed noframes".split())
NEVER_TAGS = frozenset("head nav footer aside button select menu dialog option datalist".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer copyright cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist disqus discussion feedback reply replies respond responses talkback share sharing social related recommended recommendations newsletter subscribe signup login search pagination pager toolbar widget".split())
#: Beside a hint in a name, these leave it what it is: comment-list, site-footer.
PLAIN = frozenset("area bar block body bottom box button buttons container feed form group header holder icons inner item items left links list main outer page panel post posts right row reader readers section site slot thread top unit user us wrap wrapper".split())
CONTAINERS = frozenset("html body article main section div td center blockquote form".split())
HEADINGS = frozenset(("h1", "h2"))
_TITLES = frozenset(("h1", "h2", "h3", "h4"))
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?--!?>|.*\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]|=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))*+)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]*+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# What stands in a reader's comment beside its text, and over comments.
_REPLY = re.compile(r"\W*(?:reply|respond|quote|like|upvote|flag|report|permalink|antworten|zitieren|melden|gefällt mir|répondre|citer|signaler|responder|citar|denunciar|me gusta)\b.{0,25}", re.I)
_WHEN = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|\bvor \d+ |\bil y a \d+ |\bhace \d+ ", re.I)
_OVER = re.compile(r"(?:\d+\s+)?(?:comments?|responses?|replies|discussion|reader comments|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\b.{0,20}", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)

#: Standard deviations of smoothing, in blocks; share of the mean fused ratio that makes a path content; share of content that the article holds.
SIGMA, THRESHOLD, HOLDS = 1.0, 0.5, 0.8
#: Share of a path's text in links from which it is a menu; code points and marks of a block of prose; longest copyright line.
LINKS, PROSE, MARKS, RIGHTS = 0.5, 40, 1, 200
#: Longest block that is a comment's name, time or reply link; share of alike siblings that must have such; longest line over comments.
SHORT, ALIKE, OVER = 60, 0.8, 40
#: Prose outside a hinted element, as a share of the text inside, from which the element goes: whole names, parts of names.
OUTSIDE = {2: 0.1, 1: 2.0}
#: Share of the most prose in a hinted element from which the first such element counts as the article's wrapper.
FAIR = 0.2


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    label: str
    number: int
    hint: int = 0  # 2: named by a hint, 1: a hint is part of a longer name
    never: bool = False
    inline: bool = False
    article: bool = False


@dataclass(slots=True)
class Text:
    text: str
    links: int  # code points in links
    up: tuple[Element, ...]  # root first


def _hint(names: str) -> int:
    """Whether a class or id names what isn't an article: 2 wholly, 1 in part, 0 not."""
    found = 0
    for name in names.split():
        parts = [x for x in _PARTS.split(_HUMP.sub("-", name).lower()) if x and not x.isdigit()]
        if not HINTS.isdisjoint(parts):
            found = max(found, 2 if all(x in HINTS or x in PLAIN for x in parts) else 1)
    return found


def _element(tag: str, attributes: str, number: int, inside_article: bool) -> Element:
    e = Element(tag, "", number, never=tag in NEVER_TAGS or tag == "header" and not inside_article, article=tag == "article", inline=tag not in BLOCK_TAGS)
    if tag == "form":
        e.hint = 2
    if not attributes.strip(" \t\r\n/"):
        return e
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            e.never = True
        elif name == "role":
            e.never |= value.lower() in NEVER_ROLES and tag not in ("body", "article", "main")
        elif name == "itemprop":
            e.article |= value == "articleBody"
        elif name in ("class", "id"):
            e.label = e.label or " ".join(value.split())
            if tag not in ("html", "body", "article", "main"):
                e.hint = max(e.hint, _hint(value))
    return e


def text_blocks(page: str) -> list[Text]:
    """The page's blocks with text, but for those in elements that never hold an article."""
    found: list[Text] = []
    stack: list[Element] = []
    pieces: list[str] = []
    links = number = at = 0
    anchor = False

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append(Text(text, links, tuple(e for e in stack if not e.inline)))
            pieces.clear()
        links = 0

    def close(upto: int) -> None:
        if not all(e.inline for e in stack[upto:]):
            flush()
        del stack[upto:]

    while True:
        m = _TAG.search(page, at)
        if not (stack and stack[-1].never):
            piece = page[at : m.start() if m else len(page)]
            pieces.append(piece)
            links += len(piece) if anchor else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag == "a":
            anchor = not ends
        if tag == "br":
            pieces.append(" ")
        elif tag in RAW_TAGS and not ends:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK_TAGS:
                flush()
        elif ends:
            of = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if of is not None:
                close(of)
            elif tag in BLOCK_TAGS:
                flush()
        elif tag not in BLOCK_TAGS:
            if tag not in VOID_TAGS and (m[3].strip(" \t\r\n/") or tag in NEVER_TAGS):
                e = _element(tag, m[3], 0, True)
                if e.never:
                    stack.append(e)
        else:
            if not (tag in NEVER_TAGS and tag in ("button", "select", "option", "datalist")):
                flush()
            anchor = False
            if tag == "body":  # what the head left open
                close(next((i for i, x in enumerate(stack) if x.tag == "head"), len(stack)))
            ends_at = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or stack[i].tag in ends_at:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "td"):
                    break
            if tag not in VOID_TAGS:
                number += 1
                e = _element(tag, m[3], number, any(x.article or x.tag == "main" for x in stack))
                e.never |= bool(stack and stack[-1].never)
                stack.append(e)
    flush()
    return found


def _prose(b: Text) -> bool:
    return len(b.text) >= PROSE and 2 * b.links < len(b.text) and len(PUNCTUATION.findall(b.text)) >= MARKS


def without_hinted(blocks: list[Text]) -> list[Text]:
    """blocks less the hinted elements that go.

    Elements named wholly by hints are judged from the outermost. Where too little prose is left outside to drop all, the
    first one with a fair share of the prose is taken for the article's wrapper, and the others are judged again.
    """
    blocks = [b for b in blocks if len(b.text) > RIGHTS or not _RIGHTS.match(b.text)]
    wrappers: set[int] = set()
    while True:
        inside, own, rest = {}, {}, 0
        for b in blocks:
            top = next((e.number for e in b.up if e.hint == 2 and e.number not in wrappers), None)
            prose = len(b.text) if _prose(b) else 0
            if top is None:
                rest += prose
            else:
                inside[top] = inside.get(top, 0) + len(b.text)
                own[top] = own.get(top, 0) + prose
        gone = {n for n, size in inside.items() if not own[n] or rest >= OUTSIDE[2] * size}
        blocks = [b for b in blocks if not any(e.number in gone for e in b.up)]
        left = [n for n in inside if n not in gone]
        if not left:
            break
        wrappers.add(next(n for n in left if own[n] >= FAIR * max(own[k] for k in left)))
    total = sum(len(b.text) for b in blocks if _prose(b))
    inside, own = {}, {}
    for b in blocks:
        for e in b.up:
            if e.hint == 1:
                inside[e.number] = inside.get(e.number, 0) + len(b.text)
                own[e.number] = own.get(e.number, 0) + (len(b.text) if _prose(b) else 0)
    gone = {n for n, size in inside.items() if total - own[n] >= max(OUTSIDE[1] * size, 1)}
    return [b for b in blocks if not any(e.number in gone for e in b.up)]


def without_comments(blocks: list[Text]) -> list[Text]:
    """blocks less comments that no name gives away: two siblings or more of one tag and class, after prose, that have a reply link each, or a short line with a time."""
    members: dict[tuple, dict[int, list[int]]] = {}
    for i, b in enumerate(blocks):
        for above, e in zip(b.up, b.up[1:]):
            if e.tag in ("div", "li", "section", "article", "tr", "dd"):
                members.setdefault((above.number, e.tag, e.label), {}).setdefault(e.number, []).append(i)
    gone: set[int] = set()
    prose = np.cumsum([0, *(len(b.text) if _prose(b) else 0 for b in blocks)])
    for (above, _, _), each in sorted(members.items(), key=lambda x: min(map(min, x[1].values()))):
        first, last = min(map(min, each.values())), max(map(max, each.values()))
        short = [[blocks[i].text for i in at if len(blocks[i].text) <= SHORT] for at in each.values()]
        # all of a comment but its short lines must be prose of its own: an entry with a heading is an article
        marked = sum(any(_REPLY.fullmatch(t) for t in lines) or len(lines) < len(at) and any(_WHEN.search(t) for t in lines) for lines, at in zip(short, each.values(), strict=True))
        headed = any(e.tag in _TITLES for at in each.values() for i in at for e in blocks[i].up)
        if len(each) < 2 or marked < ALIKE * len(each) or headed or first in gone or prose[first] < (prose[last + 1] - prose[first]) * OUTSIDE[2]:
            continue
        gone.update(i for at in each.values() for i in at)
        if first and len(blocks[first - 1].text) <= OVER and _OVER.fullmatch(blocks[first - 1].text):
            gone.add(first - 1)
    return [b for i, b in enumerate(blocks) if i not in gone]


def content(blocks: list[Text]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: whether its path's fused ratio makes it content, what it weighs as such, and whether its path's text is mostly links."""
    number: dict[str, int] = {}
    of = np.array([number.setdefault("\t".join(f"{e.tag}.{e.label}" for e in b.up), len(number)) for b in blocks])
    length = np.array([len(b.text) for b in blocks], float)
    points = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    nodes = np.bincount(of)
    reach = int(3 * SIGMA)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    around = np.convolve(np.ones(len(of)), bell)[reach:-reach]
    smooth = lambda x: np.convolve((np.bincount(of, x) / nodes)[of], bell)[reach:-reach] / around
    plain = np.array([max(len(b.text) - b.links, 0) for b in blocks], float)
    fused = smooth(plain) * (smooth(points) + 0.1)
    by_path = np.bincount(of, fused) / nodes
    menu = (np.bincount(of, length - plain) >= LINKS * np.bincount(of, length))[of]
    chosen = (by_path >= THRESHOLD * np.average(fused, weights=length))[of] & ~menu
    own = (np.bincount(of, plain) / nodes * (np.bincount(of, points) / nodes + 0.1))[of]  # unsmoothed, so that neighbours lend nothing
    return chosen, np.where(chosen, length * own, 0.0), menu


def _outer(blocks: list[Text], article: Element, first: int) -> Element:
    """The lowest element below the body with the article, whose first block is given, and an h1 before it; else the main element, else the parent."""
    above = [e for e in blocks[first].up[: blocks[first].up.index(article) + 1] if e.tag not in ("html", "body")]
    titles = {e.number for b in blocks[: first + 1] if any(e.tag == "h1" for e in b.up) for e in b.up}
    return next((e for e in reversed(above) if e.number in titles), None) or next((e for e in above if e.tag == "main"), above[-2] if len(above) > 1 else article)


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one space."""
    blocks = without_comments(without_hinted(text_blocks(page or "")))
    if not blocks:
        return ""
    chosen, weight, menu = content(blocks)
    held: dict[int, float] = {}
    elements: dict[int, Element] = {}
    for b, ok, w in zip(blocks, chosen, weight.tolist(), strict=True):
        for e in b.up if ok else ():
            held[e.number] = held.get(e.number, 0) + w
            elements[e.number] = e
    if not held:  # no element, or nothing but links
        return " ".join(b.text for b, links in zip(blocks, menu, strict=True) if not links)
    most = HOLDS * weight.sum()
    holders = [e for n, e in sorted(elements.items()) if held[n] >= most and e.tag in CONTAINERS and e.tag not in ("html", "body")]  # from the root
    article = next((e for e in holders if e.article), holders[-1] if holders else None)
    if article is None:
        low, high = np.flatnonzero(chosen)[[0, -1]]
        return " ".join(b.text for i, (b, links) in enumerate(zip(blocks, menu, strict=True)) if not links and (low <= i <= high or any(e.tag == "h1" for e in b.up)))
    first = next(i for i, b in enumerate(blocks) if article in b.up)
    outer, kept = _outer(blocks, article, first), []
    line = {e.number for e in blocks[first].up[: blocks[first].up.index(article)]}
    for i, (b, ok, links) in enumerate(zip(blocks, chosen, menu, strict=True)):
        heading = next((k for k, e in enumerate(b.up) if e.tag in HEADINGS), None)
        title = heading is not None and i < first and (outer in b.up or b.up[heading].tag == "h1" and (heading == 0 or b.up[heading - 1].number in line))
        # a linked heading over prose is the article's own; one over links is a teaser
        linked = links and any(e.tag in _TITLES for e in b.up) and i + 1 < len(blocks) and not menu[i + 1] and article in blocks[i + 1].up
        if article in b.up and (not links or linked) or outer in b.up and ok or title:
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Each row of pages(page_id, url, html) as page_id, url, text, n_chars."""

    def run(batches):
        for pdf in batches:
            text = [main_text(x if isinstance(x, str) else None) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
