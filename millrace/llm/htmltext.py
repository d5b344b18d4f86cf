"""Main text of web pages by a linear-chain conditional random field.

A page is read into its leaf blocks: runs of text between the tags that break
lines, in page order. A block has features of its ancestors' tags and class
names, of its place and of its text; a chain of two states, main text and other,
is decoded by Viterbi. The field is trained on labelled pages, which ``labelled``
makes: layouts with and without semantic tags, with menus, notices, adverts,
forms, side columns, reader comments and broken markup.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

TRAIN_PAGES = 600
STEPS, RATE, RIDGE = 150, 0.25, 2e-4

# ---- reading pages into blocks ----------------------------------------------

#: Elements that break lines.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video audio canvas object".split()
)
#: Elements whose content is no text, to the page's end if they aren't closed.
RAW = frozenset("script style textarea".split())
#: Elements whose content is not shown; without an end tag only the start tag goes.
UNSHOWN = frozenset("noscript template svg title select iframe annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table div section article body".split())

#: A tag's quoted values may hold ">"; where quotes don't close, the tag ends at the first one.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+'){0,400}+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*")


class Node:
    """An open element: its tag, names and parent; equal ones of one page are one node."""

    __slots__ = ("parent", "tag", "names", "item", "inherited", "inmost", "own")

    def __init__(self, parent: Node | None, tag: str, names: str):
        self.parent, self.tag, self.names = parent, tag, names
        #: The nearest element up from here that holds items or is one.
        self.item = self if tag in HOLDS or tag in ENDS else parent.item if parent else None
        more = {f"in {tag}", *(f"named {m}" for m in _meanings(names))}
        above = parent.inherited if parent else frozenset()
        self.inherited = above if more <= above else above | more  # shared: there are few tags and meanings
        self.inmost = tag if tag in ("article", "main", "aside", "nav", "header", "footer", "form", "section") else parent.inmost if parent else "-"
        self.own: list[str] | None = None

    def features(self) -> list[str]:
        if self.own is None:
            self.own = ["bias", *sorted(self.inherited), f"leaf {self.tag}", *sorted(f"leaf named {m}" for m in _meanings(self.names)), f"inmost {self.inmost}"]
        return self.own


@dataclass
class Block:
    text: str
    node: Node | None  # the innermost element it begins in
    linked: int  # characters inside links


class _Open:
    """The elements open at a place of a page. All steps are constant time, or paid by the elements they close."""

    def __init__(self) -> None:
        self.top: Node | None = None
        self._known: dict[tuple[Node | None, str, str], Node] = {}
        self._count: dict[str, int] = {}

    def push(self, tag: str, names: str) -> None:
        key = (self.top, tag, names)
        node = self._known.get(key)
        if node is None:
            node = self._known[key] = Node(*key)
        self.top = node
        self._count[tag] = self._count.get(tag, 0) + 1

    def pop(self) -> None:
        self._count[self.top.tag] -= 1
        self.top = self.top.parent

    def close(self, tag: str) -> None:
        """The innermost element ``tag`` ends, with all inside it; an end tag of none is ignored."""
        if self._count.get(tag):
            while self.top.tag != tag:
                self.pop()
            self.pop()

    def end_items(self, tag: str) -> None:
        """An open item that a start tag ``tag`` ends, if no holder of items lies between."""
        if not any(self._count.get(x) for x in ENDS[tag]):
            return
        node = self.top.item if self.top else None
        while node is not None:
            if node.tag in ENDS[tag]:
                while self.top is not node:
                    self.pop()
                self.pop()
                return
            if node.tag in HOLDS:
                return
            node = node.parent.item if node.parent else None


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack, unclosed = _Open(), set()
    parts: list[str] = []
    node: Node | None = None
    linked, in_link, at = 0, False, 0
    end = page.rfind(">") + 1  # no tag ends beyond

    def add(raw: str) -> None:
        nonlocal node, linked
        if not raw:
            return
        if not parts or node is None:
            node = stack.top
        parts.append(raw)
        if in_link:
            linked += len(raw.strip())

    def flush() -> None:
        nonlocal parts, linked, node
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, node, linked))
        parts, linked, node = [], 0, None

    def beyond(name: str, at: int) -> int | None:
        """Where the next end tag ``name`` ends."""
        if name in unclosed:
            return None
        stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
        if stop is None:
            unclosed.add(name)
            return None
        return stop.end()

    while at < end:
        m = _TOKEN.search(page, at, end)
        if m is None:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if at == end and m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)  # a comment that isn't closed
            continue  # a comment or declaration
        closing, name, rest = bool(m[1] or m[4]), name.lower(), m[3] if m[2] else m[6]
        if not closing and (name in RAW or name in UNSHOWN):
            if name in BREAKING:
                flush()
            done = at if name == "svg" and rest.endswith("/") else beyond(name, at)
            if done is None and name in RAW:
                done = len(page)
            if done is not None:
                at = done
                add(" ")
                continue
        if name == "a":
            in_link = not closing
        if name == "br" or name == "img":
            add(" ")
        if name not in BREAKING:
            continue
        flush()
        in_link = in_link and name not in ("li", "td", "p")
        if closing:
            stack.close(name)
            continue
        if stack.top and stack.top.tag == "p":
            stack.pop()
        if name in ENDS:
            stack.end_items(name)
        if name not in VOID:  # a slash closes nothing but foreign elements
            stack.push(name, " ".join(x.strip("\"'") for x in _NAMES.findall(rest)) if rest else "")
    add(page[at:])
    flush()
    return out


# ---- features ---------------------------------------------------------------

#: What class names and roles tell, by their parts.
MEANINGS = {
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner teaser dfp".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs topbar tabs pagination pager toc skip".split(),
    "foot": "footer foot copyright colophon legal imprint bottom".split(),
    "head": "header masthead logo brand top hero".split(),
    "side": "sidebar aside related recommend recommended recommendations widget rail popular trending secondary complementary more".split(),
    "comment": "comment comments reply replies discussion disqus respond thread feedback review reviews".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay paywall banner disclaimer warning".split(),
    "form": "form newsletter subscribe signup login search register contact input field".split(),
    "share": "share sharing social follow tags meta byline author date".split(),
    "body": "content article post entry main body story text page".split(),
}
_MEANING = {w: k for k, words in MEANINGS.items() for w in words}
_CUES = re.compile(r"\b(cookies?|subscribe|newsletter|sign up|log ?in|advertisement|sponsored|comments?|reply|replies|all rights reserved|privacy|terms|share|follow us|related|search|menu|accept|password|e-?mail)\b|©|\(c\)", re.I)


def _meanings(names: str) -> set[str]:
    return {_MEANING[w.lower()] for w in _PART.findall(names) if w.lower() in _MEANING}


def features(page: list[Block]) -> list[list[str]]:
    out, n = [], len(page)
    for k, b in enumerate(page):
        own = b.node.features() if b.node else ["bias", "leaf -", "inmost -"]
        words = b.text.count(" ") + 1
        share = b.linked / max(len(b.text), 1)
        more = [
            f"words {min(words.bit_length(), 7)}",
            f"linked {0 if share < 0.1 else 1 if share < 0.5 else 2}",
            f"stop {b.text[-1] in '.!?:;”»…'}",
            f"place {min(4, 5 * k // max(n, 1))}",
        ]
        if share >= 0.5 and words <= 4:
            more.append("short link")
        cue = _CUES.search(b.text)
        if cue:
            more.append(f"cue {words > 25}")
        if k and page[k - 1].node is b.node:
            more.append("like before")
        out.append(own + more)
    return out


# ---- the field --------------------------------------------------------------

@dataclass
class Field:
    """Weights of features for each state, and of steps between states; state 1 is main text."""

    emit: dict[str, tuple[float, float]]
    step: list[list[float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        if not page:
            return []
        get, (s0, s1) = self.emit.get, self.step
        a = b = 0.0
        back = []
        for k, own in enumerate(page):
            e0 = e1 = 0.0
            for f in own:
                w = get(f)
                if w is not None:
                    e0 += w[0]
                    e1 += w[1]
            if k:
                from0, from1 = a + s0[0] < b + s1[0], a + s0[1] < b + s1[1]
                back.append((from0, from1))
                a, b = (b + s1[0] if from0 else a + s0[0]) + e0, (b + s1[1] if from1 else a + s0[1]) + e1
            else:
                a, b = e0, e1
        state, states = int(b > a), []
        for step in reversed(back):
            states.append(state)
            state = int(step[state])
        return [state, *states[::-1]]


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """The field of largest likelihood for pages of features and states, with a ridge."""
    pages = [p for p in pages if p[0]]
    names = {f: k for k, f in enumerate(sorted({f for page, _ in pages for own in page for f in own}))}
    longest, n = max(len(y) for _, y in pages), len(pages)
    real, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    spot, col = [], []
    for i, (page, y) in enumerate(pages):
        real[i, : len(y)], gold[i, : len(y)] = True, y
        for t, own in enumerate(page):
            spot += [i * longest + t] * len(own)
            col += [names[f] for f in own]
    spot, col = np.array(spot), np.array(col)
    w, step = np.zeros((2, len(names))), np.zeros((2, 2))
    both = real[:, 1:] & real[:, :-1]
    held = np.zeros((2, 2))
    np.add.at(held, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    one_hot = np.stack([(gold == 0) & real, (gold == 1) & real], -1).astype(float)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
    for k in range(1, STEPS + 1):
        e = np.stack([np.bincount(spot, weights=w[s][col], minlength=n * longest).reshape(n, longest) for s in (0, 1)], -1)
        fore, back = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(fore[:, t - 1, :1] + step[0], fore[:, t - 1, 1:] + step[1]) + e[:, t]
            fore[:, t] = np.where(real[:, t, None], new, fore[:, t - 1])
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + back[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
            back[:, t] = np.where(real[:, t + 1, None], new, 0)
        chance = np.exp(fore + back - total[:, None, None]) * real[..., None]
        pull = (chance - one_hot).reshape(-1, 2) / n
        g = np.stack([np.bincount(col, weights=pull[spot, s], minlength=len(names)) for s in (0, 1)]) + RIDGE * w
        pair = fore[:, :-1, :, None] + step + (e + back)[:, 1:, None, :] - total[:, None, None, None]
        gs = (np.exp(np.where(both[..., None, None], pair, -np.inf)).sum((0, 1)) - held) / n + RIDGE * step
        for value, grad, m, v in ((w, g, moments[0], moments[1]), (step, gs, moments[2], moments[3])):
            m[:], v[:] = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            value -= RATE / (1 + k / 50) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field({f: (float(w[0, k]), float(w[1, k])) for f, k in names.items()}, step.tolist())


# ---- labelled pages ---------------------------------------------------------

_SYLLABLES = "an be con der el fi gar hu in jo ka lo mer nu or pa qui re sol ti und ver wa xe you zen que ción ment heit".split()


class _Writer:
    """Writes one page and keeps the states of its blocks in order."""

    def __init__(self, seed: int):
        self.r, self.out, self.states = random.Random(seed), [], []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        return self.words(low, high).capitalize() + self.r.choice("...!?")

    def put(self, text: str) -> None:
        self.out.append(text)

    def block(self, tag: str, text: str, main: bool, names: str = "", end: bool = True) -> None:
        self.put(f"<{tag}{names}>{text}" + (f"</{tag}>" if end else ""))
        self.states.append(int(main))

    def names(self, *some: str) -> str:
        kind, name = self.r.choice(["class", "class", "id"]), self.r.choice(some)
        extra = f" {self.r.choice(['wide', 'box', 'col-8', 'js-x', 'm-2'])}" if kind == "class" and self.r.random() < 0.4 else ""
        return f' {kind}="{name}{extra}"'

    def maybe(self, p: float, part) -> None:
        if self.r.random() < p:
            part()

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def menu(self) -> None:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        self.put(f"<{tag}{self.names('menu', 'navbar', 'breadcrumbs', 'main-nav') if tag != 'nav' or self.r.random() < 0.3 else ''}>")
        if tag != "ul":
            self.put("<ul>")
        for _ in range(self.r.randint(2, 8)):
            self.block("li", self.link(self.words(1, 2)), False, end=self.r.random() < 0.8)
        self.put(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def head(self) -> None:
        tag = self.r.choice(["header", "header", "div"])
        self.put(f"<{tag}{self.names('site-header', 'masthead', 'top') if tag == 'div' else ''}>")
        self.block("div", self.link(self.words(1, 3)), False, self.names("logo", "brand"))
        self.maybe(0.4, lambda: self.block("p", self.words(3, 8), False))
        self.maybe(0.5, self.menu)
        self.put(f"</{tag}>")

    def advert(self) -> None:
        tag = self.r.choice(["div", "div", "aside", "section"])
        self.block(tag, self.r.choice(["", "Advertisement ", "Sponsored "]) + self.sentence(3, 14), False, self.names("ad", "ads", "advert", "sponsored", "promo", "ad-slot"))

    def notice(self) -> None:
        self.put(f"<div{self.names('cookie-notice', 'consent', 'notice', 'gdpr-banner', 'alert')}>")
        self.block("p", self.r.choice(["We use cookies. ", "", "Accept our terms. "]) + self.sentence(5, 20), False)
        self.maybe(0.6, lambda: self.block("button", self.words(1, 2), False))
        self.put("</div>")

    def form(self) -> None:
        self.put(f"<form{self.names('search', 'newsletter', 'login', 'signup')}>")
        self.maybe(0.6, lambda: self.block("p", self.r.choice(["Subscribe to our newsletter. ", "Sign up. ", ""]) + self.sentence(2, 10), False))
        for _ in range(self.r.randint(1, 3)):
            self.block("label", self.words(1, 3), False)
            self.put('<input type="text">')
        self.block("button", self.words(1, 2), False)
        self.put("</form>")

    def side(self) -> None:
        tag = self.r.choice(["aside", "aside", "div"])
        self.put(f"<{tag}{self.names('sidebar', 'related', 'widget', 'recommended', 'popular') if tag == 'div' or self.r.random() < 0.4 else ''}>")
        self.maybe(0.7, lambda: self.block(self.r.choice(["h3", "h4", "h2"]), self.words(1, 4), False))
        for _ in range(self.r.randint(1, 5)):
            self.block(self.r.choice(["p", "li", "div"]), self.r.choice([self.link(self.words(2, 7)), self.sentence(5, 25)]), False)
        self.put(f"</{tag}>")

    def comments(self) -> None:
        tag = self.r.choice(["section", "div", "div", "ol"])
        self.put(f"<{tag}{self.names('comments', 'comment-list', 'discussion', 'replies', 'respond')}>")
        self.maybe(0.7, lambda: self.block("h3", self.r.choice(["Comments", "3 comments", self.words(1, 3)]), False))
        for _ in range(self.r.randint(1, 6)):
            inner = self.r.choice(["div", "li", "article"])
            self.put(f"<{inner}{self.names('comment', 'reply', 'comment-body', 'post') if self.r.random() < 0.8 else ''}>")
            self.maybe(0.6, lambda: self.block("div", self.words(1, 2), False, self.names("author", "meta")))
            for _ in range(self.r.randint(1, 2)):
                self.block("p", " ".join(self.sentence() for _ in range(self.r.randint(1, 4))), False)
            self.put(f"</{inner}>")
        self.maybe(0.3, self.form)
        self.put(f"</{tag}>")

    def foot(self) -> None:
        tag = self.r.choice(["footer", "footer", "div"])
        self.put(f"<{tag}{self.names('footer', 'site-footer', 'copyright') if tag == 'div' else ''}>")
        if self.r.random() < 0.5:
            self.put(f"&copy; {self.word()} &middot; {self.sentence(2, 12)}")
            self.states.append(0)
        else:
            for _ in range(self.r.randint(1, 4)):
                self.block(self.r.choice(["p", "li", "div"]), self.r.choice([self.link(self.words(1, 3)), "&copy; 2020 " + self.words(1, 4), self.sentence(3, 12)]), False)
        self.put(f"</{tag}>")

    def article(self) -> None:
        plain = self.r.random() < 0.2
        tag = "div" if plain else self.r.choice(["article", "article", "main", "div", "section", "td"])
        if tag == "td":
            self.put("<table><tr>")
        names = "" if plain or tag in ("article", "main") and self.r.random() < 0.6 else self.names("content", "article-body", "post", "entry-content", "story", "main-text")
        self.put(f"<{tag}{names}>")
        self.maybe(0.8, lambda: self.block(self.r.choice(["h1", "h1", "h2"]), self.words(2, 12), True))
        for _ in range(self.r.choice([1, 2, 3, 4, 5, 6, 8, 12])):
            kind = self.r.random()
            text = " ".join(self.sentence(1, 22) for _ in range(self.r.choice([1, 1, 2, 3, 5, 8])))
            if kind < 0.72:
                if self.r.random() < 0.15:
                    text = f"<b>{text}<br>"
                if self.r.random() < 0.15:
                    text += " " + self.link(self.words(1, 3)) + " " + self.sentence()
                if self.r.random() < 0.1:
                    text = self.words(1, 4) + "."
                self.block("p", text, True, end=self.r.random() < 0.85)
            elif kind < 0.8:
                self.block(self.r.choice(["h2", "h3"]), self.words(1, 7), True)
            elif kind < 0.88:
                self.put("<ul>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("li", self.sentence(), True)
                self.put("</ul>")
            elif kind < 0.93:
                self.block(self.r.choice(["blockquote", "pre", "figcaption", "div"]), text, True)
            else:
                self.r.choice([self.advert, self.side, self.form, self.notice])()
        self.maybe(0.25, self.comments)
        self.put(f"</{tag}>")
        if tag == "td":
            self.put("</tr></table>")

    def page(self) -> tuple[str, list[int]]:
        self.put(f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>")
        for p, part in ((0.5, self.head), (0.7, self.menu), (0.3, self.notice), (0.5, self.advert), (0.15, self.side), (0.15, self.form)):
            self.maybe(p, part)
        self.article()
        for p, part in ((0.3, self.comments), (0.3, self.side), (0.3, self.advert), (0.2, self.form), (0.9, self.foot), (0.1, self.notice)):
            self.maybe(p, part)
        if self.r.random() < 0.9:
            self.put("</body></html>")
        return "".join(self.out), self.states


def labelled(n: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """``n`` pages with the states of their blocks."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]


_fields: dict[int, Field] = {}


def default_field(n: int = TRAIN_PAGES) -> Field:
    """The field trained on ``n`` labelled pages."""
    if n not in _fields:
        pages = []
        for page, states in labelled(n):
            found = blocks(page)
            if len(found) != len(states):
                raise AssertionError("a made page isn't read as its labels say")
            pages.append((features(found), states))
        _fields[n] = train(pages)
    return _fields[n]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, state in zip(found, field.decode(features(found)), strict=True) if state)


def extracted(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    A null or empty page, and one without main text, gives the empty text. Equal
    rows give equal rows, an empty table an empty result; further columns are
    not looked at.
    """
    field = field or default_field()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, field) for x in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_slices(own, "html", one, "page_id long, url string, text string, n_chars long")
