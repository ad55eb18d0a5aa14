"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page becomes a sequence of blocks of text between block-level tags, in one pass over the page: tags
and attributes end where HTML says, raw elements (script, style, title and so on) at their own end tag
only. Features of a block are its ancestors' tags, words of their class, id and role attributes, and
shape and content of the text; the chain's weights are fitted on labelled pages by maximum likelihood
and blocks are labelled by Viterbi. Script, style and other invisible elements are no text.

The labelled pages are composed here (``labelled_pages``): layouts of articles among menus, headers,
sidebars, notices, adverts, forms and comments, with texts drawn from a seeded generator or from texts
that the caller passes. Their number, ``Settings.training_pages``, is the bound of the fit.

What an element hides (``hidden``, ``display: none``) is no text of the page, unless it is the body itself; a drawing
that is left open ends where HTML ends it, at the next paragraph or the like.

Defined results: a tag that never ends hides the rest of the page, as in browsers, but a "<" before a
word that names no element and is cut off by the next "<" is text; null and empty html gives empty text; a page without a block labelled as main text
gives empty text; rows that repeat a page_id are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import read

#: HTML elements by what they do to text.
INVISIBLE = frozenset("script style noscript noembed noframes template head title svg iframe object textarea select".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: A start tag that ends an open element of these kinds (HTML's optional end tags).
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}

#: The elements of HTML. A tag of another name that is cut off by the next "<" is text, as in "x<y holds".
KNOWN = VOID | INLINE | INVISIBLE | RAW | frozenset(
    "address article aside audio blockquote body button canvas caption center colgroup datalist dd details dialog dir div dl dt fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup html"
    " legend li main map marquee math menu menuitem meter nav noembed noframes ol optgroup option output p picture plaintext pre progress rp rt ruby search section slot strike summary table tbody td tfoot th thead tr ul video xmp".split()
)

#: Where raw text ends: its own end tag only. Within a script, ``<!-- <script`` makes one more end tag part of the text.
RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I | re.A) for t in RAW}
SCRIPT_MARK = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I | re.A)
TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
BETWEEN = re.compile(r"[\t\n\f\r /]*")
ATTRIBUTE_NAME = re.compile(r"=?[^\t\n\f\r />=]*")
EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile(r"--!?>")
NAME_WORD = re.compile(r"[a-z]{2,}")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")
#: How an element hides what it holds, and the mark of such an element among the words of its names.
HIDES, UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I), "\0"
#: Start tags that end a drawing or formula that is still open, as HTML has it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())


@dataclass
class Block:
    text: str
    #: The innermost open element that is not inline, the tags of all such elements, and the words of all open elements' names.
    parent: str
    tags: frozenset[str]
    names: frozenset[str]
    link_chars: int = 0


@dataclass
class _Open:
    tag: str
    names: frozenset[str]
    closed: bool = False
    unseen: bool = False


def script_end(page: str, at: int) -> int:
    """The position of the end tag of the script whose text starts at ``at``, by HTML's escaped states."""
    escaped = nested = False
    while m := SCRIPT_MARK.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            at -= 2  # "<!-->" is open and closed
            escaped = True
        elif m[0] == "-->":
            escaped = nested = False
        elif not m[1]:
            nested = escaped
        elif nested:
            nested = False
        else:
            return m.start()
    return len(page)


def attributes_at(page: str, at: int) -> tuple[str, bool, int]:
    """The class, id, role and itemprop of the tag whose name ends at ``at`` (behind UNSEEN, if it hides its element); whether a slash closes it; the place behind it, -1 if it never ends."""
    found, size = [], len(page)
    while True:
        low = at
        at = BETWEEN.match(page, at).end()
        if at == size:
            return "", False, -1
        if page[at] == ">":
            return " ".join(found), at > low and page[at - 1] == "/", at + 1
        m = ATTRIBUTE_NAME.match(page, at)
        name, at = m[0], m.end()
        if name.lower() == "hidden":
            found.insert(0, UNSEEN)
        if not (m := EQUALS.match(page, at)):
            continue
        at = m.end()
        quote = page[at : at + 1]
        if quote in ('"', "'"):
            end = page.find(quote, at + 1)
            if end < 0:
                return "", False, -1
            value, at = page[at + 1 : end], end + 1
        else:
            m = UNQUOTED.match(page, at)
            value, at = m[0], m.end()
        if name.lower() in ("class", "id", "role", "itemprop"):
            found.append(value.replace(UNSEEN, ""))
        elif name.lower() == "style" and HIDES.search(value):
            found.insert(0, UNSEEN)


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name or text, attributes, closed by a slash), kind being text, start or end; one pass over the page.

    Comments, declarations and the content of raw elements are left out.
    """
    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low != at:
            yield "text", page[at : low if low >= 0 else size], "", False
            if low < 0:
                return
        ahead = page[low + 1 : low + 3]
        closing = ahead[:1] == "/"
        if ahead[:1] == "!" and page.startswith("<!--", low):
            if page.startswith((">", "->"), low + 4):
                at = page.index(">", low) + 1
            else:
                m = COMMENT_END.search(page, low + 4)
                at = m.end() if m else size
        elif ahead[:1] in ("!", "?") or (closing and len(ahead) == 2 and not (ahead[1].isascii() and ahead[1].isalpha())):
            end = page.find(">", low + 1)
            at = end + 1 if end >= 0 else size
        elif not (m := TAG_NAME.match(page, low + 1 + closing)):
            yield "text", "<", "", False
            at = low + 1
        else:
            tag, end = m[0].lower(), m.end()
            if tag not in KNOWN and "-" not in tag and ":" not in tag:
                following = page.find("<", low + 1)
                if page.find(">", low + 1, following if following >= 0 else size) < 0:
                    yield "text", "<", "", False
                    at = low + 1
                    continue
            found, slash, at = ("", False, end + 1) if page[end : end + 1] == ">" else attributes_at(page, end)
            if at < 0:
                return  # a tag that never ends
            yield "end" if closing else "start", tag, found, slash
            if tag in RAW and not closing:
                end = RAW_END[tag].search(page, at) if tag != "script" else None
                at = script_end(page, at) if tag == "script" else end.start() if end else size


class _Stack:
    """Open elements. Closing is linear overall: an inline element under open blocks is marked, not moved."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.open, self.places = known, [], {}
        self.blocks: list[int] = []  # places of elements that aren't inline
        self.tags, self.names = Counter(), Counter()
        self.hidden = self.in_link = 0
        self.context: tuple | None = None

    def push(self, tag: str, names: frozenset[str], unseen: bool = False) -> None:
        if self.known is not None:
            names &= self.known
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
            if self.known is None or tag in self.known:
                self.tags[tag] += 1
        self.names.update(names)
        unseen = unseen or tag in INVISIBLE
        self.open.append(_Open(tag, names, unseen=unseen))
        self.hidden += unseen
        self.in_link += tag == "a"
        self.context = None

    def _left(self, o: _Open) -> None:
        self.hidden -= o.unseen
        self.in_link -= o.tag == "a"
        for counter, keys in ((self.tags, [o.tag] if o.tag in self.tags and o.tag not in INLINE else []), (self.names, o.names)):
            for k in keys:
                counter[k] -= 1
                if not counter[k]:
                    del counter[k]
        self.context = None

    def pop(self) -> None:
        o = self.open.pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        if not o.closed:
            self.places[o.tag].pop()
            self._left(o)

    def top(self) -> str:
        while self.open and self.open[-1].closed:
            self.pop()
        return self.open[-1].tag if self.open else ""

    def close(self, tag: str) -> None:
        """Close the innermost ``tag`` and what it holds; an inline one leaves the blocks that it holds open."""
        at = self.places[tag][-1]
        if tag in INLINE and self.blocks and self.blocks[-1] > at:
            self.places[tag].pop()
            self.open[at].closed = True
            self._left(self.open[at])
            return
        while len(self.open) > at:
            self.pop()

    def holds_block(self, tag: str) -> bool:
        """Whether closing the innermost ``tag`` closes an element that isn't inline."""
        return tag not in INLINE and bool(self.places.get(tag))

    def reveal(self) -> None:
        """Invisible elements that are still open end."""
        for o in self.open:
            if o.tag in INVISIBLE and not o.closed:
                self.places[o.tag].pop()
                self._left(o)
                o.closed = True

    def here(self) -> tuple[str, frozenset[str], frozenset[str]]:
        if self.context is None:
            while self.blocks and self.open[self.blocks[-1]].closed:
                self.blocks.pop()
            parent = self.open[self.blocks[-1]].tag if self.blocks else ""
            self.context = (parent, frozenset(self.tags), frozenset(self.names))
        return self.context


def blocks_of(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order, with references decoded and white space made single.

    ``known`` are the tags and name words that matter to the caller (all, if not given); with it, what a block
    holds is bounded however deep the page is nested.
    """
    stack, seen_body = _Stack(known), False
    blocks: list[Block] = []
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(text, *stack.here(), links))
            parts.clear()
        links = 0

    for kind, tag, found, slash in tokens(page or ""):
        if kind == "text":
            if not stack.hidden:
                text = html_lib.unescape(tag) if "&" in tag else tag
                parts.append(text)
                links += len(text) if stack.in_link else 0
        elif kind == "end":
            if stack.places.get(tag):
                if stack.holds_block(tag):
                    flush()
                stack.close(tag)
        elif tag not in RAW:
            if tag in BREAKOUT:
                for drawing in ("svg", "math"):
                    if stack.places.get(drawing) and not stack.places.get("foreignobject"):
                        stack.close(drawing)
            if tag == "br":
                if not stack.hidden:
                    parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
                closes = CLOSES.get(tag, ())
                while (top := stack.top()) and (top in closes or top in INLINE):
                    stack.pop()
                if tag == "body":
                    if seen_body:
                        continue
                    seen_body = True
                    stack.reveal()  # what the head left open ends here
            if tag not in VOID and not slash:
                # a page that hides itself shows itself later, by a script
                stack.push(tag, frozenset(NAME_WORD.findall(CAMEL.sub(" ", found).lower())) if found else frozenset(), found[:1] == UNSEEN and tag not in ("html", "body"))
    flush()
    return blocks


# ---- features


STOPS = re.compile(r"[.!?:;…。]['\"”»)\]]*$")
MARKS = re.compile(r"©|\(c\)|[|»›·•]")
#: What a line of rights begins with or says, in the languages of the web's larger part.
RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved|\balle rechte vorbehalten|\btous droits r[ée]serv[ée]s|\b(?:todos los derechos|todos os direitos) reservados", re.I)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    articles = sum("article" in b.tags or "main" in b.tags for b in blocks)
    # running text: some words, few of them in links, ending as sentences end
    linked = [b.link_chars / max(1, len(b.text)) for b in blocks]
    prose = [int(share < 0.5 and b.text.count(" ") >= 7 and bool(STOPS.search(b.text))) for share, b in zip(linked, blocks)]
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size = min(7, words.bit_length())
        links = b.link_chars / max(1, len(b.text))
        f = ["bias", f"words={size}", f"links={int(min(links, 0.99) * 4)}", f"parent={b.parent}"]
        f += [f"in={t}" for t in b.tags if t not in ("html", "body", "div", "span")]
        f += [f"name={n}" for n in b.names]
        if "article" in b.tags or "main" in b.tags:
            f.append(f"article,words={size}")
        elif articles:
            f.append("beside the article")
        if STOPS.search(b.text):
            f.append("stop")
            f.append(f"stop,words={size}")
        if MARKS.search(b.text):
            f.append("mark")
        if RIGHTS.search(b.text):
            f += ["rights", f"rights,words={size}"]
        before, behind = prose[max(0, k - 2) : k], prose[k + 1 : k + 3]
        f.append(f"prose before={sum(before)}")
        f.append(f"prose behind={sum(behind)}")
        if prose[k]:
            f.append(f"prose beside={min(2, sum(before) + sum(behind))}")
        elif b.parent in HEADINGS:
            f.append(f"heading,prose behind={sum(behind[:1])}")
        f.append(f"links around={int(min(sum(linked[max(0, k - 2) : k + 3]) / len(linked[max(0, k - 2) : k + 3]), 0.99) * 4)}")
        f.append(f"third={3 * k // len(blocks)}")
        f.append(f"commas={min(3, b.text.count(','))}")
        if b.text[-1].isdigit():
            f.append("digit")
        out.append(f)
    return out


# ---- the chain


@dataclass
class Chain:
    """Two labels, 0 beside and 1 main: weights per feature and label, and per pair of labels."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self.gain = {}
        #: Tags and name words of which a weight depends.
        self.known = frozenset(f.partition("=")[2] for f in self.index if f.startswith(("in=", "name="))) | {"article", "main"}

    def _gains(self) -> dict[str, float]:
        if not self.gain:
            margin = (self.weights[:, 1] - self.weights[:, 0]).tolist()
            self.gain = {name: margin[k] for name, k in self.index.items()}
        return self.gain

    def label(self, rows: list[list[str]]) -> list[int]:
        """The best labels, by Viterbi."""
        if not rows:
            return []
        gain = self._gains()
        (s00, s01), (s10, s11) = self.step.tolist()
        beside, main = self.start[0], self.start[1]
        back: list[tuple[int, int]] = []
        for k, row in enumerate(rows):
            if k:
                to0 = 0 if beside + s00 >= main + s10 else 1
                to1 = 0 if beside + s01 >= main + s11 else 1
                beside, main = (main + s10 if to0 else beside + s00), (main + s11 if to1 else beside + s01)
                back.append((to0, to1))
            main += sum(gain.get(f, 0.0) for f in row)
        best = int(main > beside)
        out = [best]
        for step in reversed(back):
            best = step[best]
            out.append(best)
        return out[::-1]


def fit_chain(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3, least: int = 2) -> Chain:
    """Maximum likelihood with a ridge, by gradient ascent; expectations by forward-backward, all pages in step."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                seen[f] = seen.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    pages = sorted(pages, key=lambda p: -len(p[0]))
    size = np.array([len(r) for r, _ in pages])
    first = np.cumsum(size) - size
    block, feature = [], []
    for p, (rows, _) in enumerate(pages):
        for k, row in enumerate(rows):
            known = [index[f] for f in row if f in index]
            block += [first[p] + k] * len(known)
            feature += known
    block, feature = np.array(block), np.array(feature)
    truth = np.array([y for _, labels in pages for y in labels])
    n, steps = len(truth), int(size[0])
    live = [int((size > t).sum()) for t in range(steps)]
    w, start, step = np.zeros((len(index), 2)), np.zeros(2), np.zeros((2, 2))
    wanted = np.zeros((len(index), 2))
    np.add.at(wanted, (feature, truth[block]), 1)
    inner = np.setdiff1d(np.arange(n), first)
    wanted_step = np.zeros((2, 2))
    np.add.at(wanted_step, (truth[inner - 1], truth[inner]), 1)
    wanted_start = np.bincount(truth[first], minlength=2)
    momentum = [np.zeros_like(x) for x in (w, start, step)]
    square = [np.zeros_like(x) for x in (w, start, step)]
    logsum = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for r in range(1, rounds + 1):
        score = np.zeros((n, 2))
        np.add.at(score, block, w[feature])
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[first] = start + score[first]
        for t in range(1, steps):
            at = first[: live[t]] + t
            forward[at] = score[at] + logsum(forward[at - 1][:, :, None] + step, 1)
        for t in range(steps - 1, 0, -1):
            at = first[: live[t]] + t
            backward[at - 1] = logsum(step + (score[at] + backward[at])[:, None, :], 2)
        total = np.repeat(logsum(forward[first + size - 1], 1), size)
        p = np.exp(forward + backward - total[:, None])
        pair = np.exp(forward[inner - 1][:, :, None] + step + (score[inner] + backward[inner])[:, None, :] - total[inner][:, None, None])
        expected = np.zeros_like(w)
        np.add.at(expected, feature, p[block])
        grads = [(wanted - expected) / len(pages) - ridge * w, (wanted_start - p[first].sum(0)) / len(pages), (wanted_step - pair.sum(0)) / len(pages) - ridge * step]
        for x, g, m, s in zip((w, start, step), grads, momentum, square):  # Adam
            m[:] = 0.9 * m + 0.1 * g
            s[:] = 0.99 * s + 0.01 * g * g
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8) * min(1, 2 * (1 - r / (rounds + 1)))
    return Chain(index, w, start, step)


# ---- labelled pages


class Composer:
    """Pages of known main text, in layouts that vary: semantic tags, bare divs, nested wrappers, tables, unclosed and misspelt tags."""

    def __init__(self, seed: int, texts: list[str] | None = None, families: tuple[int, int, int] = (76, 12, 12)):
        self.r, self.glue, self.families = random.Random(seed), " ", families
        #: What a page's names say: what its parts are, nothing (made by a tool), or there are none.
        self.names = "plain"
        parts = "an the re on er in ti es or ha en nd st le ou ver ion ment ar to is it al".split()
        self.vocabulary = ["".join(self.r.choices(parts, k=self.r.randint(1, 4))) for _ in range(1500)]
        if texts:
            self.vocabulary += [w for t in texts for w in t.split()]

    def words(self, low: int, high: int) -> str:
        return self.glue.join(html_lib.escape(w) for w in self.r.choices(self.vocabulary, k=self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(4, 24).capitalize()
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]

    def pick(self, *names: str) -> str:
        """An attribute that says what the element is, in the ways pages do."""
        name = self.r.choice(names)
        if self.names == "none":
            return ""
        if self.names == "hashed":
            return f' class="{self.r.choice(["css", "sc", "jsx", ""])}{self.r.choice("-_")}{self.r.randrange(1 << 32):x}"'
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.r.choice("wide box block col left right".split())}"', f' class="{self.r.choice("site page l c".split())}-{name}"'])

    def menu(self) -> str:
        items = self.links(3, 9)
        body = self.r.choice([f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items)])
        return self.r.choice([f"<nav>{body}</nav>", f"<nav{self.pick('menu', 'nav', 'main-nav')}>{body}</nav>", f"<div{self.pick('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs')}>{body}</div>"])

    def header(self) -> str:
        body = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 6)}</p>", f"<div>{self.words(2, 5)}</div>{self.menu()}"])
        return self.r.choice([f"<header>{body}</header>", f"<div{self.pick('header', 'masthead', 'banner', 'top')}>{body}</div>"])

    def footer(self) -> str:
        year, rights = self.r.randint(1999, 2030), self.r.choice(["All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", ""])
        lines = [f"<p>{self.words(2, 6)} © {year}</p>", " ".join(self.links(2, 6)), f"<p>&copy; {year} {self.words(1, 4).title()}. {rights}</p>", f"<p>Copyright {year}, {self.words(1, 4)}</p>"]
        if self.names == "plain":
            lines += [f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>{self.prose(1, 2)}</p>"]
        body = self.r.choice(lines)
        return self.r.choice([f"<footer>{body}</footer>", f"<footer{self.pick('footer')}>{body}</footer>", f"<div{self.pick('footer', 'bottom', 'copyright', 'legal')}>{body}</div>", f"<div{self.pick('footer')}>{body}</div>" if self.r.random() < 0.8 else body])

    def sidebar(self) -> str:
        body = self.r.choice([f"<h3>{self.words(1, 3)}</h3><ul>{''.join(f'<li>{i}</li>' for i in self.links(2, 6))}</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 2)}</p>", f"<p>{self.prose(1, 3)}</p>"][: 3 if self.names == "plain" else 1])
        return self.r.choice([f"<aside>{body}</aside>", f"<aside{self.pick('sidebar', 'related')}>{body}</aside>", f"<div{self.pick('sidebar', 'related', 'widget', 'side', 'recommended', 'popular', 'share', 'social', 'tags')}>{body}</div>"])

    def notice(self) -> str:
        body = self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>"])
        return f"<div{self.pick('cookie', 'cookies', 'notice', 'consent', 'alert', 'banner', 'popup', 'gdpr', 'newsletter', 'subscribe', 'disclaimer')}>{body}</div>"

    def advert(self) -> str:
        body = self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f"<a href='/x'>{self.words(2, 8)}</a>"])
        return f"<div{self.pick('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor')}>{body}</div>"

    def form(self) -> str:
        return f"<form{self.r.choice(['', self.pick('search', 'login', 'signup', 'contact')])}><label>{self.words(1, 3)}</label><input type=text><p>{self.words(2, 8)}</p><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        each = "".join(f"<div{self.pick('comment', 'reply')}><b>{self.words(1, 2)}</b><p>{self.prose(1, 3)}</p></div>" for _ in range(self.r.randint(1, 5)))
        head = self.r.choice(["", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.r.randint(1, 40)} {self.words(1, 1)}</h3>"])
        return self.r.choice([f"<section{self.pick('comments', 'discussion', 'responses')}>{head}{each}</section>", f"<div{self.pick('comments', 'comment-list', 'disqus')}>{head}{each}</div>"])

    def main(self) -> str:
        """The article's body, every block marked by \\x01."""
        mark, out = "\x01", []
        self.glue = self.r.choices([" ", " | ", "*** ", "!! ", " © "], [78, 8, 8, 4, 2])[0]  # odd texts are main text as well
        if self.r.random() < 0.85:
            out.append(f"<h1>{mark}{self.words(2, 10)}</h1>")
        if self.r.random() < 0.08:  # paragraphs that only breaks part
            body = "<br><br>".join(self.prose(1, 4) for _ in range(self.r.randint(1, 6)))
            self.glue = " "
            return "".join(out) + self.r.choice(["<div>%s</div>", "<p>%s</p>", "<span>%s</span>", "%s", "%s"]) % f"{mark}{body}"
        unclosed = self.r.random() < 0.3
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = self.r.random()
            if kind < 0.1:
                out.append(f"<h2>{mark}{self.words(1, 6)}</h2>")
            elif kind < 0.17:
                out.append("<ul>" + "".join(f"<li>{mark}{self.r.choice([self.words(1, 8), self.sentence()])}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.22:
                out.append(f"<blockquote>{mark}{self.prose(1, 3)}</blockquote>")
            elif kind < 0.26:
                out.append(f"<pre>{mark}{self.words(3, 20)}</pre>")
            elif kind < 0.29:
                out.append("<table><tr>" + "".join(f"<td>{mark}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.33:
                out.append(f"<p>{mark}{self.words(1, 7)}{'<br>' if unclosed else '</p>'}")
            elif kind < 0.36:
                out.append(self.r.choice([f"<figure><img src=i.png alt='{self.words(1, 3)}'><figcaption>{mark}{self.words(3, 14)}</figcaption></figure>", f"<dl><dt>{mark}{self.words(1, 3)}<dd>{mark}{self.sentence()}</dl>", f"<pre><code>{mark}if a &lt; {self.words(1, 4)} {{ {self.words(1, 8)}; }}</code></pre>", f"<h3 id=part-{self.r.randint(1, 9)}>{mark}{self.words(1, 7)}</h3>", f"<ol><li><p>{mark}{self.prose(1, 2)}</p><li>{mark}{self.words(2, 12)}</ol>"]))
            elif kind < 0.42:
                out.append(f"<p>{mark}{self.r.choice([self.words(1, 2), self.words(1, 5), self.sentence()])}.{'' if unclosed else '</p>'}")
            else:
                inline = self.prose()
                if self.r.random() < 0.06:
                    inline = f'<a href="/r">{inline}</a>'
                elif self.r.random() < 0.3:
                    inline += f' <a href="/q">{self.words(1, 4)}</a> <em>{self.words(1, 3)}</em> ' + self.prose(1, 2)
                if unclosed and self.r.random() < 0.5:
                    inline = "<b>" + inline + "<br>"
                out.append(f"<p>{mark}{inline}{'' if unclosed else '</p>'}")
        self.glue = " "
        body = "".join(out)
        if self.r.random() < 0.15:  # paragraphs, and perhaps all else, that aren't said to be any
            body = re.sub(self.r.choice([r"<(/?)p\b", r"<(/?)(?:p|h2|h3|blockquote)\b"]), r"<\1div", body)
            body = re.sub("<br>$", "</div>", body)
        return body

    def thread(self) -> str:
        """Messages of a forum's thread, which are its main text, each below the name of who wrote it."""
        each = lambda: f"<div{self.pick('message', 'post', 'topic')}><div{self.pick('author', 'user')}>{self.words(1, 2)}</div>" + "".join(f"<p>\x01{self.prose(1, 4)}</p>" for _ in range(self.r.randint(1, 3))) + "</div>"
        return f"<h1>\x01{self.words(2, 9)}</h1>" + "".join(each() for _ in range(self.r.randint(2, 6)))

    def page(self) -> str:
        r = self.r
        self.names = r.choices(["plain", "hashed", "none"], self.families)[0]
        soup = self.names != "plain" and r.random() < 0.7  # elements that say as little as the names
        forum = r.random() < 0.05
        inner = self.thread() if forum else self.main()
        # without names only what looks like none of the article can be told from it: no prose in adverts, notices or comments
        quiet = self.names != "plain"
        for make, chance in () if quiet else ((self.advert, 0.3), (self.sidebar, 0.15), (self.form, 0.07), (self.notice, 0.07)):  # within the article
            if r.random() < chance * 0.5:
                at = [m.end() for m in re.finditer(r"</(?:p|ul|h1|h2|blockquote|pre|table)>", inner)]
                if at:
                    k = r.choice(at)
                    inner = inner[:k] + make() + inner[k:]
        if not quiet and r.random() < 0.15:
            inner += self.comments()
        wrap = r.choice(["<article>%s</article>"] * 4 + ["<main>%s</main>", "<main><article>%s</article></main>", f"<div{self.pick('content', 'article', 'post', 'entry', 'story', 'article-body')}>%s</div>", f"<div{self.pick('content', 'article', 'post', 'entry')}>%s</div>", f"<article{self.pick('post', 'entry')}>%s</article>", "<div>%s</div>", f"<main id=main><article class='hentry'><div class='entry-content'>%s</div></article></main>", f"<div{self.pick('main', 'content', 'body-text', 'text')}><section>%s</section></div>"])
        if forum or r.random() < 0.1:
            wrap = r.choice(["<div>%s</div>", "<div><div>%s</div></div>", "<section>%s</section>", '<div itemprop="articleBody">%s</div>', "%s", f"<div{self.pick('content', 'page', 'text')}>%s</div>"])
        body = wrap.replace("%s", inner)
        before = [make() for make, c in ((self.header, 0.5), (self.menu, 0.8), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.15), (self.sidebar, 0.15)) if r.random() < c and not (quiet and make in (self.notice, self.advert))]
        after = [make() for make, c in ((self.comments, 0.35), (self.sidebar, 0.4), (self.advert, 0.3), (self.notice, 0.2), (self.form, 0.15), (self.menu, 0.15), (self.footer, 0.85)) if r.random() < c and not (quiet and make in (self.comments, self.notice, self.advert))]
        kind = r.random()
        if kind < 0.08:  # columns of a table
            body = f"<table width=100%><tr><td colspan=3>{''.join(before)}<tr><td{self.pick('left', 'nav')}>{self.menu()}<td>{body}<td{self.pick('right', 'side')}>{self.sidebar()}</table>{''.join(after)}"
        elif kind < 0.25:  # wrappers around parts or all
            body = f"{''.join(before)}<div{self.pick('wrapper', 'container', 'page', 'site')}><div{self.pick('row', 'inner', 'layout')}>{body}</div></div>{''.join(after)}"
            body = f"<div id=root>{body}</div>" if r.random() < 0.5 else body
        else:
            body = f"{''.join(before)}{body}{''.join(after)}"
        if r.random() < 0.06:  # a form around the page
            body = f"<form method=post action=/default.aspx id=aspnetForm><input type=hidden name=__VIEWSTATE>{re.sub('</?form[^>]*>', '', body)}</form>"
        if soup:
            body = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside)\b", r"<\1div", body)
        page = f"<!DOCTYPE html><html>{self.head()}<body>{body}</body></html>"
        if r.random() < 0.1:  # tags in capitals
            page = re.sub(r"</?[a-z]+", lambda m: m[0].upper(), page)
        if r.random() < 0.1:  # end tags that close nothing
            page = page.replace("</p>", "</p></span></font>")
        return page

    def head(self) -> str:
        scripts = ["<script>var t='</p>';</script>", "<script>for (i = 0; i < n; i++) { f(i) }</script>", "<script><!--\nif (a<b) g();\n//--></script>", '<script type="application/ld+json">{"headline": "<p>x"}</script>', "<script src=/a.js async></script>", ""]
        styles = ["<style>p{margin:0}</style>", "<style>a > b::before { content: '<' }</style>", "<link rel=stylesheet href=/s.css>", ""]
        return f"<head><meta charset=utf-8><title>{self.words(2, 8)}</title>{self.r.choice(styles)}{self.r.choice(scripts)}{self.r.choice(['', '<noscript><p>no script</p></noscript>'])}</head>"


def labelled_pages(n: int, seed: int = 41, texts: list[str] | None = None, families: tuple[int, int, int] = (76, 12, 12)) -> list[tuple[str, list[int]]]:
    """(html, label of each block): composed pages; ``families`` are the shares of those with telling, meaningless and no names."""
    composer, out = Composer(seed, texts, families), []
    for _ in range(n):
        marked = composer.page()
        out.append((marked.replace("\x01", ""), [int("\x01" in b.text) for b in blocks_of(marked)]))
    return out


# ---- the operator


@dataclass(frozen=True)
class Settings:
    training_pages: int = 1200
    rounds: int = 60
    seed: int = 41


@lru_cache(maxsize=4)
def trained(settings: Settings) -> Chain:
    """The chain of composed pages, fitted once in a session for each settings."""
    return train(settings, labelled_pages(settings.training_pages, settings.seed))


def train(settings: Settings = Settings(), pages: list[tuple[str, list[int]]] | None = None) -> Chain:
    """A chain from labelled pages; without any given, from composed ones."""
    if pages is None:
        return trained(settings)
    return fit_chain([(features_of(blocks_of(page)), labels) for page, labels in pages], settings.rounds)


def main_text(page: str | None, chain: Chain) -> str:
    blocks = blocks_of(page, chain.known)
    return "\n\n".join(b.text for b, y in zip(blocks, chain.label(features_of(blocks))) if y)


def extract(pages: DataFrame, chain: Chain, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, the main text and its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # as many weights as features of the labelled pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = b.column("__html")
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                texts = [main_text(source[k].as_py(), shared.value) for k in range(low, low + part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    src = pages.select(*keep, F.col(html).alias("__html"))
    ddl = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep), "text string, n_chars long"])
    return src.mapInArrow(run, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the main text of every page."""
    return extract(read(spark, sf_dir, "pages"), train())
