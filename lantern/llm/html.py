"""Main text of web pages: a recurrent labeller of blocks.

A page is cut into its leaf blocks, the runs of text between block-level tags. A
bidirectional LSTM (numpy) reads the blocks in page order, each as a vector of its hashed
tag path (names, classes, ids of the elements around it), its hashed words and a few
measures, and labels every block from the context of the whole page, article or not.

The labeller is fitted here, on invented pages: page_with_labels() draws layouts from a
seeded generator (menus, headers, sidebars, notices, adverts, forms, comments, footers in
several mark-ups around an article) and knows what each block is. PAGES bounds the fit.

Cases: a null html is empty; a page without an article gives an empty text with n_chars 0.
Unclosed and stray tags are passed over as browsers do in the main; a head that is not closed
ends at the first text or tag that only a body holds; quotes count in attribute values as
long as each tag ends outside of them. Scripts, styles, comments and the head hold no blocks.
Reading and vectors take time and memory in proportion to the page, however it is nested or
broken. Repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored. No text is cut, however long the page.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import released, sealed, unsealed

PATH_DIMS, WORD_DIMS, MEASURES = 256, 32, 8
INPUT = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
PAGES = 1200
EPOCHS = 10
#: Blocks of a page whose vectors are held at once.
SLAB = 8192

#: A tag whose quoted values may hold any character, and one that ends at its first >. Nothing is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+").findall

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
#: What a start tag ends if it is open: a paragraph ends before any block, an item before the next.
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


#: Elements whose content is passed over, and those that a head may hold.
_SKIPPED = frozenset("script style noscript template svg iframe title object".split())
_IN_HEAD = _SKIPPED | frozenset("html head meta link base basefont bgsound noframes".split())
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I).search for name in _SKIPPED}
_CLOSES_P = frozenset(("div", "td", "li", "article", "section", "blockquote", "body"))
_LISTS = frozenset(("ul", "ol", "dl", "table", "select", "menu"))
_CELLS = frozenset(("td", "th", "table"))
_OF_TABLE = frozenset(("td", "th", "tr", "table", "tbody", "thead", "tfoot"))

Element = tuple[str, ...]  # a name and the words of its class, id and role


class Node:
    """An open element; those around it are reached through it, so that blocks share them."""

    __slots__ = ("parent", "element", "depth")

    def __init__(self, parent: Node | None, element: Element):
        self.parent, self.element, self.depth = parent, element, (parent.depth if parent else 0) + 1


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> list[Element]:
        """The elements around the block, outermost first."""
        out, node = [], self.node
        while node:
            out.append(node.element)
            node = node.parent
        return out[::-1]


class Open:
    """The stack of open elements; where each name stands last is known without a search."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}

    def push(self, element: Element) -> None:
        self.at.setdefault(element[0], []).append(len(self.nodes))
        self.nodes.append(Node(self.nodes[-1] if self.nodes else None, element))

    def last(self, names: tuple[str, ...] | frozenset[str]) -> int:
        return max((x[-1] for n in names if (x := self.at.get(n))), default=-1)

    def pop(self, names: tuple[str, ...], barrier: frozenset[str]) -> None:
        """Closes the innermost element of names and all within, unless one of barrier is within it."""
        k = self.last(names)
        if k < 0 or self.last(barrier) > k:
            return
        for node in self.nodes[k:]:
            self.at[node.element[0]].pop()
        del self.nodes[k:]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked = 0
    head, quotes = False, True
    elements: dict[tuple[str, str], Element] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.nodes[-1] if stack.nodes else None, text, linked))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked, head
        if head:
            if text.isspace():
                return
            head = False
        parts.append(text)
        if stack.at.get("a"):
            linked += len(text)

    at = look = 0  # text begins at; the next < is looked for from
    last = page.rfind(">")
    while 0 <= (lt := page.find("<", look)) < last or page.startswith("<!--", lt if lt >= 0 else len(page)):
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 4) if comment else page.find(">", lt)
            end = len(page) if end < 0 else end + (3 if comment else 1)
            if lt > at:
                say(page[at:lt])
            at = look = end
            continue
        m = (_TAG if quotes else _SIMPLE_TAG).match(page, lt)
        if m is None and quotes and _SIMPLE_TAG.match(page, lt):
            quotes = False  # from here on no tag would end outside of quotes
            m = _SIMPLE_TAG.match(page, lt)
        if m is None:
            look = lt + 1
            continue
        if lt > at:
            say(page[at:lt])
        at = look = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "head":
                head = False
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            stack.pop((name,), frozenset() if name in _OF_TABLE else _CELLS)
            continue
        if name in _SKIPPED:
            end = _ENDS[name](page, at)
            at = look = end.end() if end else len(page)
            continue
        if name == "head":
            head = True
        elif head and name not in _IN_HEAD:
            head = False
        if name in BLOCK:
            flush()
            stack.pop(("p",), _CLOSES_P)
            if name in _SAME:
                stack.pop(_SAME[name], _LISTS)
        elif name == "br":
            parts.append(" ")
        if name not in VOID:
            key = name, m[3]
            if key not in elements:
                found = _NAMES.findall(m[3]) if m[3] else ()
                elements[key] = (name, *(w for f in found for w in _PARTS("".join(f).lower())))
            stack.push(elements[key])
    if at < len(page):
        say(page[at:])
    flush()
    return out


def _bucket(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dims


@lru_cache(maxsize=20_000)
def _buckets(element: Element) -> tuple[int, int, tuple[int, ...]]:
    """Where an element counts by its name among the inner two and farther out (-1: nowhere), and by its words."""
    name = element[0]
    own = name not in ("html", "body")
    return _bucket(name, PATH_DIMS) if own else -1, _bucket(f"^{name}", PATH_DIMS) if own else -1, tuple(_bucket(f".{w}", PATH_DIMS) for w in element[1:])


class Paths:
    """The vector of the elements around a block, kept from block to block: only what has been opened
    or closed in between is counted anew."""

    def __init__(self) -> None:
        self.node: Node | None = None
        self.names, self.words = np.zeros(PATH_DIMS, np.int32), np.zeros(PATH_DIMS, np.int32)

    def _count(self, node: Node, n: int) -> None:
        _, far, words = _buckets(node.element)
        if far >= 0:
            self.names[far] += n
        for w in words:
            self.words[w] += n

    def vector(self, node: Node | None) -> np.ndarray:
        was, opened = self.node, []
        to = node
        while was is not to:
            if to is None or was is not None and was.depth >= to.depth:
                self._count(was, -1)
                was = was.parent
            else:
                opened.append(to)
                to = to.parent
        for x in opened:
            self._count(x, 1)
        self.node = node
        inner = [x for x in (node, node.parent if node else None) if x]
        here = [_buckets(x.element) for x in inner]
        for _, far, _ in here:
            if far >= 0:
                self.names[far] -= 1
        out = (self.names > 0).astype(np.float32)
        for near, far, _ in here:
            if far >= 0:
                self.names[far] += 1
                out[near] = 1
        return out + self.words


def vectors(page: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """A row for each block of the page, or for those from lo to hi."""
    part = page[lo:hi]
    x = np.zeros((len(part), INPUT), np.float32)
    paths = Paths()
    for k, b in enumerate(part):
        x[k, :PATH_DIMS] = paths.vector(b.node)
        words = b.text.lower().split()
        seen = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIMS for w in words), np.int64, len(words))
        x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.sqrt(np.bincount(seen, minlength=WORD_DIMS) / len(words))
        n = len(b.text)
        x[k, -MEASURES:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / n), b.text[-1] in ".!?…:;\"'»”)", min(3.0, (b.node.depth if b.node else 0) / 10),
            (lo + k) / len(page), b.text[:1] in "©|»>", sum(map(b.text.count, "!$€%")) / n,
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from either end, and a logistic layer over both."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = r.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
            self.w["h" + d] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.w["b" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.w["o"] = r.normal(0, HIDDEN**-0.5, 2 * HIDDEN)
        self.w["s"] = r.normal(0, INPUT**-0.5, INPUT)
        self.w["c"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, d: str, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) of x (T, B, INPUT), and what the way back needs. start: h and c before the first."""
        given = x @ self.w["x" + d] + self.w["b" + d]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        if start is not None:
            h, c = start
        states, tape = [], []
        for g in given:
            g = g + h @ self.w["h" + d]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            z = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * z
            t = np.tanh(new)
            tape.append((h, c, i, f, o, z, t))
            h, c = o * t, new
            states.append(h)
        return np.array(states), tape

    def _back(self, x: np.ndarray, d: str, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        gates = np.zeros((*grad.shape[:2], 4 * HIDDEN), np.float32)
        rec = np.zeros_like(self.w["h" + d])
        for k in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, z, t = tape[k]
            dh = dh + grad[k]
            dc = dc + dh * o * (1 - t * t)
            g = np.concatenate([dc * z * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - z * z)], axis=1)
            gates[k] = g
            rec += h.T @ g
            dh, dc = g @ self.w["h" + d].T, dc * f
        return {"x" + d: np.tensordot(x, gates, ((0, 1), (0, 1))), "h" + d: rec, "b" + d: gates.sum(axis=(0, 1))}

    @staticmethod
    def _turned(lengths: list[int], steps: int) -> np.ndarray:
        """Index (T, B) that reverses each sequence within its length."""
        t = np.arange(steps)[:, None]
        n = np.array(lengths)[None, :]
        return np.where(t < n, n - 1 - t, t)

    def forward(self, pages: list[np.ndarray]):
        lengths = [len(p) for p in pages]
        x = np.zeros((max(lengths), len(pages), INPUT), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        turn, cols = self._turned(lengths, len(x)), np.arange(len(pages))[None, :]
        f, tape_f = self._run(x, "f")
        y = x[turn, cols]
        b, tape_b = self._run(y, "b")
        both = np.concatenate([f, b[turn, cols]], axis=2)
        return x, y, turn, cols, both, tape_f, tape_b, both @ self.w["o"] + x @ self.w["s"] + self.w["c"]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """A boolean per block of each page: part of the article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi, most = lo + 1, len(pages[order[lo]])
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi + 1 - lo) <= max(20_000, 2 * most):
                hi += 1
            part = order[lo:hi]
            logit = self.forward([pages[k] for k in part])[-1]
            for column, k in enumerate(part):
                out[k] = logit[: len(pages[k]), column] > 0
            lo = hi
        return out

    def label_long(self, page: list[Block], slab: int = SLAB) -> np.ndarray:
        """As label() for one page, whose vectors are made a slab at a time, once for either direction."""
        logit = np.zeros(len(page), np.float32)
        cuts = [(lo, min(lo + slab, len(page))) for lo in range(0, len(page), slab)]
        for d, order, out in (("f", cuts, slice(0, HIDDEN)), ("b", cuts[::-1], slice(HIDDEN, None))):
            start = None
            for lo, hi in order:
                x = vectors(page, lo, hi)
                states, tape = self._run((x if d == "f" else x[::-1])[:, None], d, start)
                h, c, i, f, o, z, _ = tape[-1]
                start = states[-1], f * c + i * z
                states = states[:, 0] if d == "f" else states[::-1, 0]
                logit[lo:hi] += states @ self.w["o"][out] + (x @ self.w["s"] if d == "f" else 0)
        return logit + self.w["c"] > 0

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 32, seed: int = 9) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            groups = np.array_split(np.argsort([len(p) for p in pages], kind="stable"), max(1, len(pages) // batch))
            for g in r.permutation(len(groups)):
                chosen = groups[g]
                x, y, turn, cols, both, tape_f, tape_b, logit = self.forward([pages[k] for k in chosen])
                grad = np.zeros_like(logit)
                for column, k in enumerate(chosen):
                    n = len(pages[k])
                    grad[:n, column] = _sigmoid(logit[:n, column]) - labels[k]
                grad /= max(1, sum(len(pages[k]) for k in chosen))
                d = grad[..., None] * self.w["o"]
                got = {"o": np.tensordot(grad, both, ((0, 1), (0, 1))), "s": np.tensordot(grad, x, ((0, 1), (0, 1))), "c": grad.sum(keepdims=True)[0]}
                got |= self._back(x, "f", tape_f, d[..., :HIDDEN]) | self._back(y, "b", tape_b, d[..., HIDDEN:][turn, cols])
                step += 1
                for k, v in got.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


_MENU = "Home About Contact Login News Sport Search Menu Products Services Help Start Kontakt Accueil Inicio".split()
_SAYS = {
    "notice": ("We use cookies to improve your visit. Accept", "This site needs your consent. Privacy policy", "Please enable JavaScript.", "Diese Seite verwendet Cookies."),
    "ad": ("Sponsored", "Advertisement", "Buy now and save 50%!", "Special offer $9.99", "Anzeige", "Publicité"),
    "form": ("Subscribe to our newsletter", "Email address", "Your name", "Submit", "Sign up"),
    "footer": ("© 2024 All rights reserved", "Terms of use | Privacy | Imprint", "Powered by a site builder", "Copyright"),
    "side": ("Related posts", "Popular this week", "Recent articles", "Tags", "Follow us", "Share this"),
    "comment": ("Great read, thanks!", "I do not agree with this at all.", "Reply", "Leave a comment", "3 comments"),
}
_SYLLABLES = "a en ti on er re th in es la mo ka ru sch ü é ción ge ver un que ou ß ñ li to".split()


def _prose(r: random.Random, words: int) -> str:
    out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(words)]
    for k in range(0, words, r.randint(5, 14)):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += "."
    mark = r.choice(["", "", "", "###", "***", "!!", "&amp;&amp;"])
    return " ".join(w + mark if mark and r.random() < 0.8 else w for w in out) + r.choice([".", ".", ".", "", "!"])


def page_with_labels(r: random.Random) -> tuple[str, set[str]]:
    """An invented page and the texts of its article's blocks."""
    article: set[str] = set()
    number = iter(range(10_000))

    def tell(text: str, main: bool = False) -> str:
        text = f"{text} {next(number)}" if not main else text
        if main:
            article.add(" ".join(entities.unescape(re.sub("<[^>]*>", "", text)).split()))
        return text

    def wrap(kind: str, inner: str) -> str:
        names = {
            "nav": ("nav", "menu", "navbar", "breadcrumb"), "header": ("header", "masthead", "topbar", "banner"), "side": ("sidebar", "aside", "widget", "related"),
            "notice": ("cookie", "notice", "consent", "alert"), "ad": ("ad", "ads", "advert", "promo", "sponsor"), "form": ("form", "newsletter", "subscribe", "login"),
            "footer": ("footer", "foot", "copyright", "bottom"), "comment": ("comments", "comment", "discussion", "replies"),
        }[kind]
        own = {"nav": "nav", "header": "header", "side": "aside", "form": "form", "footer": "footer"}.get(kind)
        name = r.choice(names)
        attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} box"'])
        if own and r.random() < 0.6:
            return f"<{own}{attr if r.random() < 0.4 else ''}>{inner}</{own}>"
        tag = r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def short(kind: str) -> str:
        said = _SAYS[kind]
        text = r.choice(said) if r.random() < 0.5 else _prose(r, r.randint(1, 40 if kind in ("comment", "ad", "footer", "side") else 8))
        return tell(text)

    def piece(kind: str) -> str:
        if kind in ("nav", "header"):
            items = [tell(r.choice(_MENU) if r.random() < 0.4 else _prose(r, 1)) for _ in range(r.randint(2, 8))]
            if kind == "header" or r.random() < 0.2:
                return wrap(kind, "".join(f"<div>{x}</div>" for x in items[:3]))
            return wrap(kind, "<ul>" + "".join(f'<li><a href="/x">{x}</a></li>' for x in items) + "</ul>")
        tag = r.choice(["p", "div", "span", "li"])
        bare = kind in ("ad", "footer", "notice") and r.random() < 0.5
        inner = short(kind) if bare else "".join(f"<{tag}>{short(kind)}</{tag}><br>" for _ in range(r.randint(1, 5)))
        return wrap(kind, inner)

    body = []
    if r.random() < 0.95:
        body.append(f"<h1>{tell(_prose(r, r.randint(1, 12)), True)}</h1>")
    for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
        text = tell(_prose(r, r.choice([1, 1, 2, 6, 25, 60, 120])), True)
        kind = r.random()
        if kind < 0.72:
            body.append(f"<p>{text}</p>" if r.random() < 0.7 else f"<p><b>{text}<br>")
        elif kind < 0.8:
            body.append(f"<h2>{text}</h2>")
        elif kind < 0.9:
            body.append(f"<ul><li>{text}</li></ul>")
        else:
            body.append(r.choice(["<blockquote>{}</blockquote>", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"]).format(text))
        if r.random() < 0.05:
            body.append(piece(r.choice(["ad", "form", "side"])))
    inner = "".join(body)
    shell = r.random()
    if shell < 0.5:
        inner = f"<article>{inner}</article>"
    elif shell < 0.65:
        inner = f"<main>{inner}</main>"
    elif shell < 0.9:
        name = r.choice(["content", "post", "entry", "article", "main", "story", "text", "body"])
        inner = f'<div {r.choice(["class", "id"])}="{name}">{inner}</div>'
    else:
        inner = f"<div>{inner}</div>"
    before = [piece(k) for k in ("notice", "header", "nav", "ad", "side") if r.random() < 0.5]
    after = [piece(k) for k in ("comment", "form", "side", "ad", "nav", "footer", "notice") if r.random() < 0.4]
    if r.random() < 0.25:
        r.shuffle(after)
    end = "" if r.random() < 0.1 else "</body></html>"
    return f"<html><head><title>t</title></head><body>{''.join(before)}{inner}{''.join(after)}{end}", article


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = 11) -> Labeller:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, article = page_with_labels(r)
        found = blocks(page)
        xs.append(vectors(found))
        ys.append(np.array([b.text in article for b in found], np.float32))
    out = Labeller()
    out.fit(xs, ys)
    return out


def main_text(pages: list[str | None], labeller: Labeller) -> list[str]:
    found = [blocks(p or "") for p in pages]
    none = np.zeros((0, INPUT), np.float32)
    marks = labeller.label([vectors(b) if 0 < len(b) <= SLAB else none for b in found])
    marks = [m if len(b) <= SLAB else labeller.label_long(b) for m, b in zip(marks, found, strict=True)]
    return ["\n\n".join(b.text for b, keep in zip(page, mark, strict=True) if keep) for page, mark in zip(found, marks, strict=True)]


def extract(df: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    told = df.sparkSession.sparkContext.broadcast((labeller or trained()).w)  # a few thousand weights

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Labeller()
        own.w = told.value
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                text = main_text(part["html"].tolist(), own)
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": text, "n_chars": [len(x) for x in text]})

    out = df.select(sealed("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(
        run, "page_id long, url string, text string, n_chars long"
    )
    return out.withColumn("page_id", unsealed("page_id"))
