"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text under one block-level element. Each block has features of its ancestors
(tags, words of class, id and role) and of its text (length, link share, punctuation, place in the page). A chain over
the blocks, trained by maximum likelihood on labelled pages, is decoded by Viterbi; blocks decoded as main are joined.

Inside a block character references are decoded, white space becomes one space and `<br>` counts as white space.
Scripts, styles, comments of the markup and the head are no text; formulas and what stands in for an object are. A null or empty page, or one without main blocks, has
the text "". Repeated pages give repeated results.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import by_bytes

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NO_TEXT = frozenset("script style noscript iframe title textarea head".split())  # unclosed, they take the rest of the page
_NOT_SHOWN = frozenset("svg canvas template annotation annotation-xml".split())  # unclosed, they are elements like others
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr br input meta link hr area col embed param source track svg canvas math mi mn mo ms mtext mspace mrow "
    "mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts "
    "mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
_VOID = frozenset("img br input meta link hr area col embed param source track wbr base".split())
_CLOSES = {  # an element's start ends these open ones above the nearest barrier
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}}
_BARRIER = frozenset("ul ol dl table select body div article section main form aside nav header footer".split())
_TAGS = frozenset(
    "nav header footer aside article main section form ul ol li table td th h1 h2 h3 h4 h5 h6 p div blockquote pre figure "
    "figcaption button select label dl dd dt details dialog address fieldset menu summary body".split())
_PURPOSE = frozenset("nav header footer aside article main form button select label dialog details fieldset menu".split())
_GROUPS = {
    "article": "article content main post entry story body text",
    "page": "page more teaser",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toolbar tags links",
    "head": "header masthead",
    "foot": "footer copyright legal contentinfo",
    "side": "sidebar aside widget related recommended complementary share sharing social",
    "advert": "ad ads advert advertisement advertising banner promo sponsor sponsored",
    "notice": "cookie cookies consent notice alert warning message popup modal",
    "comment": "comment comments commentlist reply replies respond discussion disqus",
    "form": "form login signup newsletter subscribe search",
    "unseen": "hidden"}
_NAMES = {name: group for group, names in _GROUPS.items() for name in names.split()}
_SAID = re.compile(
    r"\b(cookies?|subscribe|newsletter|copyright|all rights reserved|advertisement|sponsored|log ?in|sign up|share|comments?|"
    r"reply|menu|search|related|privacy|terms)\b|©", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str
    path: frozenset  # features of all ancestors
    near: frozenset  # features of the innermost ancestor that says what it is for
    linked: int


@lru_cache(8192)
def _names(attributes: str) -> frozenset:
    """Features of an element's class, id, role and visibility."""
    out = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            out |= {f"in:{_NAMES[w]}" for w in map(str.lower, _WORD.findall(value)) if w in _NAMES}
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.add("in:unseen")
        elif name == "hidden" or value.lower() == "true":
            out.add("in:unseen")
    return frozenset(out)


def _end_of(page: str, tag: str, at: int) -> int | None:
    """Where an element opened before `at` ends, others of its tag inside it counted; None if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif not m[0].endswith("/>"):
            depth += 1
    return None


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset]] = [("", frozenset(), frozenset())]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked, anchors, at, page = 0, 0, 0, page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, *stack[-1], linked))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            count[stack.pop()[0]] -= 1

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            parts.append(page[at:begin])
            if anchors:
                linked += begin - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), m[1]
        if tag in _NO_TEXT:
            if not ending and not (m[3] or "").endswith("/"):
                if tag != "head":
                    over = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                    at = over.end() if over else size
                else:
                    over = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
                    at = (over.end() if over[0][1] == "/" else over.start()) if over else at
            continue
        if tag in _NOT_SHOWN and not ending and not (m[3] or "").endswith("/") and (over := _end_of(page, tag, at)) is not None:
            at = over
            continue
        if tag in _INLINE:
            if tag == "a":
                anchors = 0 if ending else 1
            elif tag in ("br", "hr", "img", "input"):
                parts.append(" ")
            continue
        flush()
        anchors = 0
        if ending:
            if count.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if count.get("p"):  # a block ends an open paragraph
            k = len(stack) - 1
            while k and stack[k][0] != "p" and stack[k][0] not in _BARRIER:
                k -= 1
            if k and stack[k][0] == "p":
                close(k)
        if tag in _CLOSES:
            k = len(stack) - 1
            while k and stack[k][0] not in _CLOSES[tag] and stack[k][0] not in _BARRIER:
                k -= 1
            if k and stack[k][0] in _CLOSES[tag]:
                close(k)
        if tag in _VOID or (m[3] or "").endswith("/"):
            continue
        names = _names(m[3]) if m[3] else frozenset()
        path = stack[-1][1] | ({f"under:{tag}"} if tag in _TAGS else frozenset()) | names
        near = frozenset({f"near:{tag}", *(f"near {x}" for x in names)}) if names or tag in _PURPOSE else stack[-1][2]
        stack.append((tag, path, near))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        share = min(1.0, b.linked / max(1, len(b.text)))
        own = ["bias", f"tag:{b.tag if b.tag in _TAGS else 'other'}", f"words:{_bin(n, (2, 4, 8, 16, 32))}", f"linked:{_bin(share, (0.01, 0.3, 0.7))}",
               f"ends:{b.text[-1] in '.!?…。»”'}", f"marks:{_bin(sum(map(b.text.count, ',.;')), (1, 3))}",
               f"place:{_bin(i / len(page), (0.1, 0.3, 0.7, 0.9))}"]
        if n < 30 and _SAID.search(b.text):
            own.append("said")
        out.append([*own, *b.path, *b.near])
    return out


@dataclass
class Chain:
    """Weights of features for class 1 over class 0, and of transitions between the classes."""

    weights: dict[str, float]
    moves: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """The best sequence of classes, by Viterbi."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [], 0.0, 0.0
        for i, names in enumerate(features(page)):
            gain = sum([self.weights.get(f, 0.0) for f in names])
            if i == 0:
                a, b = 0.0, gain
                continue
            from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + gain
        best = [int(b > a)]
        for step in reversed(back):
            best.append(step[best[-1]])
        return best[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, main in zip(found, self.decode(found)) if main)


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood with an L2 penalty, by gradient steps over all pages at once (forward and backward sums)."""
    pages = [(b, y) for b, y in pages if b]
    named = [features(b) for b, _ in pages]
    ids = {f: i for i, f in enumerate(sorted({f for page in named for x in page for f in x}))}
    n, longest, d = len(pages), max(len(b) for b, _ in pages), len(ids)
    x = np.zeros((n, longest, d), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (page, (_, classes)) in enumerate(zip(named, pages)):
        mask[p, : len(page)], y[p, : len(page)] = True, classes
        for i, names in enumerate(page):
            x[p, i, [ids[f] for f in names]] = 1
    w, moves = np.zeros(d), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    state = [np.zeros(d + 4), np.zeros(d + 4)]
    total = mask.sum()
    for step in range(1, rounds + 1):
        score = np.zeros((n, longest, 2))
        score[..., 1] = x @ w
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for i in range(1, longest):
            move = np.logaddexp(*[ahead[:, i - 1, k, None] + moves[k] for k in (0, 1)]) + score[:, i]
            ahead[:, i] = np.where(mask[:, i, None], move, ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            move = np.logaddexp(*[moves[:, k] + (score[:, i + 1, k] + behind[:, i + 1, k])[:, None] for k in (0, 1)])
            behind[:, i] = np.where(mask[:, i + 1, None], move, 0)
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead[..., 1] + behind[..., 1] - norm[:, None]) * mask
        pair = np.exp(ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - norm[:, None, None, None]) * both[..., None, None]
        slope = np.concatenate([
            np.tensordot(y * mask - one, x, 2) / total - penalty * w, ((seen - pair.sum((0, 1))) / total - penalty * moves).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope**2
        change = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, moves = w + change[:d], moves + change[d:].reshape(2, 2)
    return Chain({f: float(w[i]) for f, i in ids.items()}, moves)


class _Maker:
    """Labelled pages: layouts, element names and texts drawn at random, each text known as main or not."""

    def __init__(self, seed: int):
        self.rng, self.main = random.Random(seed), set()

    def words(self, low: int, high: int) -> str:
        r = self.rng
        made = ["".join(r.choice("aeiourtnslcdmpbg") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        return " ".join(made).capitalize()

    def said(self, low: int, high: int, main: bool = False) -> str:
        """Sentences; remembered if they are main text."""
        text = self.words(low, high)
        if self.rng.random() < 0.15:  # no prose: symbols, capitals, cells
            text = self.rng.choice([re.sub(r"(\w) ", r"\1### ", text), text.upper(), text.replace(" ", " | ")])
        elif self.rng.random() < 0.85:
            text = re.sub(r"(\w+ ){9}\w+", lambda m: m[0] + self.rng.choice([".", ",", ",", ";"]), text) + "."
        if main:
            self.main.add(text)
        return text

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>'

    def named(self, tag: str, names: str, inner: str) -> str:
        r = self.rng
        name = r.choice(names.split(","))
        kind = r.choice(["class", "class", "id"])
        name = r.choice([name, f"{name} c{r.randint(1, 9)}", f"site-{name}", f"{name}-box"]) if name else ""
        return f'<{tag} {kind}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def menu(self) -> str:
        r = self.rng
        items = [self.link() if r.random() < 0.9 else self.words(1, 2) for _ in range(r.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " ", " · "]).join(items)
        return self.named("nav", ",,menu,navbar", inner) if r.random() < 0.6 else self.named("div", "nav,menu,navigation,breadcrumb,navbar", inner)

    def head(self) -> str:
        inner = f"<{(t := self.rng.choice(['div', 'p', 'h2', 'span']))}>{self.words(1, 8)}</{t}>" + (self.menu() if self.rng.random() < 0.5 else "")
        return self.named("header", ",,masthead", inner) if self.rng.random() < 0.5 else self.named("div", "header,masthead,banner", inner)

    def foot(self) -> str:
        r = self.rng
        inner = r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(r.choice(["© 2024 ", "Copyright ", "", "", "All rights reserved "]) + self.said(2, 25))
        inner += self.menu() if r.random() < 0.3 else ""
        return self.named("footer", ",,footer", inner) if r.random() < 0.6 else self.named("div", "footer,contentinfo,copyright,legal", inner)

    def side(self) -> str:
        r = self.rng
        inner = "".join(r.choice([f"<h3>{self.words(1, 4)}</h3>", self.menu(), f"<p>{self.said(3, 30)}</p>", f"<div>{self.link()}</div>"]) for _ in range(r.randint(1, 4)))
        return self.named("aside", ",,sidebar,related", inner) if r.random() < 0.5 else self.named("div", "sidebar,widget,related,recommended,promo", inner)

    def advert(self) -> str:
        inner = self.rng.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(self.said(2, 30))
        return self.named(self.rng.choice(["div", "div", "section", "p"]), "ad,ads,advert,advertisement,sponsored,promo,banner", inner)

    def notice(self) -> str:
        text = self.rng.choice(["", "", "We use cookies. ", "Subscribe to our newsletter. "]) + self.said(3, 40)
        inner = self.rng.choice(["{}", "<p>{}</p>", "<p>{}</p><button>OK</button>"]).format(text)
        return self.named(self.rng.choice(["div", "div", "p", "section", "dialog"]), "notice,cookie,cookies,consent,alert,message,popup,modal,warning", inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input type=text><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"
        inner = self.rng.choice([inner, f"<p>{self.said(3, 25)}</p>{inner}", inner + f"<div>{self.said(3, 20)}</div>"])
        return self.named("form", ",,search,login,signup,newsletter,subscribe", inner + f"<button>{self.words(1, 2)}</button>")

    def comments(self) -> str:
        r = self.rng
        one = lambda: r.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<p>{}</p><p>" + self.said(5, 60) + "</p>"]).format(self.said(4, 80))
        items = [one() for _ in range(r.randint(1, 6))]
        listed = "<ol>" + "".join(f"<li>{i}</li>" for i in items) + "</ol>" if r.random() < 0.4 else "".join(self.named("div", "comment,reply,", i) for i in items)
        title = f"<h{(k := r.choice('234'))}>{r.choice(['Comments', self.words(1, 3), '3 comments'])}</h{k}>" if r.random() < 0.6 else ""
        return self.named(r.choice(["div", "section", "div", "aside"]), "comments,commentlist,discussion,replies,respond,disqus", title + listed)

    def inline(self, text: str) -> str:
        """Inline markup and references inside a text; what it reads as stays the same."""
        r = self.rng
        if r.random() < 0.3 and len(w := text.split(" ")) > 4:
            i = r.randrange(len(w) - 2)
            w[i : i + 2] = [f"<{(t := r.choice(['b', 'i', 'em', 'a', 'span', 'strong']))}>{w[i]} {w[i + 1]}</{t}>"]
            text = " ".join(w)
        return text

    def article(self) -> str:
        r = self.rng
        part = [f"<h1>{self.said(2, 10, True)}</h1>"] if r.random() < 0.85 else []
        if part and r.random() < 0.2:
            part = [f"<header>{part[0]}</header>"]
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            roll = r.random()
            size = r.choice([(1, 2), (2, 8), (5, 30), (15, 90), (40, 150)])
            if roll < 0.66:
                text = self.inline(self.said(*size, True))
                part.append(r.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<div>{text}</div>", f"<section><p>{text}</p></section>", f"<p><b>{text}<br><p></p>"]))
            elif roll < 0.72:
                part.append(f"<h{(k := r.choice('234'))}>{self.said(1, 8, True)}</h{k}>")
            elif roll < 0.77:
                part.append("<ul>" + "".join(f"<li>{self.said(2, 25, True)}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 4))) + "</ul>")
            elif roll < 0.80:
                part.append(f"<blockquote>{self.said(5, 50, True)}</blockquote>")
            elif roll < 0.82:
                part.append(f"<table><tr><td>{self.said(1, 5, True)}<td>{self.said(1, 5, True)}</table>")
            elif roll < 0.84:
                part.append(f"<figure><figcaption>{self.said(3, 15, True)}</figcaption></figure>")
            else:
                part.append(r.choice([self.advert, self.notice, self.form, self.side, self.advert, self.notice])())
        if r.random() < 0.15:
            part.append(r.choice([self.comments, self.foot, self.form])())
        inner = "".join(part)
        style = r.random()
        if style < 0.5:
            return r.choice(["{}", "<main>{}</main>", '<div class="page">{}</div>']).format(self.named("article", ",,,post,entry,story", inner))
        if style < 0.65:
            return self.named("main", ",,content", inner)
        return self.named("div", "content,article,post,entry,story,text,main,body,", inner)

    def page(self) -> tuple[list[Block], list[int]]:
        r = self.rng
        self.main.clear()
        before = [f for f, p in ((self.head, 0.5), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.4), (self.side, 0.2), (self.form, 0.2)) if r.random() < p]
        after = [f for f, p in ((self.comments, 0.4), (self.side, 0.4), (self.form, 0.2), (self.advert, 0.3), (self.menu, 0.2), (self.foot, 0.8)) if r.random() < p]
        inner = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if r.random() < 0.2:
            inner = f'<div class="{r.choice(["wrapper", "page", "container", "main"])}">{inner}</div>'
        found = blocks(f"<html><head><title>{self.words(1, 5)}</title></head><body>{inner}</body></html>")
        return found, [int(b.text in self.main) for b in found]


@lru_cache(4)
def trained(pages: int = 600, seed: int = 11) -> Chain:
    """A chain fitted to `pages` labelled pages of the maker above; a bounded sample, the same in every run."""
    maker = _Maker(seed)
    return fit([maker.page() for _ in range(pages)])


def main_text(page: Column | str, model: Chain | None = None) -> Column:
    """The main text of each page."""
    model = model or trained()

    @F.arrow_udf("string")
    def extract(page: pa.Array) -> pa.Array:
        return pa.array([model.text(p) for a, b in by_bytes(page) for p in page[a:b].to_pylist()], pa.string())

    return extract(page)


def extract_pages(pages: DataFrame, page: str = "html", out: str = "text", model: Chain | None = None) -> DataFrame:
    """The rows with the main text of `page` in `out`. Other columns pass through unchanged."""
    return pages.withColumn(out, main_text(F.col(page), model))
