"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page is cut into leaf blocks: runs of text between the borders of block elements.  Each has features of its
ancestors and of its text.  The field's weights are fitted to labelled pages by the gradient of the
likelihood; Viterbi decoding says which blocks are main text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import small_batches

#: Labelled pages made for training, rounds over them, step and weight decay; pages of the table that are
#: labelled by their article element, at most, and code points of each that are used.
MADE_PAGES, ROUNDS, STEP, DECAY = 400, 6, 0.4, 1e-5
TABLE_PAGES, TABLE_PAGE_POINTS = 60, 40_000

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "textarea", "title", "iframe", "svg")
MAIN = frozenset(("article", "main"))
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Comments, raw elements, tags and declarations.  Each tag ends at the next >, so a scan of a page up to its last > is linear.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?:\s(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)?/>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+")
CUES = re.compile(r"(?i)©|copyright|cookie|subscribe|newsletter|sign (?:in|up)|log ?in|all rights|advert|sponsor|privacy|share this|related|reply|comments?\b")


@dataclass
class Block:
    """A run of text, the nearest block element around it, the tags and the class, id and role words around it."""

    text: str
    near: str
    around: frozenset[str]
    names: frozenset[str]
    linked: int = 0
    label: int = 0
    features: list[str] = field(default_factory=list)


class Open:
    """The open elements.  Sets of their tags and names are kept between changes, so that deep nesting costs no time."""

    def __init__(self, known: frozenset[str] | None):
        #: Features that matter; None for all.
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[int] = []
        self.open: dict[str, int] = {}
        # Of the tags and of the names that features are made of: how many are open.
        self.shown: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.sets: tuple[frozenset[str], frozenset[str]] | None = None

    def _matters(self, feature: str) -> bool:
        return self.known is None or feature in self.known

    def _show(self, tag: str, names: tuple[str, ...], step: int) -> None:
        keys = [(0, tag)] if tag not in INLINE and (tag in MAIN or self._matters(f"in:{tag}")) else []
        for which, key in [*keys, *((1, n) for n in names)]:
            counts = self.shown[which]
            n = counts.get(key, 0) + step
            if n:
                counts[key] = n
            else:
                del counts[key]
            if n == (step > 0):
                self.sets = None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        names = tuple(n for n in names if self._matters(f"name:{n}"))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, names))
        self.open[tag] = self.open.get(tag, 0) + 1
        self._show(tag, names, 1)

    def pop_to(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        while len(self.stack) > place:
            tag, names = self.stack.pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.open[tag] -= 1
            self._show(tag, names, -1)

    def close(self, tag: str) -> None:
        """Close the innermost element of this tag and all inside it; nothing if none is open."""
        if self.open.get(tag):
            place = len(self.stack) - 1
            while self.stack[place][0] != tag:
                place -= 1
            self.pop_to(place)

    def near(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else ""

    def around(self) -> tuple[frozenset[str], frozenset[str]]:
        if self.sets is None:
            self.sets = frozenset(self.shown[0]), frozenset(self.shown[1])
        return self.sets


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order, with features; with known, only such features of tags and names around."""
    found: list[Block] = []
    at_work = Open(known)
    parts: list[str] = []
    linked = 0

    def end_block():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, at_work.near(), *at_work.around(), linked))
            parts, linked = [], 0

    def hold(text: str):
        nonlocal linked
        # Character references are decoded here, as none goes on across a tag.
        parts.append(entities.unescape(text))
        if at_work.open.get("a"):
            linked += len(text)

    at, last, m = 0, page.rfind(">") + 1, None
    for m in MARKUP.finditer(page, 0, last):
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if not tag:
            if m.group("raw"):
                end_block()
            continue
        tag = tag.lower()
        if tag not in INLINE:
            end_block()
        if m.group("end"):
            at_work.close(tag)
        elif tag not in VOID and not m.group("attrs").endswith("/"):
            if tag in CLOSES_ITSELF and at_work.near() == tag:
                at_work.pop_to(at_work.blocks[-1])
            at_work.push(tag, _names(m.group("attrs")))
    # What follows the last > holds no tag; an open comment or raw element goes on to the page's end.
    if not (m and m.end() == last and _unended(m)):
        comment = page.find("<!--", last)
        hold(page[at : comment if comment >= 0 else len(page)])
    end_block()
    for i, b in enumerate(found):
        b.features = _features(b, i, len(found))
    return found


def _unended(final: re.Match) -> bool:
    """Whether a match is a comment or raw element without its end."""
    text, raw = final.group(), final.group("raw")
    if text.startswith("<!--"):
        return not (text.endswith("-->") and len(text) >= 7)
    return bool(raw) and not re.search(rf"(?i)</{raw}\s*>\Z", text)


def _names(attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return ()
    values = " ".join(next(x for x in m.groups()[1:] if x is not None) for m in NAMED.finditer(attrs))
    return tuple(w.lower() for w in WORD.findall(values))


def _features(b: Block, place: int, total: int) -> list[str]:
    words = b.text.count(" ") + 1
    near = b.near
    out = ["", f"tag:{near}", f"words:{min(8, int(math.log2(words)))}", f"links:{min(4, round(4 * b.linked / max(1, len(b.text))))}"]
    out += [f"in:{t}" for t in sorted(b.around) if t not in ("html", "body")]
    out += [f"name:{n}" for n in sorted(b.names)]
    if b.text[-1] in ".!?…:»”\"":
        out.append("ends")
    if CUES.search(b.text[:200]):
        out.append("cue")
    out.append(f"place:{min(3, place)}" if place < total / 2 else f"back:{min(3, total - 1 - place)}")
    if not MAIN & b.around:
        out.append(f"plain:{near}:{min(4, int(math.log2(words)))}")
    return out


class Field:
    """Weights of the label 1 against 0 for each feature, and of the steps between labels."""

    def __init__(self):
        self.weight: dict[str, float] = defaultdict(float)
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.weight)

    def scores(self, page: list[Block]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in b.features]) for b in page]

    def decode(self, page: list[Block]) -> list[int]:
        """The labels of greatest score together, by Viterbi; on ties 0."""
        if not page:
            return []
        s = self.scores(page)
        best, back = (0.0, s[0]), []
        for x in s[1:]:
            came = [int(best[1] + self.step[1][y] > best[0] + self.step[0][y]) for y in (0, 1)]
            best = tuple(best[came[y]] + self.step[came[y]][y] + (x if y else 0.0) for y in (0, 1))
            back.append(came)
        y = int(best[1] > best[0])
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]

    def gradient(self, page: list[Block]) -> tuple[list[float], list[list[float]]]:
        """Of the log-likelihood: label less its chance for each block, and the same for each kind of step."""
        s, n = self.scores(page), len(page)

        def both(a: float, b: float) -> float:
            top = max(a, b)
            return top + math.log(math.exp(a - top) + math.exp(b - top))

        ahead, after = [(0.0, s[0])], [(0.0, 0.0)]
        for x in s[1:]:
            p = ahead[-1]
            ahead.append(tuple(both(p[0] + self.step[0][y], p[1] + self.step[1][y]) + (x if y else 0.0) for y in (0, 1)))
        for x in reversed(s[1:]):
            q = after[-1]
            after.append(tuple(both(self.step[y][0] + q[0], self.step[y][1] + x + q[1]) for y in (0, 1)))
        after.reverse()
        total = both(*ahead[-1])
        unary = [page[i].label - math.exp(ahead[i][1] + after[i][1] - total) for i in range(n)]
        steps = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            steps[page[i - 1].label][page[i].label] += 1
            for a in (0, 1):
                for b in (0, 1):
                    steps[a][b] -= math.exp(ahead[i - 1][a] + self.step[a][b] + (s[i] if b else 0.0) + after[i][b] - total)
        return unary, steps


def fit(pages: list[list[Block]]) -> Field:
    """A field fitted to labelled pages by adaptive gradient steps, page by page in a fixed shuffled order."""
    model, seen, seen_steps = Field(), defaultdict(lambda: 1e-2), [[1e-2] * 2, [1e-2] * 2]
    draw = random.Random(6)
    pages = [p for p in pages if p]
    for _ in range(ROUNDS):
        draw.shuffle(pages)
        for page in pages:
            unary, steps = model.gradient(page)
            sums: dict[str, float] = defaultdict(float)
            for b, g in zip(page, unary, strict=True):
                for f in b.features:
                    sums[f] += g
            for f, g in sums.items():
                g -= DECAY * model.weight[f] * len(page)
                seen[f] += g * g
                model.weight[f] += STEP * g / math.sqrt(seen[f])
            for a in (0, 1):
                for b in (0, 1):
                    seen_steps[a][b] += steps[a][b] ** 2
                    model.step[a][b] += STEP * steps[a][b] / math.sqrt(seen_steps[a][b])
    model.weight = dict(model.weight)
    return model


#: Stands before main text in made pages until they are labelled.
MARK = "\ue000"


def made_pages(count: int = MADE_PAGES, seed: int = 1) -> list[list[Block]]:
    """Labelled pages of many layouts.  Words are random syllables, so that structure and shape are learned, not a language."""
    draw = random.Random(seed)
    pages = []
    for _ in range(count):
        found = blocks(_made_page(draw))
        for b in found:
            b.label = int(b.text.startswith(MARK))
            b.text = b.text.removeprefix(MARK)
        for i, b in enumerate(found):
            b.features = _features(b, i, len(found)) if b.text else ["", "tag:"]
        pages.append(found)
    return pages


def _made_page(draw: random.Random) -> str:
    syllables = [a + b for a in "b d f g k l m n p r s t v z th st".split() for b in "a e i o u ai en or is".split()]

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(lo, hi)))

    def sentences(lo: int, hi: int) -> str:
        text = " ".join(words(4, 18).capitalize() + draw.choice(".....?!") for _ in range(draw.randint(lo, hi)))
        return text if draw.random() < 0.8 else text.replace(" ", draw.choice(["### ", "!! ", " "]))

    def links(n: int, inside: str = "li") -> str:
        return "".join(f'<{inside}><a href="/x">{words(1, 3)}</a></{inside}>' for _ in range(n))

    def box(names: str, inner: str, tag: str = "div") -> str:
        name = draw.choice(names.split())
        return f'<{tag} {draw.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    def maybe(p: float, text: str) -> str:
        return text if draw.random() < p else ""

    def menu() -> str:
        if draw.random() < 0.6:
            return f"<nav><ul>{links(draw.randint(2, 9))}</ul></nav>"
        return box("menu nav navbar topnav breadcrumb navigation", draw.choice([f"<ul>{links(6)}</ul>", links(5, "span")]))

    def advert() -> str:
        return box("ad ads advert promo sponsored banner adsense", draw.choice([sentences(1, 2), words(2, 6), f"<p>{sentences(1, 1)}</p>"]), draw.choice(["div", "aside", "section"]))

    def notice() -> str:
        return box("notice cookie cookie-banner consent alert newsletter popup", draw.choice([sentences(1, 3), f"<p>We use cookies. {sentences(1, 1)}</p><button>{words(1, 2)}</button>"]))

    def sidebar() -> str:
        inner = draw.choice([f"<h3>{words(1, 4)}</h3><ul>{links(draw.randint(2, 6))}</ul>", f"<h4>{words(1, 3)}</h4><p>{sentences(1, 3)}</p>"])
        return f"<aside>{inner}</aside>" if draw.random() < 0.5 else box("sidebar related widget aside recommended rail", inner)

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 2)}</label><input name="q"><p>{words(2, 8)}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        each = "".join(draw.choice([f"<li><b>{words(1, 2)}</b><p>{sentences(1, 6)}</p></li>", f'<div class="comment"><p>{sentences(1, 5)}</p></div>', f'<article class="comment"><p>{sentences(1, 4)}</p></article>']) for _ in range(draw.randint(1, 5)))
        return box("comments comment-list responses discussion replies", f"<h3>{words(1, 3)}</h3>{each}", draw.choice(["div", "section", "ol"]))

    def article() -> str:
        stock = ["All rights reserved.", "Copyright and licence of this work are stated here.", "Subscribe to our newsletter.", "Sign in to comment."]
        parts = [maybe(0.85, f"<h1>{MARK}{words(3, 12)}</h1>")]
        for _ in range(draw.randint(1, 7)):
            parts.append(
                draw.choices(
                    [
                        f"<p>{MARK}{sentences(1, 9)}</p>", f"<p>{MARK}{sentences(2, 8)}", f"<p><b>{MARK}{sentences(1, 6)}<br>{MARK}{sentences(1, 4)}</b></p>",
                        f"<h2>{MARK}{words(1, 7)}</h2>", f"<ul><li>{MARK}{words(2, 14)}</li><li>{MARK}{sentences(1, 2)}</li></ul>", f"<blockquote>{MARK}{sentences(1, 3)}</blockquote>",
                        f'<p>{MARK}{sentences(1, 2)} <a href="/y">{words(1, 3)}</a> {sentences(1, 2)}</p>', f"<table><tr><td>{MARK}{words(1, 5)}</td><td>{MARK}{words(1, 5)}</td></tr></table>", f"<pre>{MARK}{words(3, 20)}</pre>",
                    ],
                    [10, 3, 3, 2, 1, 1, 2, 0.5, 0.4],
                )[0]
            )
            parts.append(maybe(0.06, advert()))
            parts.append(maybe(0.06, f"<p>{MARK}{draw.choice(stock)} {maybe(0.5, sentences(1, 2))}</p>"))
        parts.append(maybe(0.12, box("share social tags byline meta", words(1, 5))))
        inner = "".join(parts)
        kind = draw.random()
        if kind < 0.2:
            return f"<article>{inner}</article>"
        if kind < 0.3:
            return f"<main>{inner}</main>"
        if kind < 0.6:
            tag = draw.choice(["div", "section", "div"])
            return f"<{tag}>{inner}</{tag}>"
        if kind < 0.85:
            return box("content post post-content article-body entry story main text article", inner, draw.choice(["div", "section", "div"]))
        return inner

    head = f'<html><head><title>{words(3, 9)}</title><style>p{{margin:0}}</style></head><body class="{draw.choice(["", "page", "home"])}">'
    before = [menu() if draw.random() < 0.8 else "", maybe(0.5, f"<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>"), maybe(0.3, notice()), maybe(0.55, advert()), maybe(0.2, form())]
    after = [maybe(0.35, sidebar()), maybe(0.25, advert()), maybe(0.4, comments()), maybe(0.2, form()), maybe(0.15, notice())]
    draw.shuffle(before)
    draw.shuffle(after)
    foot = maybe(0.85, draw.choice([f"<footer>&copy; {words(1, 3)} &middot; {draw.choice([sentences(1, 2), words(2, 8)])}</footer>", f"<footer><p>{sentences(1, 2)}</p></footer>", box("footer copyright bottom", f"<p>Copyright {words(1, 6)}</p>")]))
    return head + "".join(before) + maybe(0.3, sidebar()) + article() + "".join(after) + foot + "</body></html>"


def labelled(page: str) -> list[Block] | None:
    """A page labelled by its one article or main element; None without one."""
    found = blocks(page)
    inside = [bool(MAIN & b.around) for b in found]
    if not any(inside) or len(re.findall(r"(?i)<(?:article|main)\b", page)) != 1:
        return None
    for b, y in zip(found, inside, strict=True):
        b.label = int(y and not {"aside", "nav", "form", "footer"} & b.around and not {"ad", "ads", "comment", "comments"} & b.names)
    return found


def train(pages: DataFrame | None = None, html: str = "html") -> Field:
    """A field from made pages and, of a table, a bounded sample of those that an article element labels."""
    known = made_pages()
    if pages is not None:
        share = min(1.0, 20 * TABLE_PAGES / max(1, pages.count()))
        usable = F.col(html).contains("<article") & (F.length(html) <= TABLE_PAGE_POINTS)
        sample = pages.where(usable).select(F.col(html).alias("html")).withColumn("h", F.xxhash64("html")).where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
        for r in sample.orderBy("h").limit(TABLE_PAGES).collect():
            if page := labelled(r["html"]):
                known.append(page)
    return fit(known)


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page or "", model.known)
    return " ".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def extract(pages: DataFrame, model: Field, html: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of every whole page; empty for null or empty pages and where no block is main text.

    Rows, repeated ones too, and other columns stay; a column named like the new one is replaced.  No rows give no rows.  Where
    both labels of a block score alike it is not main text.  A page costs time in proportion to its length, however deeply its
    elements nest and whatever is left open.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    text = F.pandas_udf(_series(lambda s: s.map(lambda x: main_text(x, shared.value))), "string")
    return pages.withColumn(into, text(F.col(html)))


def _series(f):
    f.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return f


def digest(pages: DataFrame) -> DataFrame:
    """The rows that op6 returns."""
    model = train(pages)
    return extract(pages.select("page_id", "url", "html"), model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
