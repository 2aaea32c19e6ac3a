"""Language identification by cross-parsing against suffix automata.

Labelled text of each language is turned into a suffix automaton.  A text is parsed into phrases, each the
longest match in a language's automaton from where the last ended; the language that needs the fewest
phrases, counted by what each costs (the logarithm of the automaton's size), wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nephos.llm.common import cut, gathered, released, small_batches, with_fields

#: What a model learns from at most: labelled rows of each language, letters of each such row, letters in all
#: of a language.  A longer row gives blocks, one from each of so many equal parts.
SAMPLE_ROWS, SAMPLE_LETTERS_OF_ROW, SAMPLE_LETTERS = 400, 400, 24_000
PARTS_OF_ROW = 4
#: A phrase of a language with fewer learned letters costs as if it had so many: few letters make a phrase cheap, not likely.
LEAST_LETTERS = SAMPLE_LETTERS // 8
#: Texts are parsed in blocks of so many letters, so many of them side by side; phrases go on across the blocks' borders.
BLOCK, SIDE_BY_SIDE = 1024, 4096
#: Borders that are still parsed twice are gone through one by one when so few are left.
FEW_APART = 48
#: Shares of labels are broadcast up to so many, and joined by shuffle beyond it.
BROADCAST_LABELS = 100_000
SPACE, OTHER = 0, 1
#: No code point from here on is a letter.
LETTERS_END = 0x34000
UNDETERMINED = "und"


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings of text; state 0 is the start (Blumer et al., 1985)."""
    go: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


class Model:
    """The automata of all languages as one sparse table: a state's place and a symbol lead to a slot, which holds the next
    state if it is that state's own; else the symbol starts a new phrase.  Its size follows the learned text, not the letters."""

    def __init__(self, texts: dict[str, str], least: int | None = None):
        """With least, a phrase costs as among so many letters at least, and a letter not learned costs alike in all languages."""
        self.langs = sorted(texts)
        #: Sampled texts of each language, where train() made the model.
        self.learned: dict[str, int] = {}
        letters = sorted({c for t in texts.values() for c in t if c.isalpha()})
        self.symbol = {c: i + 2 for i, c in enumerate(letters)}
        self.width = len(letters) + 2
        #: Of each language: the state that a symbol leads to when it starts a phrase.
        self.first = np.zeros((len(self.langs), self.width), np.int32)
        self.starts, self.costs, edges = [], [], []
        offset = 0
        for k, lang in enumerate(self.langs):
            go = suffix_automaton(texts[lang])
            # The last state stands before a phrase: any symbol starts one there.
            before = len(go)
            coded = [{SPACE if c == " " else self.symbol[c]: to + offset for c, to in out.items()} for out in go]
            self.first[k] = offset + before
            self.first[k, list(coded[0])] = list(coded[0].values())
            # No step ends in the automaton's start, so its edges need no slots.
            edges += [{}, *coded[1:], {}]
            self.starts.append(offset + before)
            self.costs.append(np.log2(max(2, least or 0, len(texts[lang]))))
            offset += before + 1
        #: Of each language and symbol: what a letter that the language has not learned costs besides its phrase.
        self.strange = np.zeros((len(self.langs), self.width))
        for k, cost in enumerate(self.costs if least else []):
            self.strange[k, self.first[k] == self.starts[k]] = max(self.costs) - cost
        self._place(edges)

    def _place(self, edges: list[dict[int, int]]) -> None:
        """Give each state a place such that no two edges fall in one slot, states of most edges first."""
        self.place = np.zeros(len(edges), np.int32)
        places = 2 * sum(map(len, edges)) + 1
        self.owner = np.full(places + self.width, -1, np.int32)
        self.next = np.zeros(places + self.width, np.int32)
        draw = np.random.default_rng(5)
        single = [s for s, out in enumerate(edges) if len(out) == 1]
        for s in sorted((s for s, out in enumerate(edges) if len(out) > 1), key=lambda s: -len(edges[s])):
            symbols = np.fromiter(edges[s], np.int64, len(edges[s]))
            while True:
                slots = int(draw.integers(places)) + symbols
                if (self.owner[slots] < 0).all():
                    break
            self.place[s] = slots[0] - symbols[0]
            self.owner[slots] = s
            self.next[slots] = list(edges[s].values())
        # Single edges fill what is free; from the width on, their places are not negative.
        free = np.flatnonzero(self.owner < 0)
        slots = free[free >= self.width][: len(single)]
        if len(slots) < len(single):
            more = np.arange(len(self.owner), len(self.owner) + len(single) - len(slots))
            slots = np.concatenate([slots, more])
        symbols = np.array([next(iter(edges[s])) for s in single], np.int64)
        size = max(len(self.owner), int(slots.max(initial=0)) + self.width + 1)
        self.owner = np.concatenate([self.owner, np.full(size - len(self.owner), -1, np.int32)])
        self.next = np.concatenate([self.next, np.zeros(size - len(self.next), np.int32)])
        if single:
            self.place[single] = slots - symbols
            self.owner[slots] = single
            self.next[slots] = [next(iter(edges[s].values())) for s in single]

    def classes(self) -> np.ndarray:
        """From code point to symbol: letters not learned are OTHER, all that is no letter is SPACE."""
        table = np.fromiter((OTHER if chr(c).isalpha() else SPACE for c in range(LETTERS_END)), np.min_scalar_type(self.width), LETTERS_END)
        for c, s in self.symbol.items():
            table[ord(c)] = s
        return table

    def encoded(self, text: str, table: np.ndarray) -> np.ndarray:
        points = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = table[np.minimum(points, len(table) - 1)]
        space = codes == SPACE
        keep = ~(space & np.concatenate(([True], space[:-1]))) if len(codes) else space
        return codes[keep]

    def costs_of(self, coded: list[np.ndarray]) -> np.ndarray:
        """Bits that each text's phrases cost in each language, parsed side by side."""
        phrases = np.zeros((len(self.langs), len(coded)), np.int64)
        blocks = [(i, a) for i, x in enumerate(coded) for a in range(0, len(x), BLOCK)]
        ended = np.array(self.starts, np.int32)
        for at in range(0, len(blocks), SIDE_BY_SIDE):
            part = blocks[at : at + SIDE_BY_SIDE]
            counts, states = self._parsed([coded[i][a : a + BLOCK] for i, a in part], np.array([a > 0 for _, a in part]), ended)
            np.add.at(phrases, (slice(None), [i for i, _ in part]), counts)
            ended = states[:, -1]
        totals = np.zeros((len(coded), len(self.langs)))
        for k, cost in enumerate(self.costs):
            totals[:, k] = phrases[k] * cost
            if self.strange[k].any():
                totals[:, k] += [self.strange[k].take(x).sum() for x in coded]
        return totals

    def _step(self, states: np.ndarray, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a symbol leads each state, and whether it starts a phrase there; first is where it leads if so."""
        at = self.place.take(states)
        at += symbols
        fresh = self.owner.take(at) != states
        return np.where(fresh, first, self.next.take(at)), fresh

    def _met(self, a: int, b: int, first: np.ndarray, symbols: np.ndarray) -> tuple[int, int, int]:
        """Two parses until they are in one state or the symbols end, and how many phrases more the first one started."""
        place, owner, following, extra = memoryview(self.place), memoryview(self.owner), memoryview(self.next), 0
        for symbol, fresh in zip(symbols.tolist(), first[symbols].tolist(), strict=True):
            at, to = place[a] + symbol, place[b] + symbol
            if owner[at] != a:
                a, extra = fresh, extra + 1
            else:
                a = following[at]
            if owner[to] != b:
                b, extra = fresh, extra - 1
            else:
                b = following[to]
            if a == b:
                break
        return a, b, extra

    def _parsed(self, blocks: list[np.ndarray], goes_on: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that start in each block and the states at its end, by language.

        A block that goes on with a text continues the phrase of the block before it, the first one that of ended.  Blocks are
        parsed as if each started a phrase, all at once.  Then each border is parsed again from the state before it, beside the
        parse from its start, until both are in one state: from there they are the same.  Where they never meet, the end state
        is another one and the next border is parsed once more.
        """
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        # Longest first, so that at each step those that go on are the first ones.
        wide = np.zeros((sizes.max(), len(blocks)), np.int32)
        for k, b in enumerate(order):
            wide[: sizes[b], k] = blocks[b]
        placed = np.empty(len(blocks), np.int64)
        placed[order] = np.arange(len(blocks))
        found = np.repeat(np.array(self.starts, np.int32)[:, None], len(blocks), 1)
        phrases = np.zeros((len(self.langs), len(blocks)), np.int32)
        live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(len(wide)), side="right")
        for step, n in enumerate(live):
            symbols = wide[step, :n]
            found[:, :n], fresh = self._step(found[:, :n], symbols, self.first.take(symbols, 1))
            phrases[:, :n] += fresh
        state, counts = found[:, placed], phrases[:, placed].astype(np.int64)
        alone, own = counts.copy(), state.copy()
        lang, block = np.nonzero(np.broadcast_to(goes_on, counts.shape))
        while len(lang):
            came = np.where(block > 0, state[lang, block - 1], ended[lang])
            mine, other = came, np.array(self.starts, np.int32)[lang]
            more = np.zeros(len(lang), np.int64)
            apart, step = np.flatnonzero(mine != other), 0
            while len(apart) > FEW_APART and step < len(wide):
                apart = apart[sizes[block[apart]] > step]
                symbols = wide[step, placed[block[apart]]]
                first = self.first[lang[apart], symbols]
                a, a_fresh = self._step(mine[apart], symbols, first)
                b, b_fresh = self._step(other[apart], symbols, first)
                mine[apart], other[apart] = a, b
                more[apart] += a_fresh.astype(np.int64) - b_fresh
                apart, step = apart[a != b], step + 1
            for k in apart:
                mine[k], other[k], extra = self._met(int(mine[k]), int(other[k]), self.first[lang[k]], blocks[block[k]][step:])
                more[k] += extra
            counts[lang, block] = alone[lang, block] + more
            new = np.where(mine == other, own[lang, block], mine)
            changed = state[lang, block] != new
            state[lang, block] = new
            follows = changed & (block + 1 < len(blocks))
            follows[follows] = goes_on[block[follows] + 1]
            lang, block = lang[follows], block[follows] + 1
        return counts, state

    def predict(self, texts: list[str | None], table: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each text.  The score is how much cheaper the best is than the next, from 0.5 up to 1."""
        coded = [self.encoded(t or "", table) for t in texts]
        letters = [int(np.count_nonzero(x)) for x in coded]
        totals = self.costs_of(coded)
        out = []
        for n, costs in zip(letters, totals, strict=True):
            if not n or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            order = np.argsort(costs, kind="stable")
            rival = costs[order[1]] if len(order) > 1 else 2 * costs[order[0]]
            gap = min(rival - costs[order[0]], 60.0)
            out.append((self.langs[order[0]], float(1 / (1 + 2.0**-gap))))
        return out


def held_out(key: str = "doc_id"):
    """Whether crc32 of a key as text leaves 1 when divided by 3; a null key is held out of learning, too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def blocks_of(text: str, seed: str):
    """A text of up to SAMPLE_LETTERS_OF_ROW letters, of a longer one a block of each part, from where the seed says."""
    size = SAMPLE_LETTERS_OF_ROW // PARTS_OF_ROW
    part = F.floor(F.length(text) / PARTS_OF_ROW).cast("int")

    def block(i):
        start = F.pmod(F.xxhash64(F.col(seed), i), (part - size + 1).cast("long")).cast("int")
        return F.col(text).substr(i * part + start + 1, F.lit(size))

    blocks = F.array_join(F.array(*[block(F.lit(i)) for i in range(PARTS_OF_ROW)]), " ")
    return F.when(F.length(text) > SAMPLE_LETTERS_OF_ROW, blocks).otherwise(F.col(text))


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows, of which a bounded sample is read: the least hashes of each language's distinct texts.

    Equal texts of a language count once, and a language has min(all, SAMPLE_ROWS) of its texts in the sample.
    """
    usable = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    distinct = cut(usable.select("lang", "h").distinct())
    # Of many hashes the window sees about four times the sample; of 4 * SAMPLE_ROWS or fewer, all.
    share = distinct.groupBy("lang").agg(F.least(F.lit(2.0), F.lit(4.0 * SAMPLE_ROWS) / F.count("*")).alias("share"))
    share = share.withColumn("share", F.when(F.col("share") < 1, F.col("share")).otherwise(2.0))
    # A row a label; as the labels are few, the texts of a common one need not come to one task.
    share = cut(gathered(share))
    share = F.broadcast(share) if share.count() <= BROADCAST_LABELS else share
    few = distinct.join(share, "lang").where(F.col("h") / 2.0**64 + 0.5 < F.col("share")).drop("share")
    drawn = cut(few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE_ROWS))
    found = usable.join(F.broadcast(drawn), ["lang", "h"])
    short = found.groupBy("lang", "r").agg(F.min(blocks_of("text", "h")).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in short.orderBy("lang", "r").collect():
        words = "".join(c if c.isalpha() else " " for c in folded(r["text"])).split()
        if words:
            texts.setdefault(r["lang"], []).append(" ".join(words) + " ")
    model = Model({k: (" " + "".join(t))[:SAMPLE_LETTERS] for k, t in texts.items()}, LEAST_LETTERS)
    model.learned = {k: len(t) for k, t in texts.items()}
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add language and score, as lang_pred and score or as named, of every whole text; `und` and 0 where it is null or has no letter.

    Ties go to the first language in order of names; columns of the new names are replaced, others stay.  Repeated rows are
    predicted alike and all stay; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(scored(batches))

    def scored(batches):
        learned = shared.value
        table = learned.classes()
        for texts in batches:
            yield pd.DataFrame(learned.predict(list(texts), table), columns=list(into))

    predicted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = F.pandas_udf(predicted, f"`{into[0]}` string, `{into[1]}` double")
    # Marked so that a filter on the prediction does not get an evaluation of its own.
    return with_fields(docs, made.asNondeterministic()(F.col(text)), list(into))


def digest(documents: DataFrame) -> DataFrame:
    """The rows that op5 returns."""
    model = train(documents.where(~held_out()))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
