"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token there is one last token of its encoding.  An automaton over the vocabulary
with suffix links lists the tokens that end at each position; a candidate is the last token if it stays
whole when encoded by itself and no merge crosses the border to the last token of the shorter prefix.
Following the back-pointers from the whole pre-token gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import small_batches, with_fields

#: Most chunks that a worker remembers in each of two generations, and most pairs of tokens; it only saves time.
REMEMBERED = 200_000
#: Stands for the mark of a word's end in the automaton's alphabet of bytes.
END = "Ā"
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A byte-level BPE vocabulary with a mark at the end of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])
        self.from_letter = {ord(c): chr(b) for c, b in byte_letters().items()}
        # Merges as numbers: parts of each token, the rank that makes it, and the rank of each adjacent pair.
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = self.ids[left + right]
            pair = (self.ids[left], self.ids[right])
            self.rank.setdefault(pair, rank)
            if whole not in self.made:
                self.parts[whole], self.made[whole] = pair, rank
        self.right_spine = Spines(self, 1)
        self.left_spine = Spines(self, 0)
        self.stands: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}

    def _spelled(self, name: str) -> str:
        marked = name.endswith(self.suffix)
        body = name[: -len(self.suffix)] if marked else name
        return body.translate(self.from_letter) + END * marked

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for name, token in self.ids.items():
            if self._stands(token):
                spelled = self._spelled(name)
                found.add_word(spelled, (len(spelled), token))
        found.make_automaton()
        return found

    def _stands(self, token: int) -> bool:
        """Whether a token is its own encoding: all borders inside it are crossed by its own merges only."""
        if token not in self.parts:
            return True
        if token not in self.stands:
            left, right = self.parts[token]
            self.stands[token] = self._crossing(left, right) == self.made[token] and self._stands(left) and self._stands(right)
        return self.stands[token]

    def _crossing(self, left: int, right: int) -> int:
        """Rank of the first merge across the border of two tokens that each stand, or NEVER."""
        a, b = self.right_spine[left], self.left_spine[right]
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = a[i], b[j]
            rank = self.rank.get((x, y), NEVER)
            # Of equal ranks the leftmost pair merges first: one inside the left token comes before the border's.
            if rank < x_gone and rank <= y_gone and rank != NEVER:
                return rank
            if x_gone == NEVER and y_gone == NEVER:
                return NEVER
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        known = self._crossing(left, right) == NEVER
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        self.fits[left << 20 | right] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1") + END
        last = [-1] * (len(spelled) + 1)
        width = [0] * (len(spelled) + 1)
        fits, done = self.fits, -1
        for end, (size, token) in self.automaton.iter(spelled):
            if end == done:
                continue
            before = last[end + 1 - size]
            if end + 1 == size:
                found = True
            elif before < 0:
                continue
            else:
                found = fits.get(before << 20 | token)
                if found is None:
                    found = self.compatible(before, token)
            if found:
                last[end + 1], width[end + 1] = token, size
                done = end
        ids, end = [], len(spelled)
        while end > 0:
            ids.append(last[end])
            end -= width[end]
        return ids[::-1]

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self.chunks(text))

    def encode(self, text: str) -> list[int]:
        return self.unpacked(self.packed(text))

    @staticmethod
    def unpacked(packed: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids) -> str:
        """Token names joined by spaces: this vocabulary's file names no decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def chunks(self, text: str) -> Iterator[bytes]:
        """The packed ids of each part of a text between spaces."""
        known = self.known
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield struct.pack("<I", self.special[part])
            elif part:
                yield from map(known.__getitem__, self.normal(part).split(" "))

    @cached_property
    def known(self) -> Remembered:
        return Remembered(self._chunk)

    @cached_property
    def whole(self) -> dict[str, int]:
        """Pre-tokens of printable ASCII that are one standing token: the automaton's match over all of them is the last token."""
        size = len(self.suffix)
        plain = {name[:-size]: token for name, token in self.ids.items() if name.endswith(self.suffix) and self._stands(token)}
        return {piece: token for piece, token in plain.items() if piece.isascii() and piece.isprintable()}

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in (chunk,) if chunk.isascii() and chunk.isalpha() else self.pieces.findall(chunk):
            token = self.whole.get(piece)
            if token is None:
                ids += self.encode_piece(piece)
            else:
                ids.append(token)
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return SPACES_ASCII.sub(" ", text).lower()
        text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()  # letter by letter: no final form


class Remembered(dict):
    """What make() gives for a key, kept in two generations: when the young one is full, it takes the old one's place."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > 64:
                return found
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Spines(dict):
    """From a token to its border symbols on one side, from the base symbol up: (token, rank at which it is merged away)."""

    def __init__(self, vocabulary: Vocabulary, side: int):
        super().__init__()
        self.vocabulary, self.side = vocabulary, side

    def __missing__(self, token: int) -> list[tuple[int, int]]:
        parts = self.vocabulary.parts.get(token)
        if parts is None:
            spine = [(token, NEVER)]
        else:
            below = self[parts[self.side]]
            spine = [*below[:-1], (below[-1][0], self.vocabulary.made[token]), (token, NEVER)]
        self[token] = spine
        return spine


SPACES = regex.compile(r"\s")
SPACES_ASCII = regex.compile(r"[\t\n\r\f\v]")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def standard_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array of int.

    A null or empty text has no ids.  The vocabulary file is read where the text is, from a path that every
    executor has.  Other columns stay; one named like the new one is replaced.  No rows give no rows.
    """
    small_batches(docs.sparkSession)
    path = path or standard_path()
    ids = F.pandas_udf(lambda s: s.map(lambda x: np.frombuffer(vocabulary(path).packed(x or ""), "<i4")), "array<int>")
    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """Add the decoded form of an array of ids; null or empty arrays give an empty text, unknown ids nothing."""
    path = path or standard_path()
    text = F.pandas_udf(lambda s: s.map(lambda x: "" if x is None else vocabulary(path).decode(x)), "string")
    return docs.withColumn(into, text(F.col(ids)))


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 of every whole text, without the ids leaving the worker.

    A null or empty text has no ids and an empty decoded text; columns of the new names are replaced, all others and all
    rows stay, repeated ones too.  No rows give no rows.
    """
    small_batches(docs.sparkSession)
    path = path or standard_path()

    def digest(texts: pd.Series) -> pd.DataFrame:
        words = vocabulary(path)
        out = []
        for x in texts:
            packed = words.packed(x or "")
            decoded = words.decode(words.unpacked(packed))
            out.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return with_fields(docs, made(F.col(text)), ["n_tokens", "ids_sha256", "decoded_sha256"])


def digest(documents: DataFrame) -> DataFrame:
    """The rows that op4 returns."""
    return digests(documents.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
