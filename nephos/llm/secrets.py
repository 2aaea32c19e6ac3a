"""Secret scans by assignment-aware lexing.

Three fixed patterns are matched first.  Then every assignment of source or configuration syntax (name =
value, name: value, name := value, "name" => value, <name>value</name>) is lexed into a target name and a
value made of string literals, bare words and names; names are looked up among earlier assignments, so a
literal is found where a constant leads from it to a sensitive target.  A literal counts by what its target is
called and by what it looks like.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nephos.llm.common import small_batches

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "named")

SEPARATOR = re.compile(r":=|=>|==|[=:]|<(?=[A-Za-z_][A-Za-z0-9_.:-]*>[^<>\s]+</)")
QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
BARE = re.compile(r"[A-Za-z0-9+/_.=~$@!%^&*-]+")
ELEMENT = re.compile(r"([A-Za-z_][A-Za-z0-9_.:-]*)>([^<>\s]+)</")
#: A name that is read as $name or ${name}; a call whose first argument is a literal or a name; the mark of a YAML block.
READ = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9+/_.=~$@!%^&*-])")
CALL = re.compile(r"[A-Za-z_][A-Za-z0-9_.:]{0,80}\([\x20\t]*(?=[\"'`A-Za-z_$])")
BLOCK_MARK = re.compile(r"[|>][+-]?[\x20\t]*\n[\x20\t]+(?=\S)")
LINE = re.compile(r"[^\s#]+")
PLUS = re.compile(r"\x20*\+\x20*")
SPACE = re.compile(r"[\x20\t]*")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
#: A type up to the = after it: names, subscripts with one level of nesting, alternatives.  The = has a space before it or a
#: literal after it, as one that ends a value (base64) has not.
ANNOTATED = re.compile(r"""[\x20\t]*["']?[A-Za-z_][A-Za-z0-9_.]{0,80}["']?(?:\[(?:[^\[\]\n=]|\[[^\[\]\n=]{0,80}\]){0,80}\])?(?:\x20*\|\x20*[A-Za-z_][A-Za-z0-9_.]{0,80})*(?:[\x20\t]+(?==(?![=>]))|(?==[\x20\t]*["'][^"'\s,;)}\]]))""")
#: Parts of target names and how much they say; a pair of parts says what the list gives for it.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3,
    "credentials": 3, "bearer": 2, "authorization": 2, "auth": 1, "pin": 1, "private key": 3, "api key": 3,
    "access key": 3, "signing key": 3, "encryption key": 3, "secret key": 3, "account key": 2, "master key": 3,
}
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|changeme|example|placeholder|none|null|true|false|undefined|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)\Z")
NAMED_FROM = 5.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def name_weight(name: str) -> int:
    parts = [p.lower() for p in PART.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0) for p in (*parts, *pairs)), default=0)


def literal_weight(value: str) -> float:
    """What a literal looks like: at least 8 characters without a space, of mixed kinds or high entropy."""
    if len(value) < 8 or any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return 0.0
    kinds = sum(any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return (kinds > 1) + (kinds > 2) + (entropy >= 2.5) + (entropy >= 3.2)


def target(text: str, at: int, end: int) -> str:
    """The name that ends before a separator, but for white space, a quote or the bracket of a subscript; no leading dashes."""
    while at > end and text[at - 1] in " \t":
        at -= 1
    if at > end and text[at - 1] == "]":
        at -= 1
        while at > end and text[at - 1] in " \t":
            at -= 1
    if at > end and text[at - 1] in "\"'":
        at -= 1
    stop = at
    while at > end and (text[at - 1].isalnum() or text[at - 1] in "_-."):
        at -= 1
    return text[at:stop].lstrip("-")


def assignments(text: str):
    """(name, literals, names read) of each assignment; a literal is (start, end, value, quoted)."""
    end = 0
    annotated: dict[int, int] = {}
    for m in SEPARATOR.finditer(text):
        if m.start() < end or m.group() == "==":
            continue
        if m.group() == "<":
            element = ELEMENT.match(text, m.end())
            if element:
                # The element's text is its value; what the text itself assigns is lexed as well.
                yield element.group(1), [(element.start(2), element.end(2), element.group(2), True)], []
            continue
        # A type annotation is no value: where one ends at a later =, the name before the colon waits for that.
        if m.group() == ":" and (typed := ANNOTATED.match(text, m.end())):
            annotated[typed.end()] = m.start()
            continue
        name = target(text, annotated.pop(m.start(), m.start()), end)
        if not name or not (name[0].isalpha() or name[0] == "_"):
            continue
        place = SPACE.match(text, m.end()).end()
        literals, read = [], []
        if q := BLOCK_MARK.match(text, place):
            if q := LINE.match(text, q.end()):
                end = q.end()
                yield name, [(q.start(), q.end(), q.group(), True)], []
            continue
        if q := CALL.match(text, place):
            place = q.end()
        while True:
            if q := QUOTED.match(text, place):
                g = next(g for g in (1, 2, 3) if q.group(g) is not None)
                literals.append((q.start(g), q.end(g), q.group(g), True))
            elif q := READ.match(text, place):
                read.append(q.group(1) or q.group(2))
                literals.append((q.start(), q.end(), read[-1], False))
            elif q := BARE.match(text, place):
                word = q.group()
                if IDENTIFIER.match(word):
                    read.append(word)
                literals.append((q.start(), q.end(), word, False))
            else:
                break
            place = end = q.end()
            if not (p := PLUS.match(text, place)):
                break
            place = p.end()
        if literals:
            yield name, literals, read


@dataclass(eq=False)
class Value:
    """What an assignment gives its name: literals of its own and the values of constants that it reads.

    Values share the constants below them, so one costs what its own assignment is long, whatever it leads to.
    """

    own: list[tuple[int, int, str, bool]]
    below: list["Value"] = field(default_factory=list)
    length: int = 0
    letters: int = 0
    spaced: bool = False
    reported: bool = False

    def __post_init__(self):
        # A set of letters is a number: bits of ASCII characters, one bit for all others.
        for _, _, text, _ in self.own:
            self.length += len(text)
            self.letters |= sum(1 << c for c in {min(ord(c), 128) for c in text})
            self.spaced |= any(c.isspace() for c in text)
        for v in self.below:
            self.length = min(self.length + v.length, 1 << 40)
            self.letters |= v.letters
            self.spaced |= v.spaced

    def weight(self) -> float:
        """Of a value of literals alone, what they look like put together; else by the characters that all of it holds."""
        if not self.below:
            return literal_weight("".join(x[2] for x in self.own))
        if self.length < 8 or self.spaced:
            return 0.0
        kinds = sum(bool(self.letters & group) for group in GROUPS)
        spread = math.log2(max(1, self.letters.bit_count()))
        return (kinds > 1) + (kinds > 2) + (spread >= 2.5) + (spread >= 3.2)

    def report(self, found: set[tuple[int, int]]) -> None:
        """Add the spans of all literals that lead here; those of a value are added once."""
        open_values = [self]
        while open_values:
            value = open_values.pop()
            if not value.reported:
                value.reported = True
                found.update((x[0], x[1]) for x in value.own if x[1] > x[0])
                open_values += value.below


#: Digits, lower case, upper case, and all else.
GROUPS = [sum(1 << c for c in range(128) if f(chr(c))) for f in (str.isdigit, str.islower, str.isupper)]
GROUPS.append((1 << 129) - 1 - sum(GROUPS))


def named_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants, in order."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    for name, literals, read in assignments(text):
        below = [known[x[2]] for x in literals if not x[3] and x[2] in known]
        own = [x for x in literals if x[3] or not (x[2] in known or x[2] in read and not any(c.isdigit() for c in x[2]))]
        value = Value(own, list(dict.fromkeys(below)))
        weight = name_weight(name)
        if weight and (own or below) and weight + value.weight() >= NAMED_FROM:
            value.report(found)
        # A constant is a quoted literal, a bare one that looks like a secret, or made of constants.
        kept = [x for x in own if x[3] or literal_weight(x[2]) >= 2]
        if kept or below:
            known[name] = value if len(kept) == len(own) else Value(kept, value.below)
        else:
            known.pop(name, None)
    return sorted(found)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; those by name only where no fixed pattern covers them."""
    if not text:
        return []
    base = base_spans(text)
    named = named_spans(text)
    if not named:
        return base
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, e, _ in base), max))

    def covered(a: int, b: int) -> bool:
        # Of the fixed spans that start no later, one ends no earlier.
        k = bisect_right(starts, a)
        return k > 0 and furthest[k - 1] >= b

    more = [(a, b, "named") for a, b in named if not covered(a, b)]
    return sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add an array of the secrets of each whole text, structs of start, end (code points, end exclusive) and kind.

    Null and empty texts have none; rows, repeated ones too, and other columns stay; a column named like the new one is
    replaced.  No rows give no rows.
    """
    small_batches(docs.sparkSession)
    found = F.pandas_udf(
        lambda s: s.map(lambda x: [{"start": a, "end": b, "kind": k} for a, b, k in spans(x)]), "array<struct<start:long,end:long,kind:string>>"
    )
    return docs.withColumn(into, found(F.col(text)))


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    if not text or not (found := spans(text)):
        return text
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Replace secrets in each whole text by a mark and bring the length column up to date; null texts stay null, all rows stay."""
    small_batches(docs.sparkSession)
    clean = F.pandas_udf(lambda s: s.map(redacted), "string")
    out = docs.withColumn(text, clean(F.col(text)))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return out


def digest(documents: DataFrame) -> DataFrame:
    """The rows that op8 returns."""
    small_batches(documents.sparkSession)

    def one(text: str | None) -> tuple:
        found = spans(text)
        base = [s for s in found if s[2] != "named"]
        n = Counter(s[2] for s in base)
        return n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    made = F.pandas_udf(
        lambda s: pd.DataFrame([one(x) for x in s], columns=names), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return documents.select("doc_id", made("text").alias("m")).select("doc_id", "m.*")
