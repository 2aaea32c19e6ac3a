"""Level codes: a value and its kind in one integer, triples of such codes with their ranges, and their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nephos.functions.columns import once

# Fixed values of the code, by kind: bounds, the size below which a value counts as zero, and what it becomes then on the
# way in and out, and the factor that it is scaled by.  0 height above the sea, 1 sigma, 2 pressure, 3 arbitrary, 4 height
# above ground, 5 hybrid, 6 theta, 7 depth, 10 hours, 15 and 31 whole numbers, 17 matrix index, 21 pressure metres.
BOUNDS = {
    0: (-20000.0, 100000.0), 1: (0.0, 1.0), 2: (0.0, 1100.0), 3: (-4.8e8, 1.0e10), 4: (-20000.0, 100000.0),
    5: (0.0, 1.0), 6: (1.0, 200000.0), 7: (0.0, 20000.0), 10: (0.0, 1.0e10), 15: (0.0, 2000000.0),
    17: (1.0, 1.0e10), 21: (0.0, 1000000.0),
}
ZERO_IN = {6: 1.0, 17: 1.0, 21: 1.001e-4}
ZERO_OUT = {6: 1.0, 17: 1.0, 21: 0.0}
FACTOR = {17: -1.0, 21: 1.0e4}
#: Kinds that are levels, whether greater values are higher (1) or lower (-1), and the units' two letters.
LEVELS = (0, 1, 2, 3, 4, 5, 6, 7, 21)
ORDER = {0: 1, 1: -1, 2: -1, 4: 1, 7: -1, 21: 1}
UNITS = {
    0: " m", 1: "sg", 2: "mb", 3: "  ", 4: " M", 5: "hy", 6: "th", 7: "m-", 10: " H", 15: "_0", 17: "[]", 21: "mp", 31: "_1",
}
HOURS, WHOLE = 10, 15
#: Mantissas of positive and negative values lie between these; negative ones are stored as 1 000 000 more.
POSITIVE, NEGATIVE, OFFSET = (1.0e5, 1.0e6), (4.8e3, 4.8e4), 1_000_000
BAD = -999999
#: What a triple's conversion says.
OK, GOOD_GUESS, TERRIBLE_GUESS, WARNING, ERROR = 0, 2, 8, 32, 64


def by_kind(kind: Column | int, table: dict, default) -> Column:
    """What a table holds for a kind."""
    if isinstance(kind, int):
        return F.lit(table.get(kind, default))
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.coalesce(pairs[kind], F.lit(default)) if table else F.lit(default)


def is_level(kind: Column) -> Column:
    return kind.isin(*LEVELS)


def is_invalid_kind(kind: Column) -> Column:
    return (kind < 0) | ((kind > 31) & (kind.bitwiseAND(F.lit(15)) != 15))


def ascending(kind: Column) -> Column:
    return by_kind(kind, ORDER, 0) == 1


def descending(kind: Column) -> Column:
    return by_kind(kind, ORDER, 0) == -1


def unit_of(kind: Column) -> Column:
    """Two letters for the unit of a kind; ?? for one without a unit, !! for none."""
    more = F.concat(F.lit("I"), F.floor(kind / 16).cast("string"))
    beyond = F.when((kind % 16 == 15) & (kind < 160), more).otherwise(F.lit("!!"))
    return F.when(kind < 0, F.lit("!!")).when(kind > 31, beyond).otherwise(by_kind(kind, UNITS, "??"))


def decode(code: Column) -> tuple[Column, Column]:
    """(value, kind) of a code; of a kind that is not known, (-999999, -1)."""
    pair = once(code, _decode)
    return pair["value"], pair["kind"]


def _decode(code: Column) -> Column:
    kind = F.shiftright(code, 24).bitwiseAND(F.lit(15))
    power = F.shiftright(code, 20).bitwiseAND(F.lit(15))
    m = code.bitwiseAND(F.lit(0xFFFFF))
    m = F.when(m > OFFSET, -(m - OFFSET)).otherwise(m)
    number = m / F.pow(F.lit(10.0), power - 4)

    def new(pair: Column) -> Column:
        """Within the bounds of the kind or, beyond them, of the kind that shares its number."""
        k, p = pair["kind"], pair["number"]
        out = F.struct(F.lit(float(BAD)).alias("value"), F.lit(-1).alias("kind"))
        whole = F.struct(code.bitwiseAND(F.lit(0xFFFFFF)).cast("double").alias("value"), F.lit(WHOLE).alias("kind"))
        choice = F.when((k == WHOLE) & (code.bitwiseAND(F.lit(0xFFFFFF)) <= 2_000_000), whole)
        for first in sorted(b for b in BOUNDS if b < WHOLE):
            for real in (first, first + 16):
                if real in BOUNDS:
                    v = p / FACTOR.get(real, 1.0)
                    low, high = BOUNDS[real]
                    small = 1.001 * ZERO_IN.get(real, 0.0)
                    shown = F.when(F.abs(v) < small, F.lit(ZERO_OUT.get(real, 0.0))).otherwise(v)
                    choice = choice.when((k == first) & v.between(low, high), F.struct(shown.alias("value"), F.lit(real).alias("kind")))
        return choice.otherwise(out)

    old_kind = (
        F.when((code > 12000) & (code <= 32000), 0)
        .when((code >= 2000) & (code <= 12000), 1)
        .when(((code >= 0) & (code < 1100)) | ((code > 1200) & (code < 2000)), 2)
        .otherwise(3)
    )
    old = (
        F.when((code > 12000) & (code <= 32000), 5.0 * (code - 12001))
        .when((code >= 2000) & (code <= 12000), (code - 2000) / 10000.0)
        .when((code >= 0) & (code < 1100), code.cast("double"))
        .when((code >= 1100) & (code <= 1200), 1200.0 - code)
        .when((code > 1200) & (code < 1400), (code - 1200) / 20000.0)
        .when((code >= 1400) & (code < 1600), (code - 1400) / 2000.0)
        .when((code >= 1600) & (code < 1800), (code - 1600) / 200.0)
        .when((code >= 1800) & (code < 2000), (code - 1800) / 20.0)
        .otherwise(code.cast("double"))
    )
    modern = once(F.struct(kind.cast("int").alias("kind"), number.alias("number")), new)
    return F.when(code > 32767, modern).otherwise(F.struct(old.alias("value"), old_kind.cast("int").alias("kind")))


def encode(value: Column, kind: Column | int) -> Column:
    """New-style code of a value, with as many digits as its mantissa holds, six or, below zero, four; -999999 out of the
    kind's bounds or of a kind that is not known.  Zero has the greatest power.  A pressure of zero is code 0."""
    k = F.lit(kind) if isinstance(kind, int) else kind
    return once(F.struct(value.cast("double").alias("v"), k.cast("int").alias("k")), _encode)


def _encode(pair: Column) -> Column:
    value, kind = pair["v"], pair["k"]
    least = by_kind(kind, ZERO_IN, 0.0)
    scaled = F.when(F.abs(value) < least, least).otherwise(value) * by_kind(kind, FACTOR, 1.0)
    powers = F.array(*[F.lit(10.0 ** (e - 4)) for e in range(16)])

    def coded(t: Column) -> Column:
        size = F.abs(t)
        low = F.when(t < 0, F.lit(NEGATIVE[0])).otherwise(F.lit(POSITIVE[0]))
        high = F.when(t < 0, F.lit(NEGATIVE[1])).otherwise(F.lit(POSITIVE[1]))
        # The first power that brings the mantissa up to its least size, else the last.
        power = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda e: size * F.get(powers, e) >= low), F.lit(0)), F.lit(15))

        def whole(e: Column) -> Column:
            m = size * F.get(powers, e)
            n = F.when(m > high, F.lit(-1)).otherwise(F.round(m) + F.when(t < 0, F.lit(OFFSET)).otherwise(F.lit(0)))
            return n.cast("long").bitwiseOR(F.shiftleft(e.cast("long"), 20)).bitwiseOR(F.shiftleft(kind.bitwiseAND(F.lit(15)).cast("long"), 24))

        return once(power, whole)

    number = F.round(value).cast("long")
    integers = F.when(number.between(0, 2_000_000), number.bitwiseOR(F.lit(WHOLE << 24).cast("long"))).otherwise(F.lit(-1))
    known = kind.isin(*BOUNDS) & value.between(by_kind(kind, {k: b[0] for k, b in BOUNDS.items()}, 0.0), by_kind(kind, {k: b[1] for k, b in BOUNDS.items()}, 0.0))
    code = F.when((kind == 2) & (value == 0), F.lit(0)).when(kind == WHOLE, integers).when(known, once(scaled, coded))
    return F.coalesce(code, F.lit(BAD)).cast("long")


def encode_old(value: Column, kind: int) -> Column:
    """Old-style code of heights, sigma, pressures and arbitrary numbers."""
    whole = F.round(value).cast("long")
    if kind == 0:
        code = F.least(F.greatest(F.round(value / 5.0 + 12001).cast("long"), F.lit(12001)), F.lit(32000))
    elif kind == 1:
        code = F.when((value >= 0) & (value <= 1), F.round(value * 10000).cast("long") + 2000)
    elif kind == 2:
        code = F.when((value < 0) | (value >= 1100), F.lit(None)).when(value >= 0.999999e1, whole)
        code = (
            code.when(value >= 0.999999, F.round(value * 20).cast("long") + 1800)
            .when(value >= 0.999999e-1, F.round(value * 200).cast("long") + 1600)
            .when(value >= 0.999999e-2, F.round(value * 2000).cast("long") + 1400)
            .when(value >= 0.999999e-3, F.round(value * 20000).cast("long") + 1200)
            .otherwise(F.lit(0))
        )
    elif kind == 3:
        code = F.when((whole >= 0) & (whole <= 100), 1200 - whole)
    else:
        raise ValueError("no old-style code for this kind")
    return F.coalesce(code, F.lit(BAD)).cast("long")


def _span(lo: Column, hi: Column, kind: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), kind.cast("int").alias("kind"))


def encode_ranges(level: Column, time: Column, other: Column) -> Column:
    """Three codes and a status from a level, a time and anything, structs of lo, hi and kind.

    The level or the time may be a range, whose second end takes the third place: a level's first end is the lower one in
    the atmosphere, a time's the later one.  Without a range the third stands for itself.  Not a level, not a time, two
    ranges or an invalid kind are errors, with codes of -1.
    """

    def made(x: Column) -> Column:
        rp1, rp2, rp3 = x["a"], x["b"], x["c"]
        one, two = rp1["hi"] != rp1["lo"], rp2["hi"] != rp2["lo"]
        up, down = ascending(rp1["kind"]), descending(rp1["kind"])
        turn = ((rp1["hi"] < rp1["lo"]) & up) | ((rp1["hi"] > rp1["lo"]) & down)
        p1, p1b = F.when(turn, rp1["hi"]).otherwise(rp1["lo"]), F.when(turn, rp1["lo"]).otherwise(rp1["hi"])
        p2, p2b = F.greatest(rp2["lo"], rp2["hi"]), F.least(rp2["lo"], rp2["hi"])
        p3 = F.when(one, p1b).when(two, p2b).otherwise(rp3["lo"])
        k3 = F.when(one, rp1["kind"]).when(two, rp2["kind"]).otherwise(rp3["kind"])
        bad = is_invalid_kind(rp1["kind"]) | is_invalid_kind(rp2["kind"]) | ~is_level(rp1["kind"]) | (rp2["kind"] != HOURS) | (one & two)
        bad = bad | (~one & ~two & is_invalid_kind(rp3["kind"]))
        p1, p2 = F.when(one, p1).otherwise(rp1["lo"]), F.when(two, p2).otherwise(rp2["lo"])
        codes = (encode(p1, rp1["kind"]), encode(p2, rp2["kind"]), encode(p3, k3))
        return F.struct(*[F.when(bad, F.lit(-1)).otherwise(c).alias(f"ip{i}") for i, c in enumerate(codes, 1)], F.when(bad, ERROR).otherwise(OK).alias("status"))

    return once(F.struct(level.alias("a"), time.alias("b"), other.alias("c")), made)


def _decoded(code: Column) -> Column:
    value, kind = decode(code)
    return F.struct(value.alias("p"), kind.alias("k"))


def decode_ranges(ip1: Column, ip2: Column, ip3: Column) -> Column:
    """level, time and other (structs of lo, hi and kind) and a status of three codes: the inverse of encode_ranges.

    Old-style codes are guesses: a time in hours in the second place, an arbitrary number in the third.  A third code that
    closes a range leaves other empty, of kind -1.
    """

    def made(x: Column) -> Column:
        a, b, c = x["a"], x["b"], x["c"]
        old2, old3 = x["ip2"] < 32768, x["ip3"] < 32768
        p2, k2 = F.when(old2, x["ip2"].cast("double")).otherwise(b["p"]), F.when(old2, F.lit(HOURS)).otherwise(b["k"])
        p3, k3 = F.when(old3, x["ip3"].cast("double")).otherwise(c["p"]), F.when(old3, F.lit(3)).otherwise(c["k"])
        negative = (x["ip1"] < 0) | (x["ip2"] < 0) | (x["ip3"] < 0)
        guess = F.when(x["ip1"] < 32768, GOOD_GUESS).otherwise(0).bitwiseOR(F.when(old2, GOOD_GUESS).otherwise(0)).bitwiseOR(F.when(old3, TERRIBLE_GUESS).otherwise(0))
        times = ~old3 & (c["k"] == HOURS) & ~old2 & (k2 == HOURS)
        levels = ~old3 & (c["k"] <= 6) & (c["k"] == a["k"])
        turn = ((p3 < a["p"]) & ascending(a["k"])) | ((p3 > a["p"]) & descending(a["k"]))
        level = F.when(levels & turn, _span(p3, a["p"], a["k"])).when(levels, _span(a["p"], p3, a["k"])).otherwise(_span(a["p"], a["p"], a["k"]))
        time = F.when(times, _span(F.least(p2, p3), F.greatest(p2, p3), k2)).otherwise(_span(p2, p2, k2))
        other = F.when(times | levels, _span(F.lit(0.0), F.lit(0.0), F.lit(-1))).otherwise(_span(p3, p3, k3))
        bad = negative | ~is_level(a["k"]) | (k2 != HOURS) | (k3 == -1) | (a["k"] > 6)
        status = F.when(negative, F.lit(ERROR)).when(bad, guess.bitwiseOR(F.lit(ERROR))).otherwise(guess)
        return F.struct(level.alias("level"), time.alias("time"), other.alias("other"), status.alias("status"))

    held = F.struct(*[c.cast("long").alias(n) for c, n in ((ip1, "ip1"), (ip2, "ip2"), (ip3, "ip3"))], *[_decoded(c.cast("long")).alias(n) for c, n in ((ip1, "a"), (ip2, "b"), (ip3, "c"))])
    return once(held, made)


def encode_pairs(p1: Column, k1: Column, p2: Column, k2: Column, p3: Column, k3: Column) -> Column:
    """Three codes and a status from three values and kinds: a level, a time and anything; a level in second place is a warning.

    A level, a level and a time come out as the range's ends in first and third place, lower in the atmosphere first; two
    times come out later first.
    """

    def made(x: Column) -> Column:
        q, k = [x[f"p{i}"] for i in (1, 2, 3)], [x[f"k{i}"] for i in (1, 2, 3)]
        bad = is_invalid_kind(k[0]) | is_invalid_kind(k[1]) | is_invalid_kind(k[2]) | ~is_level(k[0]) | (~is_level(k[1]) & (k[1] != HOURS))
        code = [x[f"c{i}"] for i in (1, 2, 3)]
        layer = (k[0] == k[1]) & (k[2] == HOURS)
        turn = ((q[0] > q[1]) & ascending(k[0])) | ((q[0] < q[1]) & descending(k[0]))
        later = (k[1] == HOURS) & (k[2] == HOURS) & (q[1] < q[2])
        out1 = F.when(layer & turn, code[1]).otherwise(code[0])
        out2 = F.when(layer | later, code[2]).otherwise(code[1])
        out3 = F.when(layer, F.when(turn, code[0]).otherwise(code[1])).when(later, code[1]).otherwise(code[2])
        status = F.when(bad, ERROR).when(is_level(k[1]), WARNING).otherwise(OK)
        return F.struct(*[F.when(bad, F.lit(-1)).otherwise(c).alias(f"ip{i}") for i, c in enumerate((out1, out2, out3), 1)], status.alias("status"))

    parts = [p.cast("double").alias(f"p{i}") for i, p in enumerate((p1, p2, p3), 1)] + [k.cast("int").alias(f"k{i}") for i, k in enumerate((k1, k2, k3), 1)]
    parts += [encode(p, k).alias(f"c{i}") for i, (p, k) in enumerate(((p1, k1), (p2, k2), (p3, k3)), 1)]
    return once(F.struct(*parts), made)


def decode_pairs(ip1: Column, ip2: Column, ip3: Column) -> Column:
    """p1, kind1 to p3, kind3 and a status of three codes: each by itself, then brought in order.

    A time in first place changes places with the second code, with a warning.  Ends of a level's range come lower in the
    atmosphere first, ends of a time's later first.
    """

    def swapped(x: Column) -> Column:
        turned = x["a"]["k"] == HOURS
        c1, c2 = F.when(turned, x["ip2"]).otherwise(x["ip1"]), F.when(turned, x["ip1"]).otherwise(x["ip2"])
        d1, d2 = F.when(turned, x["b"]).otherwise(x["a"]), F.when(turned, x["a"]).otherwise(x["b"])
        return F.struct(c1.alias("ip1"), c2.alias("ip2"), x["ip3"].alias("ip3"), d1.alias("a"), d2.alias("b"), x["c"].alias("c"), turned.alias("turned"), ((x["ip1"] < 0) | (x["ip2"] < 0) | (x["ip3"] < 0)).alias("negative"))

    def made(x: Column) -> Column:
        old2, old3 = x["ip2"] < 32768, x["ip3"] < 32768
        p1, k1 = x["a"]["p"], x["a"]["k"]
        p2, k2 = F.when(old2, x["ip2"].cast("double")).otherwise(x["b"]["p"]), F.when(old2, F.lit(HOURS)).otherwise(x["b"]["k"])
        p3, k3 = F.when(old3, x["ip3"].cast("double")).otherwise(x["c"]["p"]), F.when(old3, F.lit(3)).otherwise(x["c"]["k"])
        bad = x["negative"] | ~is_level(k1) | (~is_level(k2) & (k2 != HOURS)) | is_invalid_kind(k3)
        flag = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0))
        status = flag(x["turned"], WARNING).bitwiseOR(flag(x["ip1"] < 32768, GOOD_GUESS)).bitwiseOR(flag(old2, GOOD_GUESS))
        status = status.bitwiseOR(flag(~old2 & is_level(k2), WARNING)).bitwiseOR(flag(old3, TERRIBLE_GUESS))
        layer = (k1 == k2) & (k3 == HOURS)
        q2, q3 = F.when(layer, p3).otherwise(p2), F.when(layer, p2).otherwise(p3)
        m2, m3 = F.when(layer, k3).otherwise(k2), F.when(layer, k2).otherwise(k3)
        turn = (k1 == m3) & ((ascending(k1) & (p1 > q3)) | (descending(k1) & (p1 < q3)))
        r1, r3 = F.when(turn, q3).otherwise(p1), F.when(turn, p1).otherwise(q3)
        later = (m2 == m3) & (m2 == HOURS) & (q2 < r3)
        r2, r3 = F.when(later, r3).otherwise(q2), F.when(later, q2).otherwise(r3)
        out = ((r1, k1), (r2, m2), (r3, m3))
        fields = [c.alias(n) for i, (p, k) in enumerate(out, 1) for c, n in ((F.when(~bad, p), f"p{i}"), (F.when(~bad, k.cast("int")), f"kind{i}"))]
        return F.struct(*fields, F.when(x["negative"], F.lit(ERROR)).when(bad, status.bitwiseOR(F.lit(ERROR))).otherwise(status).alias("status"))

    held = F.struct(*[c.cast("long").alias(n) for c, n in ((ip1, "ip1"), (ip2, "ip2"), (ip3, "ip3"))], *[_decoded(c.cast("long")).alias(n) for c, n in ((ip1, "a"), (ip2, "b"), (ip3, "c"))])
    return once(once(held, swapped), made)


def text_of(value: Column) -> Column:
    """A number as %g writes it: six digits, without zeros at the end, with an exponent below 1e-4 and from 1e6."""
    return F.when(value == 0, F.lit("0")).otherwise(once(value, _text))


def _text(value: Column) -> Column:
    def written(x: Column) -> Column:
        power = F.substring_index(x["mantissa"], "e", -1).cast("int")
        # Only the branch of a row's own power is formatted.
        plain = reduce(lambda rest, e: rest.when(power == e, F.format_string(f"%.{max(0, 5 - e)}f", x["value"])), range(-3, 6), F.when(power == -4, F.format_string("%.9f", x["value"])))
        signed = F.concat(F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
        return F.when(power.between(-4, 5), _without_zeros(plain)).otherwise(F.concat(_without_zeros(F.substring_index(x["mantissa"], "e", 1)), F.lit("e"), signed))

    return once(F.struct(value.alias("value"), F.format_string("%.5e", value).alias("mantissa")), written)


def _without_zeros(digits: Column) -> Column:
    """Digits without the zeros at the end of their fraction."""
    return F.when(digits.contains("."), F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))).otherwise(digits)


def codes_text(ip1: Column, ip2: Column, ip3: Column) -> Column:
    """Three codes as text: IP1 value (unit), IP2 ..., IP3 ...; codes that do not decode stand for themselves."""

    def made(x: Column) -> Column:
        bad = (x["status"].bitwiseAND(F.lit(ERROR)) != 0) | (x["kind1"] < 0) | (x["kind2"] < 0) | (x["kind3"] < 0)
        parts = []
        for i, code in enumerate((ip1, ip2, ip3), 1):
            value = F.when(bad, code.cast("double")).otherwise(x[f"p{i}"])
            kind = F.when(bad, F.lit(WHOLE)).otherwise(x[f"kind{i}"].bitwiseAND(F.lit(31)))
            parts += [F.lit(f"IP{i} "), text_of(value), F.lit(" ("), unit_of(kind), F.lit(")" if i == 3 else "), ")]
        return F.concat(*parts)

    return once(decode_pairs(ip1, ip2, ip3), made)
