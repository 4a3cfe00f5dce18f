"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

All of it is DataFrame functions. ``regexp_extract_all`` gives a pattern's matches and ``split`` the text
between them, so a match starts after all gaps and matches before it; positions are code points. A fold that collects an array copies
it at each step, so folds go by blocks of about the square root of the number of matches (`_folded`).

Base kinds are always kept if they pass their test:

* ``email``, ``ip`` (four parts, 255 at most), ``card`` (16 to 19 digits, Luhn), ``phone`` (8 to 15 digits).

Scored kinds start from a score for their pattern and checksum; a context word within ``CONTEXT_CHARS``
before the span adds to it, and they are kept from ``KEEP_SCORE`` on:

* ``iban``: two letters, two digits, 11 to 30 letters or digits, mod-97 equal to 1. What follows may look
  like more of it, so every end of a group is tried, and of those that pass the one of the country's length is
  taken, else the longest;
* ``pan``: 13 to 15 digits passing Luhn, as some cards have; only with a context word, as a tenth of all
  numbers pass;
* ``ssn``: three, two and four digits with hyphens; only with a context word.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import let

BASE = ("email", "ip", "card", "phone")
SCORED = ("iban", "pan", "ssn")
#: The patterns, written so that a text of one long run is still read once: runs start only where no run
#: is under way, and possessive quantifiers give nothing back where that could not help.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # runs of digits that are too short or too long can't pass and aren't proposed; no run starts inside of another
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?+[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # the head only; group 1 has all that may belong to it, and the letter or digit that follows at once
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}",
    "pan": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,14}+(?![ -]?+[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no match.
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "pan": "[0-9]", "ssn": "-[0-9]{2}-"}
CONTEXT = {"iban": "iban|account|bank|konto|compte|cuenta", "pan": "card|credit|visa|amex|karte|carte|tarjeta", "ssn": "ssn|social security|tax id"}
START = {"iban": 0.7, "pan": 0.3, "ssn": 0.3}
#: Letters and digits of an IBAN by country, from the registry.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
CONTEXT_CHARS, CONTEXT_SCORE, KEEP_SCORE = 40, 0.4, 0.6


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def of(d: Column) -> Column:
        n = F.length(d)

        def step(acc: Column, i: Column) -> Column:
            x = F.ascii(F.substr(d, i, F.lit(1))) - 48
            return acc + F.when((n - i) % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

        return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)

    return let(digits, of)


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, are 1 modulo 97 as a number."""

    def of(c: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            a = F.ascii(F.substr(c, i, F.lit(1)))
            return F.when(a < 58, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), F.lit(0), step) == 1

    return let(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), of)


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "pan"):
        least, most = (16, 19) if kind == "card" else (13, 15)
        return let(digits, lambda d: F.when(F.length(d).between(least, most), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return let(F.regexp_replace(found, " ", ""), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(F.lit(False)))
    return F.lit(True)


_SPAN = "struct<start:int,end:int,found:string,place:int>"


def _blocks(items: Column) -> Column:
    """An array cut into arrays of 64 items, or of about the square root of their number if that is more; one empty one of none."""

    def of(x: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x))).cast("int"))
        return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / n).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * n + 1, n)))

    return let(items, of)


def _folded(items: Column, state: list[Column], step: Callable[[Column, Column], tuple[list[Column], Column]]) -> Column:
    """The spans that ``step(state, item)`` gives besides the next state, an array for each item, in order."""
    names = [f"s{i}" for i in range(len(state))]
    none = F.array().cast(f"array<{_SPAN}>")

    def inside(acc: Column, item: Column) -> Column:
        new, out = step(acc, item)
        return F.struct(*[c.alias(n) for c, n in zip(new, names, strict=True)], F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, items: Column) -> Column:
        done = F.aggregate(items, F.struct(*[acc[n].alias(n) for n in names], none.alias("out")), inside)
        return let(done, lambda d: F.struct(*[d[n].alias(n) for n in names], F.concat(acc["out"], F.array(d["out"])).alias("out")))

    zero = F.struct(*[c.alias(n) for c, n in zip(state, names, strict=True)], F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    return F.aggregate(_blocks(items), zero, block, lambda acc: F.flatten(acc["out"]))


def _pairs(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<gap, match, place>>``: the matches of a pattern, or a group of them, with the text before each."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("match"))
    # the gap after the last match has no match beside it
    return F.filter(F.transform(both, lambda p, i: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), i.alias("place"))), lambda p: p["match"].isNotNull())


def _span(start: Column, end: Column, found: Column, place: Column) -> Column:
    return F.array(F.struct(start.alias("start"), end.alias("end"), found.alias("found"), place.alias("place")))


def _spans(pairs: Column) -> Column:
    """The matches, tested or not, with their places in the text."""

    def step(acc: Column, p: Column) -> tuple[list[Column], Column]:
        start = acc["s0"] + F.length(p["gap"])
        end = start + F.length(p["match"])
        return [end], _span(start, end, p["match"], p["place"])

    return _folded(pairs, [F.lit(0)], step)


def _iban_spans(pairs: Column) -> Column:
    """As ``_spans``, of the codes that pass; of those that overlap the first."""
    own = F.create_map(*[F.lit(x) for n, countries in IBAN_CHARS.items() for c in countries.split() for x in (c, n)])

    def code(run: Column) -> Column:
        def of(groups: Column) -> Column:
            ends = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.array_join(F.slice(groups, F.lit(1), i), " "))
            passing = F.filter(ends, lambda c: c.rlike("^[A-Z0-9 ]+$") & _passes("iban", c))
            ranked = F.transform(passing, lambda c: F.struct((F.length(F.regexp_replace(c, " ", "")) == F.coalesce(F.try_element_at(own, F.substr(c, F.lit(1), F.lit(2))), F.lit(0))).alias("own"), F.length(c).alias("n"), c.alias("found")))
            return F.array_max(ranked)["found"]

        return let(F.split(run, " "), of)

    def step(acc: Column, p: Column) -> tuple[list[Column], Column]:
        start = acc["s0"] + F.length(p["gap"])
        end = start + F.length(p["code"])
        taken = p["code"].isNotNull() & (start >= acc["s1"])
        # only the head was cut out of the text
        return [start + 4, F.when(taken, end).otherwise(acc["s1"])], F.when(taken, _span(start, end, p["code"], p["place"])).otherwise(F.array().cast(f"array<{_SPAN}>"))

    coded = F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), code(p["match"]).alias("code"), p["place"].alias("place")))
    return _folded(coded, [F.lit(0), F.lit(0)], step)


def _before(pairs: Column, place: Column, cut: int | None) -> Column:
    """The ``CONTEXT_CHARS`` before a match, from the gap before it and the ten pairs before that, of which each has four characters
    or more. ``cut``: how many of a match were cut out of the text."""
    first = F.greatest(place - 9, F.lit(1))
    head = lambda p: p["match"] if cut is None else F.substr(p["match"], F.lit(1), F.lit(cut))
    earlier = F.transform(F.slice(pairs, first, place + 1 - first), lambda p: F.concat(F.right(p["gap"], F.lit(CONTEXT_CHARS)), head(p)))
    return F.right(F.concat(F.array_join(earlier, ""), F.element_at(pairs, place + 1)["gap"]), F.lit(CONTEXT_CHARS))


def _kept(kind: str, text: Column) -> Column:
    def of(pairs: Column) -> Column:
        spans = _iban_spans(pairs) if kind == "iban" else F.filter(_spans(pairs), lambda s: _passes(kind, s["found"]))
        if kind in SCORED:
            # a context word is all that can bring these kinds from their start to the score they need
            near = lambda s: F.lower(_before(pairs, s["place"], 4 if kind == "iban" else None)).rlike(CONTEXT[kind])
            spans = F.filter(spans, lambda s: F.lit(START[kind]) + F.when(near(s), CONTEXT_SCORE).otherwise(0.0) >= KEEP_SCORE)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(NEEDS[kind]), let(_pairs(text, PATTERNS[kind], int(kind == "iban")), of)).otherwise(none)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = BASE + SCORED) -> DataFrame:
    """``doc_id, text`` and for each kind an array of ``start, end, found``, in order of start.

    Null texts count as empty and come back empty; null ids and repeated rows stay; other columns go. Spans of one kind
    never overlap, those of different kinds may. Matches that fail their test are dropped and not retried, but for
    ``iban``, of which every start and end is tried.
    """
    doc = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return doc.select("doc_id", "text", *[_kept(k, F.col("text")).alias(k) for k in kinds])


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, comma-joined, by kind and then start."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def mask(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, n_chars, ...)`` with each span's text replaced by its kind in brackets.

    Where spans of different kinds overlap, the one that starts first wins, then the longer one. ``n_chars`` becomes the length
    of the new text. Rows without a span, and null texts, stay as they are.
    """
    text = F.col("text")

    def puts(kind: str) -> Column:
        return F.transform(_kept(kind, text), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("order"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))

    def block(acc: Column, spans: Column) -> Column:
        """Only the text that a block of spans reaches is cut up for it."""
        base = acc["at"]
        reach = F.greatest(F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), base), base)

        def cut(part: Column) -> Column:
            def step(inner: Column, s: Column) -> Column:
                put = F.struct(s["end"].alias("at"), F.concat(inner["out"], F.array(F.substr(part, inner["at"] - base + 1, s["start"] - inner["at"]), s["put"])).alias("out"))
                return F.when(s["start"] >= inner["at"], put).otherwise(inner)

            done = F.aggregate(spans, F.struct(base.alias("at"), F.array().cast("array<string>").alias("out")), step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

        return let(F.substr(text, base + 1, reach - base), cut)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    every = F.array_sort(F.concat(*map(puts, BASE + SCORED)))
    masked = F.aggregate(_blocks(every), zero, block, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1))), ""))
    # nothing to cut up in most texts
    masked = F.when(F.coalesce(functools.reduce(operator.or_, [text.rlike(n) for n in NEEDS.values()]), F.lit(False)), masked).otherwise(text)
    done = docs.withColumn("text", F.when(text.isNull(), text).otherwise(masked))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return done
