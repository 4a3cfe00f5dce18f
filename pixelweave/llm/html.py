"""Main text of web pages, read through wrappers inferred from pages of the same host.

A page is a stream of tags and texts. Streams of one host are aligned one after the other into a wrapper, a regular
expression without unions: elements of one place (the same tags and classes from the root down) are matched; what some pages
lack becomes optional, what follows itself becomes a repeated group, elements that come in changing order become a repeated
group of optional ones, and texts that differ become slots. Texts that all pages share at a place stay fixed.

Each page is then matched against its host's wrapper from the root down. Its main text is what fills the slots of the wrapper's main
elements: ``article`` or ``main`` if they hold a fair part of what varies, else the deepest element that holds nearly all of it. Fixed texts are
the site's and go; so do menus, headers, footers, sidebars, notices, adverts, forms and comments, told by tag, or by class, id or role where the
wrapper doesn't say otherwise. A page that its host's wrapper doesn't fit is read through a wrapper of its own.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import written

#: A host's wrapper is inferred from so many different pages, those of least hash; whole pages are aligned and all pages are read.
PAGES_A_HOST = 12
#: Texts that so many pages share at a place are fixed.
FIXED_PAGES = 3
#: Wrappers of more bytes in all aren't broadcast.
BROADCAST_BYTES = 64 << 20
#: Where they aren't, so many pages of a host are joined together at most.
PART_PAGES = 20_000
_ASIDE = frozenset("nav header footer aside form menu dialog button select iframe svg title head".split())
_WORD = "ads?|advert|adverts|advertisements?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo|promotion|related|replies|respond|share|sharing|sidebar|social|sponsored|subscribe|toolbar|widget"
_FRONT = "site|page|main|top|bottom|left|right|global|post|user|reader"
_BACK = "list|section|area|box|bar|block|wrapper|wrap|container|content|inner|outer|links?|items?|notices?|banner|buttons?|thread|form|widget|slot|unit|posts|articles|stories|media|icons|menu|main|top|bottom|left|right|primary|secondary"
#: A class, id or role is one of these words, alone or with a word of place or form; ``social-science`` or ``notice-board`` isn't.
_ASIDE_NAME = re.compile(rf"(?:(?:{_FRONT})[-_]?)?(?:{_WORD})(?:[-_](?:{_BACK}|{_WORD}|[0-9]+))*", re.IGNORECASE)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that are part of a text and never its main element.
_INNER = frozenset("p li ul ol tr td th table tbody thead tfoot blockquote pre dl dd dt h1 h2 h3 h4 h5 h6 hr figure figcaption address summary details".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template")}
_NEVER_ASIDE = frozenset("html body main article".split())
#: A start of these ends an open one of the same kind.
_ENDS = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: A start of these ends an open paragraph.
_AFTER_P = _BLOCK - frozenset("html head body tr td th tbody thead tfoot".split())
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile("[<>\"']")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, attributes or text)``: kind is ``start``, ``end`` or ``text``. Every character is looked at a fixed number of times; a tag
    that isn't closed before the next one is text."""
    at, n, missing = 0, len(page), set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield ("text", "", page[at : lt if lt >= 0 else n])
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        tag = _TAG.match(page, lt)
        if not tag:
            end = find(">", lt) if page[lt + 1 : lt + 2] in ("!", "?") else -1
            if end < 0:
                yield ("text", "", "<")
            at = end + 1 if end >= 0 else lt + 1
            continue
        pos = tag.end()
        while (stop := _STOP.search(page, pos)) and stop[0] in "\"'":
            close = find(stop[0], stop.end())
            pos = close + 1 if close >= 0 else stop.end()
        if not stop or stop[0] == "<":
            at = stop.start() if stop else n
            yield ("text", "", page[lt:at])
            continue
        name, at = tag[2].lower(), stop.end()
        yield ("end" if tag[1] else "start", name, page[tag.end() : stop.start()])
        if not tag[1] and name in _RAW:
            close = _RAW[name].search(page, at)
            yield ("end", name, "")
            at = close.end() if close else n


class Element:
    """An open element: the hash of its place, and whether it is aside by its tag or its names. ``base`` is the innermost one, it or around it,
    that has a place of its own."""

    __slots__ = ("base", "by_name", "by_tag", "name", "outer", "place")

    def __init__(self, name: str, place: int, by_tag: bool, by_name: bool, outer: Element | None):
        self.name, self.place, self.by_tag, self.by_name = name, place, by_tag, by_name
        self.outer = outer.base if outer else None
        self.base = self.outer if self.outer and self.outer.place == place else self


@dataclass
class Block:
    """A run of text: the element right around it, its pieces, and how many of its characters are in links."""

    element: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    @functools.cached_property
    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.pieces)).split())


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """The element as the wrapper names it, and whether its class, id or role is an aside's."""
    if "=" not in attributes:
        return name, False
    label, aside = name, False
    for kind, *values in _NAMED.findall(attributes):
        for value in "".join(values).split():
            aside = aside or bool(_ASIDE_NAME.fullmatch(value)) and name not in _NEVER_ASIDE
            if kind.lower() == "class":
                label += "." + value
    return label, aside


def parse(page: str, opened: list[tuple[int, int, str, str]] | None = None) -> list[Block]:
    """The blocks of a page. Into ``opened`` goes each element that is a block or aside, in order: its place, that of the element around it, its
    label and its tag. Unclosed elements end with the one around them."""
    root = Element("", 0, False, False, None)
    stack, where, solid = [root], {}, [0]  # open elements, their numbers by name, the numbers of open blocks
    blocks = [Block(root)]
    links = 0  # open ones

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            e = stack.pop()
            where[e.name].pop()
            links -= e.name == "a"
            if solid[-1] == len(stack):
                solid.pop()

    for kind, name, rest in tokens(page):
        if kind == "text":
            blocks[-1].pieces.append(rest)
            if links:
                blocks[-1].linked += len(rest)
            continue
        if kind == "start" and name in _VOID:
            if name in _BLOCK:
                blocks.append(Block(stack[-1].base))
            else:
                blocks[-1].pieces.append(" ")
            continue
        breaks = name in _BLOCK
        if kind == "start":
            last = stack[solid[-1]].name
            if last in _ENDS.get(name, ()) or last == "p" and name in _AFTER_P:
                close(solid[-1])
                breaks = True
            label, by_name = _label(name, rest)
            by_tag = name in _ASIDE
            outer, place = stack[-1], stack[-1].place
            if name in _BLOCK or by_tag or by_name:
                place = xxhash.xxh64_intdigest(label.encode(errors="replace"), outer.place)
                if opened is not None:
                    opened.append((place, outer.place, label, name))
            element = Element(name, place, by_tag, by_name, outer)
            breaks = breaks or by_tag or by_name
            if not breaks and rest.endswith("/"):
                continue
            where.setdefault(name, []).append(len(stack))
            if name in _BLOCK:
                solid.append(len(stack))
            stack.append(element)
            links += name == "a"
        elif open_ := where.get(name):
            k = open_[-1]
            if name in _BLOCK or solid[-1] < k:
                breaks = breaks or stack[k].by_tag or stack[k].by_name
                close(k)
        if breaks:
            blocks.append(Block(stack[-1].base))
    return [b for b in blocks if b.text]


@dataclass
class Place:
    """What the wrapper knows of one place. ``groups``: the places inside, in order; those in one group come in changing order."""

    label: str
    outer: int
    tag: str
    pages: int = 0
    repeats: bool = False
    groups: list[set[int]] = field(default_factory=list)
    fixed: set[str] | None = None
    varies: bool = False


def _in_order(kids: list[int]) -> list[set[int]]:
    """Places in order of their first one; those that come again after others are a group with these."""
    last = {k: i for i, k in enumerate(kids)}
    out: list[set[int]] = []
    end = -1
    for i, k in enumerate(kids):
        if i > end:
            out.append(set())
        out[-1].add(k)
        end = max(end, last[k])
    return out


def _merged(a: list[set[int]], b: list[set[int]]) -> list[set[int]]:
    """Both orders in one: what they order differently becomes a group."""
    number = {k: i for i, g in enumerate(a) for k in g}
    joins = [0] * (len(a) + 1)  # differences of how often a group is to be one with that before it
    more: list[set[int]] = [set() for _ in a]
    new: dict[int, list[set[int]]] = {}
    at = 0  # what comes next belongs here or later
    for group in b:
        hits = [number[k] for k in group if k in number]
        if not hits:
            new.setdefault(at, []).append(group)
            continue
        first, at = min(hits), max(max(hits) + 1, at if min(hits) < at else 0)
        joins[min(first + 1, at)] += 1
        joins[at] -= 1
        more[at - 1] |= group
    out: list[set[int]] = []
    joined = 0
    for i in range(len(a) + 1):
        joined += joins[i]
        own = [*new.get(i, ()), *([a[i] | more[i]] if i < len(a) else ())]
        if joined and out:
            out[-1] = out[-1].union(*own)
        else:
            out += own
    return out


class Wrapper:
    """The expression that fits all pages it was given, with what it knows of their texts."""

    def __init__(self) -> None:
        self.places: dict[int, Place] = {0: Place("", 0, "")}
        self.pages = 0

    def add(self, page: str) -> None:
        """Align a page with what is there."""
        opened: list[tuple[int, int, str, str]] = []
        blocks = parse(page, opened)
        kids: dict[int, list[int]] = {}
        for place, outer, label, tag in opened:
            p = self.places.setdefault(place, Place(label, outer, tag))
            own = kids.setdefault(outer, [])
            p.repeats = p.repeats or place in own[-1:]
            if place not in own[-1:]:
                own.append(place)
        texts: dict[int, set[str]] = {}
        for b in blocks:
            texts.setdefault(b.element.place, set()).add(b.text)
        here = {place for place, *_ in opened} | {0}
        for k in here:
            p = self.places[k]
            p.pages += 1
            p.groups = _merged(p.groups, _in_order(kids.get(k, [])))
            own = texts.get(k, set())
            p.varies = p.varies or p.fixed is not None and own != p.fixed
            p.fixed = own if p.fixed is None else p.fixed & own
        self.pages += 1

    def fixed(self) -> set[tuple[int, str]]:
        """Places with the texts that all pages share there."""
        return {(k, t) for k, p in self.places.items() if p.pages >= FIXED_PAGES for t in p.fixed or ()}

    def _inside(self, p: Place) -> list[str | tuple[int, bool]]:
        """What stands inside a place: signs, and places with whether they are one of a group."""
        out: list[str | tuple[int, bool]] = []
        for g in p.groups:
            many = len(g) > 1
            out += ["("] * many + [(x, many) for x in sorted(g, key=lambda x: self.places[x].label)] + [")+"] * many
        return out

    def __str__(self) -> str:
        out: list[str] = []
        todo = self._inside(self.places[0])[::-1]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            k, mixed = item
            p = self.places[k]
            optional = mixed or p.pages < self.places[p.outer].pages
            sign = ")*" if p.repeats and optional else ")+" if p.repeats else ")?" if optional else ""
            text = "#TEXT" if p.varies or p.repeats and p.fixed else " ".join(sorted(p.fixed or ()))
            todo += reversed([*["("] * bool(sign), f"<{p.label}>", text, *self._inside(p), f"</{p.tag}>", sign])
        return "".join(out)


def _kind(blocks_of: list[tuple[int, int, str, str]]) -> str:
    """A page's template: the elements that hold others, whatever their number, as a hash."""
    held = sorted({place for place, _, _, tag in blocks_of if tag not in _INNER})
    return xxhash.xxh64_hexdigest(repr(held).encode())


class Sides:
    """Whether elements are aside, if the names of ``kept`` places don't count, and whether in one of the places ``main``."""

    def __init__(self, kept: set[int], main: set[int]):
        self.kept, self.main, self.known = kept, main, {}

    def of(self, e: Element) -> tuple[bool, bool]:
        chain = []
        x: Element | None = e
        while x is not None and id(x) not in self.known:
            chain.append(x)
            x = x.outer
        aside, inside = self.known[id(x)][:2] if x is not None else (False, False)
        for x in reversed(chain):
            aside = aside or x.by_tag or x.by_name and x.place not in self.kept
            inside = inside or x.place in self.main
            self.known[id(x)] = (aside, inside, x)  # holds the element, so its id stays its own
        return aside, inside


def _main(pages: list[list[Block]], fixed: set[tuple[int, str]]) -> tuple[set[int], set[int]]:
    """Of pages of one template: the places of the main elements, and places whose names don't make them aside."""
    sides, kept = Sides(set(), set()), set()
    places: dict[int, tuple[int, str, int]] = {0: (0, "", 0)}  # the place around, the tag, the depth; outer ones come first
    for blocks in pages:
        for b in blocks:
            chain, e = [], b.element
            while e is not None and e.place not in places:
                chain.append(e)
                e = e.outer
            for e in reversed(chain):
                places[e.place] = (e.outer.place, e.name, places[e.outer.place][2] + 1)
    if all(sides.of(b.element)[0] for blocks in pages for b in blocks):
        # nothing but asides: names alone don't make them so
        kept = set(places)
        sides = Sides(kept, set())
    weight = dict.fromkeys(places, 0)
    for blocks in pages:
        for b in blocks:
            n = len(b.text)
            if 2 * b.linked <= n and (b.element.place, b.text) not in fixed and not sides.of(b.element)[0]:
                weight[b.element.place] += n
    for p in reversed(places):
        if p:
            weight[places[p][0]] += weight[p]
    for name in ("article", "main"):
        wanted = {p for p in places if places[p][1] == name and weight[p]}
        if sum(weight[p] for p in wanted) > 0.3 * weight[0]:
            return wanted, kept
    found = [p for p in places if places[p][1] not in _INNER and weight[p] and weight[p] >= 0.8 * weight[0]]
    return {max(found, key=lambda p: places[p][2])} if found else {0}, kept


@dataclass
class Rules:
    """How pages of a host are read: fixed texts, and by template the main places and those kept whatever their names."""

    fixed: set[tuple[int, str]] = field(default_factory=set)
    main: dict[str, tuple[set[int], set[int]]] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps([sorted(self.fixed), {k: [sorted(a), sorted(b)] for k, (a, b) in self.main.items()}])

    @staticmethod
    @functools.lru_cache(maxsize=256)
    def load(text: str) -> Rules:
        fixed, main = json.loads(text)
        return Rules({(k, t) for k, t in fixed}, {k: (set(a), set(b)) for k, (a, b) in main.items()})


def infer(pages: Iterable[str]) -> tuple[Wrapper, Rules]:
    """The wrapper of some pages of one host, and how it reads them."""
    wrapper, kinds = Wrapper(), {}
    for page in pages:
        wrapper.add(page)
        opened: list[tuple[int, int, str, str]] = []
        blocks = parse(page, opened)
        kinds.setdefault(_kind(opened), []).append(blocks)
    rules = Rules(wrapper.fixed())
    for kind, own in kinds.items():
        main, kept = _main(own, rules.fixed)
        sides = Sides(kept, main)
        inside = [(b.element.place, b.text) for blocks in own for b in blocks if sides.of(b.element) == (False, True)]
        if 2 * sum(len(t) for k, t in inside if (k, t) in rules.fixed) > sum(len(t) for _, t in inside):
            # pages that are copies of each other say nothing about what is fixed
            rules.fixed -= set(inside)
            main, kept = _main(own, rules.fixed)
        rules.main[kind] = (main, kept)
    return wrapper, rules


def main_text(page: str, rules: Rules | None = None) -> str:
    """The blocks that fill the slots of the main elements; by a wrapper of the page's own where ``rules`` don't fit it."""
    opened: list[tuple[int, int, str, str]] = []
    blocks = parse(page, opened)
    rules = rules or Rules()
    found = rules.main.get(_kind(opened))
    main, kept = found or _main([blocks], rules.fixed)
    sides = Sides(kept, main)
    return "\n\n".join(b.text for b in blocks if (b.element.place, b.text) not in rules.fixed and sides.of(b.element) == (False, True))


def host_of(url: Column) -> Column:
    """The host in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, per_host: int = PAGES_A_HOST) -> DataFrame:
    """``host, n_pages, wrapper, rules`` for every host of ``pages(page_id, url, html)``: the expression and how it reads pages, as JSON.

    Of a host the ``per_host`` different pages of least hash are aligned. Ranks are cut before and after the shuffle, so no host is
    ever gathered. Null urls share the empty host; null htmls are empty pages.
    """
    page = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("h", F.xxhash64("html"))
    counts = page.groupBy("host").agg(F.count("*").alias("n_pages"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    least = written(page.select("host", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= per_host).select("host", "h"), "html-sample")
    small = F.broadcast(least) if least.count() * 100 <= BROADCAST_BYTES else least  # about 100 bytes a row
    sample = page.join(small, ["host", "h"]).groupBy("host", "h").agg(F.any_value("html").alias("html"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        wrapper, rules = infer(rows.sort_values("h")["html"].tolist())
        return pd.DataFrame([{"host": rows["host"].iloc[0], "wrapper": str(wrapper), "rules": rules.dump()}])

    return counts.join(sample.groupBy("host").applyInPandas(fit, "host string, wrapper string, rules string"), "host")


def extract(pages: DataFrame, per_host: int = PAGES_A_HOST) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    ``text`` is the main text, empty if there is none or html is null or empty; ``n_chars`` its code points. Null ids and urls
    and repeated rows stay; other columns go. An empty table gives an empty one. Where the wrappers are too large to be broadcast, pages are dealt
    by host and, within a host, by parts.
    """
    known = written(wrappers(pages, per_host).select("host", "n_pages", "rules"), "wrappers")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    if (known.agg(F.sum(F.length("rules") + F.length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known.drop("n_pages")), "host", "left")
    else:
        parts = F.ceil(F.col("n_pages") / PART_PAGES).cast("int")
        big = known.where(F.col("n_pages") > PART_PAGES).select("host", parts.alias("parts"))  # one for so many pages
        dealt = rows.join(F.broadcast(big), "host", "left").withColumn("part", F.pmod(F.xxhash64("html", "page_id"), F.coalesce("parts", F.lit(1))))
        joined = dealt.join(known.select("host", "rules", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part")), ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), Rules.load(r.as_py()) if r.is_valid else None) for h, r in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "rules").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
