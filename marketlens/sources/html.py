"""Records from HTML: pages become trees of elements, from which cards and their fields are taken by class selectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import locality

#: Elements without content, and what an opening tag closes before it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: An implied end reaches no further than these.
HOLDS = frozenset("ul ol dl table tbody thead select div article section nav body html".split())
#: Where a directory's result page has its cards and their fields; of several selectors the first with a value counts.
CARD, NEXT = ".result", "a.next"
FIELDS = {
    "name": (".business-name span", "h2.n a"), "address": (".street-address",), "locality": (".locality",), "phone": (".phone",), "website": ("a.track-visit-website@href",),
}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    content: list[Element | str] = field(default_factory=list)

    def text(self) -> str:
        """All text inside, tags left out."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.content))
        return "".join(out)

    def inside(self) -> Iterator[Element]:
        """The elements inside in the page's order."""
        stack = [c for c in reversed(self.content) if isinstance(c, Element)]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.content) if isinstance(c, Element))

    def fits(self, simple: str) -> bool:
        """tag.class.class: either may be left out."""
        tag, *classes = simple.split(".")
        return (not tag or tag == self.tag) and set(classes) <= set(self.attributes.get("class", "").split())

    def find(self, selector: str) -> list[Element]:
        """Elements inside that fit the last part of a selector and stand in elements that fit the parts before, in their order."""
        *above, last = selector.split()
        out = []
        for x in self.inside():
            if x.fits(last):
                up, need = x.parent, list(above)
                while need and up is not None:
                    if up.fits(need[-1]):
                        need.pop()
                    up = up.parent
                if not need:
                    out.append(x)
        return out

    def value(self, selectors: Sequence[str]) -> str:
        """The trimmed text of all that a selector finds, or with @name the first one's attribute; the first selector that gives any."""
        for selector in selectors:
            path, _, attribute = selector.partition("@")
            found = self.find(path)
            got = (found[0].attributes.get(attribute, "") if found else "") if attribute else "".join(x.text() for x in found)
            if got.strip():
                return got.strip()
        return ""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        up: Element | None = self.now if tag in CLOSES else None
        while up is not None and up.tag not in HOLDS:
            if up.tag in CLOSES[tag]:
                self.now = up.parent or self.root
            up = up.parent
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.content.append(new)
        if tag not in VOID:
            self.now = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        up: Element | None = self.now
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:  # an end without a beginning is passed over
            self.now = up.parent

    def handle_data(self, data: str) -> None:
        self.now.content.append(data)


def parse(html: str | None) -> Element:
    """The tree of a page; anything at all has one."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _cards(batches: Iterable[pa.RecordBatch], card: str, fields: Mapping[str, Sequence[str]], next_: str) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "position", "has_next", *fields]
    for batch in batches:
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree = parse(html)
            more = bool(tree.find(next_))
            rows = [(page, i, more, *[x.value(s) for s in fields.values()]) for i, x in enumerate(tree.find(card))]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.string()] * len(fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def cards(pages: DataFrame, card: str = CARD, fields: Mapping[str, Sequence[str]] = FIELDS, next_: str = NEXT) -> DataFrame:
    """(page_id, html) -> page_id, position, has_next and the fields of each card in the page's order, empty text where a card lacks one.

    Entities are text, quotes of both kinds and unclosed tags are read as browsers do. A page is read by itself; null and empty pages, and those without
    cards, have no rows.
    """
    schema = "page_id long, position int, has_next boolean" + "".join(f", `{f}` string" for f in fields)
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(lambda it: _cards(it, card, fields, next_), schema)


def listed(found: DataFrame, city: str, state: str) -> DataFrame:
    """Cards as listings: those with a name; the locality as city, state and zip, the search's own where it has none; a site without its query, if it is one."""
    place = locality(F.col("locality"), city, state)
    site = F.when(F.col("website").startswith("http"), F.split("website", r"\?")[0]).otherwise("")
    rows = found.filter("name <> ''").withColumns({"_p": place, "website": site})
    return rows.select("page_id", "position", "has_next", "name", "address", F.col("_p.city").alias("city"), F.col("_p.state").alias("state"), F.col("_p.zip").alias("zip"), "phone", "website")
