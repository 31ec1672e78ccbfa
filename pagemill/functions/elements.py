"""The elements of a page as an array: one linear pass over its tags, at any nesting depth.

Rules, tables and catalogs are native filters over this array."""

from __future__ import annotations

import html as references
import re
import sys
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The scanner travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``start``, ``inner`` and ``stop`` are places in the page: of the open tag, behind it, and of the closing tag or
#: what else ends the element. ``parent`` is the ``no`` of the element around it (-1: none), ``last`` that of the last
#: element inside it (its own: none), so elements inside have the numbers up to it; ``nth`` counts the
#: elements of the same tag in that parent up to this one, ``nth_any`` those of any tag. ``own`` has the
#: text nodes outside child elements, references decoded, ``attrs`` the attributes, the first of a name. ``c0``,
#: ``c1`` and ``c2`` are the chunks of the page that begin at ``start``, ``inner`` and ``stop``.
ELEMENT = (
    "struct<no:int,tag:string,start:int,inner:int,stop:int,parent:int,nth:int,nth_any:int,"
    "attrs:map<string,string>,own:array<string>,last:int,c0:int,c1:int,c2:int>"
)
#: The elements of a page, and the page cut where they begin and end: what an element holds is a run of chunks, found
#: without reading the page from its start.
SCANNED = f"struct<all:array<{ELEMENT}>,chunks:array<string>>"
#: Characters of pages whose elements are held at once.
SCAN_CHARS = 1_000_000

# Elements without content, elements whose content is text only, and tags that end an open
# element: (the ones they end, what shields those from them).
VOID = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
)
RAW = frozenset(["script", "style", "textarea", "title"])
ENDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "a": (("a",), ("table",)),
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
}
for _tag in (
    ["address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figure"]
    + ["footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre"]
    + ["section", "table", "ul"]
):
    ENDS[_tag] = (("p",), ("table", "td", "th", "button"))
_SHIELDS = frozenset(["table", "td", "th"])
_TABLE_TAGS = frozenset(["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"])

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>|[!?][^>]*+>)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")


class _Elements:
    """The elements of some pages as columns, in the order of their open tags."""

    def __init__(self) -> None:
        self.pages, self.tag, self.start, self.inner, self.stop = [0], [], [], [], []
        self.parent, self.nth, self.nth_any, self.last = [], [], [], []
        self.c0, self.c1, self.c2 = [], [], []
        self.attributes, self.names, self.values = [0], [], []
        self.own: list[list[str]] = []
        self.chunks: list[list[str]] = []

    def add_attributes(self, text: str) -> int:
        """The attributes of an element, the first of a name; how many there are up to this element."""
        found: dict[str, str] = {}
        for name, double, single, bare in _ATTRIBUTE.findall(text):
            value = double or single or bare
            found.setdefault(name.lower(), references.unescape(value) if "&" in value else value)
        self.names += found
        self.values += found.values()
        return len(self.names)

    def array(self) -> pa.Array:
        """A ``SCANNED`` for each page."""
        own = [0, *accumulate(map(len, self.own))]
        counts = np.diff(self.pages)
        number = np.arange(len(self.tag)) - np.repeat(self.pages[:-1], counts)
        columns = {
            "no": pa.array(number, pa.int32()),
            "tag": pa.array(self.tag, pa.string()),
            **{n: pa.array(getattr(self, n), pa.int32()) for n in ("start", "inner", "stop", "parent", "nth", "nth_any")},
            "attrs": pa.MapArray.from_arrays(
                pa.array(self.attributes, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string())
            ),
            "own": pa.ListArray.from_arrays(
                pa.array(own, pa.int32()), pa.array(list(chain.from_iterable(self.own)), pa.string())
            ),
            **{n: pa.array(getattr(self, n), pa.int32()) for n in ("last", "c0", "c1", "c2")},
        }
        structs = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        elements_of = pa.ListArray.from_arrays(pa.array(self.pages, pa.int32()), structs)
        return pa.StructArray.from_arrays([elements_of, pa.array(self.chunks, pa.list_(pa.string()))], ["all", "chunks"])

    def scan(self, page: str | None) -> None:
        """Add the elements of a page, and the page cut at their places."""
        page = page or ""
        first = len(self.tag)
        starts, stops, lasts, ends, owns = self.start, self.stop, self.last, self.c2, self.own
        tags, inners, parents, nths, nths_any = self.tag, self.inner, self.parent, self.nth, self.nth_any
        c0s, c1s, attributed, end_of_names, unescape = self.c0, self.c1, self.attributes, len(self.names), references.unescape
        stack: list[int] = []
        # Per tag the places in the stack where it is open; per parent how often each tag came.
        opened: dict[str, list[int]] = {}
        children: dict[int, dict[str, int]] = {}
        # The depths of the stack where cells and tables are open, which shield what is around them.
        shields: list[int] = []
        # The places to cut at come in rising order.
        places: list[int] = []
        lower = None
        # Whether the next text goes on with the last text node: what a stray "<" or an ignored closing tag cuts is one.
        joined = False

        def mark(at: int) -> int:
            if not places or places[-1] != at:
                places.append(at)
            return len(places) - 1

        def deepest(tags) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

        def close(depth: int, at: int) -> None:
            """End the elements from this depth of the stack on."""
            chunk, newest = mark(at), len(self.tag) - 1 - first
            while len(stack) > depth:
                i = stack.pop()
                opened[tags[i]].pop()
                stops[i], ends[i], lasts[i] = at, chunk, newest
            while shields and shields[-1] >= depth:
                shields.pop()

        at, find, match_at = 0, page.find, _TAG.match
        while True:
            start = find("<", at)
            match = match_at(page, start) if start >= 0 else None
            until = len(page) if start < 0 else start if match else start + 1
            if until > at and stack:
                piece = page[at:until]
                piece = unescape(piece) if "&" in piece else piece
                own = owns[stack[-1]]
                if own and joined:
                    own[-1] += piece
                else:
                    own.append(piece)
                joined = True
            if start < 0:
                break
            if match is None:
                at = until
                continue
            at = match.end()
            slash, tag, attributes = match.groups()
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                places_open = opened.get(tag)
                if places_open and (not shields or places_open[-1] > shields[-1] or tag in _TABLE_TAGS):
                    close(places_open[-1], start)
                    joined = False
                continue
            ended = ENDS.get(tag)
            if ended:
                depth = deepest(ended[0]) if len(ended[0]) > 1 or opened.get(ended[0][0]) else -1
                if depth >= 0:
                    shield = deepest(ended[1])
                    if depth > shield:
                        # The outermost of the ended ones that nothing shields.
                        close(min(p for t in ended[0] for p in opened.get(t, ()) if p > shield), start)
            i = len(tags)
            parent = stack[-1] - first if stack else -1
            counts = children.get(parent)
            if counts is None:
                counts = children[parent] = {"*": 0}
            counts[tag] = nth = counts.get(tag, 0) + 1
            counts["*"] = nth_any = counts["*"] + 1
            tags.append(tag)
            starts.append(start)
            inners.append(at)
            stops.append(at)
            parents.append(parent)
            nths.append(nth)
            nths_any.append(nth_any)
            lasts.append(i - first)
            c0s.append(mark(start))
            # The end of a tag lies behind all places before it.
            places.append(at)
            chunk = len(places) - 1
            c1s.append(chunk)
            ends.append(chunk)
            if attributes:
                end_of_names = self.add_attributes(attributes)
            attributed.append(end_of_names)
            owns.append([])
            joined = False
            if tag in VOID:
                continue
            if tag in RAW:
                lower = page.lower() if lower is None else lower
                lower = lower if len(lower) == len(page) else page
                end = lower.find(f"</{tag}", at)
                end = len(page) if end < 0 else end
                if end > at:
                    owns[i].append(references.unescape(page[at:end]) if tag in ("title", "textarea") else page[at:end])
                stops[i], ends[i] = end, mark(end)
                at = (page.find(">", end) + 1 or len(page)) if end < len(page) else end
                continue
            if tag in _SHIELDS:
                shields.append(len(stack))
            opened.setdefault(tag, []).append(len(stack))
            stack.append(i)
        close(0, len(page))
        self.pages.append(len(tags))
        self.chunks.append([page[a:b] for a, b in zip(places, places[1:])])


def _scan_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Scans run by run of ``SCAN_CHARS``, so that the elements held do not grow with the batch."""
    for batch in batches:
        run, size = _Elements(), 0
        for page in batch:
            text = page.as_py()
            run.scan(text)
            size += len(text or "")
            if size >= SCAN_CHARS:
                yield run.array()
                run, size = _Elements(), 0
        if len(run.pages) > 1 or not len(batch):
            yield run.array()


def elements(doc: Column) -> Column:
    """``SCANNED`` of a page without code; a null page has no elements."""
    # Not deterministic for the planner: a filter pushed below would scan every page twice.
    return F.arrow_udf(_scan_all, SCANNED).asNondeterministic()(doc)


def inner_html(chunks: Column, e: Column) -> Column:
    """The element's content as it stands in the page."""
    return F.array_join(F.slice(chunks, e["c1"] + 1, e["c2"] - e["c1"]), "")


def outer_html(chunks: Column, e: Column) -> Column:
    """The element from its open tag up to (not including) its closing tag."""
    return F.array_join(F.slice(chunks, e["c0"] + 1, e["c2"] - e["c0"]), "")


def attribute(e: Column, name: str) -> Column:
    """Value of an attribute, empty if it is given without one; NULL when absent."""
    return F.try_element_at(e["attrs"], F.lit(name.lower()))


def has_attribute(e: Column, name: str) -> Column:
    return F.map_contains_key(e["attrs"], F.lit(name.lower()))
