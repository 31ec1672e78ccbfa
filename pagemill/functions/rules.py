"""Extraction rules: a subset of path selectors as columns over the elements of a page.

Supported: ``//tag`` and ``//*`` steps, ``/`` for children, the conditions ``[@a]``, ``[@a="v"]``,
``[contains(@a, "v")]``, ``[contains(text(), "v")]``, ``or`` between them, ``[n]`` (the n-th in its parent of
those that pass the conditions before it), the tails ``/text()``, ``//text()``, ``/@a`` and
``/following-sibling::*/text()``, and unions with ``|``. ``text()`` inside a condition is the first text node
outside child elements. Results are in document order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.elements import ELEMENT, attribute, elements, has_attribute, inner_html, outer_html
from pagemill.functions.html import without_code
from pagemill.functions.structure import firsts_inside_each, inside_each, path_numbers, path_places, ranks
from pagemill.functions.text import let, text_content, text_nodes

_STEP = re.compile(r"(//?)(\*|[a-z][a-z0-9]*)((?:\[[^\]]*\])*)")
_TAILS = {
    "/following-sibling::*/text()": "siblings",
    "//text()": "texts",
    "/text()": "own",
}


class Page(NamedTuple):
    """The page without code, its elements, the chunks it is cut into, and by path the elements that it leads to, where
    these are known (see ``with_paths``)."""

    doc: Column
    all: Column
    chunks: Column
    paths: Mapping[str, Column] = {}

    def at(self, numbers: Column) -> Column:
        """The elements with these numbers."""
        return _at(self.all, numbers)


def staged(pages, *more: str | Column):
    """``pages`` with ``_doc``, ``_all`` and ``_chunks``, and the ``Page`` over them."""
    code_free = pages.select(*more, without_code(F.col("html")).alias("_doc"))
    scanned = code_free.withColumn("_scan", elements(F.col("_doc")))
    rows = scanned.withColumns({"_all": F.col("_scan.all"), "_chunks": F.col("_scan.chunks")}).drop("_scan")
    return rows, Page(F.col("_doc"), F.col("_all"), F.col("_chunks"))


def _condition(text: str):
    """Column test of one condition."""
    found = re.fullmatch(r'contains\(\s*@([\w-]+)\s*,\s*["\'](.*)["\']\s*\)', text)
    if found:
        name, value = found.groups()
        return lambda e: F.contains(F.coalesce(attribute(e, name), F.lit("")), F.lit(value))
    found = re.fullmatch(r'contains\(\s*text\(\)\s*,\s*["\'](.*)["\']\s*\)', text)
    if found:
        value = found.group(1)
        return lambda e: F.contains(F.coalesce(F.get(e["own"], F.lit(0)), F.lit("")), F.lit(value))
    found = re.fullmatch(r'@([\w-]+)\s*=\s*["\'](.*)["\']', text)
    if found:
        name, value = found.groups()
        return lambda e: F.coalesce(attribute(e, name) == value, F.lit(False))
    found = re.fullmatch(r"@([\w-]+)", text)
    if found:
        name = found.group(1)
        return lambda e: has_attribute(e, name)
    raise ValueError(f"condition not supported: {text}")


def _passes(e: Column, tag: str, groups: list) -> Column:
    ok = F.lit(True) if tag == "*" else e["tag"] == tag
    for group in groups:
        any_of = F.lit(False)
        for test in group:
            any_of = any_of | test(e)
        ok = ok & any_of
    return ok


def _placed(found: Column, n: int) -> Column:
    """Of the elements found, the n-th of every parent."""
    ranked = F.zip_with(found, ranks(found), lambda e, r: F.struct(e.alias("e"), r.alias("r")))
    return F.transform(F.filter(ranked, lambda x: x["r"] == n), lambda x: x["e"])


def _step(found: Column, tag: str, conditions: list[str]) -> Column:
    """Elements that pass a step's tag and conditions, in the order these are written."""
    groups: list = []
    first = True
    for text in conditions:
        if not text.strip().isdigit():
            groups.append([_condition(part.strip()) for part in re.split(r"\s+or\s+", text)])
            first = False
            continue
        n, now = int(text), groups
        if first:
            place = "nth_any" if tag == "*" else "nth"
            found = F.filter(found, lambda e: _passes(e, tag, []) & (e[place] == n))
        else:
            found = _placed(F.filter(found, lambda e: _passes(e, tag, now)), n)
        groups, first = [], False
    return F.filter(found, lambda e: _passes(e, tag, groups))


def _parse(rule: str):
    """(steps, tail, attribute) of a rule; a step is (axis, tag, conditions)."""
    tail, name, path = None, None, rule
    for ending, kind in _TAILS.items():
        if path.endswith(ending):
            path, tail = path[: -len(ending)], kind
            break
    found = re.search(r"/@([\w-]+)$", path)
    if found:
        path, name = path[: found.start()], found.group(1)
    path = path.removeprefix(".")
    if not path or "".join(m.group(0) for m in _STEP.finditer(path)) != path:
        raise ValueError(f"rule not supported: {rule}")
    return [(axis, tag, re.findall(r"\[([^\]]*)\]", tests)) for axis, tag, tests in _STEP.findall(path)], tail, name


def _step_lists(page: Page, steps: list) -> tuple[list[str], list[Column]]:
    """The axes of a rule's steps, and the elements of the page that pass each step's tests."""
    return [axis for axis, _, _ in steps], [_step(page.all, tag, conditions) for _, tag, conditions in steps]


def _found(page: Page, steps: list) -> Column:
    """The elements that the steps of a rule lead to, each once, in document order."""
    known = page.paths.get(repr(steps))
    if known is not None:
        return known
    axes, lists = _step_lists(page, steps)
    if len(steps) > 1:
        return page.at(path_numbers(axes, lists))
    return F.filter(lists[0], lambda e: e["parent"] == -1) if axes[0] == "/" else lists[0]


def _parts(rule: str) -> list[tuple]:
    return [_parse(part.strip()) for part in re.split(r"\s\|\s", rule)]


def has_path(rule: str) -> bool:
    """Whether a rule has a path of several steps."""
    return any(len(steps) > 1 for steps, _, _ in _parts(rule))


def _fields(e: Column, names: Iterable[str]) -> Column:
    return F.struct(*[e[name].alias(name) for name in names])


def with_paths(rows: DataFrame, page: Page, rules: Iterable[str], *keep: str | Column, kind: str = "text") -> tuple[DataFrame, Page]:
    """The columns ``keep`` of ``rows``, and a page to read these rules from, as ``kind``.

    Rows wait for the function that follows paths of several steps, by thousands and on disk if memory is short. So they
    keep of the elements only those that a path may end at, with what is read of them, and the chunks if a rule reads these."""
    parts = [part for rule in rules for part in _parts(rule)]
    paths = {repr(steps): steps for steps, _, _ in parts}
    fields = ["no", "parent", "last", "c0", "c1", "c2"]
    fields += ["attrs"] * (kind == "all" or any(name for _, _, name in parts)) + ["own"] * any(tail == "own" for _, tail, _ in parts)
    ends, known, joined = [], {}, []
    for i, (path, steps) in enumerate(paths.items()):
        axes, lists = _step_lists(page, steps)
        last = _found(page, steps) if len(steps) == 1 else lists[-1]
        ends.append(F.transform(last, lambda e: _fields(e, fields)).alias(f"_end{i}"))
        known[path] = F.col(f"_end{i}")
        if len(steps) > 1:
            steps_before = [f"_step{i}_{k}" for k in range(len(axes) - 1)]
            ends += [F.transform(x, lambda e: _fields(e, fields[:3])).alias(s) for s, x in zip(steps_before, lists)]
            joined.append((path, axes, [*map(F.col, steps_before), known[path]]))
    around = F.transform(page.all, lambda e: _fields(e, ["no", "parent", "own"])).alias("_all")
    rows = rows.select(*keep, *ends, around, page.chunks.alias("_chunks"))
    if joined:
        rows = rows.withColumn("_places", path_places([(axes, lists) for _, axes, lists in joined]))
    for n, (path, _, _) in enumerate(joined):
        known[path] = _at(known[path], F.get(F.col("_places"), F.lit(n)))
    return rows, Page(F.lit(None).cast("string"), F.col("_all"), F.col("_chunks"), known)


def _at(found: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(found, i))


def _in_order(lists: list[Column]) -> Column:
    """The elements of several lists, each once, in document order."""
    return let(
        F.flatten(F.array(*lists)),
        lambda flat: let(
            F.array_sort(F.transform(flat, lambda e, i: F.struct(e["no"].alias("no"), i.alias("i")))),
            lambda placed: F.transform(
                F.filter(placed, lambda x, k: (k == 0) | (x["no"] != F.get(placed, k - 1)["no"])), lambda x: F.get(flat, x["i"])
            ),
        ),
    )


def firsts_inside(page: Page, outers: Column, rules: Iterable[str]) -> Column:
    """ARRAY<ARRAY<INT>>: for each rule, a path without a tail, and each of the elements ``outers`` the number of the
    first element that the rule finds inside it, -1 without one."""
    parsed = [_parse(rule) for rule in rules]
    if any(tail or name for _, tail, name in parsed):
        raise ValueError("a rule names no elements")
    return firsts_inside_each(outers, [_step_lists(page, steps) for steps, _, _ in parsed])


def numbers_inside(page: Page, outers: Column, rule: str, first: bool = False) -> Column:
    """For each of the elements ``outers``, the numbers of the elements that a rule without a tail finds inside it;
    with ``first``, only the first one's, -1 without one. Parts of a union are put in document order."""
    each = []
    for part in re.split(r"\s\|\s", rule):
        steps, tail, name = _parse(part.strip())
        if tail or name:
            raise ValueError(f"rule names no elements: {rule}")
        each.append(inside_each(outers, *_step_lists(page, steps), first=first and "|" not in rule))
    if len(each) == 1:
        return each[0]
    both = each[0]
    for more in each[1:]:
        both = F.zip_with(both, more, lambda x, y: F.array_sort(F.array_union(x, y)))
    return F.transform(both, lambda numbers: F.coalesce(F.get(numbers, F.lit(0)), F.lit(-1))) if first else both


def _attributes(found: Column, name: str) -> Column:
    return F.filter(F.transform(found, lambda e: attribute(e, name)), lambda v: v.isNotNull())


def select_elements(page: Page, rule: str) -> Column:
    """The elements of a rule without a tail, those of a union in document order."""
    parts = [_parse(part.strip()) for part in re.split(r"\s\|\s", rule)]
    if any(tail or name for _, tail, name in parts):
        raise ValueError(f"rule names no elements: {rule}")
    if len(parts) == 1:
        return _found(page, parts[0][0])
    if page.paths:
        return _in_order([_found(page, steps) for steps, _, _ in parts])
    places = F.flatten(F.array(*[F.transform(_found(page, steps), lambda e: e["no"]) for steps, _, _ in parts]))
    return page.at(F.array_sort(F.array_distinct(places)))


def _siblings(page: Page, e: Column) -> Column:
    after = F.filter(page.all, lambda x: (x["parent"] == e["parent"]) & (x["no"] > e["no"]))
    return F.flatten(F.transform(after, lambda x: x["own"]))


def _texts(page: Page, e: Column) -> Column:
    return text_nodes(inner_html(page.chunks, e))


def element_value(page: Page, e: Column, kind: str) -> Column:
    """``text`` (trimmed) or ``html`` of an element."""
    return outer_html(page.chunks, e) if kind == "html" else text_content(inner_html(page.chunks, e))


def select(page: Page, rule: str, kind: str = "text") -> Column:
    """ARRAY<STRING> of what a rule finds, in document order. The parts of a union that end in texts or
    attributes follow one another. ``kind`` is ``text`` or ``html`` of elements found."""
    parts = [part.strip() for part in re.split(r"\s\|\s", rule)]
    parsed = [_parse(part) for part in parts]
    if not any(tail or name for _, tail, name in parsed):
        return F.transform(select_elements(page, rule), lambda e: element_value(page, e, kind))
    values = []
    for steps, tail, name in parsed:
        found = _found(page, steps)
        if name:
            values.append(_attributes(found, name))
        elif tail == "own":
            values.append(F.flatten(F.transform(found, lambda e: e["own"])))
        elif tail == "texts":
            values.append(F.flatten(F.transform(found, lambda e: _texts(page, e))))
        elif tail == "siblings":
            values.append(F.flatten(F.transform(found, lambda e: _siblings(page, e))))
        else:
            values.append(F.transform(found, lambda e: element_value(page, e, kind)))
    return values[0] if len(values) == 1 else F.concat(*values)


def select_all(page: Page, rule: str) -> Column:
    """ARRAY<STRUCT<text, html, attributes>> of what a rule finds; a text or an attribute has no attributes."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    if any(tail or name for _, tail, name in map(_parse, (p.strip() for p in re.split(r"\s\|\s", rule)))):
        return F.transform(
            select(page, rule), lambda v: F.struct(v.alias("text"), v.alias("html"), none.alias("attributes"))
        )
    return F.transform(
        select_elements(page, rule),
        lambda e: F.struct(
            element_value(page, e, "text").alias("text"),
            outer_html(page.chunks, e).alias("html"),
            e["attrs"].alias("attributes"),
        ),
    )


def first(values: Column, default: str | None = None) -> Column:
    """First value of a rule, else the default."""
    return F.when(F.size(values) > 0, values.getItem(0)).otherwise(F.lit(default))


def no_elements() -> Column:
    return F.array().cast(f"array<{ELEMENT}>")


def css_rule(selector: str) -> str:
    """The path rule for a simple CSS selector; ``>`` is a child."""
    steps = []
    for child, part in re.findall(r"(>?)\s*([^\s>]+)", selector.strip()):
        tag = re.match(r"[a-zA-Z*][a-zA-Z0-9]*", part)
        rest = part[tag.end() :] if tag else part
        rest = re.sub(r"#([\w-]+)", r'[@id="\1"]', rest)
        rest = re.sub(r"\.([\w-]+)", r'[contains(@class, "\1")]', rest)
        steps.append(f"{'/' if child and steps else '//'}{tag.group(0).lower() if tag else '*'}{rest}")
    return "".join(steps)


# Rules for academic pages.
ACADEMIC_RULES = {
    "course_title": '//h1[@class="course-title"] | //h1 | //title',
    "instructor": '//*[contains(@class, "instructor")] | //*[contains(text(), "Professor")]',
    "schedule": '//*[contains(@class, "schedule")] | //*[contains(text(), "Schedule")]',
    "prerequisites": '//*[contains(text(), "Prerequisites")] | //*[contains(@class, "prereq")]',
    "textbooks": '//*[contains(text(), "Textbook")] | //*[contains(@class, "textbook")]',
    "grading": '//*[contains(text(), "Grading")] | //*[contains(@class, "grading")]',
    "office_hours": '//*[contains(text(), "Office Hours")] | //*[contains(@class, "office")]',
    "assignments": '//a[contains(@href, "assignment") or contains(@href, "homework")]',
}

# Links to course materials.
MATERIAL_RULES = {
    "pdf_links": '//a[contains(@href, ".pdf")]',
    "doc_links": '//a[contains(@href, ".doc") or contains(@href, ".docx")]',
    "ppt_links": '//a[contains(@href, ".ppt") or contains(@href, ".pptx")]',
    "video_links": '//a[contains(@href, ".mp4") or contains(@href, ".avi")]',
    "download_links": '//a[@download or contains(@class, "download")]',
}

# Where a course page tells its name, instructor, semester, description.
NAME_RULES = [
    '//h1[@class="course-title"]/text()',
    '//h1[@class="course-name"]/text()',
    '//div[@class="course-header"]//h1/text()',
    "//title/text()",
    "//h1/text()",
    '//meta[@property="og:title"]/@content',
]
INSTRUCTOR_RULES = [
    '//span[@class="instructor"]/text()',
    '//div[@class="instructor-name"]/text()',
    '//*[contains(@class, "instructor")]//text()',
    '//*[contains(text(), "Instructor:")]/following-sibling::*/text()',
    '//*[contains(text(), "Professor:")]/following-sibling::*/text()',
]
SEMESTER_RULES = [
    '//span[@class="semester"]/text()',
    '//div[@class="term"]/text()',
    '//*[contains(@class, "semester")]//text()',
    '//*[contains(@class, "term")]//text()',
    '//*[contains(text(), "Semester:")]/following-sibling::*/text()',
    '//*[contains(text(), "Term:")]/following-sibling::*/text()',
]
DESCRIPTION_RULES = [
    '//div[@class="course-description"]/text()',
    '//p[@class="description"]/text()',
    '//meta[@name="description"]/@content',
    '//meta[@property="og:description"]/@content',
    '//*[contains(@class, "description")]//text()',
]

# Containers of a course in a catalog, tried in this order.
CATALOG_RULES = [
    '//div[@class="course-item"]',
    '//li[@class="course"]',
    '//tr[@class="course-row"]',
    '//article[@class="course"]',
    '//*[contains(@class, "course-card")]',
    '//*[contains(@class, "course-listing")]',
]
