"""Structural joins between elements of a page.

Elements are numbered in document order and know the number of the last element inside them, so what is inside an
element is a range of numbers. A step from some elements to those inside them is one merge of two sorted lists: an
element is inside one of the earlier ones if the furthest end among these reaches it."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The joins travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_REF = "array<struct<no:int,parent:int,last:int>>"


def _refs(found: Column) -> Column:
    """What a join needs of elements."""
    return F.transform(found, lambda e: F.struct(e["no"].alias("no"), e["parent"].alias("parent"), e["last"].alias("last")))


class _Lists:
    """A column of lists of (no, parent, last), as numbers with the offsets of its rows."""

    def __init__(self, column: pa.ListArray):
        self.offsets = column.offsets.to_numpy()
        fields = column.values.flatten()
        self.no, self.parent, self.last = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.offsets[i], self.offsets[i + 1]
        return self.no[a:b], self.parent[a:b], self.last[a:b]


def _step(axis: str, around: tuple[np.ndarray, ...], here: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of the elements ``here``, those inside some of ``around`` (``//``), or whose parent is one of them (``/``)."""
    if not len(around[0]):
        return tuple(part[:0] for part in here)
    if axis == "/":
        at = np.minimum(np.searchsorted(around[0], here[1]), len(around[0]) - 1)
        kept = around[0][at] == here[1]
    else:
        before = np.searchsorted(around[0], here[0]) - 1
        kept = (before >= 0) & (np.maximum.accumulate(around[2])[before] >= here[0])
    return tuple(part[kept] for part in here)


def _within(outer: tuple[int, int], axes: Sequence[str], steps: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Numbers of the elements that the steps lead to from the element (no, last) ``outer``."""
    now = (np.array([outer[0]]), np.array([-2]), np.array([outer[1]]))
    for axis, (no, parent, last) in zip(axes, steps):
        a, b = np.searchsorted(no, outer[0], "right"), np.searchsorted(no, outer[1], "right")
        now = _step(axis, now, (no[a:b], parent[a:b], last[a:b]))
    return now[0]


_PAGE = (-1, 1 << 40)


def path_numbers(axes: Sequence[str], steps: Sequence[Column]) -> Column:
    """ARRAY<INT>: the numbers of the elements that lead through the steps, from the page on; every step is the
    elements that pass its test."""
    axes = list(axes)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            lists = [_Lists(c) for c in columns]
            found = [_within(_PAGE, axes, [x.row(i) for x in lists]) for i in range(len(columns[0]))]
            yield pa.array(found, pa.list_(pa.int32()))

    return _iterated(run, len(steps), "array<int>")(*map(_refs, steps))


def path_places(paths: Sequence[tuple[Sequence[str], Sequence[Column]]]) -> Column:
    """ARRAY<ARRAY<INT>>: for several paths the places, in the list of the last step, of the elements that lead through
    the steps. Pages wait for what a function gives back, so one function for all paths keeps them once and not once a path."""
    shapes = [list(axes) for axes, _ in paths]
    columns = [column for _, steps in paths for column in steps]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            lists = [_Lists(c) for c in batch]
            found = []
            for i in range(len(batch[0])):
                rows = iter([x.row(i) for x in lists])
                of_page = []
                for axes in shapes:
                    steps = [next(rows) for _ in axes]
                    of_page.append(np.searchsorted(steps[-1][0], _within(_PAGE, axes, steps)))
                found.append(of_page)
            yield pa.array(found, pa.list_(pa.list_(pa.int32())))

    return _iterated(run, len(columns), "array<array<int>>")(*map(_refs, columns))


def firsts_inside_each(outers: Column, paths: Sequence[tuple[Sequence[str], Sequence[Column]]]) -> Column:
    """ARRAY<ARRAY<INT>>: for each path and each of ``outers`` the number of the first element that the path leads to
    from it, -1 if there is none; one function for all paths, as in ``path_places``."""
    shapes = [list(axes) for axes, _ in paths]
    columns = [outers, *[column for _, steps in paths for column in steps]]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            outer, *lists = [_Lists(c) for c in batch]
            found = []
            for i in range(len(batch[0])):
                rows = iter([x.row(i) for x in lists])
                no, _, last = outer.row(i)
                pairs = list(zip(no.tolist(), last.tolist()))
                of_page = []
                for axes in shapes:
                    steps = [next(rows) for _ in axes]
                    each = [_within(pair, axes, steps) for pair in pairs]
                    of_page.append([int(x[0]) if len(x) else -1 for x in each])
                found.append(of_page)
            yield pa.array(found, pa.list_(pa.list_(pa.int32())))

    return _iterated(run, len(columns), "array<array<int>>")(*map(_refs, columns))


def inside_each(outers: Column, axes: Sequence[str], steps: Sequence[Column], first: bool = False) -> Column:
    """ARRAY<ARRAY<INT>>: for each of ``outers``, the numbers of the elements that the steps lead to from it. With
    ``first``, ARRAY<INT>: only the first one of each, -1 if there is none."""
    axes = list(axes)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            outer, *lists = [_Lists(c) for c in columns]
            found = []
            for i in range(len(columns[0])):
                rows = [x.row(i) for x in lists]
                no, _, last = outer.row(i)
                each = [_within(pair, axes, rows) for pair in zip(no.tolist(), last.tolist())]
                found.append([int(x[0]) if len(x) else -1 for x in each] if first else each)
            yield pa.array(found, pa.list_(pa.int32() if first else pa.list_(pa.int32())))

    return _iterated(run, len(steps) + 1, "array<int>" if first else "array<array<int>>")(*map(_refs, [outers, *steps]))


def ranks(found: Column) -> Column:
    """ARRAY<INT>: for each of the elements found, how many of them its parent has up to it."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            lists = _Lists(column)
            out = []
            for i in range(len(column)):
                parent = lists.row(i)[1]
                order = np.argsort(parent, kind="stable")
                starts = np.searchsorted(parent[order], parent[order])
                rank = np.empty(len(parent), np.int32)
                rank[order] = np.arange(len(parent)) - starts + 1
                out.append(rank)
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>").asNondeterministic()(_refs(found))


def table_cells(
    tables: Column, heads: Column, bodies: Column, rows: Column, firsts: Column, cells: Column, header_cells: Column
) -> Column:
    """ARRAY<STRUCT<headers ARRAY<INT>, rows ARRAY<ARRAY<INT>>>>: for each table the numbers of its header cells and
    of the cells of its data rows, in document order. Header cells are those named so in a head and all of a row that
    is the first of its parent; data rows are those in a body and those that are not the first of their parent."""
    kind = "array<struct<headers:array<int>,rows:array<array<int>>>>"
    arrow = pa.list_(pa.struct([("headers", pa.list_(pa.int32())), ("rows", pa.list_(pa.list_(pa.int32())))]))

    def one(outer: tuple[int, int], parts: list[tuple[np.ndarray, ...]]) -> dict:
        head, body, row, first, cell, header = parts
        titles = [_within(outer, ["//", "//"], [head, header]), _within(outer, ["//", "//"], [first, cell])]
        inner = _within(outer, ["//"], [row])
        data = np.union1d(np.setdiff1d(inner, first[0]), _within(outer, ["//", "//"], [body, row]))
        place = np.searchsorted(row[0], data)
        spans = zip(row[0][place].tolist(), row[2][place].tolist())
        return {
            "headers": np.union1d(*titles),
            "rows": [cell[0][np.searchsorted(cell[0], a, "right") : np.searchsorted(cell[0], b, "right")] for a, b in spans],
        }

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            outer, *lists = [_Lists(c) for c in columns]
            found = []
            for i in range(len(columns[0])):
                parts = [x.row(i) for x in lists]
                no, _, last = outer.row(i)
                found.append([one(pair, parts) for pair in zip(no.tolist(), last.tolist())])
            yield pa.array(found, arrow)

    return _iterated(run, 7, kind)(*map(_refs, [tables, heads, bodies, rows, firsts, cells, header_cells]))


def _iterated(run, columns: int, kind: str):
    """An Arrow function over batches of so many columns."""
    if columns == 1:

        def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(batches)

        return F.arrow_udf(single, kind).asNondeterministic()

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(several, kind).asNondeterministic()
