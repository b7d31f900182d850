"""Strokes with arrow tips at their ends, in numpy, for many sheets at once.

Rows of paths come sheet by sheet, the first with the sheet's limits; blocks of whole
sheets become flat arrays of strokes and tips.  Strokes meet the tips of their own
sheet only, ``PAIRS`` at a time.  A stroke without finite ends has no arrows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pairs of a stroke and a tip, or of a leader and a span, that are looked at together.
PAIRS = 1 << 19
LIMITS = ["width", "width_tol", "min_length", "leader_min_length", "arrow_gap", "leader_anchor_gap", "arrow_max_area"]


def floats(column: pa.Array) -> np.ndarray:
    """Numbers as doubles, null as not a number."""
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where rows begin whose first ``keys`` columns differ from those of the row before; the first row is one."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in batch.columns[:keys]:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut and joined so that each group is in one, and where its groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(_starts(batch, keys)[-1])
        if held and not cut:
            last = held[-1]
            if all(batch.column(k)[0].as_py() == last.column(k)[-1].as_py() for k in range(keys)):
                held.append(batch)
                continue
        if held or cut:
            made = pa.concat_batches([*held, batch.slice(0, cut)])
            yield made, _starts(made, keys)
        held = [batch.slice(cut)]
    if held:
        made = pa.concat_batches(held)
        yield made, _starts(made, keys)


def strokes(items: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its row, ends ax, ay, bx, by) of the strokes of rows of items: lines, and four sides of a rectangle."""
    flat, parent = items.flatten(), pc.list_parent_indices(items).to_numpy()
    fields = dict(zip((f.name for f in flat.type), flat.flatten()))
    kind = lambda k: pc.equal(fields["kind"], k).fill_null(False).to_numpy(zero_copy_only=False)
    line = kind("l")
    n = np.where(line, 1, np.where(kind("re"), 4, 0))
    item = np.repeat(np.arange(len(n)), n)
    side = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    x0, y0, x1, y1 = (floats(fields[c])[item] for c in ("x0", "y0", "x1", "y1"))
    line, mid = line[item], (side == 1) | (side == 2)
    ends = np.stack([np.where(mid, x1, x0), np.where(side >= 2, y1, y0), np.where(line | (side < 2), x1, x0), np.where(line | mid, y1, y0)], axis=1)
    row = parent[item]
    return row, np.arange(len(row)) - np.searchsorted(row, row), ends


def tips(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of paths of three strokes (n x 3 x 4): which are triangles, their areas, and the corner (x, y) farthest from the other two."""
    ax, ay, bx, by = np.moveaxis(ends, 2, 0)
    cross = ax * by - bx * ay
    area = np.abs((cross[:, 0] + cross[:, 1] + cross[:, 2]) / 2)
    points = np.concatenate([ends[:, :, :2], ends[:, :, 2:]], axis=1)
    new = np.stack([~np.any([(points[:, j] == points[:, i]).all(1) for i in range(j)], axis=0) if j else np.ones(len(points), bool) for j in range(6)], axis=1)
    three = new.sum(1) == 3
    c = np.take_along_axis(points, np.argsort(~new, axis=1, kind="stable")[:, :3, None], axis=1)
    far = np.stack([sum(np.hypot(c[:, j, 0] - c[:, i, 0], c[:, j, 1] - c[:, i, 1]) for j in range(3)) for i in range(3)], axis=1)
    place = np.arange(len(c))
    best = np.zeros(len(c), np.int64)
    for i in (1, 2):  # equal corners go by place
        d, e = far[place, best], far[:, i]
        p, q = c[place, best], c[:, i]
        best[(e > d) | (e == d) & ((q[:, 0] < p[:, 0]) | (q[:, 0] == p[:, 0]) & (q[:, 1] < p[:, 1]))] = i
    return three, area, c[place, best]


def _pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, first[i] .. first[i] + count[i] - 1) in parts."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = count[at:end]
        i = np.repeat(np.arange(at, end), n)
        yield i, np.repeat(first[at:end] - (total[at:end] - n - done), n) + np.arange(len(i))
        at = end


def _found(batch: pa.RecordBatch, starts: np.ndarray, keys: int, path_type: pa.DataType) -> pa.RecordBatch | None:
    """A row for each sheet that has arrows, with their list."""
    col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    place, sheet = col["__n"].to_numpy(), np.repeat(np.arange(len(starts)), np.diff([*starts, batch.num_rows]))
    if ((sheet[1:] == sheet[:-1]) & (place[1:] < place[:-1])).any():  # a join may give a sheet's rows in any order
        return _found(batch.take(pa.array(np.lexsort((place, sheet)))), starts, keys, path_type)
    own = place == 1
    limit = np.full((len(LIMITS), len(starts)), np.nan)  # of sheets without limits nothing is found
    limit[:, sheet[own]] = floats(col["limits"].flatten()).reshape(-1, len(LIMITS)).T
    limit = dict(zip(LIMITS, limit))
    row, ord_, ends = strokes(col["items"])
    filled, of = col["filled"].fill_null(False).to_numpy(zero_copy_only=False), sheet[row]

    size = np.bincount(row, minlength=batch.num_rows)
    begin = (np.cumsum(size) - size)[filled & (size == 3)]
    three, area, tip = tips(ends[begin[:, None] + np.arange(3)])
    kept = three & (area <= limit["arrow_max_area"][of[begin]])
    tip = tip[kept]
    tip_count = np.bincount(of[begin][kept], minlength=len(starts))
    tip_first = np.cumsum(tip_count) - tip_count

    width = floats(col["stroke_width"])[row]
    length = np.hypot(ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1])
    least = np.minimum(limit["min_length"], limit["leader_min_length"])
    some = np.flatnonzero(~filled[row] & (np.abs(width - limit["width"][of]) <= limit["width_tol"][of]) & (length >= least[of]) & (tip_count[of] > 0))
    row, ord_, ends, of, width, length = (v[some] for v in (row, ord_, ends, of, width, length))
    gap = limit["arrow_gap"][of]
    at_a, at_b, only_a, only_b = np.zeros((4, len(of)), bool)
    for i, j in _pairs(tip_first[of], tip_count[of]):
        a, b = (np.hypot(tip[j, 0] - ends[i, k], tip[j, 1] - ends[i, k + 1]) <= gap[i] for k in (0, 2))
        at_a[i[a]], at_b[i[b]], only_a[i[a & ~b]], only_b[i[b & ~a]] = True, True, True, True
    span = (length >= limit["min_length"][of]) & at_a & at_b & only_a & only_b
    leader = ~span & (length >= limit["leader_min_length"][of]) & (at_a != at_b)
    order = np.flatnonzero(span | leader)
    order = order[np.lexsort((order, span[order], of[order]))]  # leaders, then spans, as they are drawn
    if not len(order):
        return None
    row, ord_, ends, of, width, length, span, at_a = (v[order] for v in (row, ord_, ends, of, width, length, span, at_a))
    back = ~span & ~at_a
    ends[back] = ends[back][:, [2, 3, 0, 1]]  # from tip to tail
    leaders, spans = (np.bincount(of[which], minlength=len(starts)) for which in (~span, span))
    both = leaders + spans
    first = np.cumsum(both) - both
    n = np.arange(len(of)) - first[of] - np.where(span, leaders[of], 0) + 1

    anchor = np.full(len(of), np.iinfo(np.int64).max)
    led = np.flatnonzero(~span)
    middle = (ends[:, :2] + ends[:, 2:]) / 2
    for i, j in _pairs((first + leaders)[of[led]], spans[of[led]]):
        near = np.hypot(middle[j, 0] - ends[led[i], 0], middle[j, 1] - ends[led[i], 1]) <= limit["leader_anchor_gap"][of[led[i]]]
        np.minimum.at(anchor, led[i[near]], n[j[near]])
    none = anchor == np.iinfo(np.int64).max
    values = {
        "kind": pa.array(np.where(span, "span", "leader"), pa.string()), "path_id": col["path_id"].take(pa.array(row)).cast(path_type), "ord": pa.array(ord_, pa.int32()), "n": pa.array(n, pa.int32()),
        **{c: pa.array(ends[:, k]) for k, c in enumerate(("ax", "ay", "bx", "by"))}, "length_pt": pa.array(length), "stroke_width": pa.array(width), "anchor": pa.array(np.where(none, 0, anchor), pa.int32(), mask=none),
    }
    has = np.flatnonzero(both)
    listed = pa.ListArray.from_arrays(pa.array([*first[has], len(of)], pa.int32()), pa.StructArray.from_arrays(list(values.values()), list(values)))
    at = pa.array(starts[has])
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:keys]), listed], [*batch.schema.names[:keys], "strokes"])


def arrowed(paths: DataFrame, limits: DataFrame, by: list[str], filled: Column) -> DataFrame:
    """(sheet, strokes): of each sheet its spans, strokes with an arrow of their own at both ends, and leaders, with one at exactly one end.

    A stroke has kind, path_id, ord, n (its number among those of its kind, as drawn), its
    ends (a leader goes from its tip to its tail), length_pt, stroke_width and anchor (of a
    leader the n of the first span in whose middle it points).  Leaders come first.
    ``limits`` has a row for each sheet.

    The window that numbers paths brings each sheet whole and sorted to one task, without a
    shuffle where its rows are there; a join with one row for each sheet leaves its rows
    together, whichever side it streams.
    """
    fields = {f.name: f.dataType.simpleString() for f in paths.schema.fields}
    drawn = paths.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("path_id")).alias("__n"), "path_id", filled.alias("filled"), F.coalesce(F.col("stroke_width").cast("double"), F.lit(0.0)).alias("stroke_width"), "items")
    rows = drawn.join(limits.select(*by, *LIMITS), by).select(*by, "__n", "path_id", "filled", "stroke_width", "items", F.when(F.col("__n") == 1, F.array(*LIMITS)).alias("limits"))
    schema = StructType.fromDDL(", ".join([*(f"`{c}` {fields[c]}" for c in by), f"strokes array<struct<kind:string,path_id:{fields['path_id']},ord:int,n:int,ax:double,ay:double,bx:double,by:double,length_pt:double,stroke_width:double,anchor:int>>"]))
    path_type, keys = to_arrow_schema(paths.select("path_id").schema).field(0).type, len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, keys):
            made = _found(batch, starts, keys, path_type)
            if made is not None:
                yield made

    return rows.mapInArrow(run, schema)
