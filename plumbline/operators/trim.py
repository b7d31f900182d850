"""Content boxes of page rasters.

Pixels come as PNGs (``trim_png``) or as bytes of one grey (or several interleaved)
channels (``trim``).  A probe of
at most ``probe`` pixels is taken by block means, rows then columns with enough
ink bound the content.  Batches of rasters go through numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions import png


@dataclass(frozen=True)
class Trim:
    """Fixed values of the defaults."""

    probe: int = 800
    noise: int = 6
    min_ink: int = 1
    min_run: int = 2
    pad: int = 0
    min_side: int = 96


def content_box(pixels: np.ndarray, t: Trim) -> tuple[tuple[int, int, int, int], dict]:
    """Box of what is drawn on a height x width (x channels) array; the whole page if nothing is.

    The darkest channel of the corner is the background.  A row counts its dark
    channel values, a column its pixels with one.
    """
    height, width = pixels.shape[:2]
    factor, small = 1, pixels.reshape(height, width, -1)
    if width > t.probe:
        small = small.astype(np.float32)
    while small.shape[1] > t.probe and min(small.shape[:2]) > 1:
        h, w = small.shape[0] // 2 * 2, small.shape[1] // 2 * 2
        small = small[:h, :w].reshape(h // 2, 2, w // 2, 2, -1).mean(axis=(1, 3))
        factor *= 2
    background = float(small[0, 0].min())
    limit = background - t.noise
    if small.dtype == np.uint8:  # bytes are compared as bytes
        limit = np.uint8(min(max(np.ceil(limit), 0), 255))
    ink = small < limit
    flat = ink.reshape(len(ink), -1)
    rows = np.flatnonzero(flat.any(1) if t.min_ink == 1 else flat.sum(axis=1) >= t.min_ink)
    found = {"background": int(background), "factor": factor, "empty": not len(rows)}
    if not len(rows):
        return (0, 0, width, height), found
    y0, y1 = int(rows[0]), int(rows[-1]) + 1
    held = flat[y0:y1].any(0) if t.min_ink == 1 else ink[y0:y1].any(axis=2).sum(axis=0)
    cols = np.flatnonzero(held.reshape(ink.shape[1], -1).any(1) if t.min_ink == 1 else held >= t.min_ink)
    x0, x1 = (int(cols[0]), int(cols[-1]) + 1) if len(cols) else (0, ink.shape[1])
    wider = t.min_run - 1
    box = ((x0 - wider) * factor, (y0 - wider) * factor, (x1 + wider) * factor, (y1 + wider) * factor)
    return (max(0, box[0]), max(0, box[1]), min(width, box[2]), min(height, box[3])), found


def expand(box: tuple[int, int, int, int], t: Trim, width: int, height: int) -> tuple[int, int, int, int]:
    x0, y0, x1, y1 = max(0, box[0] - t.pad), max(0, box[1] - t.pad), min(width, box[2] + t.pad), min(height, box[3] + t.pad)
    return (x0, y0, x1, y1) if x1 - x0 >= t.min_side and y1 - y0 >= t.min_side else (0, 0, width, height)


def trim_png(pictures: DataFrame, key: list[str], t: Trim = Trim(), data: str = "data", cut: bool = True, more: Callable[[np.ndarray], tuple] | None = None, added: str = "") -> DataFrame:
    """(key, trimmed, box, background, factor, empty, skipped, area_ratio, error) of PNGs: what ``trim`` gives, and the cut picture.

    A picture that stays whole keeps its bytes; one that can't be decoded gives an error;
    null gives neither.  A task holds one decoded picture at a time.  Without ``cut`` only the
    facts are found and ``trimmed`` is null.  ``more`` gives further values, the columns
    ``added``, of the decoded pixels.
    """
    fields = {f.name: f.dataType.simpleString() for f in pictures.schema.fields}
    schema = StructType.fromDDL(", ".join([*(f"{c} {fields[c]}" for c in key), "trimmed binary, x0 int, y0 int, x1 int, y1 int, background int, factor int, empty boolean, skipped boolean, area_ratio double, error string", *[added] * bool(added)]))
    further = [f.name for f in StructType.fromDDL(added).fields] if added else []
    arrow = to_arrow_schema(schema)

    def facts(raw: bytes | None) -> dict:
        if raw is None:
            return {}
        try:
            pixels = png.decode(raw)
        except png.PngError as e:
            return {"error": str(e)}
        height, width = pixels.shape[:2]
        box, found = content_box(pixels, t)
        x0, y0, x1, y1 = expand(box, t, width, height)
        whole = (x0, y0, x1, y1) == (0, 0, width, height)
        also = dict(zip(further, more(pixels))) if more else {}
        return also | {"trimmed": None if not cut else raw if whole else png.encode(pixels[y0:y1, x0:x1]), "x0": x0, "y0": y0, "x1": x1, "y1": y1, **found, "skipped": whole, "area_ratio": (x1 - x0) * (y1 - y0) / (width * height)}

    known = png.Known()  # equal pictures are looked at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for own, raw in zip(zip(*(batch.column(k).to_pylist() for k in range(len(key)))), batch.column(len(key))):
                raw = raw.as_py()
                found = known.get((raw,))
                if found is None:
                    found = known[raw,] = facts(raw)
                made.append(dict(zip(key, own)) | found)
                size += len(made[-1].get("trimmed") or b"")
                if size > png.HELD:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return pictures.select(*key, data).mapInArrow(run, schema)


def trim(rasters: DataFrame, key: list[str], t: Trim = Trim()) -> DataFrame:
    """(key, x0, y0, x1, y1, background, factor, empty, skipped, area_ratio) of rasters (key, width, height, pixels).

    ``skipped``: the page stays whole, as nothing is drawn, too little or all of it.
    """
    fields = {f.name: f.dataType.simpleString() for f in rasters.schema.fields}
    schema = ", ".join([*(f"{c} {fields[c]}" for c in key), "x0 int, y0 int, x1 int, y1 int, background int, factor int, empty boolean, skipped boolean, area_ratio double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                flat = np.frombuffer(r["pixels"], np.uint8)
                channels = len(flat) // (r["width"] * r["height"])
                box, found = content_box(flat.reshape(r["height"], r["width"], channels), t)
                x0, y0, x1, y1 = expand(box, t, r["width"], r["height"])
                out.append({**{c: r[c] for c in key}, "x0": x0, "y0": y0, "x1": x1, "y1": y1, **found, "skipped": (x0, y0, x1, y1) == (0, 0, r["width"], r["height"]), "area_ratio": (x1 - x0) * (y1 - y0) / (r["width"] * r["height"])})
            yield pd.DataFrame(out, columns=[*key, "x0", "y0", "x1", "y1", "background", "factor", "empty", "skipped", "area_ratio"])

    return rasters.select(*key, "width", "height", "pixels").mapInPandas(run, schema)
