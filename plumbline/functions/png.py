"""PNG in numpy: chunks, inflate, and the row filters undone along diagonals.

A pixel's predictors are its left, upper and upper-left neighbours, so all pixels of
one diagonal of a picture depend on the two diagonals before it.  Rows are skewed by
their number, which makes diagonals columns, and each is undone at once for all rows,
whatever filter each row has.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: its first bytes, channels by colour type, and the passes (x0, y0, dx, dy) of interlaced pictures.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


#: Bytes of encoded pictures that a task gathers before it hands them on.
HELD = 4 << 20


class Known(dict):
    """What was made of equal input, forgotten when keys and values (bytes) hold more than ``HELD``; kept within one task."""

    size = 0

    def __setitem__(self, key, value) -> None:
        own = 256 + sum(len(x) for x in (*key, *(value.values() if isinstance(value, dict) else (value,))) if isinstance(x, bytes))
        if own > HELD:
            return
        if self.size + own > HELD:
            self.clear()
            self.size = 0
        self.size += own
        super().__setitem__(key, value)


class PngError(ValueError):
    """Bytes that are no picture this codec reads."""


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(name, content) up to the end chunk, sums checked."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    found, at = [], 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        content = data[at + 8 : at + 8 + size]
        if len(content) < size or len(data) < at + 12 + size:
            break
        if zlib.crc32(name + content) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise PngError(f"the chunk {name!r} is damaged")
        found.append((name, content))
        if name == b"IEND":
            return found
        at += 12 + size
    raise PngError("the picture ends early")


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, upper and upper-left the nearest to a + b - c; ties in this order."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


#: Pixels of a row, channel by channel, that take as long as one diagonal, as a share of a row: rows are undone one by one where that is less work.
ROW_COST = 2


#: Pixels of a row that take as long as one stretch under equal ones.
STRETCH = 8


def _nearest(a: int, b: int, c: int) -> int:
    """``paeth`` of one byte."""
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _row(kind: int, rest: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One row (width x bytes of a pixel) of an average or Paeth filter.

    Under equal pixels Paeth takes the left one, so such stretches are sums.
    """
    out = np.empty_like(rest)
    if kind == 4:
        cuts = (np.flatnonzero((above[1:] != above[:-1]).any(1)) + 1).tolist()
        if (len(cuts) + 1) * STRETCH <= len(rest):
            out = np.cumsum(rest, axis=0, dtype=np.uint8)
            at, before = [0, *cuts], [x - 1 for x in cuts]
            gain, gains, none = [0] * rest.shape[1], [], [0] * rest.shape[1]
            for left, over, corner in zip([none, *out[before].tolist()], above[at].tolist(), [none, *above[before].tolist()]):
                gain = [(g + _nearest(a, b, c) - a) & 255 for g, a, b, c in zip(gain, [(x + g) & 255 for x, g in zip(left, gain)], over, corner)]
                gains.append(gain)
            for x, gain, end in zip(at, gains, [*cuts, len(rest)]):
                if any(gain):
                    out[x:end] += np.array(gain, np.uint8)
            return out
    for k in range(rest.shape[1]):
        a = c = 0
        line = []
        for x, b in zip(rest[:, k].tolist(), above[:, k].tolist()):
            if kind == 3:
                guess = (a + b) >> 1
            else:
                guess = _nearest(a, b, c)
            a, c = (x + guess) & 255, b
            line.append(a)
        out[:, k] = line
    return out


def _by_rows(kinds: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``unfilter`` by rows: those of the filter above are summed down in runs."""
    out = rest.copy()
    for i in np.flatnonzero(kinds == 1):
        np.cumsum(rest[i], axis=0, dtype=np.uint8, out=out[i])
    if kinds[0] > 2:
        out[0] = _row(int(kinds[0]), rest[0], np.zeros_like(rest[0]))
    cuts = [*(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    y = 0
    for end in cuts:
        if kinds[y] == 2:
            first = max(y, 1)
            if first < end:
                some = rest[first:end].any((1, 2))  # the others are equal to those above
                held = np.concatenate([out[first - 1 : first], rest[first:end][some]])
                out[first:end] = np.cumsum(held, axis=0, dtype=np.uint8)[np.cumsum(some)]
        elif kinds[y] > 2:
            for i in range(max(y, 1), end):
                out[i] = _row(int(kinds[i]), rest[i], out[i - 1])
        y = end
    return out


def unfilter(kinds: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Bytes of rows (height x width x bytes of a pixel) from their filters and what these left."""
    if len(kinds) and kinds.max() > 4:
        raise PngError(f"no such row filter: {kinds.max()}")
    height, width, size = rest.shape
    if not height or not width:
        return rest.copy()
    if kinds.max() <= 1:  # rows on their own: sums along them
        return np.where((kinds == 1)[:, None, None], np.cumsum(rest, axis=1, dtype=np.uint8), rest)
    hard = np.flatnonzero(kinds > 2)
    if len(hard) * size * ROW_COST <= width + height:  # few rows with an average or Paeth: those pixel by pixel, the rest in runs
        return _by_rows(kinds, rest)
    skewed = np.zeros((height, width + height, size), np.int16)
    skewed[:, :width] = rest
    skewed = skewed.reshape(-1, size)[: height * (width + height - 1)].reshape(height, width + height - 1, size).transpose(1, 0, 2).copy()
    kind = kinds.astype(np.int16)[:, None]
    has = [bool((kinds == k).any()) for k in range(5)]
    zero = np.zeros((height, size), np.int16)
    before, last = zero, zero  # the two diagonals before, by row
    up, corner = np.zeros((2, height, size), np.int16)
    for d in range(width + height - 1):
        first, end = max(0, d - width + 1), min(height, d + 1)
        up[1:], corner[1:] = last[:-1], before[:-1]
        rows = slice(first, end)
        a, b, c, k = last[rows], up[rows], corner[rows], kind[rows]
        guess = np.where(k == 1, a, 0)
        if has[2]:
            guess = np.where(k == 2, b, guess)
        if has[3]:
            guess = np.where(k == 3, (a + b) >> 1, guess)
        if has[4]:
            guess = np.where(k == 4, paeth(a, b, c), guess)
        now = np.zeros((height, size), np.int16)
        now[rows] = (skewed[d, rows] + guess) & 255
        skewed[d] = now
        before, last = last, now
    flat = np.zeros((height, width + height, size), np.uint8).reshape(-1, size)
    flat[: height * (width + height - 1)] = skewed.transpose(1, 0, 2).reshape(-1, size)
    return np.ascontiguousarray(flat.reshape(height, width + height, size)[:, :width])


def _samples(raw: bytes, at: int, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples (height x width x channels) of one pass, and where the next begins."""
    size = max(1, depth * channels // 8)
    line = (width * depth * channels + 7) // 8
    need = height * (line + 1)
    if len(raw) < at + need:
        raise PngError("too little picture data")
    rows = np.frombuffer(raw, np.uint8, need, at).reshape(height, line + 1)
    data = unfilter(rows[:, 0], rows[:, 1:].reshape(height, line // size, size)).reshape(height, line)
    if depth == 16:
        return data.reshape(height, width, channels, 2)[..., 0].copy(), at + need  # the high byte
    if depth < 8:
        bits = np.unpackbits(data, axis=1).reshape(height, -1, depth)[:, :width]
        return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[..., None], at + need
    return data.reshape(height, width, channels), at + need


def decode(data: bytes) -> np.ndarray:
    """Pixels as height x width x channels of bytes: grey, grey and alpha, RGB or RGBA.

    Palettes become RGB, or RGBA where a palette has transparent colours; samples of one
    to four bits are stretched, of sixteen cut to eight.  Interlaced pictures are read.
    """
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise PngError("no header")
    width, height, depth, kind, packing, filtering, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if not width or not height or kind not in CHANNELS or depth not in (1, 2, 4, 8, 16) or packing or filtering or interlace > 1 or depth < 8 and kind not in (0, 3) or depth == 16 and kind == 3:
        raise PngError("a header that no picture has")
    channels = CHANNELS[kind]
    try:
        raw = zlib.decompress(b"".join(c for n, c in parts if n == b"IDAT"))
    except zlib.error as e:
        raise PngError(f"picture data: {e}") from e
    if interlace:
        pixels, at = np.zeros((height, width, channels), np.uint8), 0
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                pixels[y::dy, x::dx], at = _samples(raw, at, w, h, depth, channels)
    else:
        pixels, _ = _samples(raw, 0, width, height, depth, channels)
    if kind == 3:
        palette = next((c for n, c in parts if n == b"PLTE"), b"")
        colours = np.frombuffer(palette, np.uint8, len(palette) // 3 * 3).reshape(-1, 3)
        if pixels.max() >= len(colours):
            raise PngError("a colour beyond the palette")
        alpha = next((c for n, c in parts if n == b"tRNS"), None)
        if alpha is not None:
            clear = np.full(len(colours), 255, np.uint8)
            clear[: len(alpha)] = np.frombuffer(alpha, np.uint8)[: len(colours)]
            colours = np.concatenate([colours, clear[:, None]], axis=1)
        return colours[pixels[..., 0]]
    return pixels * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else pixels


def filtered(pixels: np.ndarray, kind: int, above: np.ndarray | None = None) -> np.ndarray:
    """What one row filter leaves of each row; ``above`` are the rows above, else those of the picture."""
    if kind == 0:
        return pixels.astype(np.uint8)
    p = pixels.astype(np.int16)
    a, b, c = np.zeros((3, *p.shape), np.int16)
    if kind != 1:
        if above is None:
            b[1:] = p[:-1]
        else:
            b[:] = above
    a[:, 1:], c[:, 1:] = p[:, :-1], b[:, :-1]
    guess = (0, a, b, (a + b) >> 1, paeth(a, b, c) if kind == 4 else 0)[kind]
    return ((p - guess) & 255).astype(np.uint8)


#: Share of bytes equal to those before them from which runs alone are compressed as well as by a search, in a third of the time.
RUNS = 0.98


def _deflated(raw: np.ndarray, level: int) -> bytes:
    runs = np.count_nonzero(raw[1:] == raw[:-1]) >= RUNS * len(raw)
    made = zlib.compressobj(level, strategy=zlib.Z_RLE if runs else zlib.Z_DEFAULT_STRATEGY)
    return made.compress(raw) + made.flush()


def encode(pixels: np.ndarray, kinds: np.ndarray | int | None = None, level: int = 6) -> bytes:
    """A PNG of height x width (x 1 to 4 channels) bytes.

    Without ``kinds`` (a filter of all rows, or of each) rows take the filter that
    leaves the least sum of distances from zero.  Rows that are equal to the last, under
    equal rows, are filtered once.
    """
    pixels = np.ascontiguousarray(pixels.reshape(*pixels.shape[:2], -1))
    height, width, channels = pixels.shape
    flat = pixels.reshape(height, -1)
    other = np.ones(height, bool)
    other[0], other[1:] = flat[0].any(), (flat[1:] != flat[:-1]).any(1)
    new = other.copy()
    new[0], new[1:] = True, other[1:] | other[:-1]
    some, of = np.flatnonzero(new), np.cumsum(new) - 1
    above = pixels[some - 1]
    above[0] = 0
    made = [filtered(pixels[some], k, above).reshape(len(some), -1) for k in range(5)]
    if kinds is None:
        kinds = np.argmin([np.abs(m.view(np.int8).astype(np.int16)).sum(1) for m in made], axis=0)[of]
    kinds = np.broadcast_to(np.asarray(kinds, np.uint8), (height,))
    raw = np.empty((height, width * channels + 1), np.uint8)
    raw[:, 0] = kinds
    raw[:, 1:] = np.stack(made)[kinds, of]
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]

    def chunk(name: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", _deflated(raw.reshape(-1), level)) + chunk(b"IEND", b"")
