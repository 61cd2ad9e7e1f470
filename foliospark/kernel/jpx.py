"""JPEG 2000 images: boxes, packets, bit-plane coding, inverse wavelets.

Supported: one or more tiles, all progression orders, precincts, layers, both
wavelets, component transforms, palettes.  Not supported, and said so: coding
bypass, separate segments for each pass, packed headers and region of interest.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from foliospark.kernel.mq import Contexts, Decoder

MAX_PIXELS = 64 << 20


class Unsupported(Exception):
    pass


def up(a: int, b: int) -> int:
    return -(-a // b)


@dataclass
class Style:
    levels: int
    block: tuple[int, int]  # exponents: width, height
    causal: bool
    symbols: bool
    reversible: bool
    precincts: list[tuple[int, int]]


@dataclass
class Steps:
    kind: int
    guard: int
    values: list[tuple[int, int]]  # exponent, mantissa

    def of(self, band: int) -> tuple[int, int]:
        if self.kind == 1:
            exponent, mantissa = self.values[0]
            return exponent - (max(band - 1, 0) // 3), mantissa
        return self.values[min(band, len(self.values) - 1)]


@dataclass
class Block:
    box: tuple[int, int, int, int]
    missing: int = 0
    passes: int = 0
    length: int = 3
    seen: bool = False
    data: bytearray = field(default_factory=bytearray)


class Tree:
    """A tag tree over a grid."""

    def __init__(self, width: int, height: int):
        self.levels = []
        while True:
            self.levels.append((width, [0] * (width * height), [False] * (width * height)))
            if width * height <= 1:
                break
            width, height = up(width, 2), up(height, 2)

    def read(self, bits: Bits, x: int, y: int, limit: int) -> tuple[int, bool]:
        """(value so far, whether it is final), read on until it reaches ``limit``."""
        low, final = 0, True
        for k in range(len(self.levels) - 1, -1, -1):
            width, values, known = self.levels[k]
            i = (y >> k) * width + (x >> k)
            values[i] = max(values[i], low)
            while not known[i] and values[i] < limit:
                if bits.take(1):
                    known[i] = True
                else:
                    values[i] += 1
            low, final = values[i], known[i]
            if not final:
                break
        return low, final and k == 0


class Bits:
    """Packet header bits; a byte after 0xFF holds seven."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.byte = data, at, 0, 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            if not self.left:
                self.left = 7 if self.byte == 0xFF else 8
                self.byte = self.data[self.at] if self.at < len(self.data) else 0
                self.at += 1
            self.left -= 1
            v = v << 1 | self.byte >> self.left & 1
        return v

    def align(self) -> int:
        if self.byte == 0xFF:
            self.at += 1
        self.left, self.byte = 0, 0
        return self.at


def pass_count(bits: Bits) -> int:
    if not bits.take(1):
        return 1
    if not bits.take(1):
        return 2
    n = bits.take(2)
    if n < 3:
        return 3 + n
    n = bits.take(5)
    return 6 + n if n < 31 else 37 + bits.take(7)


# ---- bit planes -------------------------------------------------------------

RUN, UNIFORM = 17, 18


def _zero_table() -> dict[str, list[int]]:
    """Zero-coding contexts by (horizontal, vertical, diagonal) counts of significant neighbours."""
    out = {}
    for kind in ("LL", "HL", "HH"):
        rows = []
        for h in range(3):
            for v in range(3):
                for d in range(5):
                    if kind == "HH":
                        hv = h + v
                        rows.append(8 if d >= 3 else (7 if hv else 6) if d == 2 else (5 if hv >= 2 else 4 if hv else 3) if d == 1 else 2 if hv >= 2 else hv)
                    else:
                        a, b = (v, h) if kind == "HL" else (h, v)
                        rows.append(8 if a == 2 else (7 if b else 6 if d else 5) if a == 1 else (4 if b == 2 else 3 if b else 2 if d >= 2 else d))
        out[kind] = rows
    return out


ZERO = _zero_table()
# Sign contexts by contributions (horizontal, vertical): (context, flip).
SIGN = {(1, 1): (13, 0), (1, 0): (12, 0), (1, -1): (11, 0), (0, 1): (10, 0), (0, 0): (9, 0), (0, -1): (10, 1), (-1, 1): (11, 1), (-1, 0): (12, 1), (-1, -1): (13, 1)}


class Planes:
    """Bit-plane passes over one code block."""

    def __init__(self, width: int, height: int, kind: str, causal: bool = False):
        self.w, self.h, self.stride = width, height, width + 2
        n = self.stride * (height + 2)
        self.value, self.sign, self.on, self.visited, self.refined = [0] * n, [0] * n, bytearray(n), bytearray(n), bytearray(n)
        self.zero, self.causal = ZERO["HL" if kind == "HL" else "HH" if kind == "HH" else "LL"], causal
        self.contexts = Contexts(19)
        self.contexts.state[0], self.contexts.state[RUN], self.contexts.state[UNIFORM] = 4, 3, 46
        self.half = 0

    def read(self, context: int, what: str, at: int) -> int:
        return self.source.bit(self.contexts, context)

    def run(self, source, passes: int, planes: int, symbols: bool = False) -> None:
        self.source, kind, plane = source, 2, planes - 1
        for _ in range(passes):
            if plane < 0:
                break
            self.one = 1 << plane
            (self._significance, self._refinement, self._cleanup)[kind]()
            if kind == 2:
                if symbols:
                    for _ in range(4):
                        self.read(UNIFORM, "symbol", 0)
                self.visited = bytearray(len(self.visited))
                plane -= 1
            kind = (kind + 1) % 3
        # The last plane read whole: half of it is the middle of what is left open.
        self.half = 1 << (plane + 1 if passes % 3 == 1 or plane < 0 else plane)

    def _around(self, i: int, last: bool) -> tuple[int, int, int]:
        on, s = self.on, self.stride
        below = (0, 0, 0) if last and self.causal else on[i + s - 1 : i + s + 2]
        return on[i - 1] + on[i + 1], on[i - s] + below[1], on[i - s - 1] + on[i - s + 1] + below[0] + below[2]

    def _sign(self, i: int, last: bool) -> None:
        on, sign, s = self.on, self.sign, self.stride
        part = lambda k: 0 if not on[k] else -1 if sign[k] else 1
        h = max(-1, min(1, part(i - 1) + part(i + 1)))
        v = max(-1, min(1, part(i - s) + (0 if last and self.causal else part(i + s))))
        context, flip = SIGN[h, v]
        self.sign[i] = self.read(context, "sign", i) ^ flip
        self.on[i] = 1
        self.value[i] |= self.one

    def _stripes(self):
        for top in range(0, self.h, 4):
            deep = min(4, self.h - top)
            for x in range(self.w):
                yield top, deep, (top + 1) * self.stride + x + 1

    def _significance(self) -> None:
        for _, deep, first in self._stripes():
            for k in range(deep):
                i = first + k * self.stride
                if self.on[i]:
                    continue
                h, v, d = self._around(i, k == 3)
                if h or v or d:
                    self.visited[i] = 1
                    if self.read(self.zero[(h * 3 + v) * 5 + d], "bit", i):
                        self._sign(i, k == 3)

    def _refinement(self) -> None:
        for _, deep, first in self._stripes():
            for k in range(deep):
                i = first + k * self.stride
                if not self.on[i] or self.visited[i]:
                    continue
                context = 16 if self.refined[i] else 15 if any(self._around(i, k == 3)) else 14
                self.refined[i] = 1
                if self.read(context, "bit", i):
                    self.value[i] |= self.one

    def _cleanup(self) -> None:
        on, visited, s = self.on, self.visited, self.stride
        for _, deep, first in self._stripes():
            k = 0
            if deep == 4 and not any(on[first + j * s] or visited[first + j * s] or any(self._around(first + j * s, j == 3)) for j in range(4)):
                if not self.read(RUN, "run", first):
                    continue
                k = self.read(UNIFORM, "high", first) << 1 | self.read(UNIFORM, "low", first)
                self._sign(first + k * s, k == 3)
                k += 1
            while k < deep:
                i = first + k * s
                if not on[i] and not visited[i]:
                    h, v, d = self._around(i, k == 3)
                    if self.read(self.zero[(h * 3 + v) * 5 + d], "bit", i):
                        self._sign(i, k == 3)
                k += 1

    def result(self, half: bool) -> np.ndarray:
        """Signed values; for the irreversible wavelet in the middle of their interval."""
        grid = lambda v: np.array(v, np.float64).reshape(self.h + 2, self.stride)[1:-1, 1:-1]
        value = grid(self.value)
        if half:
            value = np.where(value > 0, value + self.half / 2, 0.0)
        return np.where(grid(self.sign) > 0, -value, value)


# ---- wavelets ---------------------------------------------------------------


def _neighbours(line: np.ndarray, start: int, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the odd (or even) samples and the sums of their neighbours, mirrored at the ends."""
    n = line.shape[-1]
    at = np.arange((start + odd) % 2, n, 2)
    right = np.where(at + 1 >= n, 2 * (n - 1) - at - 1, at + 1)
    return at, line[..., np.abs(at - 1)] + line[..., right]


#: Lifting steps of the irreversible wavelet, undone from the last: (odd samples, factor).
LIFTING = ((False, -0.443506852043971), (True, -0.882911075530934), (False, 0.052980118572961), (True, 1.586134342059924))
SCALE = 1.230174104914001


def synthesise(low: np.ndarray, high: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    """One level along the last axis; ``start`` is the position of the first sample."""
    n = low.shape[-1] + high.shape[-1]
    out = np.zeros((*low.shape[:-1], n))
    out[..., start % 2 :: 2], out[..., (start + 1) % 2 :: 2] = low, high
    if n == 1:
        return out / 2 if start % 2 else out
    if reversible:
        at, around = _neighbours(out, start, False)
        out[..., at] -= np.floor((around + 2) / 4)
        at, around = _neighbours(out, start, True)
        out[..., at] += np.floor(around / 2)
        return out
    out[..., start % 2 :: 2] *= SCALE
    out[..., (start + 1) % 2 :: 2] /= SCALE
    for odd, step in LIFTING:
        at, around = _neighbours(out, start, odd)
        out[..., at] += step * around
    return out


# ---- codestream -------------------------------------------------------------


class Tile:
    def __init__(self, stream: Codestream, index: int):
        self.s, self.data = stream, bytearray()
        across = up(stream.size[0] - stream.tile[2], stream.tile[0])
        p, q = index % across, index // across
        w, h, x0, y0 = stream.tile
        self.box = (max(x0 + p * w, stream.size[2]), max(y0 + q * h, stream.size[3]), min(x0 + (p + 1) * w, stream.size[0]), min(y0 + (q + 1) * h, stream.size[1]))
        self.order, self.layers, self.transform = stream.order, stream.layers, stream.transform
        self.styles, self.steps = dict(stream.styles), dict(stream.steps)

    def component(self, c: int) -> tuple:
        """(box, resolutions); a resolution is (box, precinct grid, bands)."""
        dx, dy = self.s.sampling[c]
        style, steps = self.styles.get(c, self.styles[None]), self.steps.get(c, self.steps[None])
        x0, y0, x1, y1 = (up(v, d) for v, d in zip(self.box, (dx, dy, dx, dy)))
        out = []
        for r in range(style.levels + 1):
            n = 1 << (style.levels - r)
            box = tuple(up(v, n) for v in (x0, y0, x1, y1))
            pw, ph = style.precincts[min(r, len(style.precincts) - 1)]
            grid = [box[0] >> pw, box[1] >> ph, up(box[2], 1 << pw), up(box[3], 1 << ph)] if box[2] > box[0] and box[3] > box[1] else [0, 0, 0, 0]
            bands = []
            for k, (kind, ox, oy) in enumerate([("LL", 0, 0)] if r == 0 else [("HL", 1, 0), ("LH", 0, 1), ("HH", 1, 1)]):
                m = style.levels if r == 0 else style.levels - r + 1
                half = 1 << (m - 1) if m else 0
                edge = lambda v, o: up(v - half * o, 1 << m)  # noqa: B023, E731
                b = (edge(x0, ox), edge(y0, oy), edge(x1, ox), edge(y1, oy))
                number = 0 if r == 0 else 3 * (r - 1) + 1 + k
                exponent, mantissa = steps.of(number)
                shrink = 0 if r == 0 else 1
                bw, bh = min(style.block[0], pw - shrink), min(style.block[1], ph - shrink)
                bands.append(Band(kind, b, exponent, mantissa, steps.guard, grid, (pw - shrink, ph - shrink), (bw, bh), self.s.depth[c]))
            out.append((box, grid, (pw, ph), bands))
        return (x0, y0, x1, y1), style, steps, out

    def packets(self, components):
        """(component, resolution, precinct) in the order of the stream, with its layer."""
        every = []
        for c, (_, style, _, resolutions) in enumerate(components):
            dx, dy = self.s.sampling[c]
            for r, (_, grid, (pw, ph), _) in enumerate(resolutions):
                n = style.levels - r
                for j in range(grid[3] - grid[1]):
                    for i in range(grid[2] - grid[0]):
                        y = max(((grid[1] + j) << (ph + n)) * dy, self.box[1])
                        x = max(((grid[0] + i) << (pw + n)) * dx, self.box[0])
                        every.append((c, r, j * (grid[2] - grid[0]) + i, y, x))
        keys = (
            lambda p, layer: (layer, p[1], p[0], p[2]), lambda p, layer: (p[1], layer, p[0], p[2]), lambda p, layer: (p[1], p[3], p[4], p[0], p[2], layer),
            lambda p, layer: (p[3], p[4], p[0], p[1], p[2], layer), lambda p, layer: (p[0], p[3], p[4], p[1], p[2], layer),
        )
        if self.order >= len(keys):
            raise Unsupported("progression order")
        key = keys[self.order]
        return sorted(((p, layer) for p in every for layer in range(self.layers)), key=lambda v: key(*v))

    def decode(self) -> list[np.ndarray]:
        components = [self.component(c) for c in range(len(self.s.sampling))]
        data, at = bytes(self.data), 0
        for (c, r, precinct, _, _), layer in self.packets(components):
            if at >= len(data):
                break
            if data[at : at + 2] == b"\xff\x91":
                at += 6
            at = self._packet(data, at, components[c][3][r][3], precinct, layer)
        planes = [self._plane(*component) for component in components]
        if self.transform and len(planes) >= 3:
            a, b, d = planes[:3]
            if components[0][1].reversible:
                green = a - np.floor((b + d) / 4)
                planes[:3] = [d + green, green, b + green]
            else:
                planes[:3] = [a + 1.402 * d, a - 0.344136 * b - 0.714136 * d, a + 1.772 * b]
        return planes

    def _packet(self, data: bytes, at: int, bands, precinct: int, layer: int) -> int:
        bits = Bits(data, at)
        lengths: list[tuple[Block, int]] = []
        if bits.take(1):
            for band in bands:
                width, height, blocks, inclusion, zeros = band.precinct(precinct)
                for k, block in enumerate(blocks):
                    x, y = k % width, k // width
                    if block.seen:
                        present = bits.take(1)
                    else:
                        value, final = inclusion.read(bits, x, y, layer + 1)
                        present = final and value <= layer
                    if not present:
                        continue
                    if not block.seen:
                        block.seen, limit = True, 1
                        while True:
                            value, final = zeros.read(bits, x, y, limit)
                            if final:
                                break
                            limit += 1
                            if limit > 80:
                                raise Unsupported("damaged packet")
                        block.missing = value
                    n = pass_count(bits)
                    while bits.take(1):
                        block.length += 1
                    lengths.append((block, bits.take(block.length + n.bit_length() - 1)))
                    block.passes += n
        at = bits.align()
        if data[at : at + 2] == b"\xff\x92":
            at += 2
        for block, n in lengths:
            block.data += data[at : at + n]
            at += n
        return at

    def _plane(self, box, style: Style, steps: Steps, resolutions) -> np.ndarray:
        plane = None
        for r, (area, _, _, bands) in enumerate(resolutions):
            parts = [b.samples(style) for b in bands]
            if r == 0:
                plane = parts[0]
                continue
            hl, lh, hh = parts
            upper = synthesise(plane, hl, area[0], style.reversible)
            lower = synthesise(lh, hh, area[0], style.reversible)
            plane = synthesise(upper.T, lower.T, area[1], style.reversible).T
        return plane


class Band:
    def __init__(self, kind, box, exponent, mantissa, guard, grid, precinct, block, precision):
        self.kind, self.box, self.exponent, self.mantissa, self.guard = kind, box, exponent, mantissa, guard
        self.grid, self.size, self.block = grid, precinct, block
        self.precision = precision
        self.known: dict[int, tuple] = {}

    def precinct(self, number: int) -> tuple:
        """(blocks across, down, blocks, inclusion tree, zero-plane tree) of a precinct."""
        if number in self.known:
            return self.known[number]
        wide = self.grid[2] - self.grid[0]
        px, py = self.grid[0] + number % wide, self.grid[1] + number // wide
        x0, y0 = max(px << self.size[0], self.box[0]), max(py << self.size[1], self.box[1])
        x1, y1 = min((px + 1) << self.size[0], self.box[2]), min((py + 1) << self.size[1], self.box[3])
        blocks, width, height = [], 0, 0
        if x1 > x0 and y1 > y0:
            bw, bh = self.block
            columns, rows = range(x0 >> bw, up(x1, 1 << bw)), range(y0 >> bh, up(y1, 1 << bh))
            width, height = len(columns), len(rows)
            blocks = [Block((max(i << bw, x0), max(j << bh, y0), min((i + 1) << bw, x1), min((j + 1) << bh, y1))) for j in rows for i in columns]
        out = self.known[number] = (width, height, blocks, Tree(max(width, 1), max(height, 1)), Tree(max(width, 1), max(height, 1)))
        return out

    def samples(self, style: Style) -> np.ndarray:
        x0, y0, x1, y1 = self.box
        out = np.zeros((max(y1 - y0, 0), max(x1 - x0, 0)))
        gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[self.kind]
        step = 1.0 if style.reversible else 2.0 ** (self.precision + gain - self.exponent) * (1 + self.mantissa / 2048)
        planes = self.guard + self.exponent - 1
        for _, _, blocks, _, _ in self.known.values():
            for b in blocks:
                if not b.passes:
                    continue
                a0, c0, a1, c1 = b.box
                coder = Planes(a1 - a0, c1 - c0, self.kind, style.causal)
                coder.run(Decoder(bytes(b.data)), b.passes, planes - b.missing, style.symbols)
                out[c0 - y0 : c1 - y0, a0 - x0 : a1 - x0] = coder.result(not style.reversible) * step
        return out


class Codestream:
    def __init__(self, data: bytes):
        self.styles: dict = {}
        self.steps: dict = {}
        tiles: dict[int, Tile] = {}
        tile, at, end = None, 2, 0
        if data[:2] != b"\xff\x4f":
            raise Unsupported("no codestream")
        while at + 2 <= len(data):
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            if marker == 0x93:
                stop = min(end or len(data), len(data))
                tile.data += data[at:stop]
                at, tile = stop, None
                continue
            size = struct.unpack(">H", data[at : at + 2])[0]
            body = data[at + 2 : at + size]
            if marker == 0x51:
                self._size(body)
            elif marker == 0x52:
                self._coding(body, tile or self)
            elif marker == 0x53:
                c, rest = self._component(body)
                (tile or self).styles[c] = self._style(rest[1:], rest[0] & 1)
            elif marker in (0x5C, 0x5D):
                c, rest = (None, body) if marker == 0x5C else self._component(body)
                (tile or self).steps[c] = self._quantiser(rest)
            elif marker == 0x90:
                index, length = struct.unpack(">HI", body[:6])
                tile = tiles.setdefault(index, None) or Tile(self, index)
                tiles[index] = tile
                end = at - 2 + length if length else 0
            elif marker in (0x5E, 0x5F, 0x60, 0x61):
                raise Unsupported("region of interest, order changes or packed headers")
            at += size
        self.tiles = tiles

    def _size(self, body: bytes) -> None:
        _, x1, y1, x0, y0, tw, th, tx, ty, n = struct.unpack(">HIIIIIIIIH", body[:36])
        if (x1 - x0) * (y1 - y0) > MAX_PIXELS or not tw or not th or not n:
            raise Unsupported("image size")
        self.size, self.tile = (x1, y1, x0, y0), (tw, th, tx, ty)
        parts = [body[36 + 3 * i : 39 + 3 * i] for i in range(n)]
        self.depth = [(p[0] & 127) + 1 for p in parts]
        self.signed = [bool(p[0] & 128) for p in parts]
        self.sampling = [(p[1], p[2]) for p in parts]

    def _component(self, body: bytes):
        return (body[0], body[1:]) if len(self.sampling) < 257 else (struct.unpack(">H", body[:2])[0], body[2:])

    def _coding(self, body: bytes, to) -> None:
        to.order, to.layers, to.transform = body[1], struct.unpack(">H", body[2:4])[0], body[4]
        to.styles[None] = self._style(body[5:], body[0] & 1)

    @staticmethod
    def _style(body: bytes, own: int) -> Style:
        levels, bw, bh, flags, wavelet = body[:5]
        if flags & ~0x28 or levels > 32:
            raise Unsupported("code block style")
        precincts = [(p & 15, p >> 4) for p in body[5 : 6 + levels]] if own else [(15, 15)]
        return Style(levels, (bw + 2, bh + 2), bool(flags & 8), bool(flags & 32), wavelet == 1, precincts)

    @staticmethod
    def _quantiser(body: bytes) -> Steps:
        kind, guard = body[0] & 31, body[0] >> 5
        values = [(b >> 3, 0) for b in body[1:]] if kind == 0 else [(v >> 11, v & 2047) for (v,) in struct.iter_unpack(">H", body[1 : 1 + (len(body) - 1) // 2 * 2])]
        return Steps(kind, guard, values)

    def image(self) -> list[np.ndarray]:
        """A plane for each component, as unsigned values of its depth."""
        x1, y1, x0, y0 = self.size
        planes = [np.zeros((up(y1, dy) - up(y0, dy), up(x1, dx) - up(x0, dx))) for dx, dy in self.sampling]
        for tile in self.tiles.values():
            for c, part in enumerate(tile.decode()):
                dx, dy = self.sampling[c]
                left, top = up(tile.box[0], dx) - up(x0, dx), up(tile.box[1], dy) - up(y0, dy)
                planes[c][top : top + part.shape[0], left : left + part.shape[1]] = part
        out = []
        for plane, depth in zip(planes, self.depth):
            top = (1 << depth) - 1
            out.append(np.clip(np.floor(plane + 0.5) + (1 << (depth - 1)), 0, top) / top)
        return out


def boxes(data: bytes):
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        stop = len(data) if size == 0 or kind == b"jp2c" and at + size > len(data) else at + size
        if size and size < head or stop > len(data):
            break
        yield kind, data[at + head : stop]
        at = stop


def decode(data: bytes) -> np.ndarray:
    """height x width x components bytes."""
    stream, palette, space = data, None, 0
    if data[:2] != b"\xff\x4f":
        stream = b""
        for kind, body in boxes(data):
            if kind == b"jp2h":
                for inner, content in boxes(body):
                    if inner == b"colr" and content[:1] == b"\x01":
                        space = struct.unpack(">I", content[3:7])[0]
                    elif inner == b"pclr":
                        count, columns = struct.unpack(">HB", content[:3])
                        palette = np.frombuffer(content[3 + columns : 3 + columns + count * columns], np.uint8).reshape(count, columns)
            elif kind == b"jp2c" and not stream:
                stream = body
    code = Codestream(stream)
    planes = code.image()
    if palette is not None:
        index = np.round(planes[0] * ((1 << code.depth[0]) - 1)).astype(int)
        return palette[np.minimum(index, len(palette) - 1)]
    height, width = planes[0].shape
    for i, plane in enumerate(planes):
        if plane.shape != (height, width):
            ry, rx = up(height, plane.shape[0]), up(width, plane.shape[1])
            planes[i] = np.repeat(np.repeat(plane, ry, 0), rx, 1)[:height, :width]
    colour = np.stack(planes[:3] if len(planes) >= 3 else planes[:1], axis=2) * 255
    if space == 18 and colour.shape[2] == 3:
        y, cb, cr = colour[:, :, 0], colour[:, :, 1] - 128, colour[:, :, 2] - 128
        colour = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(colour + 0.5), 0, 255).astype(np.uint8)
