"""Bilevel images: generic, refinement, symbol and text regions, arithmetic coded.

Huffman-coded and halftone segments are not supported, as in the format's use
by PDF writers they hardly occur.  A bitmap is a list of rows, a row a list of
0 and 1 (1 is black).
"""

from __future__ import annotations

import struct

import numpy as np

from foliospark.kernel import ccitt
from foliospark.kernel.mq import Contexts, Decoder, Integers

MAX_PIXELS = 64 << 20

# Order of the context bits, from the most significant, "a" to "d" being adaptive pixels.
ORDERS = (
    ["d", (-1, -2), (0, -2), (1, -2), "c", "b", (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), "a", (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), "a", (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), "a", (-2, 0), (-1, 0)],
    [(-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), "a", (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
)
DEFAULT_ADAPTIVE = ([(3, -1), (-3, -1), (2, -2), (-2, -2)], [(3, -1)], [(2, -1)], [(2, -1)])
TYPICAL = (0x9B25, 0x0795, 0x00E5, 0x0195)


class Unsupported(Exception):
    pass


def blank(width: int, height: int, value: int = 0) -> list[bytearray]:
    if width * height > MAX_PIXELS:
        raise Unsupported("bitmap too large")
    return [bytearray([value]) * width for _ in range(height)]


def generic(decoder: Decoder, width: int, height: int, template: int, adaptive, typical: bool, contexts: Contexts | None = None) -> list[bytearray]:
    """An arithmetic-coded bitmap."""
    contexts = contexts or Contexts(1 << 16)
    places = dict(zip("abcd", adaptive))
    order = [places[p] if isinstance(p, str) else p for p in ORDERS[template]]
    pad = max(8, *(abs(dx) for dx, _ in order))
    up = max(2, *(-dy for _, dy in order))
    rows = [bytearray(width + 2 * pad) for _ in range(up)]
    bit, repeat = decoder.bit, 0
    for y in range(height):
        if typical:
            repeat ^= bit(contexts, TYPICAL[template])
            if repeat:
                rows.append(bytearray(rows[-1]))
                continue
        row = bytearray(width + 2 * pad)
        rows.append(row)
        sources = [(rows[len(rows) - 1 + dy], dx + pad) for dx, dy in order]
        for x in range(width):
            context = 0
            for source, dx in sources:
                context = context << 1 | source[x + dx]
            row[x + pad] = bit(contexts, context)
    return [bytearray(r[pad : pad + width]) for r in rows[up:]]


# Context pixels of the refinement templates: of the new bitmap, then of the reference.
REFINEMENT = (
    ([(-1, -1), (0, -1), (1, -1), (-1, 0)], [(0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]),
    ([(-1, -1), (0, -1), (1, -1), (-1, 0)], [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1), (1, 1)]),
)


def refinement(decoder: Decoder, width: int, height: int, template: int, reference, dx: int, dy: int, adaptive, typical: bool, contexts: Contexts) -> list[bytearray]:
    """A bitmap coded as changes to a reference."""
    out = blank(width, height)
    rh, rw = len(reference), len(reference[0]) if reference else 0

    def old(x: int, y: int) -> int:
        x, y = x - dx, y - dy
        return reference[y][x] if 0 <= y < rh and 0 <= x < rw else 0

    def new(x: int, y: int) -> int:
        return out[y][x] if 0 <= y < height and 0 <= x < width else 0

    repeat = 0
    for y in range(height):
        if typical:
            repeat ^= decoder.bit(contexts, 0x10 if template == 0 else 0x08)  # only the reference pixel itself set
        for x in range(width):
            if repeat:
                around = {old(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
                if len(around) == 1:
                    out[y][x] = around.pop()
                    continue
            if template == 0:
                (ax, ay), (bx, by) = adaptive
                bits = [new(x + ax, y + ay), new(x, y - 1), new(x + 1, y - 1), new(x - 1, y), old(x + bx, y + by), *(old(x + i, y + j) for i, j in REFINEMENT[0][1])]
            else:
                bits = [*(new(x + i, y + j) for i, j in REFINEMENT[1][0]), *(old(x + i, y + j) for i, j in REFINEMENT[1][1])]
            context = 0
            for b in bits:
                context = context << 1 | b
            out[y][x] = decoder.bit(contexts, context)
    return out


def compose(page, bitmap, x0: int, y0: int, operator: int) -> None:
    """Combine a bitmap into a page: or, and, xor, xnor, replace."""
    height, width = len(page), len(page[0]) if page else 0
    for j, row in enumerate(bitmap):
        y = y0 + j
        if not 0 <= y < height:
            continue
        lo, hi = max(0, -x0), min(len(row), width - x0)
        if lo >= hi:
            continue
        a = np.frombuffer(bytes(page[y][x0 + lo : x0 + hi]), np.uint8)
        b = np.frombuffer(bytes(row[lo:hi]), np.uint8)
        page[y][x0 + lo : x0 + hi] = (a | b, a & b, a ^ b, 1 - (a ^ b), b)[operator].tobytes()


class Image:
    """Segments of one embedded stream, after those of its globals."""

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height
        self.page = blank(width, height)
        self.symbols: dict[int, list] = {}
        self.bitmaps: dict[int, list] = {}

    def read(self, data: bytes) -> None:
        at = 0
        while at + 11 <= len(data):
            number, flags, count = struct.unpack(">IBB", data[at : at + 6])
            at += 5
            if count >> 5 == 7:
                count = struct.unpack(">I", data[at : at + 4])[0] & 0x1FFFFFFF
                at += 4 + (count + 8) // 8
            else:
                count >>= 5
                at += 1
            step = 1 if number <= 256 else 2 if number <= 65536 else 4
            referred = [int.from_bytes(data[at + i * step : at + (i + 1) * step], "big") for i in range(count)]
            at += count * step + (4 if flags & 0x40 else 1)
            length = struct.unpack(">I", data[at : at + 4])[0]
            at += 4
            if length == 0xFFFFFFFF:
                if flags & 63 not in (38, 39):
                    raise Unsupported("segment of unknown length")
                mmr = data[at + 17] & 1
                end = data.find(b"\0\0" if mmr else b"\xff\xac", at + 18)
                length = (len(data) if end < 0 else end + 6) - at
            self._segment(number, flags & 63, referred, data[at : at + length])
            at += length

    def _segment(self, number: int, kind: int, referred: list[int], body: bytes) -> None:
        if kind == 48:
            if len(body) > 16 and body[16] & 4:
                self.page = blank(self.width, self.height, 1)
        elif kind == 0:
            self.symbols[number] = self._dictionary(referred, body)
        elif kind in (4, 6, 7, 36, 38, 39, 40, 42, 43):
            width, height, x, y, flags = struct.unpack(">IIIIB", body[:17])
            reader = self._text if kind < 8 else self._generic if kind < 40 else self._refined
            bitmap = reader(referred, body[17:], width, height, x, y)
            if kind in (4, 36, 40):
                self.bitmaps[number] = bitmap
            else:
                compose(self.page, bitmap, x, y, min(flags & 7, 4))
        elif kind in (16, 20, 22, 23):
            raise Unsupported("halftone region")

    @staticmethod
    def _adaptive(body: bytes, at: int, n: int):
        return [struct.unpack(">bb", body[at + 2 * i : at + 2 * i + 2]) for i in range(n)], at + 2 * n

    def _generic(self, referred, body, width, height, x, y):
        flags = body[0]
        if flags & 1:
            packed = ccitt.decode(body[1:], {"K": -1, "Columns": width, "BlackIs1": True}, width, height)
            rows = np.unpackbits(np.frombuffer(packed.ljust((width + 7) // 8 * height, b"\0"), np.uint8).reshape(height, -1), axis=1)[:, :width]
            return [bytearray(r.tobytes()) for r in rows]
        template = flags >> 1 & 3
        adaptive, at = self._adaptive(body, 1, 4 if template == 0 else 1)
        return generic(Decoder(body[at:]), width, height, template, adaptive, bool(flags & 8))

    def _refined(self, referred, body, width, height, x, y):
        flags = body[0]
        template, at, adaptive = flags & 1, 1, [(-1, -1), (-1, -1)]
        if template == 0:
            adaptive, at = self._adaptive(body, 1, 2)
        found = next((self.bitmaps[r] for r in referred if r in self.bitmaps), None)
        reference = found if found is not None else [row[x : x + width] for row in self.page[y : y + height]]
        return refinement(Decoder(body[at:]), width, height, template, reference, 0, 0, adaptive, bool(flags & 2), Contexts(1 << 13))

    def _inputs(self, referred) -> list:
        return [s for r in referred for s in self.symbols.get(r, ())]

    def _dictionary(self, referred, body) -> list:
        flags = struct.unpack(">H", body[:2])[0]
        if flags & 1:
            raise Unsupported("Huffman-coded symbols")
        refine, template, refine_template, at = flags >> 1 & 1, flags >> 10 & 3, flags >> 12 & 1, 2
        adaptive, at = self._adaptive(body, at, 4 if template == 0 else 1)
        refine_adaptive = [(-1, -1), (-1, -1)]
        if refine and refine_template == 0:
            refine_adaptive, at = self._adaptive(body, at, 2)
        exported, new = struct.unpack(">II", body[at : at + 8])
        known = self._inputs(referred)
        total = len(known) + new
        if total > 1 << 20:
            raise Unsupported("too many symbols")
        decoder = Decoder(body[at + 8 :])
        numbers, contexts, refining = Integers(decoder), Contexts(1 << 16), Contexts(1 << 13)
        symbols, height, start = list(known), 0, len(known)
        while len(symbols) - start < new:
            height += numbers.integer("height") or 0
            width = 0
            while True:
                more = numbers.integer("width")
                if more is None or len(symbols) - start >= new:
                    break
                width += more
                if not refine:
                    symbols.append(generic(decoder, width, height, template, adaptive, False, contexts))
                    continue
                instances = numbers.integer("instances")
                length = max(1, (total - 1).bit_length()) if total > 1 else 0
                if instances == 1:
                    which, rx, ry = numbers.symbol(length), numbers.integer("rx") or 0, numbers.integer("ry") or 0
                    symbols.append(refinement(decoder, width, height, refine_template, symbols[which], rx, ry, refine_adaptive, False, refining))
                else:
                    symbols.append(text_region(numbers, decoder, width, height, instances or 0, symbols, length, Text(refine=True, refine_template=refine_template, refine_adaptive=refine_adaptive), refining))
        out, i, keep = [], 0, False
        while i < len(symbols) and len(out) < exported:
            run = numbers.integer("export") or 0
            if keep:
                out += symbols[i : i + run]
            i += run
            keep = not keep
        return out

    def _text(self, referred, body, width, height, x, y):
        flags = struct.unpack(">H", body[:2])[0]
        if flags & 1:
            raise Unsupported("Huffman-coded text")
        offset = flags >> 10 & 31
        how = Text(bool(flags & 2), flags >> 2 & 3, flags >> 4 & 3, bool(flags & 64), flags >> 7 & 3, flags >> 9 & 1, offset - 32 if offset > 15 else offset, flags >> 15)
        at = 2
        if how.refine and how.refine_template == 0:
            how.refine_adaptive, at = self._adaptive(body, at, 2)
        instances = struct.unpack(">I", body[at : at + 4])[0]
        symbols = self._inputs(referred)
        length = (len(symbols) - 1).bit_length() if len(symbols) > 1 else 0
        decoder = Decoder(body[at + 4 :])
        return text_region(Integers(decoder), decoder, width, height, instances, symbols, length, how, Contexts(1 << 13))

    def packed(self) -> bytes:
        """Rows of bits, 1 black."""
        return np.packbits(np.frombuffer(b"".join(self.page), np.uint8).reshape(self.height, self.width), axis=1).tobytes()


class Text:
    """How a text region places its symbols."""

    def __init__(self, refine=False, log_strips=0, corner=1, transposed=False, operator=0, default=0, offset=0, refine_template=0, refine_adaptive=((-1, -1), (-1, -1))):
        self.refine, self.log_strips, self.corner, self.transposed = refine, log_strips, corner, transposed
        self.operator, self.default, self.offset, self.refine_template, self.refine_adaptive = operator, default, offset, refine_template, refine_adaptive


def text_region(numbers: Integers, decoder: Decoder, width: int, height: int, instances: int, symbols: list, length: int, how: Text, refining: Contexts) -> list[bytearray]:
    out = blank(width, height, how.default)
    strips = 1 << how.log_strips
    strip = -(numbers.integer("strip") or 0) * strips
    first, placed = 0, 0
    while placed < instances:
        strip += (numbers.integer("strip") or 0) * strips
        first += numbers.integer("first") or 0
        s = first
        while True:
            t = strip + (0 if strips == 1 else numbers.integer("within") or 0)
            which = numbers.symbol(length)
            symbol = symbols[which] if which < len(symbols) else []
            if how.refine and numbers.integer("refined"):
                dw, dh, dx, dy = (numbers.integer(k) or 0 for k in ("rw", "rh", "rx", "ry"))
                w, h = (len(symbol[0]) if symbol else 0) + dw, len(symbol) + dh
                symbol = refinement(decoder, w, h, how.refine_template, symbol, (dw >> 1) + dx, (dh >> 1) + dy, how.refine_adaptive, False, refining)
            w, h = len(symbol[0]) if symbol else 0, len(symbol)
            # Corners: 0 bottom left, 1 top left, 2 bottom right, 3 top right.
            right, bottom = how.corner in (2, 3), how.corner in (0, 2)
            if not how.transposed:
                if right:
                    s += w - 1
                compose(out, symbol, s - (w - 1 if right else 0), t - (h - 1 if bottom else 0), how.operator)
                if not right:
                    s += w - 1
            else:
                if bottom:
                    s += h - 1
                compose(out, symbol, t - (w - 1 if right else 0), s - (h - 1 if bottom else 0), how.operator)
                if not bottom:
                    s += h - 1
            placed += 1
            gap = numbers.integer("gap")
            if gap is None or placed > instances:
                break
            s += gap + how.offset
    return out


def decode(data: bytes, shared: bytes | None, width: int, height: int) -> bytes:
    """Packed rows, 1 black; ``shared`` are the segments of JBIG2Globals."""
    image = Image(width, height)
    if shared:
        image.read(shared)
    image.read(data)
    return image.packed()
