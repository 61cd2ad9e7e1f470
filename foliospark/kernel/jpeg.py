"""JPEG images, baseline and progressive, Huffman coded.

Coefficients are decoded block by block; dequantisation, the inverse cosine
transform and colour conversion then run over all blocks at once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAX_PIXELS = 64 << 20


class Unsupported(Exception):
    pass


def _zigzag() -> np.ndarray:
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([y * 8 + x for y, x in order])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: rows: frequencies, columns: samples
COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(0.125), 0.5)


@dataclass
class Component:
    name: int
    across: int
    down: int
    table: int
    wide: int = 0
    high: int = 0
    blocks: np.ndarray | None = None


class Bits:
    """Entropy-coded bits of one scan, stuffing removed, markers ending it."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.hold, self.n = data, at, 0, 0

    def _fill(self) -> None:
        data = self.data
        b = data[self.at] if self.at < len(data) else 0xFF
        if b == 0xFF:
            after = data[self.at + 1] if self.at + 1 < len(data) else 0xD9
            if after == 0:
                self.at += 2
            else:
                b = 0  # a marker: zeros from here on
                self.hold, self.n = self.hold << 8, self.n + 8
                return
        else:
            self.at += 1
        self.hold, self.n = (self.hold << 8 | b) & 0xFFFFFFFFFF, self.n + 8

    def take(self, count: int) -> int:
        while self.n < count:
            self._fill()
        self.n -= count
        return self.hold >> self.n & ((1 << count) - 1)

    def code(self, table: dict[int, int]) -> int:
        """The next Huffman symbol; tables are keyed by length and code together."""
        value = 1
        for _ in range(16):
            value = value << 1 | self.take(1)
            found = table.get(value)
            if found is not None:
                return found
        raise Unsupported("bad Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1

    def restart(self) -> None:
        """Drop what is held and step over the next restart marker."""
        self.hold = self.n = 0
        if self.data[self.at : self.at + 1] == b"\xff" and self.at + 1 < len(self.data) and 0xD0 <= self.data[self.at + 1] <= 0xD7:
            self.at += 2


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], dict[int, int]] = {}
        self.parts: list[Component] = []
        self.width = self.height = self.interval = 0
        self.progressive = False
        self.adobe: int | None = None
        self.run = 0

    def read(self) -> None:
        data, at = self.data, 0
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            at += 2
            if marker in (0x00, 0x01, 0xD8, 0xFF) or 0xD0 <= marker <= 0xD7:
                at -= marker == 0xFF
                continue
            if marker == 0xD9:
                break
            size = struct.unpack(">H", data[at : at + 2])[0]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self.progressive = marker == 0xC2
                self._frame(body)
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Unsupported("lossless or arithmetic coding")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker == 0xDA:
                at = self._scan(body, at)
        if not self.parts:
            raise Unsupported("no frame")

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, which = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            table = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8)
            self.quantisers[which] = table.astype(np.int64)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            which, counts = body[at], body[at + 1 : at + 17]
            at += 17
            table, code = {}, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[1 << length | code] = body[at]
                    at += 1
                    code += 1
                code <<= 1
            self.codes[which >> 4, which & 15] = table

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not self.width or not self.height or self.width * self.height > MAX_PIXELS:
            raise Unsupported("sample depth or size")
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= v <= 4 for c in self.parts for v in (c.across, c.down)):
            raise Unsupported("sampling factors")
        self.most_across, self.most_down = max(c.across for c in self.parts), max(c.down for c in self.parts)
        self.units = (-(-self.width // (8 * self.most_across)), -(-self.height // (8 * self.most_down)))
        for c in self.parts:
            c.wide = -(-(-(-self.width * c.across // self.most_across)) // 8)
            c.high = -(-(-(-self.height * c.down // self.most_down)) // 8)
            c.blocks = np.zeros((self.units[1] * c.down, self.units[0] * c.across, 64), np.int32)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0]
        chosen = []
        for i in range(n):
            part = next(c for c in self.parts if c.name == body[1 + 2 * i])
            tables = body[2 + 2 * i]
            chosen.append((part, self.codes.get((0, tables >> 4), {}), self.codes.get((1, tables & 15), {})))
        start, end, shifts = body[1 + 2 * n : 4 + 2 * n]
        high, low = shifts >> 4, shifts & 15
        bits = Bits(self.data, at)
        step = self._block(start, end, high, low)
        last = {id(c): 0 for c, _, _ in chosen}
        self.run = 0
        if n == 1:
            part = chosen[0][0]
            places = (((part, *chosen[0][1:], y, x),) for y in range(part.high) for x in range(part.wide))
        else:
            places = (
                tuple((c, dc, ac, uy * c.down + j, ux * c.across + i) for c, dc, ac in chosen for j in range(c.down) for i in range(c.across))
                for uy in range(self.units[1]) for ux in range(self.units[0])
            )
        for count, unit in enumerate(places):
            if self.interval and count and count % self.interval == 0:
                bits.restart()
                last = dict.fromkeys(last, 0)
                self.run = 0
            for part, dc, ac, y, x in unit:
                step(bits, part.blocks[y, x], dc, ac, last, id(part))
        return bits.at

    def _block(self, start: int, end: int, high: int, low: int):
        if not self.progressive:
            return self._whole
        if start == 0:
            return lambda *a: self._first_dc(*a, low) if not high else self._more_dc(*a, low)
        return (lambda *a: self._first_ac(*a, start, end, low)) if not high else (lambda *a: self._more_ac(*a, start, end, low))

    @staticmethod
    def _whole(bits, block, dc, ac, last, key):
        last[key] += bits.signed(bits.code(dc))
        block[0] = last[key]
        k = 1
        while k < 64:
            symbol = bits.code(ac)
            skip, size = symbol >> 4, symbol & 15
            if not size:
                if skip != 15:
                    break
                k += 16
                continue
            k += skip
            if k > 63:
                break
            block[k] = bits.signed(size)
            k += 1

    @staticmethod
    def _first_dc(bits, block, dc, ac, last, key, low):
        last[key] += bits.signed(bits.code(dc))
        block[0] = last[key] << low

    @staticmethod
    def _more_dc(bits, block, dc, ac, last, key, low):
        if bits.take(1):
            block[0] |= 1 << low

    def _first_ac(self, bits, block, dc, ac, last, key, start, end, low):
        if self.run:
            self.run -= 1
            return
        k = start
        while k <= end:
            symbol = bits.code(ac)
            skip, size = symbol >> 4, symbol & 15
            if not size:
                if skip < 15:
                    self.run = (1 << skip) - 1 + (bits.take(skip) if skip else 0)
                    return
                k += 16
                continue
            k += skip
            if k > 63:
                return
            block[k] = bits.signed(size) * (1 << low)
            k += 1

    def _more_ac(self, bits, block, dc, ac, last, key, start, end, low):
        one, k = 1 << low, start

        def refine(i):
            if bits.take(1) and not abs(int(block[i])) & one:
                block[i] += one if block[i] > 0 else -one

        if not self.run:
            while k <= end:
                symbol = bits.code(ac)
                skip, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif skip < 15:
                    self.run = (1 << skip) + (bits.take(skip) if skip else 0)
                    break
                while k <= end:
                    if block[k]:
                        refine(k)
                    else:
                        if skip == 0:
                            break
                        skip -= 1
                    k += 1
                if value and k <= 63:
                    block[k] = value
                k += 1
        if self.run:
            while k <= end:
                if block[k]:
                    refine(k)
                k += 1
            self.run -= 1

    def samples(self) -> np.ndarray:
        """height x width x components, after the inverse transform."""
        planes = []
        for c in self.parts:
            table = self.quantisers.get(c.table)
            if table is None:
                raise Unsupported("no quantiser")
            flat = np.zeros(c.blocks.shape, np.float64)
            flat[:, :, ZIGZAG] = c.blocks * table
            grid = flat.reshape(*c.blocks.shape[:2], 8, 8)
            pixels = np.einsum("fy,abfg,gx->abyx", COSINES, grid, COSINES, optimize=True) + 128
            plane = np.clip(np.floor(pixels + 0.5), 0, 255).transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * 8, c.blocks.shape[1] * 8)
            plane = np.repeat(np.repeat(plane, self.most_down // c.down, 0), self.most_across // c.across, 1)
            planes.append(plane[: self.height, : self.width])
        return np.stack(planes, axis=2)


def decode(data: bytes, transform: int | None = None) -> tuple[np.ndarray, bool]:
    """(height x width x components bytes, whether four inks are stored inverted)."""
    reader = Reader(data)
    reader.read()
    out = reader.samples()
    n = out.shape[2]
    mode = reader.adobe if reader.adobe is not None else transform if transform is not None else 1 if n == 3 else 0
    if n == 3 and reader.adobe is None and transform is None and bytes(c.name for c in reader.parts) == b"RGB":
        mode = 0
    if n >= 3 and mode:
        y, cb, cr = out[:, :, 0], out[:, :, 1] - 128, out[:, :, 2] - 128
        out[:, :, 0], out[:, :, 1], out[:, :, 2] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8), n == 4 and reader.adobe is not None
