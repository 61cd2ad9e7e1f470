"""JPEG 2000 decoding against a small encoder made from the decoder's own passes."""

import struct

import numpy as np
import pytest

from foliospark.kernel import builder as b
from foliospark.kernel import extract as x
from foliospark.kernel import jpx, pictures
from tests.test_kernel import Coder


class Writing(jpx.Planes):
    """The passes, with every decision taken from known values and written down."""

    def encode(self, values):
        self.truth = np.pad(np.abs(values), 1).ravel().tolist()
        self.minus = np.pad((values < 0).astype(int), 1).ravel().tolist()
        planes = max(max(self.truth).bit_length(), 1)
        self.coder = Coder()
        passes = 3 * planes - 2
        self.run(None, passes, planes)
        return self.coder.finish()[:-2], passes, planes

    def read(self, context, what, at):
        if what == "bit":
            v = int(bool(self.truth[at] & self.one))
        elif what == "sign":
            h = self.signs(at)
            v = self.minus[at] ^ jpx.SIGN[h][1]
        elif what == "run":
            self.found = next((k for k in range(4) if self.truth[at + k * self.stride] & self.one), None)
            v = int(self.found is not None)
        else:
            v = self.found >> 1 if what == "high" else self.found & 1
        self.coder.bit(self.contexts, context, v)
        return v

    def signs(self, i):
        part = lambda k: 0 if not self.on[k] else -1 if self.sign[k] else 1
        return max(-1, min(1, part(i - 1) + part(i + 1))), max(-1, min(1, part(i - self.stride) + part(i + self.stride)))


def analyse(line):
    """One reversible level along the last axis, starting at an even position."""
    out = line.astype(float).copy()
    if out.shape[-1] == 1:
        return out, out[..., :0]
    at, around = jpx._neighbours(out, 0, True)
    out[..., at] -= np.floor(around / 2)
    at, around = jpx._neighbours(out, 0, False)
    out[..., at] += np.floor((around + 2) / 4)
    return out[..., ::2], out[..., 1::2]


class Header:
    def __init__(self):
        self.bits, self.out = [], bytearray()

    def put(self, v, n):
        self.bits += [v >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        out, at = bytearray(), 0
        while at < len(self.bits):
            n = 7 if out and out[-1] == 0xFF else 8
            part = self.bits[at : at + n] + [0] * max(0, n - len(self.bits[at : at + n]))
            out.append(int("".join(map(str, part)), 2))
            at += n
        if out and out[-1] == 0xFF:
            out.append(0)
        return bytes(out)


def passes_code(h, n):
    if n == 1:
        h.put(0, 1)
    elif n == 2:
        h.put(2, 2)
    elif n <= 5:
        h.put(3, 2)
        h.put(n - 3, 2)
    elif n <= 36:
        h.put(15, 4)
        h.put(n - 6, 5)
    else:
        raise AssertionError


def packet(bands, exponents):
    h, body = Header(), b""
    h.put(1, 1)
    for (kind, values), exponent in zip(bands, exponents):
        if not values.size:
            continue
        if not values.any():
            h.put(0, 1)
            continue
        data, passes, planes = Writing(values.shape[1], values.shape[0], kind).encode(values.astype(int))
        h.put(1, 1)
        h.put(1, exponent + 1 - planes + 1)  # missing planes as zeros, then a one
        passes_code(h, passes)
        width = 3 + passes.bit_length() - 1
        while len(data) >> width:
            h.put(1, 1)
            width += 1
        h.put(0, 1)
        h.put(len(data), width)
        body += data
    return h.done() + body


def encode(planes, levels, transform=False):
    height, width = planes[0].shape
    n = len(planes)
    shifted = [p.astype(float) - 128 for p in planes]
    if transform:
        r, g, c = shifted
        shifted = [np.floor((r + 2 * g + c) / 4), c - g, r - g]
    exponents = [8] + [8 + k for _ in range(levels) for k in (1, 1, 2)]
    exponents = [e + transform for e in exponents]
    resolutions = []
    for plane in shifted:
        parts = []
        for _ in range(levels):
            low, high = analyse(plane.T)
            low, high = low.T, high.T
            ll, hl = analyse(low)
            lh, hh = analyse(high)
            parts.insert(0, [("HL", hl), ("LH", lh), ("HH", hh)])
            plane = ll
        resolutions.append([[("LL", plane)], *parts])
    body = b"".join(packet(resolutions[c][r], exponents[:1] if r == 0 else exponents[3 * r - 2 : 3 * r + 1]) for r in range(levels + 1) for c in range(n))
    siz = struct.pack(">HIIIIIIIIH", 0, width, height, 0, 0, width, height, 0, 0, n) + b"\x07\1\1" * n
    cod = bytes([0, 0]) + struct.pack(">H", 1) + bytes([int(transform), levels, 4, 4, 0, 1])
    qcd = bytes([2 << 5]) + bytes(e << 3 for e in exponents)
    mark = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    sot = mark(0x90, struct.pack(">HIBB", 0, 12 + 2 + len(body), 0, 1))
    return b"\xff\x4f" + mark(0x51, siz) + mark(0x52, cod) + mark(0x5C, qcd) + sot + b"\xff\x93" + body + b"\xff\xd9"


def picture(height, width, seed=0):
    y, px = np.mgrid[0:height, 0:width]
    noise = np.random.default_rng(seed).integers(-9, 10, (height, width))
    return np.clip(128 + 80 * np.sin(px / 5 + seed) * np.cos(y / 4) + noise, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("size,levels", [((14, 20), 0), ((14, 20), 1), ((31, 45), 3), ((1, 7), 1), ((9, 1), 2)])
def test_lossless_grey(size, levels):
    plane = picture(*size)
    assert (jpx.decode(encode([plane], levels))[:, :, 0] == plane).all()


def test_lossless_colour_in_a_file():
    planes = [picture(23, 19, s) for s in (0, 1, 2)]
    stream = encode(planes, 2, True)
    assert (jpx.decode(stream) == np.stack(planes, axis=2)).all()
    box = lambda k, d: struct.pack(">I4s", len(d) + 8, k) + d
    jp2 = box(b"jP  ", b"\r\n\x87\n") + box(b"jp2h", box(b"colr", b"\1\0\0" + struct.pack(">I", 16))) + box(b"jp2c", stream)
    objs = b.page_tree(1, 4, "/XObject <</I 6 0 R>>") | {5: b.stream("", b"q 10 0 0 10 0 0 cm /I Do Q"), 6: b.stream("/Subtype /Image /Width 19 /Height 23 /Filter /JPXDecode", jp2)}
    image = x.read(b.classic(objs), x.Options(images=True)).pages[0].images[0]
    assert (pictures.pixels(image) == np.stack(planes, axis=2)).all()
    for cut in range(0, len(jp2), 41):
        image.data = jp2[:cut]
        try:
            pictures.pixels(image)
        except pictures.Unsupported:
            pass


def test_irreversible_wavelet_undoes_its_steps():
    line = np.random.default_rng(1).normal(size=(3, 17))
    for start in (0, 1):
        out = line.copy()
        for odd, step in reversed(jpx.LIFTING):
            at, around = jpx._neighbours(out, start, odd)
            out[..., at] -= step * around
        low, high = out[..., start % 2 :: 2] / jpx.SCALE, out[..., (start + 1) % 2 :: 2] * jpx.SCALE
        assert np.allclose(jpx.synthesise(low, high, start, False), line)


def test_unsupported_is_said():
    for bad in (b"", b"\xff\x4f\xff\xd9", b"junk" * 9):
        with pytest.raises((jpx.Unsupported, IndexError, AttributeError, struct.error)):
            jpx.decode(bad)
