"""Image records, and their samples as pixels.

Raw, indexed, CCITT, JBIG2, JPEG and JPEG 2000 samples become 8-bit grey or RGB.
What a codec does not support is said by ``pixels``, and the bytes are kept.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from foliospark.kernel import ccitt, filters, functions, jbig2, jpeg, jpx
from foliospark.kernel.interpreter import SHORT_SPACES, Matrix, Painted
from foliospark.kernel.objects import Name, Stream
from foliospark.kernel.reader import File

PAGE_BYTES = 256 << 20
DEVICE = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4}


class Unsupported(Exception):
    pass


@dataclass
class Space:
    name: str
    components: int
    #: of Indexed and Separation/DeviceN: the space below, and how to get there
    base: Space | None = None
    palette: bytes = b""
    high: int = 0
    tint: object = None


@dataclass
class Image:
    width: int
    height: int
    bits: int
    components: int
    space: Space | None
    filter: str | None
    mask: bool
    inline: bool
    ctm: Matrix
    data: bytes
    decode: list[float] = field(default_factory=list)
    parms: dict = field(default_factory=dict)
    #: segments that a JBIG2 stream shares with others
    shared: bytes | None = None

    def to_page(self, x: float, y: float) -> tuple[float, float]:
        """A pixel corner in page space; the first row is the top."""
        u, v = x / self.width, 1 - y / self.height
        a, b, c, d, e, f = self.ctm
        return (u * a + v * c + e, u * b + v * d + f)

    def quad(self):
        a, b, c, d, e, f = self.ctm
        return [(e, f), (a + e, b + f), (a + c + e, b + d + f), (c + e, d + f)]


def space_of(file: File, value, resources, depth: int = 0) -> Space | None:
    value = file.get(value)
    if depth > 4 or value is None:
        return None
    if isinstance(value, Name):
        name = SHORT_SPACES.get(str(value), str(value))
        if name in DEVICE:
            return Space(name, DEVICE[name])
        if name == "Pattern":
            return None
        own = file.key(file.key(resources, "ColorSpace"), str(value))
        return space_of(file, own, resources, depth + 1) if own is not None else None
    if not isinstance(value, list) or not value:
        return None
    kind = SHORT_SPACES.get(str(file.get(value[0])), str(file.get(value[0])))
    if kind in DEVICE:
        return Space(kind, DEVICE[kind])
    if kind == "ICCBased" and len(value) > 1:
        n = file.key(value[1], "N")
        return Space({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(n, "DeviceGray"), n if n in (1, 3, 4) else 1)
    if kind == "Indexed" and len(value) > 3:
        base = space_of(file, value[1], resources, depth + 1)
        table = file.get(value[3])
        if isinstance(table, Stream):
            try:
                table = file.body(table)
            except filters.Problem as e:
                table = e.kept
        high = file.get(value[2])
        if base is None or not isinstance(table, bytes) or type(high) is not int:
            return None
        return Space("Indexed", 1, base, table, min(max(high, 0), 255))
    if kind in ("Separation", "DeviceN") and len(value) > 3:
        base = space_of(file, value[2], resources, depth + 1)
        names = file.get(value[1])
        count = len(names) if isinstance(names, list) else 1
        try:
            tint = functions.Function(file, value[3])
        except (ValueError, TypeError, IndexError):
            tint = None
        return Space(kind, count, base, tint=tint)
    return None


def load(file: File, painted: Painted, limit: int = filters.STREAM_LIMIT) -> Image:
    """The record of a painting; raises for images that cannot be read."""
    inline = painted.stream is None
    own = painted.attributes if inline else painted.stream.attributes
    get = lambda k: file.get(own.get(k))
    width, height = get("Width"), get("Height")
    if type(width) is not int or type(height) is not int or not (0 < width <= 1 << 20 and 0 < height <= 1 << 20):
        raise Unsupported("image without size")
    mask = ("ImageMask" in own) if inline else get("ImageMask") is True
    codec, parms = None, {}
    if inline:
        names = get("Filter")
        names = [names] if isinstance(names, Name) else file.items(names)
        steps = [p if isinstance(p, dict) else {} for p in ([get("DecodeParms")] if isinstance(get("DecodeParms"), dict) else file.items(get("DecodeParms")))]
        data, codec, parms = filters.decode(painted.data, filters.chain(names, steps), limit)
        if codec in ("JPXDecode", "JBIG2Decode"):
            raise Unsupported(f"inline {codec}")
    else:
        data, codec, parms = file.image_body(painted.stream, limit)
    bits = get("BitsPerComponent")
    bits = 1 if mask or codec in ("CCITTFaxDecode", "JBIG2Decode") else bits if type(bits) is int else 8
    space = None if mask else space_of(file, own.get("ColorSpace"), painted.resources)
    decode = [float(v) for v in file.items(own.get("Decode")) if isinstance(v, (int, float))]
    shared = None
    if codec == "JBIG2Decode" and isinstance(file.get(parms.get("JBIG2Globals")), Stream):
        shared = file.body(file.get(parms["JBIG2Globals"]))
    return Image(width, height, bits, space.components if space else 1, space, codec, mask, inline, painted.ctm, data, decode, parms, shared)


def pixels(image: Image, limit: int = 64 << 20) -> np.ndarray:
    """height x width x (1 or 3) bytes; raises Unsupported for codecs that stay encoded."""
    if image.width * image.height > limit:
        raise Unsupported("image exceeds the pixel limit")
    if image.filter == "CCITTFaxDecode":
        data = ccitt.decode(image.data, image.parms, image.width, image.height)
    elif image.filter == "JBIG2Decode":
        try:
            bits = np.frombuffer(jbig2.decode(image.data, image.shared, image.width, image.height), np.uint8)
        except (jbig2.Unsupported, struct.error) as e:
            raise Unsupported(f"JBIG2: {e}") from None
        data = (~bits).tobytes()  # black is 0 in sample space
    elif image.filter == "DCTDecode":
        return _photograph(image)
    elif image.filter == "JPXDecode":
        try:
            return jpx.decode(image.data)
        except (jpx.Unsupported, struct.error, IndexError, ValueError, AttributeError) as e:
            raise Unsupported(f"JPEG 2000: {e}") from None
    elif image.filter:
        raise Unsupported(f"{image.filter} stays encoded")
    else:
        data = image.data
    n = image.components
    row = (image.width * image.bits * n + 7) // 8
    if image.bits not in (1, 2, 4, 8, 16):
        raise Unsupported("bits per component")
    have = data[: row * image.height]
    missing = row * image.height - len(have)
    raw = np.frombuffer(have + (b"\xff" if image.bits == 1 and n == 1 else b"\0") * missing, np.uint8).reshape(image.height, row)
    if image.bits == 16:
        samples = raw.reshape(image.height, -1, 2)[:, :, 0].astype(np.uint16)
        top = 255
    elif image.bits == 8:
        samples, top = raw, 255
    else:
        bits = np.unpackbits(raw, axis=1).reshape(image.height, -1, image.bits)
        samples, top = bits @ (1 << np.arange(image.bits)[::-1]), (1 << image.bits) - 1
    samples = samples[:, : image.width * n].reshape(image.height, image.width, n)
    if image.space is not None and image.space.name == "Indexed":
        return _indexed(image.space, np.minimum(samples[:, :, 0], image.space.high))
    values = samples.astype(np.float64) / top
    for i in range(n):
        if len(image.decode) >= 2 * i + 2:
            lo, hi = image.decode[2 * i : 2 * i + 2]
            values[:, :, i] = np.clip(lo + values[:, :, i] * (hi - lo), 0, 1)
    return _to_device(values, image.space)


def _photograph(image: Image) -> np.ndarray:
    """JPEG samples through the image's colour space."""
    try:
        samples, inverted = jpeg.decode(image.data, image.parms.get("ColorTransform"))
    except (jpeg.Unsupported, struct.error, IndexError, ValueError) as e:
        raise Unsupported(f"JPEG: {e}") from None
    values = samples.astype(np.float64) / 255
    if inverted and not image.decode:
        values = 1 - values
    for i in range(values.shape[2]):
        if len(image.decode) >= 2 * i + 2:
            lo, hi = image.decode[2 * i : 2 * i + 2]
            values[:, :, i] = np.clip(lo + values[:, :, i] * (hi - lo), 0, 1)
    space = image.space if image.space is not None and image.space.components == values.shape[2] and image.space.name != "Indexed" else None
    return _to_device(values, space)


def _indexed(space: Space, index: np.ndarray) -> np.ndarray:
    n = space.base.components
    table = np.frombuffer(space.palette[: (space.high + 1) * n].ljust((space.high + 1) * n, b"\0"), np.uint8).reshape(1, -1, n)
    colours = _to_device(table.astype(np.float64) / 255, space.base)[0]
    return colours[index.astype(int)]


def _to_device(values: np.ndarray, space: Space | None) -> np.ndarray:
    if space is not None and space.tint is not None and space.base is not None:
        flat = values.reshape(-1, values.shape[2])
        unique, back = np.unique(np.round(flat * 255).astype(np.uint8), axis=0, return_inverse=True)
        mapped = np.array([space.tint([c / 255 for c in u]) for u in unique])
        return _to_device(mapped[back.ravel()].reshape(*values.shape[:2], -1), space.base)
    if values.shape[2] == 4:
        ink = values[:, :, 3:]
        values = (1 - values[:, :, :3]) * (1 - ink)
    elif values.shape[2] not in (1, 3):
        values = values[:, :, :1]
    return np.floor(np.clip(values, 0, 1) * 255 + 0.5).astype(np.uint8)
