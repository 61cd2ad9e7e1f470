"""Example files for single features: composite fonts, spacing, image kinds, tints, filters, forms."""

from __future__ import annotations

import base64
import zlib

import numpy as np

from foliospark.kernel import builder as b


def page(content: bytes, resources: str, more: dict[int, bytes], attributes: str = "", extra: str = "") -> bytes:
    """One page with its content in object 5; ``more`` brings the other objects."""
    objects = b.page_tree(1, 4, resources, extra=extra)
    if attributes:
        objects[4] = f"<</Type /Page /Parent 2 0 R /Contents 5 0 R {attributes}>>".encode()
    return b.classic(objects | {5: b.stream("", content)} | more)


# ---- composite fonts ---------------------------------------------------------


def composite(encoding: str, child: str, first: int, to_unicode: str | None = None) -> dict[int, bytes]:
    """A Type0 font as object ``first``, its descendant and its ToUnicode CMap behind it."""
    mapped = f"/ToUnicode {first + 2} 0 R" if to_unicode else ""
    out = {
        first: f"<</Type /Font /Subtype /Type0 /BaseFont /Example /Encoding /{encoding} /DescendantFonts [{first + 1} 0 R] {mapped}>>".encode(),
        first + 1: f"<</Type /Font /Subtype /CIDFontType2 /BaseFont /Example /CIDSystemInfo <</Registry (Adobe) /Ordering (Identity) /Supplement 0>> {child}>>".encode(),
    }
    return out | ({first + 2: b.stream("", to_unicode.encode())} if to_unicode else {})


def codes(text: str) -> bytes:
    return b"<" + text.encode("utf-16-be").hex().encode() + b">"


#: Two-byte codes are the characters themselves, by one range for each 256 codes.
WIDE_CMAP = "1 begincodespacerange <0000> <FFFF> endcodespacerange\n5 beginbfrange\n" + "".join(f"<{h:02X}00> <{h:02X}FF> <{h:02X}00>\n" for h in range(5)) + "endbfrange"


def wide_pdf(text: str) -> bytes:
    """A text in a composite font, 600 wide, with a ToUnicode CMap: no character is lost to a code page."""
    show = lambda lines: b"BT /F1 10 Tf\n" + b"\n".join(b"1 0 0 1 72 %d Tm %s Tj" % (720 - 14 * k, codes(line)) for k, line in enumerate(lines)) + b"\nET"

    def build(objects: dict[int, bytes]) -> bytes:
        fonts = composite("Identity-H", "/DW 600", max(objects) + 1, WIDE_CMAP)
        return b.classic(objects | {3: fonts.pop(max(objects) + 1)} | fonts)

    return b.text_pdf(text, content=show, build=build)


def cid_widths_pdf(name: str) -> bytes:
    """Digits 500 wide, capitals 700, a space 250, everything else 400."""
    child = "/DW 400 /W [32 [250] 48 57 500 65 90 700]"
    return page(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm %s Tj ET" % codes(name), "/Font <</F1 6 0 R>>", composite("Identity-H", child, 6, WIDE_CMAP))


def vertical_pdf(name: str) -> bytes:
    return page(b"BT /F1 10 Tf 1 0 0 1 300 700 Tm %s Tj ET" % codes(name), "/Font <</F1 6 0 R>>", composite("Identity-V", "/DW 1000 /DW2 [880 -1200]", 6, WIDE_CMAP))


def unicode_cmap_pdf(name: str) -> bytes:
    """A predefined Unicode encoding and no ToUnicode CMap."""
    return page(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm %s Tj ET" % codes(name), "/Font <</F1 6 0 R>>", composite("UniGB-UCS2-H", "/DW 600", 6))


# ---- simple fonts ------------------------------------------------------------


def spaced_pdf(name: str) -> bytes:
    """Two more points behind every character, five behind a space, all at half width."""
    return page(b"BT /F1 10 Tf 2 Tc 5 Tw 50 Tz 1 0 0 1 72 700 Tm %s Tj ET" % b.literal(name), "/Font <</F1 6 0 R>>", {6: b.COURIER})


def named_glyph_pdf(glyph: str) -> bytes:
    font = f"<</Type /Font /Subtype /Type1 /BaseFont /Example /Encoding <</Differences [65 /{glyph}]>> /FirstChar 65 /Widths [600]>>".encode()
    return page(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (A) Tj ET", "/Font <</F1 6 0 R>>", {6: font})


def face_pdf(face: str, shown: str) -> bytes:
    encoding = "" if face in ("Symbol", "ZapfDingbats") else "/Encoding /WinAnsiEncoding"
    return page(b"BT /F1 100 Tf 1 0 0 1 72 700 Tm %s Tj ET" % b.literal(shown), "/Font <</F1 6 0 R>>", {6: f"<</Type /Font /Subtype /Type1 /BaseFont /{face} {encoding}>>".encode()})


# ---- images ------------------------------------------------------------------


def image(attributes: str, data: bytes, more: dict[int, bytes] | None = None) -> bytes:
    """An 8 by 8 image over the page."""
    own = b.flate(f"/Type /XObject /Subtype /Image /Width 8 /Height 8 {attributes}", data)
    return page(b"q 80 0 0 80 100 200 cm /I Do Q", "/XObject <</I 6 0 R>>", {6: own} | (more or {}))


def packed(values: list[int], bits: int) -> bytes:
    joined = "".join(format(v, f"0{bits}b") for v in values)
    return int(joined, 2).to_bytes(len(joined) // 8, "big")


def grey_pdf(pixels: list[int], bits: int, decode: str = "") -> bytes:
    """Grey levels of 0 to 254 at fewer or more bits."""
    data = b"".join(bytes([p, 7]) for p in pixels) if bits == 16 else packed([p >> (8 - bits) for p in pixels], bits)
    return image(f"/BitsPerComponent {bits} /ColorSpace /DeviceGray {decode}", data)


def coloured_pdf(pixels: list[int], space: str) -> bytes:
    each = (lambda p: bytes([p, 254 - p, 9])) if space == "DeviceRGB" else (lambda p: bytes([p, 0, 0, 0]))
    return image(f"/BitsPerComponent 8 /ColorSpace /{space}", b"".join(map(each, pixels)))


def indexed_pdf(pixels: list[int]) -> bytes:
    return image("/BitsPerComponent 8 /ColorSpace [/Indexed /DeviceGray 3 <0A3C6EFA>]", bytes(p >> 6 for p in pixels))


def inline_pdf(pixels: list[int]) -> bytes:
    return page(b"q 80 0 0 80 100 200 cm BI /W 8 /H 8 /BPC 8 /CS /G ID " + bytes(pixels) + b" EI Q", "", {})


#: Tints of a separation, as functions of ink.
TINTS = {
    "power": (b"<</FunctionType 2 /Domain [0 1] /C0 [0.9] /C1 [0.1] /N 2>>",),
    "stitched": (b"<</FunctionType 3 /Domain [0 1] /Bounds [0.5] /Encode [0 1 0 1] /Functions [8 0 R 9 0 R]>>", b"<</FunctionType 2 /Domain [0 1] /C0 [0] /C1 [1] /N 1>>", b"<</FunctionType 2 /Domain [0 1] /C0 [1] /C1 [0] /N 1>>"),
    "sampled": (b.stream("/FunctionType 0 /Domain [0 1] /Range [0 1] /Size [3] /BitsPerSample 8", bytes([0, 255, 51])),),
    "calculator": (b.stream("/FunctionType 4 /Domain [0 1] /Range [0 1]", b"{ dup mul 1 exch sub }"),),
}


def tint_pdf(pixels: list[int], kind: str) -> bytes:
    return image("/BitsPerComponent 8 /ColorSpace [/Separation /Ink /DeviceGray 7 0 R]", bytes(pixels), {7 + i: f for i, f in enumerate(TINTS[kind])})


# ---- containers and filters ---------------------------------------------------


def chained_pdf(text: str) -> bytes:
    return b.text_pdf(text, wrap=lambda a, d: b.stream(f"{a} /Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(d)) + b"~>"))


def tiff_pdf(text: str) -> bytes:
    """Bytes as differences to the one before, in rows of sixteen."""

    def differ(data: bytes) -> bytes:
        data += b" " * (-len(data) % 16)
        return b"".join(bytes([row[0], *((x - y) & 255 for x, y in zip(row[1:], row))]) for row in (data[i : i + 16] for i in range(0, len(data), 16)))

    return b.text_pdf(text, wrap=lambda a, d: b.flate(f"{a} /DecodeParms <</Predictor 2 /Columns 16>>", differ(d)))


def png_mixed_pdf(text: str) -> bytes:
    """Rows of sixteen by the five row filters in turn."""

    def encode(data: bytes) -> bytes:
        rows = np.frombuffer(data + b" " * (-len(data) % 16), np.uint8).reshape(-1, 16).astype(np.int16)
        around = np.zeros((len(rows) + 1, 17), np.int16)
        around[1:, 1:] = rows
        left, above, corner = around[1:, :-1], around[:-1, 1:], around[:-1, :-1]
        kind = np.arange(len(rows)) % 5
        near = np.stack([np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)])
        paeth = np.choose(near.argmin(0), [left, above, corner])
        guess = np.choose(kind[:, None], [np.zeros_like(rows), left, above, (left + above) // 2, paeth])
        return np.concatenate([kind[:, None], rows - guess & 255], axis=1).astype(np.uint8).tobytes()

    return b.text_pdf(text, wrap=lambda a, d: b.flate(f"{a} /DecodeParms <</Predictor 15 /Columns 16>>", encode(d)))


# ---- pages and forms ----------------------------------------------------------


def boxes_pdf(width: int) -> bytes:
    """Size and rotation inherited from the tree, an own crop box with its corners swapped."""
    objects = b.page_tree(1, 4, "", box=f"0 0 {width} 500", extra="")
    objects[2] = objects[2].replace(b"/Type /Pages", b"/Type /Pages /Rotate -90")
    objects[4] = f"<</Type /Page /Parent 2 0 R /Contents 5 0 R /CropBox [{width - 10} 480 10 20]>>".encode()
    return b.classic(objects | {5: b.stream("", b"")})


def state_pdf(name: str, chosen: int) -> bytes:
    """A check box whose appearance depends on its state."""
    form = lambda text: b.stream("/Type /XObject /Subtype /Form /BBox [0 0 100 20] /Resources <</Font <</F1 6 0 R>>>>", b"BT /F1 10 Tf 1 0 0 1 2 5 Tm %s Tj ET" % b.literal(text))
    note = f"<</Type /Annot /Subtype /Widget /FT /Btn /T (box) /Rect [100 100 200 120] /AS /{'Yes' if chosen else 'Off'} /AP <</N <</Yes 7 0 R /Off 8 0 R>>>>>>"
    return page(b"", "", {6: b.COURIER, 7: form(f"{name} yes"), 8: form(f"{name} no")}, attributes=f"/Annots [{note}]")


def fitted_outline_pdf(title: str, level: int) -> bytes:
    """Bookmarks that fit a width, a height and a rectangle."""
    objects = b.page_tree(1, 4, "", extra="/Outlines 10 0 R")
    kinds = (f"/FitH {level}", f"/FitV {level}", f"/FitR 1 2 3 {level}")
    objects |= {5: b.stream("", b""), 10: b"<</First 11 0 R /Last 13 0 R>>"}
    for i, kind in enumerate(kinds):
        following = f"/Next {12 + i} 0 R" if i < 2 else ""
        objects[11 + i] = b"<</Title %s /Parent 10 0 R /Dest [4 0 R %s] %s>>" % (b.literal(title), kind.encode(), following.encode())
    return b.classic(objects)
