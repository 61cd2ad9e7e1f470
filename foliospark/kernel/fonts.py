"""Fonts: from string bytes to texts and advances.

A simple font becomes two arrays of 256 entries, so a whole string is decoded by
array look-ups; composite fonts go code by code through their CMaps.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

from foliospark.kernel import encodings, filters
from foliospark.kernel.metrics import standard_widths
from foliospark.kernel.objects import Name, Ref, Scanner, Stream
from foliospark.kernel.reader import File

# ---- CMaps ------------------------------------------------------------------


@dataclass
class CMap:
    spaces: list[tuple[int, int, int]] = field(default_factory=list)  # (bytes, low, high)
    texts: dict[tuple[int, int], str] = field(default_factory=dict)  # (bytes, code)
    cids: dict[tuple[int, int], int] = field(default_factory=dict)
    cid_ranges: list[tuple[int, int, int, int]] = field(default_factory=list)
    vertical: bool = False
    identity: bool = False
    unicode_codec: str | None = None

    def codes(self, raw: bytes):
        """(bytes, code) one after another, by code space; one byte where none fits."""
        at, sizes = 0, sorted({s for s, _, _ in self.spaces}) or [2 if self.identity else 1]
        while at < len(raw):
            for size in sizes:
                piece = raw[at : at + size]
                code = int.from_bytes(piece, "big")
                if len(piece) == size and (not self.spaces or any(s == size and _inside(code, lo, hi, size) for s, lo, hi in self.spaces)):
                    break
            else:
                size, code = (1, raw[at]) if not self.identity else (2, int.from_bytes(raw[at : at + 2], "big"))
            yield size, code
            at += size

    def cid(self, size: int, code: int) -> int:
        if self.identity and not self.cids and not self.cid_ranges:
            return code
        found = self.cids.get((size, code))
        if found is not None:
            return found
        for s, lo, hi, first in self.cid_ranges:
            if s == size and lo <= code <= hi:
                return first + code - lo
        return code if self.identity else 0


def _inside(code: int, lo: int, hi: int, size: int) -> bool:
    return all((lo >> s & 255) <= (code >> s & 255) <= (hi >> s & 255) for s in range(0, 8 * size, 8))


MAX_ENTRIES = 100_000


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


def parse_cmap(data: bytes, resolve=None, depth: int = 0) -> CMap:
    out, scan = CMap(), Scanner(data, 0, references=False)
    last, entries = None, 0
    while True:
        token = scan.value()
        if token == "" and scan.at >= len(data):
            break
        if token == "usecmap" and isinstance(last, Name) and depth < 8:
            base = named_cmap(str(last), resolve, depth + 1)
            if base is not None:
                out.spaces = out.spaces or list(base.spaces)
                out.texts = base.texts | out.texts
                out.cids = base.cids | out.cids
                out.cid_ranges += base.cid_ranges
                out.vertical |= base.vertical
                out.identity |= base.identity
        elif isinstance(last, Name) and last == "WMode" and type(token) is int:
            out.vertical = token == 1
        elif isinstance(token, str) and token.startswith("begin") and token[5:] in ("codespacerange", "bfchar", "bfrange", "cidchar", "cidrange", "notdefrange"):
            kind, args = token[5:], []
            while True:
                item = scan.value()
                if isinstance(item, str) and not isinstance(item, Name):
                    break
                args.append(item)
            step = 2 if kind in ("codespacerange", "bfchar", "cidchar") else 3
            for i in range(0, len(args) - step + 1, step):
                entries += _entry(out, kind, args[i : i + step], MAX_ENTRIES - entries)
                if entries >= MAX_ENTRIES:
                    break
        last = token
    if not out.spaces and (out.texts or out.cids):
        out.spaces = [(s, 0, (1 << 8 * s) - 1) for s in sorted({k[0] for k in (*out.texts, *out.cids)})]
    return out


def _entry(out: CMap, kind: str, args: list, room: int) -> int:
    lo = args[0]
    if not isinstance(lo, bytes) or not 0 < len(lo) <= 4:
        return 0
    size, code = len(lo), int.from_bytes(lo, "big")
    if kind == "codespacerange":
        if isinstance(args[1], bytes):
            out.spaces.append((size, code, int.from_bytes(args[1], "big")))
        return 0
    if kind == "bfchar":
        if isinstance(args[1], bytes):
            out.texts[size, code] = _utf16(args[1])
        elif isinstance(args[1], Name):
            out.texts[size, code] = encodings.glyph_text(args[1])
        return 1
    if kind == "cidchar":
        if type(args[1]) is int:
            out.cids[size, code] = args[1]
        return 1
    if not isinstance(args[1], bytes):
        return 0
    last, to = int.from_bytes(args[1], "big"), args[2]
    if kind == "cidrange":
        if type(to) is int:
            out.cid_ranges.append((size, code, last, to))
        return 1
    if kind == "notdefrange":
        return 0
    count = min(last - code + 1, room, 65536)
    if isinstance(to, list):
        for i, t in enumerate(to[: max(count, 0)]):
            if isinstance(t, bytes):
                out.texts[size, code + i] = _utf16(t)
    elif isinstance(to, bytes) and to:
        head, tail = to[:-2], int.from_bytes(to[-2:], "big")
        for i in range(max(count, 0)):
            unit = (tail + i) & 0xFFFF
            out.texts[size, code + i] = _utf16(head + (unit.to_bytes(2, "big") if len(to) > 1 else bytes([unit & 255])))
    return max(count, 0)


def named_cmap(name: str, resolve=None, depth: int = 0) -> CMap | None:
    if name in ("Identity-H", "Identity-V"):
        return CMap([(2, 0, 0xFFFF)], vertical=name.endswith("V"), identity=True)
    m = re.fullmatch(r"Uni\w*-(UCS2|UTF16|UTF8|UTF32)(?:-HW)?-([HV])", name)
    if m:
        codec, sizes = {"UCS2": ("utf-16-be", (2,)), "UTF16": ("utf-16-be", (2, 4)), "UTF8": ("utf-8", (1, 2, 3, 4)), "UTF32": ("utf-32-be", (4,))}[m[1]]
        spaces = [(2, 0, 0xFFFF)] if sizes == (2,) else [(2, 0, 0xD7FF), (2, 0xE000, 0xFFFF), (4, 0xD800DC00, 0xDBFFDFFF)] if sizes == (2, 4) else [(4, 0, 0x10FFFF)] if sizes == (4,) else [(1, 0, 0x7F), (2, 0xC280, 0xDFBF), (3, 0xE08080, 0xEFBFBF), (4, 0xF0808080, 0xF4BFBFBF)]
        return CMap(spaces, vertical=m[2] == "V", identity=True, unicode_codec=codec)
    data = resolve(name) if resolve is not None and depth < 8 else None
    return parse_cmap(data, resolve, depth) if data else None


def load_cmap(file: File, value, resolve=None) -> CMap | None:
    value = file.get(value)
    if isinstance(value, Name):
        return named_cmap(str(value), resolve)
    if isinstance(value, Stream):
        try:
            data = file.body(value)
        except filters.Problem as e:
            data = e.kept
        cmap = parse_cmap(data, resolve)
        base = file.key(value, "UseCMap")
        under = load_cmap(file, base, resolve) if base is not None else None
        if under is not None:
            cmap.spaces = cmap.spaces or under.spaces
            cmap.texts, cmap.cids = under.texts | cmap.texts, under.cids | cmap.cids
        if file.key(value, "WMode") == 1:
            cmap.vertical = True
        return cmap
    return None


# ---- font programs, for text hints ------------------------------------------


def _sfnt_tables(data: bytes) -> list[tuple[tuple[int, int], dict[int, int]]]:
    """((platform, encoding), code -> glyph) of every cmap subtable, the least telling first."""
    start = struct.unpack(">I", data[12:16])[0] if data[:4] == b"ttcf" else 0
    tables = struct.unpack(">H", data[start + 4 : start + 6])[0]
    out = []
    for i in range(tables):
        tag, _, offset, length = struct.unpack(">4sIII", data[start + 12 + 16 * i : start + 28 + 16 * i])
        if tag == b"cmap":
            body = data[offset : offset + length]
            count = struct.unpack(">H", body[2:4])[0]
            for k in range(count):
                platform, encoding, at = struct.unpack(">HHI", body[4 + 8 * k : 12 + 8 * k])
                rank = {(3, 10): 4, (0, 4): 4, (3, 1): 3, (0, 3): 2, (3, 0): 1}.get((platform, encoding), 0 if platform == 0 else -1)
                out.append((rank, at, (platform, encoding), _subtable(body[at:])))
    return [(which, sub) for _, _, which, sub in sorted(out, key=lambda x: x[:3])]


def sfnt_map(data: bytes) -> dict[int, str]:
    """Glyph id -> text from a TrueType/OpenType cmap; ASCII first, then the lowest code."""
    codes: dict[int, int] = {}
    tables = _sfnt_tables(data)
    symbol = any(which == (3, 0) for which, _ in tables)
    mac = encodings.table("MacRomanEncoding")
    for which, sub in tables:
        if which == (1, 0) and not symbol:
            sub = {ord(mac[c]): g for c, g in sub.items() if c < 256 and mac[c]}
        elif which == (3, 0):
            sub = {c & 0xFF: g for c, g in sub.items() if c >> 8 in (0, 0xF0, 0xF1, 0xF2)}
        codes.update(sub)
    out: dict[int, str] = {}
    for code, glyph in sorted(codes.items(), key=lambda x: (not 32 <= x[0] < 127, x[0])):
        if glyph and code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            out.setdefault(glyph, chr(code))
    return out


def sfnt_bytes(data: bytes) -> dict[int, int]:
    """Byte -> glyph id: how a simple font's codes select glyphs, through Mac, symbol or Unicode subtables."""
    out: dict[int, int] = {}
    for which, sub in _sfnt_tables(data):
        if which[0] == 1:
            out |= {c: g for c, g in sub.items() if c < 256}
        else:
            out |= {c & 0xFF: g for c, g in sub.items() if 0xF000 <= c <= 0xF0FF and c & 0xFF not in sub}
            out |= {c: g for c, g in sub.items() if c < 256}
    return out


def _subtable(sub: bytes) -> dict[int, int]:
    kind = struct.unpack(">H", sub[:2])[0]
    out: dict[int, int] = {}
    if kind == 0:
        out = {c: g for c, g in enumerate(sub[6:262]) if g}
    elif kind == 4:
        n = struct.unpack(">H", sub[6:8])[0] // 2
        read = lambda at: struct.unpack(f">{n}H", sub[at : at + 2 * n])
        ends, starts, deltas, offsets = read(14), read(16 + 2 * n), read(16 + 4 * n), read(16 + 6 * n)
        for k in range(n):
            for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                if offsets[k] == 0:
                    g = (c + deltas[k]) & 0xFFFF
                else:
                    at = 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k])
                    g = struct.unpack(">H", sub[at : at + 2])[0] if at + 2 <= len(sub) else 0
                    g = (g + deltas[k]) & 0xFFFF if g else 0
                if g:
                    out[c] = g
    elif kind == 6:
        first, count = struct.unpack(">HH", sub[6:10])
        for i in range(min(count, (len(sub) - 10) // 2)):
            out[first + i] = struct.unpack(">H", sub[10 + 2 * i : 12 + 2 * i])[0]
    elif kind in (12, 13):
        for k in range(min(struct.unpack(">I", sub[12:16])[0], (len(sub) - 16) // 12)):
            lo, hi, g = struct.unpack(">III", sub[16 + 12 * k : 28 + 12 * k])
            for c in range(lo, min(hi, lo + 65535) + 1):
                out[c] = g + (c - lo if kind == 12 else 0)
    return out


def type1_encoding(data: bytes) -> dict[int, str]:
    head = data.split(b"eexec", 1)[0]
    return {int(c): t for c, n in re.findall(rb"dup\s+(\d+)\s*/([^\s/]+)\s+put", head) if int(c) < 256 and (t := encodings.glyph_text(n.decode("latin-1")))}


# Glyph names of the compact format's standard strings 150 to 170.
CFF_SPECIAL = "onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior registered minus eth multiply threesuperior copyright"
CFF_LETTERS = "acute circumflex dieresis grave ring tilde".split()


def _cff_standard() -> list[str]:
    """Texts of the standard strings 0 to 228: the standard encoding by code, some marks, accented capitals and small letters."""
    out = ["", *(t for t in encodings.table("StandardEncoding") if t)]
    out += [encodings.glyph_text(n) for n in CFF_SPECIAL.split()]
    letters = [f"{a}{m}" for a, marks in (("A", CFF_LETTERS), ("C", ["cedilla"]), ("E", CFF_LETTERS[:4]), ("I", CFF_LETTERS[:4]), ("N", ["tilde"]), ("O", [*CFF_LETTERS[:4], "tilde"]), ("S", ["caron"]), ("U", CFF_LETTERS[:4]), ("Y", ["acute", "dieresis"]), ("Z", ["caron"])) for m in marks]
    return out + [encodings.glyph_text(n) for n in (*letters, *(n[0].lower() + n[1:] for n in letters))]


def cff_encoding(data: bytes) -> dict[int, str]:
    """Code -> text of a bare compact font program, by its encoding, charset and strings."""

    def index(at: int) -> tuple[list[bytes], int]:
        count = struct.unpack(">H", data[at : at + 2])[0]
        if not count:
            return [], at + 2
        size = data[at + 2]
        if not 1 <= size <= 4:
            raise ValueError("bad offset size")
        marks = [int.from_bytes(data[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(count + 1)]
        base = at + 2 + (count + 1) * size
        return [data[base + a : base + b] for a, b in zip(marks, marks[1:])], base + marks[-1]

    def operands(raw: bytes) -> dict[int, list[int]]:
        out, stack, i = {}, [], 0
        while i < len(raw):
            b = raw[i]
            i += 1
            if b <= 21:
                if b == 12:
                    b = 1200 + raw[i]
                    i += 1
                out[b], stack = stack, []
            elif b == 28:
                stack.append(struct.unpack(">h", raw[i : i + 2])[0])
                i += 2
            elif b == 29:
                stack.append(struct.unpack(">i", raw[i : i + 4])[0])
                i += 4
            elif b == 30:  # a real number, of no use here
                while i < len(raw) and raw[i] & 15 != 15 and raw[i] >> 4 != 15:
                    i += 1
                i += 1
                stack.append(0)
            elif b <= 246:
                stack.append(b - 139)
            elif b <= 254:
                stack.append((b - 247) * 256 + raw[i] + 108 if b <= 250 else -(b - 251) * 256 - raw[i] - 108)
                i += 1
        return out

    _, at = index(data[2])
    tops, at = index(at)
    strings, _ = index(at)
    top = operands(tops[0])
    if 1230 in top:
        return {}
    standard = _cff_standard()

    def text(sid: int) -> str:
        if sid < len(standard):
            return standard[sid]
        return encodings.glyph_text(strings[sid - 391].decode("latin-1")) if 391 <= sid < 391 + len(strings) else ""

    glyphs = len(index(top[17][-1])[0])
    where = (top.get(15) or [0])[-1]
    if where in (1, 2):
        raise ValueError("expert character set")
    sids = list(range(glyphs))
    if where:
        kind, at, sids = data[where], where + 1, [0]
        while len(sids) < glyphs:
            first = struct.unpack(">H", data[at : at + 2])[0]
            at += 2
            left = 0
            if kind:
                left = int.from_bytes(data[at : at + kind], "big")
                at += kind
            sids += range(first, first + left + 1)
    where = (top.get(16) or [0])[-1]
    if where == 1:
        raise ValueError("expert encoding")
    if where == 0:
        return {}  # the standard encoding, which is the fallback anyway
    kind, count, at, out, glyph = data[where] & 127, data[where + 1], where + 2, {}, 1
    for _ in range(count):
        first, left = data[at], data[at + 1] if kind else 0
        at += 2 if kind else 1
        for code in range(first, first + left + 1):
            if glyph < len(sids) and code < 256:
                out[code] = text(sids[glyph])
            glyph += 1
    if data[where] & 128:
        for i in range(data[at]):
            code, sid = struct.unpack(">BH", data[at + 1 + 3 * i : at + 4 + 3 * i])
            out[code] = text(sid)
    return {c: t for c, t in out.items() if t}


# ---- fonts ------------------------------------------------------------------


@dataclass
class Font:
    composite: bool = False
    vertical: bool = False
    #: of simple fonts, by code
    texts: list[str] = field(default_factory=list)
    widths: np.ndarray | None = None
    #: Type3 em, as a factor of the font size
    em: float = 0.0
    warnings: list[str] = field(default_factory=list)
    # of composite fonts
    encoding: CMap | None = None
    to_unicode: CMap | None = None
    cid_widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 1000.0
    vertical_default: tuple[float, float] = (880.0, -1000.0)
    vertical_metrics: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    glyphs: dict[int, str] | None = None
    collection: dict[int, str] | None = None
    shown: dict[bool, list[str]] = field(default_factory=dict)
    _memo: dict[tuple[int, int], tuple] = field(default_factory=dict)

    def decode(self, raw: bytes):
        """Of composite fonts: (text, width, is space, vertical metrics) per code."""
        for size, code in self.encoding.codes(raw):
            found = self._memo.get((size, code))
            if found is None:
                found = self._memo[size, code] = self._resolve(size, code)
            yield found

    def _resolve(self, size: int, code: int):
        cid = self.encoding.cid(size, code)
        text = ""
        if self.to_unicode is not None:
            text = self.to_unicode.texts.get((size, code), "")
            if not encodings.sanitize(text) and self.to_unicode.identity and size == 2:
                text = chr(code) if not 0xD800 <= code <= 0xDFFF else ""
        if not encodings.sanitize(text) and self.encoding.unicode_codec:
            try:
                text = code.to_bytes(size, "big").decode(self.encoding.unicode_codec)
            except UnicodeDecodeError:
                text = ""
        if not encodings.sanitize(text):
            text = (self.glyphs or {}).get(cid) or (self.collection or {}).get(cid) or "�"
        width = self.cid_widths.get(cid, self.default_width)
        vy, w1 = self.vertical_default
        metrics = self.vertical_metrics.get(cid, (w1, width / 2, vy))
        return text, width, size == 1 and code == 32, metrics


# Fonts that forms may name without supplying them, and what viewers take for them.
STAND_INS = {"Helv": {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}, "ZaDb": {"Subtype": Name("Type1"), "BaseFont": Name("ZapfDingbats"), "Encoding": Name("ZapfDingbatsEncoding")}}


def stand_in(file: File, name: str) -> Font | None:
    return load(file, STAND_INS[name]) if name in STAND_INS else None


#: Fonts that their dictionary alone describes, by its entries: many files name the same few.
_BARE: dict[tuple, Font] = {}
MOST_BARE = 256


def load(file: File, info: dict, resolve=None, collections=None) -> Font:
    if set(info) <= {"Type", "Subtype", "BaseFont", "Encoding", "Name"} and all(isinstance(v, Name) for v in info.values()) and info.get("Subtype") in ("Type1", "TrueType"):
        key = tuple(str(info.get(k)) for k in ("Subtype", "BaseFont", "Encoding"))
        font = _BARE.get(key)
        if font is None:
            if len(_BARE) >= MOST_BARE:
                _BARE.clear()
            font = _BARE[key] = _simple(file, info, False, resolve)
        return font
    subtype = file.key(info, "Subtype")
    return _composite(file, info, resolve, collections) if subtype == "Type0" else _simple(file, info, subtype == "Type3", resolve)


def _numbers(file: File, value) -> list[float]:
    return [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0 for v in file.items(value)]


def _program(file: File, descriptor) -> tuple[str, bytes]:
    for key in ("FontFile2", "FontFile3", "FontFile"):
        stream = file.key(descriptor, key)
        if isinstance(stream, Stream):
            try:
                return key, file.body(stream)
            except filters.Problem as e:
                return key, e.kept
    return "", b""


def _composite(file: File, info: dict, resolve, collections) -> Font:
    font = Font(composite=True)
    font.to_unicode = load_cmap(file, info.get("ToUnicode"), resolve)
    font.encoding = load_cmap(file, info.get("Encoding"), resolve)
    known = font.encoding is not None
    if not known:
        spaces = font.to_unicode.spaces if font.to_unicode else []
        font.encoding = CMap(list(spaces) or [(2, 0, 0xFFFF)], identity=True)
        if file.get(info.get("Encoding")) is not None:
            font.warnings.append("encoding CMap cannot be read")
    font.vertical = font.encoding.vertical
    descendants = file.items(info.get("DescendantFonts"))
    child = descendants[0] if descendants and isinstance(descendants[0], dict) else {}
    width = file.key(child, "DW")
    font.default_width = float(width) if isinstance(width, (int, float)) else 1000.0
    font.cid_widths = {cid: w[0] for cid, w in _runs(file, child.get("W"), 1).items()}
    dw2 = _numbers(file, child.get("DW2"))
    if len(dw2) == 2:
        font.vertical_default = (dw2[0], dw2[1])
    font.vertical_metrics = {cid: (m[0], m[1], m[2]) for cid, m in _runs(file, child.get("W2"), 3).items()}
    key, data = _program(file, child.get("FontDescriptor"))
    if key == "FontFile2" and data:
        try:
            by_glyph = sfnt_map(data)
            mapping = file.key(child, "CIDToGIDMap")
            if isinstance(mapping, Stream):
                gids = file.body(mapping)
                font.glyphs = {i // 2: by_glyph[g] for i in range(0, len(gids) - 1, 2) if (g := gids[i] << 8 | gids[i + 1]) in by_glyph}
            else:
                font.glyphs = by_glyph
        except (struct.error, IndexError, filters.Problem):
            font.warnings.append("embedded font program cannot be read")
    system = file.key(child, "CIDSystemInfo")
    if known and collections and isinstance(system, dict):
        registry, ordering = (file.get(system.get(k)) for k in ("Registry", "Ordering"))
        if registry == b"Adobe" and isinstance(ordering, bytes):
            font.collection = collections.get(ordering.decode("latin-1"))
    return font


def _runs(file: File, value, width: int) -> dict[int, list[float]]:
    """/W and /W2 arrays: ``first [a b …]`` or ``first last a…``."""
    out: dict[int, list[float]] = {}
    items, at = file.items(value), 0
    while at + 1 < len(items):
        first, second = items[at], items[at + 1]
        if not isinstance(first, (int, float)):
            at += 1
        elif isinstance(second, list):
            numbers = _numbers(file, second)
            for i in range(0, len(numbers) - width + 1, width):
                out[int(first) + i // width] = numbers[i : i + width]
            at += 2
        else:
            values = [float(v) for v in items[at + 2 : at + 2 + width] if isinstance(v, (int, float))]
            if len(values) < width:
                break
            for cid in range(int(first), min(int(second), int(first) + 65535) + 1):
                out[cid] = values
            at += 2 + width
    return out


#: Codes that mean the same character in TeX's text encodings: printable ASCII up to z, less quotes, accents and inverted marks.
_TEX_CODES = frozenset(range(0x21, 0x7B)) - set(b'"<>\\^_')


def _differences(file: File, value, type3: bool) -> dict[int, str]:
    names: dict[int, str] = {}
    code = 0
    for item in file.items(value):
        if type(item) is int:
            code = item
        elif isinstance(item, Name):
            if 0 <= code < 256:
                names[code] = str(item)
            code += 1
    texts = {c: encodings.glyph_text(n) for c, n in names.items()}
    unnamed = [c for c, n in names.items() if n != ".notdef"]
    # Fonts that number glyphs in the order of use name every code below the space: their numbers mean nothing.
    first = re.fullmatch(r"([A-Za-z]{1,2})0+", names.get(0, ""))
    if first and all(re.fullmatch(rf"{first[1]}0*{c}", names.get(c, "")) for c in range(1, 32)):
        return texts
    # Names that only carry a code, such as G41 (hexadecimal) or C65 (decimal): believed on enough evidence.
    for pattern, base in ((r"[A-Za-z]{1,2}([0-9A-Fa-f]{2})", 16), (r"[A-Za-z]{1,2}(\d{2,3})", 10)):
        coded = {c: int(m[1], base) for c in unnamed if (m := re.fullmatch(pattern, names[c]))}
        agreeing = sum(v == c for c, v in coded.items())
        if len(coded) >= 3 and len(coded) >= 0.8 * len(unnamed) and agreeing >= 0.8 * len(coded):
            for c, v in coded.items():
                if not texts[c] and 32 <= v < 127:
                    texts[c] = chr(v)
            break
    # TeX's bitmap fonts name a glyph by its code.
    if type3:
        for c, n in names.items():
            if not texts[c] and n == f"a{c}" and c in _TEX_CODES:
                texts[c] = chr(c)
    return texts


def _simple(file: File, info: dict, type3: bool, resolve) -> Font:
    font = Font()
    unicode_map = load_cmap(file, info.get("ToUnicode"), resolve)
    entry = file.get(info.get("Encoding"))
    own = entry if isinstance(entry, dict) else {}
    differences = _differences(file, own.get("Differences"), type3)
    base_font = str(file.key(info, "BaseFont") or "")
    built_in = {"Symbol": "SymbolEncoding", "ZapfDingbats": "ZapfDingbatsEncoding"}.get(base_font.split("+", 1)[-1], "")
    flags = file.key(file.get(info.get("FontDescriptor")), "Flags")
    symbolic = type(flags) is int and flags & 4 and not flags & 32
    named = entry if isinstance(entry, Name) else file.get(own.get("BaseEncoding"))
    known = ("WinAnsiEncoding", "MacRomanEncoding", "SymbolEncoding", "ZapfDingbatsEncoding")
    first = True
    if type3:
        fallback = str(named) if named in (*known[:2], "StandardEncoding") and own else None
        if fallback:
            differences = {c: t for c, t in differences.items() if t}
    elif named in known:
        fallback = str(named)
    elif isinstance(entry, Name):
        fallback, first = "", False
    elif built_in:
        fallback = built_in
    elif symbolic:
        fallback, first = "", False
    else:
        fallback = "StandardEncoding"
    hints: dict[int, str] = {}
    if not type3:
        hints = _simple_hints(file, info, font)
    under = encodings.table(fallback) if fallback is not None else ("",) * 256
    for code in range(256):
        text = unicode_map.texts.get((1, code), "") if unicode_map else ""
        if not text and unicode_map and unicode_map.identity:
            text = ""
        if not encodings.sanitize(text, False):
            if code in differences:
                text = differences[code]
            elif first and under[code]:
                text = under[code]
            elif encodings.sanitize(hints.get(code, ""), False):
                text = hints[code]
            else:
                text = under[code] if fallback is not None else "�"
        font.texts.append(text)
    scale = 1.0
    if type3:
        matrix = _numbers(file, info.get("FontMatrix"))
        if len(matrix) != 6 or not matrix[0] or not matrix[3]:
            matrix = [0.001, 0, 0, 0.001, 0, 0]
        scale = matrix[0] * 1000
        box = _numbers(file, info.get("FontBBox"))
        height = abs(box[3] - box[1]) if len(box) == 4 else 0.0
        given = sorted(w for w in _numbers(file, info.get("Widths")) if w > 0)
        font.em = abs(height * matrix[3]) or (2 * given[len(given) // 2] * abs(matrix[0]) if given else 1.0)
    start = file.key(info, "FirstChar")
    start = start if type(start) is int else 0
    widths = [w * scale for w in _numbers(file, info.get("Widths"))]
    missing = file.key(file.get(info.get("FontDescriptor")), "MissingWidth")
    default = float(missing) * scale if isinstance(missing, (int, float)) and not isinstance(missing, bool) else 500.0
    standard = standard_widths(base_font) if not isinstance(file.get(info.get("Widths")), list) and not type3 else None
    out = np.full(256, default)
    for code in range(256):
        i = code - start
        if 0 <= i < len(widths) and widths[i] > 0:
            out[code] = widths[i]
        elif isinstance(standard, float):
            out[code] = standard
        elif isinstance(standard, list):
            out[code] = standard[code] or default
        elif standard is not None:
            out[code] = standard.get(font.texts[code], default)
    font.widths = out
    return font


def _simple_hints(file: File, info: dict, font: Font) -> dict[int, str]:
    key, data = _program(file, info.get("FontDescriptor"))
    if not data:
        return {}
    try:
        if key == "FontFile2" or data[:4] in (b"\0\1\0\0", b"OTTO", b"true", b"ttcf"):
            by_glyph = sfnt_map(data)
            return {code: by_glyph[g] for code, g in sfnt_bytes(data).items() if g in by_glyph}
        return cff_encoding(data) if key == "FontFile3" else type1_encoding(data)
    except (struct.error, IndexError, ValueError, KeyError):
        font.warnings.append("embedded font program cannot be read")
        return {}


def reference_number(value) -> int | None:
    return value.number if isinstance(value, Ref) else None
