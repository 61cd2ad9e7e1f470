"""Codes and glyph names to text.

Tables are made by rule wherever a rule exists: code pages come from Python's
codecs, accented letters from the names of the Unicode character database, and
only what follows no rule is listed.
"""

from __future__ import annotations

import re
from functools import lru_cache

from foliospark.kernel import glyph_names

# Upper half of StandardEncoding (code in octal: glyph name).
STANDARD_UPPER = (
    "241 exclamdown 242 cent 243 sterling 244 fraction 245 yen 246 florin 247 section 250 currency 251 quotesingle 252 quotedblleft 253 guillemotleft 254 guilsinglleft 255 guilsinglright 256 fi 257 fl "
    "261 endash 262 dagger 263 daggerdbl 264 periodcentered 266 paragraph 267 bullet 270 quotesinglbase 271 quotedblbase 272 quotedblright 273 guillemotright 274 ellipsis 275 perthousand 277 questiondown "
    "301 grave 302 acute 303 circumflex 304 tilde 305 macron 306 breve 307 dotaccent 310 dieresis 312 ring 313 cedilla 315 hungarumlaut 316 ogonek 317 caron 320 emdash 341 AE 343 ordfeminine 350 Lslash 351 Oslash 352 OE 353 ordmasculine "
    "361 ae 365 dotlessi 370 lslash 371 oslash 372 oe 373 germandbls"
)
# PDFDocEncoding where it is not Latin-1.
PDFDOC_LOW = "˘ˇˆ˙˝˛˚˜"
PDFDOC_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
# The Symbol font's letters by code order, and its marks.
SYMBOL_UPPER = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ"
SYMBOL_LOWER = "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"
SYMBOL_OTHER = {0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2A: "∗", 0x2D: "−", 0x40: "≅", 0x5C: "∴", 0x5E: "⊥", 0x7E: "∼", 0xA0: "€"}
SYMBOL_HIGH = "ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…"
SYMBOL_TOP = "ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑"

# Glyph names that follow no rule.
IRREGULAR = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ",
    "section": "§", "currency": "¤", "quotedblleft": "“", "guillemotleft": "«", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "endash": "–", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "paragraph": "¶", "bullet": "•",
    "quotesinglbase": "‚", "quotedblbase": "„", "quotedblright": "”", "guillemotright": "»", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿", "acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸",
    "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "emdash": "—", "AE": "Æ", "ordfeminine": "ª", "Lslash": "Ł", "Oslash": "Ø", "OE": "Œ", "ordmasculine": "º", "ae": "æ", "dotlessi": "ı", "lslash": "ł", "oslash": "ø", "oe": "œ", "germandbls": "ß", "quoteleft": "‘", "quoteright": "’",
    "trademark": "™", "registered": "®", "copyright": "©", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "logicalnot": "¬", "minus": "−", "mu": "µ", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "brokenbar": "¦",
    "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Dcroat": "Đ", "dcroat": "đ", "Euro": "€", "nbspace": " ", "sfthyphen": "­", "softhyphen": "­", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "integral": "∫", "approxequal": "≈", "lozenge": "◊", "arrowleft": "←", "arrowright": "→", "arrowup": "↑", "arrowdown": "↓", "element": "∈", "emptyset": "∅", "universal": "∀", "existential": "∃", "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ", "Upsilon1": "ϒ", "checkmark": "✓",
}

@lru_cache(maxsize=4096)
def component(name: str) -> str:
    """Text of one glyph name without suffix, '' where it says nothing."""
    if name in IRREGULAR:
        return IRREGULAR[name]
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name)
    if m:
        units = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)]
        return "" if any(0xD800 <= u <= 0xDFFF for u in units) else "".join(map(chr, units))
    m = re.fullmatch(r"u([0-9A-F]{4,6})", name)
    if m:
        u = int(m[1], 16)
        return chr(u) if u <= 0x10FFFF and not 0xD800 <= u <= 0xDFFF else ""
    return glyph_names.by_rule(name, component)


@lru_cache(maxsize=4096)
def glyph_text(name: str) -> str:
    """Text of a glyph name: the part before a dot, ligature parts joined."""
    base = name.split(".", 1)[0]
    return "".join(component(p) for p in base.split("_")) if base else ""


@lru_cache
def table(name: str) -> tuple[str, ...]:
    """256 texts of a named encoding, '' for unused codes; an unknown name gives printable ASCII."""
    ascii_half = [chr(c) if 32 <= c < 127 else "" for c in range(128)]
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        upper = []
        for c in range(128, 256):
            try:
                upper.append(bytes([c]).decode(codec))
            except UnicodeDecodeError:
                upper.append("•")
        if codec == "cp1252":
            ascii_half[127] = "•"
            upper[0xAD - 128] = "-"
        return tuple(ascii_half + upper)
    if name == "StandardEncoding":
        upper = [""] * 128
        words = STANDARD_UPPER.split()
        for code, glyph in zip(words[::2], words[1::2]):
            upper[int(code, 8) - 128] = IRREGULAR[glyph]
        ascii_half[39], ascii_half[96] = "’", "‘"
        return tuple(ascii_half + upper)
    if name == "PDFDocEncoding":
        out = [chr(c) for c in range(256)]
        out[0x18:0x20] = PDFDOC_LOW
        out[0x80 : 0x80 + len(PDFDOC_HIGH)] = PDFDOC_HIGH
        out[0x9F], out[0xA0] = "", "€"
        return tuple(out)
    if name == "SymbolEncoding":
        out = ascii_half + [""] * 128
        out[0x41:0x5B], out[0x61:0x7B] = SYMBOL_UPPER, SYMBOL_LOWER
        for code, text in SYMBOL_OTHER.items():
            out[code] = text
        out[0xA1 : 0xA1 + len(SYMBOL_HIGH)] = SYMBOL_HIGH
        out[0xC0 : 0xC0 + len(SYMBOL_TOP)] = SYMBOL_TOP
        return tuple(out)
    if name == "ZapfDingbatsEncoding":
        out = [""] * 256
        out[0x20] = " "
        for code in range(0x21, 0x7F):
            out[code] = chr(0x2700 + code - 0x20)
        for code, text in {0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗"}.items():
            out[code] = text
        for code in range(0xA1, 0xFF):
            out[code] = chr(0x2700 + code - 0x40)
        for i in range(10):
            out[0xAC + i] = chr(0x2460 + i)
        for code, text in {0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠", 0xD5: "→", 0xD6: "↔", 0xD7: "↕", 0xF0: ""}.items():
            out[code] = text
        return tuple(out)
    return tuple(ascii_half + [""] * 128)


def text_string(raw: bytes) -> str:
    """A text string: by its byte order mark, or PDFDocEncoding."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw[2:].decode("utf-16-be" if raw[0] == 0xFE else "utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        try:
            return raw[3:].decode("utf-8")
        except UnicodeDecodeError:
            pass
    doc = table("PDFDocEncoding")
    return "".join(doc[b] for b in raw)


_LIGATURES = {0xFB00 + i: t for i, t in enumerate(("ff", "fi", "fl", "ffi", "ffl", "st", "st"))}
_JUNK = {c: None for c in (0xFFFD, *range(0x20), *range(0x7F, 0xA0))} | {0xA0: " ", 0x09: " "}
_PRIVATE = re.compile("[\ue000-\uf8ff]")


def sanitize(text: str, fold: bool = True) -> str:
    """Text without unmapped, control and private-use characters; ligatures spelt out if asked."""
    if text.isascii() and text.isprintable():
        return text
    text = _PRIVATE.sub("", text.translate(_JUNK))
    return text.translate(_LIGATURES) if fold else text
