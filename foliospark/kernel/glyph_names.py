"""Glyph names to text, by rule from the names of the Unicode character database.

A name is a base and words behind it: accents on a Latin or Greek letter, the
name of a script, or what is done to a sign (circled, raised, full width).  The
rules squeeze the database's own names into that form.  Only names that follow
no rule are listed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Signs whose names follow no rule, beside those of the base encodings.
SIGNS = {
    "gradient": "∇", "therefore": "∴", "similar": "∼", "congruent": "≅", "equivalence": "≡", "propersubset": "⊂", "reflexsubset": "⊆", "notsubset": "⊄", "propersuperset": "⊃", "reflexsuperset": "⊇", "intersection": "∩", "union": "∪", "logicaland": "∧", "logicalor": "∨", "angle": "∠", "perpendicular": "⊥", "proportional": "∝",
    "weierstrass": "℘", "aleph": "ℵ", "Ifraktur": "ℑ", "Rfraktur": "ℜ", "circlemultiply": "⊗", "circleplus": "⊕", "suchthat": "∋", "asteriskmath": "∗", "dotmath": "⋅", "angleleft": "〈", "angleright": "〉", "notelement": "∉", "orthogonal": "∟", "revlogicalnot": "⌐", "integraltp": "⌠", "integralbt": "⌡", "congruentmod": "≅",
    "arrowboth": "↔", "arrowupdn": "↕", "arrowupdnbse": "↨", "arrowdblleft": "⇐", "arrowdblup": "⇑", "arrowdblright": "⇒", "arrowdbldown": "⇓", "arrowdblboth": "⇔", "carriagereturn": "↵", "club": "♣", "diamond": "♦", "heart": "♥", "spade": "♠", "female": "♀", "male": "♂", "musicalnote": "♪", "musicalnotedbl": "♫", "sun": "☼", "smileface": "☺", "invsmileface": "☻",
    "filledbox": "■", "filledrect": "▬", "triagup": "▲", "triagdn": "▼", "triagrt": "►", "triaglf": "◄", "circle": "○", "openbullet": "◦", "invbullet": "◘", "invcircle": "◙", "H18533": "●", "H18543": "▪", "H18551": "▫", "H22073": "□", "house": "⌂", "block": "█", "dnblock": "▄", "upblock": "▀", "lfblock": "▌", "rtblock": "▐", "ltshade": "░", "shade": "▒", "dkshade": "▓",
    "lira": "₤", "franc": "₣", "peseta": "₧", "colonmonetary": "₡", "dong": "₫", "won": "₩", "minute": "′", "second": "″", "underscoredbl": "‗", "exclamdbl": "‼", "quotereversed": "‛", "onedotenleader": "․", "twodotenleader": "‥", "estimated": "℮", "prescription": "℞", "ohm": "Ω", "numero": "№", "longs": "ſ", "napostrophe": "ŉ", "kgreenlandic": "ĸ", "Eng": "Ŋ", "eng": "ŋ", "IJ": "Ĳ", "ij": "ĳ", "schwa": "ə", "Schwa": "Ə",
    "Hbar": "Ħ", "hbar": "ħ", "Tbar": "Ŧ", "tbar": "ŧ", "Ldot": "Ŀ", "ldot": "ŀ", "Dslash": "Đ", "Scommaaccent": "Ș", "scommaaccent": "ș", "Delta": "∆", "Omega": "Ω", "mu": "µ", "fivethirds": "", "dotlessj": "ȷ", "Idotaccent": "İ", "overline": "‾", "figuredash": "‒", "horizontalbar": "―", "afii00208": "―", "afii08941": "₤", "afii61248": "℅", "afii61289": "ℓ", "afii61352": "№", "afii61664": "‌", "afii57929": "ʼ", "afii64937": "ʽ",
}
# Numbered glyphs as runs of first number and the texts in order, · for none.
AFII = (
    (10017, "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯҐЂЃЄЅІЇЈЉЊЋЌЎ"), (10065, "абвгдеёжзийклмнопрстуфхцчшщъыьэюяґђѓєѕіїјљњћќў"), (10145, "ЏѢѲѴ"), (10193, "џѣѳѵ"), (10846, "ә"),
    (57392, "٠١٢٣٤٥٦٧٨٩"), (57403, "؛"), (57407, "؟"), (57388, "،"), (57409, "ءآأؤإئابةتثجحخدذرزسشصضطظعغ"), (57440, "ـفقكلمن·وىيًٌٍَُِّْ"), (57470, "ه"), (57505, "ڤپچژگ·ٹڈڑں"), (57519, "ے"), (57534, "ە"),
    (57636, "₪"), (57645, "־"), (57658, "׃"), (57664, "אבגדהוזחטיךכלםמןנסעףפץצקרשת"), (57716, "װױײ"), (57793, "ְֱֲֳִֵֶַָֻׁׂ"), (57806, "ֹּ"), (57839, "ֽ"), (57841, "ֿ׀"),
)
# Numbers of the box drawing glyphs (SF....0000), in order, and their texts.
BOXES = "01 02 03 04 05 06 07 08 09 10 11 19 20 21 22 23 24 25 26 27 28 36 37 38 39 40 41 42 43 44 45 46 47 48 49 50 51 52 53 54"
BOX_TEXTS = "┌└┐┘┼┬┴├┤─│╡╢╖╕╣║╗╝╜╛╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪"

#: Words behind a letter, as the database says them.
ACCENTS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "dot": "DOT ABOVE", "dotbelow": "DOT BELOW", "hookabove": "HOOK ABOVE", "hook": "HOOK", "horn": "HORN", "hungarumlaut": "DOUBLE ACUTE",
    "dblacute": "DOUBLE ACUTE", "dblgrave": "DOUBLE GRAVE", "invertedbreve": "INVERTED BREVE", "linebelow": "LINE BELOW", "ringbelow": "RING BELOW", "circumflexbelow": "CIRCUMFLEX BELOW", "dieresisbelow": "DIAERESIS BELOW", "tildebelow": "TILDE BELOW", "brevebelow": "BREVE BELOW", "commaaccent": "CEDILLA", "stroke": "STROKE", "slash": "STROKE", "bar": "STROKE", "topbar": "TOPBAR", "curl": "CURL", "retroflexhook": "RETROFLEX HOOK",
    "tonos": "TONOS", "dialytika": "DIALYTIKA", "middletilde": "MIDDLE TILDE",
}
_ACCENT_WORDS = sorted(ACCENTS, key=len, reverse=True)
#: Names of combining marks where the database says more than the accent's words.
COMBINING = {"grave": "GRAVE ACCENT", "acute": "ACUTE ACCENT", "circumflex": "CIRCUMFLEX ACCENT", "hookabove": "HOOK ABOVE", "hungarumlaut": "DOUBLE ACUTE ACCENT", "dblgrave": "DOUBLE GRAVE ACCENT"}

#: Suffix of a script: beginnings of its characters' names in the database, and the blocks to look through.
SCRIPTS = {
    "arabic": (("ARABIC LETTER ", "ARABIC "), ((0x600, 0x700), (0xFB50, 0xFE00), (0xFE70, 0xFF00))), "hebrew": (("HEBREW LETTER ", "HEBREW POINT ", "HEBREW PUNCTUATION ", "HEBREW "), ((0x590, 0x600), (0xFB1D, 0xFB50))), "thai": (("THAI CHARACTER ", "THAI "), ((0xE00, 0xE80),)),
    "deva": (("DEVANAGARI LETTER ", "DEVANAGARI "), ((0x900, 0x980),)), "bengali": (("BENGALI LETTER ", "BENGALI "), ((0x980, 0xA00),)), "gujarati": (("GUJARATI LETTER ", "GUJARATI "), ((0xA80, 0xB00),)), "gurmukhi": (("GURMUKHI LETTER ", "GURMUKHI "), ((0xA00, 0xA80),)), "bopomofo": (("BOPOMOFO LETTER ",), ((0x3100, 0x3130),)),
    "armenian": (("ARMENIAN SMALL LETTER ", "ARMENIAN "), ((0x530, 0x590),)), "cyrillic": (("CYRILLIC SMALL LETTER ", "CYRILLIC "), ((0x400, 0x530),)), "coptic": (("COPTIC SMALL LETTER ",), ((0x3E2, 0x3F0),)), "greek": (("GREEK SMALL LETTER ", "GREEK "), ((0x370, 0x400),)),
    "hiragana": (("HIRAGANA LETTER ", "HIRAGANA "), ((0x3040, 0x30A0),)), "katakana": (("KATAKANA LETTER ", "KATAKANA "), ((0x30A0, 0x3100),)), "katakanahalfwidth": (("HALFWIDTH KATAKANA LETTER ",), ((0xFF61, 0xFFA0),)), "korean": (("HANGUL LETTER ",), ((0x3130, 0x3190),)),
    "parenkorean": (("PARENTHESIZED HANGUL ",), ((0x3200, 0x3220),)), "circlekorean": (("CIRCLED HANGUL ",), ((0x3260, 0x3280),)),
}
#: Parts of names that glyphs spell otherwise than the database: {script: {glyph: database}}.
SPELT = {
    "cyrillic": {"ge": "ghe", "ii": "i", "iishort": "shorti", "kha": "ha", "yeri": "yeru", "ereversed": "e", "iu": "yu", "ia": "ya", "ushort": "shortu"},
    "hiragana": {"shi": "si", "chi": "ti", "tsu": "tu", "fu": "hu", "ji": "zi", "di": "di", "tsusmall": "tusmall", "vu": "vu"},
    "katakana": {"shi": "si", "chi": "ti", "tsu": "tu", "fu": "hu", "ji": "zi", "tsusmall": "tusmall"},
    "katakanahalfwidth": {"shi": "si", "chi": "ti", "tsu": "tu", "fu": "hu", "tsusmall": "tusmall"},
    "greek": {"lambda": "lamda"},
}


@lru_cache
def _script(suffix: str) -> dict[str, str]:
    """Squeezed name -> character of the script, small letters and uncased ones; ``+name`` for capitals."""
    heads, blocks = SCRIPTS[suffix]
    out: dict[str, str] = {}
    for lo, hi in blocks:
        for c in range(lo, hi):
            name = unicodedata.name(chr(c), "")
            capital = " CAPITAL LETTER " in name
            name = name.replace(" CAPITAL LETTER ", " SMALL LETTER ") if capital else name
            head = next((h for h in heads if name.startswith(h)), None)
            if head is None:
                continue
            rest = name[len(head) :]
            small = re.fullmatch(r"SMALL ([A-Z]+)", rest)
            vowel = re.fullmatch(r"VOWEL SIGN (.+)", rest)
            if small:
                rest = small[1] + " small"
            elif vowel:
                rest = vowel[1] + " vowelsign"
            rest = re.sub(r"^(DIGIT|SIGN|MARK|SYMBOL|ACCENT) ", "", rest)
            key = re.sub(r"WITH |FORM$|[ -]", "", rest).lower()
            out.setdefault(("+" if capital else "") + key, chr(c))
    return out


_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def _look(*names: str) -> str:
    for name in names:
        try:
            return unicodedata.lookup(name)
        except KeyError:
            continue
    return ""


@lru_cache
def _listed() -> dict[str, str]:
    out = dict(SIGNS)
    for first, texts in AFII:
        out |= {f"afii{first + i}": t for i, t in enumerate(texts) if t != "·"}
    out |= {f"SF{n}0000": t for n, t in zip(BOXES.split(), BOX_TEXTS)}
    for count, plural in (("third", "thirds"), ("fifth", "fifths"), ("sixth", "sixths"), ("eighth", "eighths")):
        for n in ("one", "two", "three", "four", "five", "seven"):
            for word in (count, plural):
                if text := _look(f"VULGAR FRACTION {n} {word}".upper()):
                    out[n + word] = text
    return out


def _accented(base: str, rest: str, script: str, case: str) -> str:
    """A letter with the accents that ``rest`` spells out one after another."""
    words = []
    while rest:
        accent = next((a for a in _ACCENT_WORDS if rest.startswith(a)), None)
        if accent is None:
            return ""
        words.append("DIALYTIKA" if script == "GREEK" and accent == "dieresis" else ACCENTS[accent])
        rest = rest[len(accent) :]
    return _look(f"{script} {case} LETTER {base} WITH {' AND '.join(words)}", f"{script} {case} LETTER {base} WITH {' AND '.join(reversed(words))}")


def _latin(name: str) -> str:
    for base, said in (("AE", "AE"), ("ae", "AE"), ("Oslash", "O WITH STROKE AND"), ("oslash", "O WITH STROKE AND")):
        if name.startswith(base) and len(name) > len(base):
            case = "CAPITAL" if base[0].isupper() else "SMALL"
            accent = ACCENTS.get(name[len(base) :])
            return _look(f"LATIN {case} LETTER {said} {accent}" if "WITH" in said else f"LATIN {case} LETTER {said} WITH {accent}") if accent else ""
    return _accented(name[0].upper(), name[1:], "LATIN", "CAPITAL" if name[0].isupper() else "SMALL")


_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _greek(name: str) -> str:
    low = name.lower()
    letter = next((g for g in sorted(_GREEK, key=len, reverse=True) if low.startswith(g)), None)
    if letter is None or low[1:] != name[1:]:
        return ""
    case, said, rest = "CAPITAL" if name[0].isupper() else "SMALL", letter.upper().replace("LAMBDA", "LAMDA"), low[len(letter) :]
    if not rest:
        return _look(f"GREEK {case} LETTER {said}")
    if rest == "final" and letter == "sigma":
        return "ς"
    return _accented(said, rest, "GREEK", case)


def _done_to(name: str, plain) -> str:
    """Signs circled, in parentheses, raised, lowered, full width, as numerals or combining marks."""
    m = re.fullmatch(r"(.+?)(monospace|circle|paren|period|superior|inferior|roman|cmb|comb|circleinversesansserif|small(?=hyphen$))", name)
    if not m:
        return ""
    base, how = m.groups()
    low, number = base.lower(), base.lower() in _NUMBERS
    text = plain(base)
    if how == "monospace":
        return chr(ord(text) + 0xFEE0) if len(text) == 1 and "!" <= text <= "~" else ""
    if how in ("cmb", "comb"):
        return _look(f"COMBINING {COMBINING.get(base, ACCENTS.get(base, base.upper()))}")
    if how == "roman":
        return _look(f"{'' if base[0].isupper() else 'SMALL '}ROMAN NUMERAL {low.upper()}")
    if how == "circleinversesansserif":
        return _look(f"DINGBAT NEGATIVE CIRCLED SANS-SERIF DIGIT {low.upper()}", f"DINGBAT NEGATIVE CIRCLED SANS-SERIF NUMBER {low.upper()}")
    if how in ("circle", "paren", "period"):
        if number:
            kind = {"circle": "CIRCLED {} {}", "paren": "PARENTHESIZED {} {}", "period": "{} {} FULL STOP"}[how]
            return _look(kind.format("DIGIT", low.upper()), kind.format("NUMBER", low.upper()))
        kind = {"circle": "CIRCLED", "paren": "PARENTHESIZED"}.get(how)
        return _look(f"{kind} LATIN {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {low.upper()}") if kind and len(base) == 1 else ""
    head = "SUPERSCRIPT" if how == "superior" else "SUBSCRIPT"
    said = {"parenleft": "LEFT PARENTHESIS", "parenright": "RIGHT PARENTHESIS", "plus": "PLUS SIGN", "minus": "MINUS", "equal": "EQUALS SIGN", "n": "LATIN SMALL LETTER N"}.get(base, base.upper())
    return _look(f"{head} {said}")


def by_rule(name: str, plain) -> str:
    """Text of a name that the base encodings do not list, '' where no rule reads it; ``plain`` reads simpler names."""
    listed = _listed().get(name)
    if listed is not None:
        return listed
    if not name.isalnum() or not name.isascii() or len(name) < 2:
        return ""
    found = _greek(name) or _latin(name)
    if found:
        return found
    for suffix in sorted(SCRIPTS, key=len, reverse=True):
        if name.endswith(suffix) and len(name) > len(suffix):
            base = name[: -len(suffix)]
            low = base[0].lower() + base[1:]
            low = SPELT.get(suffix, {}).get(low, low)
            found = _script(suffix).get(("+" if base[0].isupper() else "") + low, "")
            if found:
                return found
    # Hebrew letters also go by their bare names.
    return _done_to(name, plain) or _script("hebrew").get(name, "") or _look(name.upper() if name.islower() and len(name) > 6 else "")
