"""Advance widths of the standard fonts, in thousandths of the size."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Advance widths for codes 32 to 126, from the public metric files of the faces.
HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
HELVETICA_BOLD = "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
TIMES_BOLD = "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
TIMES_ITALIC = "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"
TIMES_BOLD_ITALIC = "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570"
SYMBOL = "250 333 713 500 549 833 778 439 333 333 500 549 250 549 250 278 500 500 500 500 500 500 500 500 500 500 278 278 549 549 549 444 549 722 667 722 612 611 763 603 722 333 631 722 686 889 722 722 768 741 556 592 611 690 439 768 645 795 611 333 863 333 658 500 500 631 549 549 494 439 521 411 603 329 603 549 549 576 521 549 549 521 549 603 439 576 713 686 493 686 494 480 200 480 549"
ZAPF_DINGBATS = "278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571 677 763 760 759 754 494 552 537 577 692 786 788 788 790 793 794 816 823 789 841 823 833 816 831 923 744 723 749 790 792 695 776 768 792 759 707 708 682 701 826 815 789 789 707 687 696 689 786 787 713 791 785 791 873 761 762 762 759 759 892 892 788 784 438 138 277 415 392 392 668 668"
# The same for codes 160 (161) to 254, 0 for none.
SYMBOL_UPPER = "750 620 247 549 167 713 500 753 753 753 753 1042 987 603 987 603 400 549 411 549 549 713 494 460 549 549 549 549 1000 603 1000 658 823 686 795 987 768 768 823 768 768 713 713 713 713 713 713 713 768 713 790 790 890 823 549 250 713 603 603 1042 987 603 987 603 494 329 790 790 786 713 384 384 384 384 384 384 494 494 494 494 0 329 274 686 686 686 384 384 384 384 384 384 494 494 494"
ZAPF_UPPER = "732 544 544 910 667 760 760 776 595 694 626 " + "788 " * 40 + "894 838 1016 458 748 924 748 918 927 928 928 834 873 828 924 924 917 930 931 463 883 836 836 867 867 696 696 874 0 874 760 946 771 865 771 888 967 888 831 873 927 970 918"

# Widths of marks beyond ASCII in Helvetica, its bold, Times, its bold, italic and bold italic.
MARKS = {
    "‘’‚": (222, 278, 333, 333, 333, 333), "“”„": (333, 500, 444, 500, 556, 500), "–": (556, 556, 500, 500, 500, 500), "—": (1000, 1000, 1000, 1000, 889, 1000), "•": (350, 350, 350, 350, 350, 350), "…": (1000, 1000, 1000, 1000, 889, 1000), "†‡€«»": (556, 556, 500, 500, 500, 500), "‰": (1000,) * 6, "‹›": (333,) * 6, "ﬁﬂ": (500, 611, 556, 556, 500, 556),
    "™": (1000, 1000, 980, 1000, 980, 1000), "§¢£¥ƒ¤": (556, 556, 500, 500, 500, 500), "¶": (537, 556, 453, 540, 523, 500), "ß": (611, 611, 500, 556, 500, 500), "æ": (889, 889, 667, 722, 667, 722), "Æ": (1000, 1000, 889, 1000, 889, 944), "œ": (944, 944, 722, 722, 667, 722), "Œ": (1000, 1000, 889, 1000, 944, 944), "ø": (611, 611, 500, 500, 500, 500), "Ø": (778, 778, 722, 778, 722, 722), "ł": (222, 278, 278, 278, 278, 278), "Ł": (556, 611, 611, 667, 556, 611), "ı": (278,) * 6,
    "¡": (333, 333, 333, 333, 389, 389), "¿": (611, 611, 444, 500, 500, 500), "©®": (737, 737, 760, 747, 760, 747), "°": (400,) * 6, "±×÷": (584, 584, 564, 570, 675, 570), "−¬": (584, 584, 564, 570, 675, 606), "µ": (556, 611, 500, 556, 500, 576), "½¼¾": (834, 834, 750, 750, 750, 750), "¹²³": (333, 333, 300, 300, 300, 300), "ª": (370, 370, 276, 300, 276, 266), "º": (365, 365, 310, 330, 310, 300), "·": (278, 278, 250, 250, 250, 250), "¦": (260, 280, 200, 220, 275, 220), "⁄": (167,) * 6,
    "ð": (556, 611, 500, 500, 500, 500), "Ð": (722,) * 6, "þ": (556, 611, 500, 556, 500, 500), "Þ": (667, 667, 556, 611, 611, 611), "´¨¯¸ˆ˜ˇ˘˙˚˝˛": (333,) * 6,
}

#: Beginnings of family names, with the faces for upright, bold, italic and bold italic.
FAMILIES = {
    "courier": None,
    "helvetica": ((HELVETICA, 0), (HELVETICA_BOLD, 1), (HELVETICA, 0), (HELVETICA_BOLD, 1)),
    "arial": ((HELVETICA, 0), (HELVETICA_BOLD, 1), (HELVETICA, 0), (HELVETICA_BOLD, 1)),
    "times": ((TIMES, 2), (TIMES_BOLD, 3), (TIMES_ITALIC, 4), (TIMES_BOLD_ITALIC, 5)),
}
#: Fonts with an encoding of their own: widths by code.
BY_CODE = {"symbol": (SYMBOL, 160, SYMBOL_UPPER), "zapfdingbats": (ZAPF_DINGBATS, 161, ZAPF_UPPER)}
BOLD, ITALIC = ("bold", "black", "heavy"), ("italic", "oblique")


@lru_cache
def _face(widths: str, column: int) -> dict[str, float]:
    """Widths by text; accented letters measure like their base letter, i without its dot."""
    out = {chr(32 + i): float(w) for i, w in enumerate(widths.split())}
    out |= {c: float(w[column]) for marks, w in MARKS.items() for c in marks}
    for c in map(chr, (*range(0xC0, 0x180), *range(0x218, 0x21C), *range(0x1E00, 0x1F00))):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c:
            out.setdefault(c, out["ı" if base == "i" else base]) if base in out else None
    return out


@lru_cache
def _coded(low: str, start: int, high: str) -> list[float]:
    out = [0.0] * 256
    for first, widths in ((32, low), (start, high)):
        for i, w in enumerate(widths.split()):
            out[first + i] = float(w)
    return out


@lru_cache(maxsize=1024)
def standard_widths(base_font: str) -> dict[str, float] | list[float] | float | None:
    """Widths of a standard font: by text, by code for the symbol fonts, 600 for Courier, None for other fonts."""
    tagged = len(base_font) > 7 and base_font[6] == "+"
    plain = "".join(c for c in base_font[7 if tagged else 0 :].casefold() if c.isalnum())
    for family, parts in BY_CODE.items():
        if plain.startswith(family):
            return _coded(*parts)
    for family, faces in FAMILIES.items():
        if plain.startswith(family):
            if faces is None:
                return 600.0
            style = any(w in plain for w in BOLD) + 2 * any(w in plain for w in ITALIC)
            return _face(*faces[style])
    return None
