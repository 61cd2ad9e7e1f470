"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# U+FB00 to U+FB06 spelt out.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
JUNK = r"[�\u0000-\u001F\u007F-\u009F-]"


def sanitize(text: Column, fold_ligatures: bool = True) -> Column:
    """Without unmapped, control and private-use characters; tabs and no-break spaces become spaces."""
    out = F.regexp_replace(F.translate(text, "\t ", "  "), JUNK, "")
    if fold_ligatures:
        for ligature, letters in LIGATURES.items():
            out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def is_junk(text: Column) -> Column:
    return text.rlike(JUNK)


def unspaced_script(text: Column) -> Column:
    """Whether text begins in a script written without spaces between words."""
    return text.rlike(r"^[　-ヿ＀-￯ㇰ-ㇿ\p{IsHan}]")


def needs_bidi(text: Column) -> Column:
    return text.rlike(r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}&&[^\p{Mn}\p{Nd}]]")


def text_string(raw: Column) -> Column:
    """A text string by its byte order mark; without one as Latin-1."""
    head = F.hex(F.substring(raw, 1, 2))
    return F.when(head == "FEFF", F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE")).when(head == "FFFE", F.decode(F.substring(raw, 3, 1 << 30), "UTF-16LE")).when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.decode(F.substring(raw, 4, 1 << 30), "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
