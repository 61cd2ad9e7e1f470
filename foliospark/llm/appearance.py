"""One consistent form for texts that look the same.

The form is compatibility normalisation in composed form, full case folding,
white space mapped to one space, and default-ignorable characters removed.
Each batch is dictionary-encoded first, so a value is normalised once however
often it occurs.  What a reader can tell apart can be kept by parameters:
:data:`LOOKS` keeps letter case, raised digits and distinct styles, and maps
look-alike letters to one skeleton letter.

Defined results: NULL stays NULL; text of nothing but white space and invisible
marks becomes ``''`` and has no key; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import checkpointed

# The default-ignorable code points of the Unicode character database.
DEFAULT_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Latin letters, and the letters of other scripts and letter-like signs that are drawn alike in print,
# after the single-letter entries of the public table of confusable characters; letters it calls confusable that
# readers tell apart (such as Cyrillic г and r) are left out.  Marks drawn alike at the end.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚKᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "-": "‐‑",
}
#: A unit sign, whose capital is drawn like M.
_NOT_FOLDED = "μ"


def _script(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ")[0]


def lookalikes(fold_case: bool) -> dict[int, str]:
    """Letter to the Latin letter drawn alike.

    Under folded case a capital's look also links the small letters, or words in
    capitals and the same words in small letters would part; unless another small
    letter of the same script already has that look, or the small letter has one
    of its own.
    """
    if not fold_case:
        return {ord(c): to for to, letters in LOOKALIKES.items() for c in letters}
    folded = {c: to.lower() for to, letters in LOOKALIKES.items() for c in letters if c == c.casefold() and not to.isupper()}
    taken = {(_script(c), to) for c, to in folded.items()}
    for to, letters in LOOKALIKES.items():
        for small in (c.casefold() for c in letters if to.isupper()):
            if small not in folded and small not in _NOT_FOLDED and not small.isascii() and (_script(small), to.lower()) not in taken:
                folded[small] = to.lower()
    return {ord(c): to for c, to in folded.items()}


@dataclass(frozen=True)
class Form:
    """What counts as the same.

    ``compatibility``: full compatibility forms; otherwise only width and plain
    sans-serif or monospace styles and joined letter pairs are undone.
    ``fold_case``, ``skeleton`` (look-alike letters), ``keep_space`` (one space
    for each run of white space; otherwise white space is left out).
    """

    compatibility: bool = True
    fold_case: bool = True
    skeleton: bool = True
    keep_space: bool = True


CANONICAL = Form()
LOOKS = Form(compatibility=False, fold_case=False, skeleton=True, keep_space=False)

_SPACE = re.compile(r"\s+")


def _removed() -> dict[int, None]:
    gone = {c: None for lo, hi in DEFAULT_IGNORABLE if lo < 0xE0000 for c in range(lo, hi + 1)}
    controls = {c: None for c in range(0xA0) if unicodedata.category(chr(c)) == "Cc" and not chr(c).isspace()}
    return gone | controls


def _styles() -> dict[int, str]:
    """Width, plain styles and letter ligatures, from the character database by rule."""
    out = {}
    for c in (*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D5A0, 0x1D5D4), *range(0x1D670, 0x1D6A4), *range(0x1D7E2, 0x1D7EC), *range(0x1D7F6, 0x1D800), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)):
        if unicodedata.decomposition(chr(c)).startswith("<"):
            out[c] = unicodedata.normalize("NFKC", chr(c))
    return out


@lru_cache(maxsize=8)
def normaliser(form: Form = CANONICAL) -> Callable[[str], str]:
    first: dict[int, str | None] = ({} if form.compatibility else _styles()) | _removed()
    last = lookalikes(form.fold_case) if form.skeleton else {}
    space = " " if form.keep_space else ""
    first_class = re.compile("[" + "".join(re.escape(chr(c)) for c in first) + "\U000e0000-\U000e0fff]")
    kd, kc = ("NFKD", "NFKC") if form.compatibility else ("NFD", "NFC")

    def run(text: str) -> str:
        if text.isascii():
            if not text.isprintable():
                text = first_class.sub(lambda m: first.get(ord(m[0])) or "", text)
        else:
            text = first_class.sub(lambda m: first.get(ord(m[0])) or "", text)
            if form.fold_case:
                # Case first, so that a look is the same for a word in capitals and in small letters.
                text = unicodedata.normalize(kd, unicodedata.normalize(kd, text).casefold())
            if last:
                # Letters are mapped below their accents, then composed again.
                text = unicodedata.normalize(kd, text).translate(last)
            text = unicodedata.normalize(kc, text)
        if form.fold_case and text.isascii():
            text = text.lower()
        text = _SPACE.sub(space, text)
        return text.strip() if form.keep_space else text

    return run


def canonical(text: str | None, form: Form = CANONICAL) -> str | None:
    return None if text is None else normaliser(form)(text)


def canonical_column(form: Form = CANONICAL):
    """A vectorised column function text -> canonical text, once per distinct value of a batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        norm = normaliser(form)
        for series in batches:
            codes, values = pd.factorize(series)
            done = pd.Series([norm(v) for v in values] + [None], dtype="object")
            yield done.iloc[codes].reset_index(drop=True)

    return run


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def look_keys(df: DataFrame, text: str, form: Form = LOOKS) -> DataFrame:
    """Replace ``text`` by two 16-byte keys: ``look`` of the form, ``stored`` of the text less spaces and line feeds.

    Only the keys leave the Python worker, so nothing after it carries texts.
    Rows whose text has nothing to see are left out.
    """
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", look binary, stored binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, plain = normaliser(form), str.maketrans("", "", " \n")
        for batch in batches:
            coded = batch.column(text).dictionary_encode()
            looks, stored = [], []
            for value in coded.dictionary.to_pylist():
                seen = norm(value) if value is not None else ""
                looks.append(_digest(seen) if seen else None)
                stored.append(_digest(value.translate(plain)) if seen else None)
            take = lambda xs: pa.array(xs, pa.binary()).take(coded.indices)
            columns = [*(batch.column(c) for c in keep), take(looks), take(stored)]
            out = pa.RecordBatch.from_arrays(columns, names=[*keep, "look", "stored"])
            yield out.filter(out.column("look").is_valid())

    return df.select(*keep, text).mapInArrow(run, schema)


def page_texts(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, text): the kept text of a page or, where NULL, its glyphs in content order.

    Glyph rows meet the few pages they are needed for before they are grouped,
    and both steps use one partitioning by (doc_id, page).
    """
    rows = pages.where(F.col("page_id").isNotNull()).select("page_id", "doc_id", "page", "text")
    kept = rows.where(F.col("text").isNotNull()).select("page_id", "text")
    bare = rows.where(F.col("text").isNull()).select("page_id", "doc_id", "page").dropDuplicates(["page_id"])
    needed = glyphs.where(F.col("text").isNotNull()).select("doc_id", "page", "idx", F.col("text").alias("t"))
    met = needed.join(bare.hint("shuffle_hash"), ["doc_id", "page"])
    runs = met.groupBy("doc_id", "page", "page_id").agg(F.collect_set(F.struct("idx", "t")).alias("g"))
    # Each idx once: of glyphs that share one, the first by text.
    runs = runs.withColumn("g", F.array_sort("g"))
    once = F.filter("g", lambda g, i: (i == 0) | ~g["idx"].eqNullSafe(F.get(F.col("g"), i - 1)["idx"]))
    text = F.array_join(F.transform(once, lambda g: g["t"]), "")
    return kept.unionByName(runs.select("page_id", text.alias("text")))


def page_keys(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, look, stored), each page once (of differing deliveries the smallest keys)."""
    keyed = look_keys(page_texts(pages, glyphs), "text")
    one = keyed.groupBy("page_id").agg(F.min(F.struct("look", "stored")).alias("k"))
    return one.select("page_id", "k.look", "k.stored")


def look_classes(keys: DataFrame) -> DataFrame:
    """(page_id, class_id, n_pages, n_variants): pages that look alike share the smallest page_id."""
    variants = keys.groupBy("look", "stored").agg(F.min("page_id").alias("m"), F.count(F.lit(1)).alias("n"))
    classes = variants.groupBy("look").agg(F.min("m").alias("class_id"), F.sum("n").alias("n_pages"), F.count(F.lit(1)).alias("n_variants"))
    return keys.join(classes, "look").select("page_id", "class_id", "n_pages", "n_variants")


#: Pages of one variant that one task pairs with a page of another.
PAIR_BLOCK = 4096


def look_pairs(keys: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b): pages that look the same though stored differently.

    Variants meet first: of each look the pairs of differing stored texts, one
    row however many pages hold them, so copies of one page never meet each
    other.  Then each pair of variants is filled with its pages, the second
    variant's in blocks of :data:`PAIR_BLOCK`, so a text that a third of all
    pages hold is not one task's work.
    """
    keys = checkpointed(keys)
    variants = keys.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    other = variants.select("look", F.col("stored").alias("stored_b"), F.col("n").alias("n_b"))
    met = variants.select("look", "stored").join(other, "look").where("stored < stored_b")
    blocks = F.ceil(F.col("n_b") / PAIR_BLOCK).cast("int")
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first = met.join(keys.select("stored", "look", F.col("page_id").alias("a")), ["look", "stored"]).select("look", "stored_b", "block", "a")
    sizes = variants.where(F.col("n") > PAIR_BLOCK).select("look", "stored", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks"))
    second = keys.join(sizes, ["look", "stored"], "left").select("look", F.col("stored").alias("stored_b"), F.pmod(F.xxhash64("page_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.col("page_id").alias("b"))
    return first.join(second, ["look", "stored_b", "block"]).select(F.least("a", "b").alias("page_id_a"), F.greatest("a", "b").alias("page_id_b"))
