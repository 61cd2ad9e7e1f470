"""Garbled text from a wrong character encoding: find the values, restore the text.

Characters are mapped back to the bytes of a legacy code page, a byte-structure
automaton finds the maximal spans of well-formed UTF-8 multibyte sequences, and
only those spans are decoded; text read wrongly twice is restored in rounds.
UTF-16 read as bytes is found by its interleaved zero bytes.  Where one
single-byte code page was taken for another no byte structure tells it; there
the spans are the words with non-ASCII characters, each re-decoded through the
pair of pages and weighed by a stated model, the letter contexts counted over
the whole corpus (:func:`train`).  Words that gain are replaced: all of them
where the value gains as a whole, else only those that gain clearly, so a value
garbled in part keeps its right words.

The counts are one dense table ``letter x left class x right class``, whose size
is fixed by the code pages (at most 700 x 64 x 64 cells), and exact counts of
wider contexts (two classes on either side), of which those with at least one in
:data:`WIDE` of all occurrences are kept, so at most so many exist at any corpus
size; the others fall back to the dense table.

Defined results: NULL and '' are never affected; a value with replacement
characters is affected and restored only around them (``restorable`` false);
values of any length are taken whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import checkpointed

#: Code pages that text was decoded with by mistake.
PAGES = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866")
#: (bytes really in, decoded as): pairs of single-byte pages that no byte structure can tell.
SWAPS = tuple(
    (true, read)
    for true in ("cp1252", "cp1251", "koi8-r", "cp850", "cp437", "mac_roman", "cp866")
    for read in ("cp1252", "cp850", "cp437", "mac_roman", "cp1251", "koi8-r", "cp866")
    if true != read
)
#: Least gain in log frequency, per re-read letter and in all, for a re-reading of all words to hold, and of some.
MIN_GAIN, MIN_TOTAL = 1.2, 2.5
MIN_GAIN_PART, MIN_TOTAL_PART = 2.5, 7.0
ROUNDS = 4
UNKNOWN = -40.0
BAD = "�"


@lru_cache
def page_table(page: str) -> dict[str, int]:
    """Character -> byte of the upper half; holes map as C1 controls, as decoders do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if page in ("cp1252", "cp1251"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache
def automaton(page: str) -> re.Pattern:
    """Maximal runs of well-formed UTF-8 multibyte sequences, over the page's characters."""
    chars: dict[int, list[str]] = {}
    for ch, b in page_table(page).items():
        chars.setdefault(b, []).append(ch)

    def some(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in chars.get(b, [])) + "￿]"

    tail = some(0x80, 0xBF)
    arms = (
        some(0xC2, 0xDF) + tail,
        some(0xE0, 0xE0) + some(0xA0, 0xBF) + tail,
        some(0xE1, 0xEC) + tail * 2,
        some(0xED, 0xED) + some(0x80, 0x9F) + tail,
        some(0xEE, 0xEF) + tail * 2,
        some(0xF0, 0xF0) + some(0x90, 0xBF) + tail * 2,
        some(0xF1, 0xF3) + tail * 3,
        some(0xF4, 0xF4) + some(0x80, 0x8F) + tail * 2,
    )
    return re.compile(f"(?:{'|'.join(arms)})+")


def decode_spans(text: str, page: str) -> str:
    table = page_table(page)
    return automaton(page).sub(lambda m: bytes(table[c] for c in m[0]).decode("utf-8", "replace") if "￿" not in m[0] else m[0], text)


@lru_cache
def swap_table(true: str, read: str) -> dict[int, str]:
    out = {}
    for ch, b in page_table(read).items():
        if ch.isascii():
            continue
        try:
            out[ord(ch)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            out[ord(ch)] = BAD
    return out


# ---- letter contexts -------------------------------------------------------


@lru_cache
def letters() -> dict[str, int]:
    """Index of every lower-case non-ASCII character of the code pages; 0 is any other."""
    found = {c.lower() for p in (*PAGES, "mac_cyrillic") for c in page_table(p) if len(c.lower()) == 1 and not c.isascii() and c != BAD}
    return {c: i + 1 for i, c in enumerate(sorted(found))}


CLASSES = 64
#: A wider context is kept if it has at least one in so many of all occurrences.
WIDE = 1 << 18


@lru_cache(maxsize=4096)
def context_class(ch: str) -> int:
    """0 edge or space, 1 digit, 2 ASCII mark, 3–28 Latin letters by base, 29–61 Cyrillic, 62 other letter, 63 other mark."""
    if ch.isspace() or ch == "":
        return 0
    if ch.isdigit():
        return 1
    low = ch.lower()
    base = unicodedata.normalize("NFD", low)[0]
    if "a" <= base <= "z":
        return 3 + ord(base) - 97
    if "а" <= low <= "я":
        return 29 + ord(low) - 0x430
    if low == "ё":
        return 34
    if ch.isascii():
        return 2
    return 62 if ch.isalpha() else 63


@lru_cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """(context class, letter index) of every code point, in lower case where that is one character."""
    known = letters()
    classes, index = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if c >= 0x3000 and c not in (0xFEFF, 0xFFFD):
            continue
        ch = chr(c)
        low = ch.lower() if len(ch.lower()) == 1 else ch
        classes[c], index[c] = context_class(low), known.get(low, 0)
    classes[0x3000:] = context_class("\u4e00")
    classes[0xFFFD] = context_class(BAD)
    return classes, index


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dense cell, wide cell) of each non-ASCII character of a text, by arrays."""
    classes, index = _code_points()
    points = np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(points > 0x7F)
    kind = classes[points]
    left, right = kind[at - 1].astype(np.int64), kind[at + 1].astype(np.int64)
    beyond_left, beyond_right = np.where(left > 0, kind[at - 2], 0), np.where(right > 0, kind[at + 2], 0)
    dense = (index[points[at]] * CLASSES + left) * CLASSES + right
    return dense, (dense * CLASSES + beyond_left) * CLASSES + beyond_right


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): dense cells as they are, wide ones numbered -1, -2, …; added up before they are shuffled."""
    total: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    for batch in batches:
        # Texts are joined by what is an edge on either side.
        dense, wide = cells("\n\n".join(t for t in batch.column("text").to_pylist() if t and not t.isascii()))
        for found in (dense, -1 - wide):
            for cell, n in zip(*(x.tolist() for x in np.unique(found, return_counts=True))):
                total[cell] = total.get(cell, 0) + n
        if len(total) > 1_000_000:
            yield out()
            total.clear()
    yield out()


Counts = tuple[np.ndarray, dict[int, float]]


def model_of(cell: np.ndarray, n: np.ndarray) -> Counts:
    """Log frequencies: the dense table, and the kept wide cells (numbered -1, -2, … in ``cell``)."""
    dense = np.zeros((len(letters()) + 1) * CLASSES * CLASSES)
    dense[cell[cell >= 0]] = n[cell >= 0]
    wide = dict(zip((-1 - cell[cell < 0]).tolist(), np.log(n[cell < 0] + 0.3).tolist()))
    per_letter = dense.reshape(-1, CLASSES * CLASSES).sum(1)
    floor = np.repeat(5 * per_letter / max(per_letter.sum(), 1), CLASSES * CLASSES)
    table = np.log(dense + floor + 1e-2)
    # A character of no code page is worth three garbled ones and not three likely ones.
    table[: CLASSES * CLASSES] = UNKNOWN
    return table.astype(np.float32), wide


def train(texts: DataFrame, text: str = "text") -> Counts:
    """Log frequencies of letters in context over all texts.

    The rows that reach the driver are cells of the dense table, fixed in number,
    and at most WIDE wide ones.
    """
    given = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    rows = checkpointed(given.mapInArrow(_count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")))
    whole = rows.where("cell < 0").agg(F.sum("n")).first()[0] or 0
    counted = rows.where((F.col("cell") >= 0) | (F.col("n") * WIDE >= whole)).toPandas()
    return model_of(counted["cell"].to_numpy(np.int64), counted["n"].to_numpy(np.float64))


#: Price of Latin and Cyrillic letters in one value, and of each place where they touch.
MIXED, TOUCHING = 1.5, 3.0


def _mixes(text: str) -> bool:
    return bool(_CYRILLIC.search(text) and _LATIN.search(text))


_LATIN, _CYRILLIC = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"), re.compile("[Ѐ-ӿ]")
_SPACES = re.compile(r"\S+")
_TOUCH = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ](?=[Ѐ-ӿ])|[Ѐ-ӿ](?=[A-Za-zÀ-ÖØ-öø-ɏ])")


#: C1 controls, and box-drawing characters against a letter, are never text.
_NO_TEXT = re.compile("[\x80-\x9f]|[─-▟](?=[^\\W\\d_])|(?<=[^\\W\\d_])[─-▟]")


class Restorer:
    def __init__(self, model: Counts):
        self.dense, self.wide = model
        self.unseen = math.log(0.3)
        self.words: dict[str, tuple[float, int]] = {}
        self.swaps: dict[str, dict[tuple[str, str], tuple[str, float, int]]] = {}

    def word(self, word: str) -> tuple[float, int]:
        """(sum of log frequencies, number of non-ASCII characters); capitals inside and touching scripts count as unlikely."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) > 100_000:
                self.words.clear()
            dense, wide = cells(word)
            total = float(self.dense[dense].sum()) + sum(self.wide.get(w, self.unseen) for w in wide.tolist())
            inside = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]) if b > "\x7f")
            known = self.words[word] = total - 3.0 * inside - TOUCHING * len(_TOUCH.findall(word)), len(dense)
        return known

    def score(self, text: str) -> tuple[float, int]:
        """The same of a whole text; contexts end at white space, so its words are scored one by one."""
        scores = [self.word(w) for w in text.split() if not w.isascii()]
        return sum(s for s, _ in scores) - (MIXED if _mixes(text) else 0.0), sum(n for _, n in scores)

    def value(self, text: str) -> float:
        """Of readings with different numbers of odd characters the fewer and likelier win."""
        total, n = self.score(text)
        return total - 20.0 * n

    def _utf16(self, text: str) -> str | None:
        body = text
        if body[:2] in ("þÿ", "ÿþ") or body.count("\0") * 3 > len(body) > 3:
            little = body.startswith("ÿþ") or (body[:2] != "þÿ" and body[1::2].count("\0") > body[0::2].count("\0"))
            if body[:2] in ("þÿ", "ÿþ"):
                body = body[2:]
            try:
                raw = b"".join(c.encode("latin-1") if ord(c) < 256 else bytes([page_table("cp1252")[c]]) for c in body)
            except KeyError:
                return None
            out = raw[: len(raw) // 2 * 2].decode("utf-16-le" if little else "utf-16-be", "replace")
            return None if BAD in out else out
        return None

    def _spans(self, text: str, rounds: int = ROUNDS) -> tuple[float, str] | None:
        """(value, text) of the best re-reading of UTF-8 spans, through any pages in turn, or None."""
        best = None
        before = self.value(text)
        seen = set()
        for page in PAGES:
            new = decode_spans(text, page)
            if new == text or new in seen or (BAD in new and BAD not in text):
                continue
            seen.add(new)
            if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in new if c > "\x7f"):
                continue
            found = self.value(new), new
            if rounds > 1 and not new.isascii():
                found = max(found, self._spans(new, rounds - 1) or found)
            if (found[0] > before or page in ("cp1252", "latin-1")) and (best is None or found > best):
                best = found
        return best

    def _word_swaps(self, word: str) -> dict[tuple[str, str], tuple[str, float, int]]:
        """Pair of pages -> (word read through it, gain, characters changed), where that gives text."""
        known = self.swaps.get(word)
        if known is None:
            if len(self.swaps) > 50_000:
                self.swaps.clear()
            known, before = {}, self.word(word)[0]
            for pair in SWAPS:
                new = word.translate(swap_table(*pair))
                if new != word and BAD not in new and not any(ord(c) < 32 or 0x7F <= ord(c) < 0xA0 for c in new):
                    known[pair] = new, self.word(new)[0] - before, sum(a != b for a, b in zip(word, new))
            self.swaps[word] = known
        return known

    def _swap(self, text: str) -> str | None:
        """The best reading of the value's non-ASCII words through one pair of pages, of all words or of those that gain."""
        words = {w for w in text.split() if not w.isascii()}
        counts = Counter(w for w in text.split() if w in words)
        options = {w: self._word_swaps(w) for w in words}
        mixed = MIXED if _mixes(text) else 0.0
        best, best_gain = None, 0.0
        for pair in (p for p in SWAPS if any(p in o for o in options.values())):
            read = {w: o[pair] for w, o in options.items() if pair in o}
            part = {w: r for w, r in read.items() if r[1] > 0}
            tries = [(read, MIN_TOTAL, MIN_GAIN)] if len(read) == len(words) else []
            if part and len(part) < len(words):
                tries.append((part, MIN_TOTAL_PART, MIN_GAIN_PART))
            for chosen, least, least_each in tries:
                gain = sum(r[1] * counts[w] for w, r in chosen.items())
                if gain <= best_gain or gain < least - MIXED:
                    continue
                new = _SPACES.sub(lambda m: chosen[m[0]][0] if m[0] in chosen else m[0], text)
                gain += mixed - (MIXED if _mixes(new) else 0.0)
                changed = sum(r[2] * counts[w] for w, r in chosen.items())
                if gain > best_gain and gain >= least and gain / changed >= least_each:
                    best, best_gain = new, gain
                    break
        return best

    def restore(self, text: str) -> tuple[str, bool] | None:
        """(restored text, fully restored) of an affected value, else None."""
        if text.isascii() and "\0" not in text:
            return None
        now, lossy = text, BAD in text
        wide = self._utf16(now)
        if wide is not None:
            now = wide
        spans = None if now.isascii() else self._spans(now)
        if spans is not None:
            now = spans[1]
        if wide is None and not text.isascii():
            # A single-byte re-reading of the value as stored must beat what the spans gave.
            swapped = self._swap(text)
            if swapped is not None and (now == text or self.value(swapped) > self.value(now)):
                now = swapped
            elif now != text and not now.isascii():
                # A value may be garbled in one word by a single-byte page and in another as UTF-8.
                now = self._swap(now) or now
        controls = "\0" in now or bool(_NO_TEXT.search(now))
        if now == text and not lossy and not controls:
            return None
        return now, not (BAD in now or controls)


def restored(df: DataFrame, model: Counts, text: str = "text") -> DataFrame:
    """The affected rows of ``df`` with ``restored`` and ``restorable`` added."""
    bc = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", restored string, restorable boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, known = Restorer(bc.value), {}
        for pdf in batches:
            values = pdf[text]
            out = []
            for v in values:
                if v is None or v != v or (v.isascii() and "\0" not in v):
                    out.append(None)
                    continue
                if v not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[v] = work.restore(v)
                out.append(known[v])
            part = pdf.loc[np.array([o is not None for o in out], bool)].copy()
            part["restored"] = pd.Series([o[0] for o in out if o], index=part.index, dtype=object)
            part["restorable"] = pd.Series([o[1] for o in out if o], index=part.index, dtype=bool)
            yield part

    return df.mapInPandas(run, schema)


def field_values(metadata: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, idx, field, text): the title, author and form values, each delivered row once."""
    of = lambda c: F.struct(F.lit(-1).cast("bigint").alias("idx"), F.lit(c).alias("field"), F.col(c).alias("text"))
    meta = metadata.select("doc_id", F.explode(F.array(of("title"), of("author"))).alias("v")).select("doc_id", "v.*")
    forms = fields.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.lit("value").alias("field"), F.col("value").alias("text"))
    both = meta.unionByName(forms).where(F.col("text").isNotNull() & (F.col("text") != ""))
    return both.dropDuplicates()


def training_texts(metadata: DataFrame, fields: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All short values whose letters teach the contexts, and page texts where given."""
    columns = [c for c in ("title", "author", "subject", "keywords", "creator", "producer") if c in metadata.columns]
    texts = metadata.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("text")).unionByName(fields.select(F.col("value").alias("text")))
    return texts if pages is None else texts.unionByName(pages.select("text"))
