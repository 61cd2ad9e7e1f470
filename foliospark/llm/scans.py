"""Noise in text read from scanned pages, and the paragraphs repaired from it.

Each page's words are put into lines by their geometry; lines that stand apart
at the top or bottom are running headers, footers and page numbers.  The words
of the body are decoded line by line as a noisy channel: every word has
candidates that the reader may have confused with what was read, weighted by
confusion probabilities, and a Viterbi search over the candidates under word and
word-pair likelihoods of the corpus picks the likeliest line.  Words divided at
the end of a line or page are put together first, so a mistake in either piece
is weighed on the whole word.

Word counts cover all pages kept as text, and the read words themselves at a
small weight; confusion probabilities are estimated from all distinct read
words.  All counts are exact.  The model shipped to tasks holds the words and
word pairs with at least one in :data:`COMMON` (:data:`PAIRS`) of all running
words, so at most so many exist at any corpus size, and the table of
confusions.  All others are met by joins, so that what is shipped changes no
result: the candidates of every distinct read word are looked up in the whole
lexicon, for the confusion probabilities and for the pages that hold the word.
Words put together from two pieces and pairs of candidates side by side are known
only once a page is laid out: lines that need none beyond what is at hand are
decoded there and then, and a page with others is packed into one row that meets
the answers to them.

Pages are handled in groups of :data:`GROUP` pages of a document, with one page
of context on either side, so no task holds a whole long document; how printed
page numbers run is voted over the whole document beforehand.

Defined results: the lexicon is every word of a page kept as text, and words
that were only read where they are at least one in :data:`READ_ONLY` of all, for
most of those are misreadings; rows without text are left out; each idx of a page counts once;
a word drawn twice at one place gets the kind of its first drawing; a page of
one line is body unless it looks like a page number; words out of the lexicon
without a likelier candidate are kept as read.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.appearance import Form, normaliser
from foliospark.session import checkpointed

COMMON = 1 << 18
#: Bits of the table that spares look-ups; more words only make it spare fewer.
SIEVE = 1 << 24
PAIRS = 1 << 19
#: A word never kept as text is one from this share of all words on, whatever is shipped.
READ_ONLY = 1 << 18
GROUP = 32
READ_WEIGHT = 0.02
#: Log advantage a correction needs over the word as read.
MARGIN = 0.7

# What is printed and what a reader may take it for (printed: seen).
CONFUSIONS = {
    "l": "1 ! | i I t", "i": "! 1 l j |", "o": "0 c", "O": "0 Q", "s": "5 $", "b": "6 h", "é": "6 e", "g": "9 q", "q": "9 g", "a": "@ o", "e": "c o", "c": "e", "t": "f l", "f": "t",
    "r": "i", "u": "ii n v", "n": "ri u ii", "h": "li b", "d": "cl", "m": "rn nn iii", "w": "vv", "ß": "B ss", "B": "8", "z": "2", "S": "5", "I": "l 1 !", "G": "6 C", "y": "v", "v": "y", "T": "7", "ó": "6",
    "rn": "m", "cl": "d", "li": "h", "ri": "n", "ii": "u", "vv": "w",
    "о": "0", "б": "6", "з": "3", "ч": "4", "п": "н", "н": "п и", "и": "н", "ш": "щ", "щ": "ш", "ь": "ъ", "е": "с", "с": "е", "л": "п", "т": "г", "г": "т", "а": "@",
}

# Words that stand beside a page number.
LABELS = ("page", "p", "pg", "seite", "s", "página", "pagina", "pág", "pag", "стр", "страница", "с", "blatt", "folio", "of", "von", "de", "sur", "di", "из", "no", "nr")

HYPHENS = "-‐‑­¬"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_FORM = normaliser(Form(compatibility=False, fold_case=False, skeleton=False, keep_space=True))
_SAME = str.maketrans({"‐": "-", "‑": "-"})


@lru_cache(maxsize=1 << 18)
def clean(token: str) -> str:
    """A token in one form of characters, its soft hyphen at the end kept."""
    if token.isascii():
        return token
    soft = token.endswith("­")
    return (_FORM(token) + ("­" if soft else "")).translate(_SAME)


@lru_cache(maxsize=1 << 18)
def core(token: str) -> str:
    """A token without the marks at its edges."""
    return token if token.isalnum() else _EDGE.sub("", token)


@lru_cache(maxsize=1 << 18)
def word_of(token: str) -> str:
    """The lexicon's key of a token: its core in lower case, or the marks themselves."""
    token = clean(token)
    return core(token).lower() or token


def pair_key(a: str, b: str) -> int:
    """64 bits, so that equal keys are equal pairs."""
    return xxhash.xxh64_intdigest(f"{a} {b}")


# ---- corpus counts ----------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, by_word, pairs = Counter(), Counter(), Counter()
    for batch in batches:
        for text, times in zip(batch.column("text").to_pylist(), batch.column("times").to_pylist()):
            if times:  # a distinct read word
                by_word[word_of(text)] += times
                continue
            found = list(map(word_of, text.split()))
            kept.update(found)
            pairs.update(zip(["", *found], found))
    words = [*((w, 0, n) for w, n in kept.items()), *((w, 1, n) for w, n in by_word.items())]
    words += [(str(pair_key(a, b)), 3, n) for (a, b), n in pairs.items()]
    if words:
        w, k, n = zip(*words)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["word", "kind", "n"])


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    total: float = 1.0
    pairs: dict[int, int] = field(default_factory=dict)
    #: marks without letters that belong to text
    marks: frozenset[str] = frozenset()
    confusion: dict[tuple[str, str], float] = field(default_factory=dict)
    #: (word, n, mark): the lexicon's words that are not in ``words``, where there are any; stays with the driver
    rare: DataFrame | None = None
    #: (pair, n): the pairs that are not in ``pairs``, where there are any; stays with the driver
    rare_pairs: DataFrame | None = None
    #: bits of the hashes of those words and pairs: what is not in them need not be looked up
    sieve: np.ndarray | None = None
    pair_sieve: np.ndarray | None = None
    #: (text, word, n, mark): for the distinct read words of the training, the words of ``rare`` that they are or may stand for; stays with the driver
    near: DataFrame | None = None

    def shipped(self) -> Model:
        return replace(self, rare=None, rare_pairs=None, near=None)


def start_confusion() -> dict[tuple[str, str], float]:
    """(seen, printed) -> log probability, before counting."""
    return {(seen, printed): math.log(0.002) for printed, all_seen in CONFUSIONS.items() for seen in all_seen.split()}


def _sieve(rows: DataFrame, at: str) -> np.ndarray | None:
    """Bits set at the places ``at`` of the rows; None if there are no rows."""
    bits = rows.selectExpr(f"{at} as at").selectExpr("shiftright(at, 5) as at", "shiftleft(1L, int(at & 31L)) as one").groupBy("at").agg(F.bit_or("one").alias("bits")).toPandas()
    if not len(bits):
        return None
    sieve = np.zeros(SIEVE >> 5, np.uint32)
    sieve[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).astype(np.uint32)
    return sieve


def train(pages: DataFrame, words: DataFrame) -> Model:
    """Counts over all pages kept as text (``ocr_glyphs`` 0) and all read words (column ``text``)."""
    kept = pages.where("coalesce(ocr_glyphs, 0) = 0 and text is not null").select("text", F.lit(0).cast("bigint").alias("times"))
    read = checkpointed(words.groupBy("text").agg(F.count(F.lit(1)).alias("times")))
    counts = kept.unionByName(read).mapInArrow(_count_words, "word string, kind int, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    score = F.sum(F.when(F.col("kind") == 0, F.col("n").cast("double")).otherwise(F.col("n") * READ_WEIGHT))
    lexicon = counts.where("kind in (0, 1)").groupBy("word").agg(score.alias("n"), F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("kept"), F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("read"))
    lexicon = checkpointed(lexicon)
    total, kept_total, read_total = (max(float(x or 0), 1.0) for x in lexicon.agg(F.sum("n"), F.sum("kept"), F.sum("read")).first())
    # A mark is text if it is not much rarer on pages kept as text than on read ones.
    mark = F.coalesce("kept", F.lit(0)) / F.lit(kept_total) > 0.2 * F.coalesce("read", F.lit(0)) / F.lit(read_total)
    lexicon = lexicon.where((F.col("kept") > 0) | (F.col("n") * READ_ONLY >= total)).withColumn("mark", mark)
    common = F.col("n") * COMMON >= total
    top = lexicon.where(common).toPandas()
    rare = lexicon.where(~common).select("word", "n", "mark")
    sieve = _sieve(rare, f"pmod(xxhash64(word), {SIEVE}L)")
    pairs = counts.where("kind = 3").select(F.col("word").alias("pair"), "n")
    n_pairs = pairs.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * PAIRS >= n_pairs
    top_pairs = pairs.where(often).toPandas()
    rare_pairs = pairs.where(~often)
    pair_sieve = _sieve(rare_pairs, f"cast(cast(pair as decimal(20, 0)) % {SIEVE} as bigint)")
    model = Model(dict(zip(top["word"], top["n"].astype(float))), total, dict(zip(map(int, top_pairs["pair"]), top_pairs["n"].tolist())), frozenset(w for w, m in zip(top["word"], top["mark"]) if m and not core(w)), start_confusion(), sieve=sieve, pair_sieve=pair_sieve)
    if sieve is not None:
        model.rare, model.near = rare, checkpointed(rare_words(read, model, rare))
    if pair_sieve is not None:
        model.rare_pairs = rare_pairs
    # How often each printed piece occurs at all, by the lexicon.
    pieces = lexicon.agg(*(F.sum(F.when(F.col("word").contains(p.lower()), F.col("n"))) for p in CONFUSIONS)).first()
    model.confusion = confusion_rates(read, model, {p: float(n or 0) for p, n in zip(CONFUSIONS, pieces)})
    return model


def rare_words(read: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """(text, word, n, mark): for each read text the words outside the shipped lexicon that it is or may stand for."""
    bc = read.sparkSession.sparkContext.broadcast(model.shipped())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(bc.value)
        for batch in batches:
            found = [(t, w) for t in batch.column("text").to_pylist() for w in channel.uncommon(clean(t))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], names=["text", "word"])

    return read.select("text").mapInArrow(run, "text string, word string").join(rare, "word").select("text", "word", "n", "mark")


def confusion_rates(read: DataFrame, model: Model, pieces: dict[str, float]) -> dict[tuple[str, str], float]:
    """Log probability of each confusion, from the best reading of every distinct read word in the whole lexicon."""
    bc = read.sparkSession.sparkContext.broadcast(model.shipped())
    if model.near is not None:
        near = model.near.groupBy("text").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))
        read = read.join(near, "text", "left")
    else:
        read = read.select("*", F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<double>").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, found = Channel(bc.value), Counter()
        for batch in batches:
            for text, n, words, counts in zip(*(batch.column(c).to_pylist() for c in ("text", "times", "words", "counts"))):
                channel.rare = dict(zip(words or (), counts or ()))
                best = channel.best(clean(text))
                if best is not None:
                    for seen, printed, _ in best.edits:
                        found[seen, printed] += n
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["seen", "printed", "n"])

    rows = read.mapInArrow(run, "seen string, printed string, n bigint").groupBy("seen", "printed").agg(F.sum("n").alias("n")).collect()
    found = {(r.seen, r.printed): r.n for r in rows}
    read_share = max(sum(found.values()), 1) / max(model.total, 1)
    scale = min(1.0, read_share) if read_share else 1.0
    return {k: math.log(min(0.05, max(1e-5, (found.get(k, 0) + 0.5) / (pieces[k[1]] * scale + 500)))) for k in model.confusion}


# ---- channel ----------------------------------------------------------------


@dataclass(frozen=True)
class Reading:
    word: str
    channel: float
    #: how often the lexicon has the word
    n: float = 0.0
    #: (seen, printed, position in the read core)
    edits: tuple[tuple[str, str, int], ...] = ()


class Channel:
    """Candidates of a read word and their likelihoods."""

    def __init__(self, model: Model):
        self.m = model
        self.by_seen: dict[str, list[tuple[str, float]]] = {}
        for (seen, printed), p in model.confusion.items():
            self.by_seen.setdefault(seen, []).append((printed, p))
        #: first character -> what may be seen, narrow first, and what it may stand for
        self.by_first: dict[str, list[tuple[str, list[tuple[str, float]]]]] = {}
        for seen in sorted(self.by_seen, key=len):
            self.by_first.setdefault(seen[0], []).append((seen, self.by_seen[seen]))
        self.signs = "".join(s for s in self.by_seen if len(s) == 1 and not s.isalnum())
        self.known: dict[str, tuple[Reading, ...]] = {}
        self.may_be: dict[str, set[str]] = {}
        #: pieces of two neighbours -> pairs to look up
        self.pairs_of: dict[tuple, tuple[int, ...]] = {}
        #: what was looked up for the pages at hand: words and pairs that are not shipped, and marks that are text
        self.rare: dict[str, float] = {}
        self.rare_pairs: dict[int, int] = {}
        self.marks: set[str] = set()
        self.log_total = math.log(model.total)

    def frequency(self, word: str) -> float:
        return self.m.words.get(word) or self.rare.get(word, 0.0)

    def log_word(self, n: float) -> float:
        return math.log(n + 0.05) - self.log_total

    def log_pair(self, a: Reading, b: Reading) -> float:
        """Likelihood of b after a: pair counts backed off to word counts."""
        key = pair_key(a.word, b.word)
        n = self.m.pairs.get(key) or self.rare_pairs.get(key, 0)
        return math.log((n + 2.0 * math.exp(self.log_word(b.n))) / (a.n + 2.0))

    def _edits(self, word: str) -> Iterator[tuple[str, float, tuple[str, str, int]]]:
        for i, c in enumerate(word):
            for seen, options in self.by_first.get(c, ()):
                if len(seen) == 1 or word.startswith(seen, i):
                    for printed, p in options:
                        yield word[:i] + printed + word[i + len(seen) :], p, (seen, printed, i)

    def forms(self, token: str) -> list[str]:
        """The core as read, and with signs at its edges that may stand for letters."""
        bare = core(token)
        out = [bare]
        start = token.find(bare) if bare else 0
        before, after = token[:start], token[start + len(bare) :]
        left = before[-1:] if before[-1:] and before[-1:] in self.signs else ""
        right = after[:1] if after[:1] and after[:1] in self.signs else ""
        if left:
            out.append(left + bare)
        if right:
            out.append(bare + right)
        return out

    def shapes(self, token: str) -> Iterator[tuple[str, float, tuple[tuple[str, str, int], ...]]]:
        """(word, channel, edits): every word one confusion away from the token, then those two away."""
        for form in self.forms(token):
            # A capital stands for itself or for what it may be confused with.
            for shape in {form, form.lower()}:
                for one, p, edit in self._edits(shape):
                    yield one.lower(), p, (edit,)
        if len(core(token)) > 2 and self.frequency(core(token).lower()) < 0.5:
            for form in self.forms(token):
                for one, p, first in self._edits(form.lower()):
                    for two, p2, second in self._edits(one):
                        if second[2] > first[2]:
                            yield two, p + p2, (first, (second[0], second[1], second[2] + len(first[0]) - len(first[1])))

    def uncommon(self, token: str) -> set[str]:
        """The words to look up in the rest of the lexicon for a read token: itself and what it may stand for."""
        bare = core(token).lower() or token
        return {w for w in (bare, *(w for w, _, _ in self.shapes(token))) if self.maybe_rare(w)}

    def maybe_rare(self, word: str) -> bool:
        """Whether the word has to be looked up."""
        if self.m.sieve is None or not word or word in self.m.words:
            return False
        at = xxhash.xxh64_intdigest(word, 42) % SIEVE  # the engine's own hash of a string
        return bool(int(self.m.sieve[at >> 5]) >> (at & 31) & 1)

    def maybe_rare_pair(self, key: int) -> bool:
        """Whether the pair has to be looked up."""
        at = key % SIEVE
        return key not in self.m.pairs and bool(int(self.m.pair_sieve[at >> 5]) >> (at & 31) & 1)

    def possible(self, token: str) -> set[str]:
        """The words of :meth:`candidates`, and perhaps others, before rare words have been looked up."""
        found = self.may_be.get(token)
        if found is None:
            if len(self.may_be) > 200_000:
                self.may_be.clear()
            found = self.may_be[token] = {core(token).lower(), *(w for w, _, _ in self.shapes(token) if w in self.m.words or self.maybe_rare(w))}
        return found

    def candidates(self, token: str) -> tuple[Reading, ...]:
        """The word as read first, then lexicon words one or two confusions away."""
        found = self.known.get(token)
        if found is not None:
            return found
        if len(self.known) > 200_000:
            self.known.clear()
        rare, words = self.rare, self.m.words
        bare = core(token)
        low = bare.lower()
        odd = any(a.islower() and b.isupper() for a, b in zip(bare, bare[1:]))
        here = words.get(low) or rare.get(low, 0.0)
        out = {low: Reading(low, math.log(0.05) if odd else 0.0, here)}
        if bare:
            for word, p, edits in self.shapes(token):
                if word != low and (word in words or word in rare) and (word not in out or out[word].channel < p):
                    out[word] = Reading(word, p, words.get(word) or rare[word], edits)
        found = self.known[token] = tuple(out.values())
        return found

    def best(self, token: str) -> Reading | None:
        """The likeliest correction without context, or None where the word stands as read."""
        options = self.candidates(token)
        if len(options) == 1:
            return None
        best = max(options[1:], key=lambda r: r.channel + self.log_word(r.n))
        here = options[0]
        return best if best.channel + self.log_word(best.n) > here.channel + self.log_word(here.n) + MARGIN else None

    def decode(self, tokens: list[str]) -> list[Reading | None]:
        """Viterbi over the candidates of a line; None where a word stands as read."""
        options = [self.candidates(t) for t in tokens]
        if all(len(o) == 1 for o in options):
            return [None] * len(tokens)
        score = [0.0]
        back: list[list[int]] = []
        previous = (Reading("", 0.0, self.frequency("")),)
        for o in options:
            now, links = [], []
            for k, r in enumerate(o):
                emit = r.channel - (MARGIN if k else 0.0)
                if len(o) == 1 and len(previous) == 1:
                    now.append(score[0] + emit)
                    links.append(0)
                    continue
                steps = [s + self.log_pair(p, r) for s, p in zip(score, previous)]
                at = max(range(len(steps)), key=steps.__getitem__)
                now.append(steps[at] + emit + 0.5 * self.log_word(r.n))
                links.append(at)
            score, previous = now, o
            back.append(links)
        at = max(range(len(score)), key=score.__getitem__)
        picked = []
        for o, links in zip(reversed(options), reversed(back)):
            picked.append(None if at == 0 else o[at])
            at = links[at]
        return picked[::-1]


# ---- pages ------------------------------------------------------------------

_NUMBER = re.compile(r"^[0-9lOoIiSB!|Zz]+$")
_ROMAN = re.compile(r"^[ivxlcdmIVXLCDM1!|]+$")
_FRACTION = re.compile(r"^[0-9lOoIS!|]+/[0-9lOoIS!|]+$")
_DIGITS = str.maketrans("lI!|iOoSBZz", "11111005822")
_WRAP = "[](){}.,:;–—-·|~*_"


def _value(token: str) -> int | None:
    """The page number that a token stands for, misread digits included."""
    bare = token.strip(_WRAP)
    if _FRACTION.match(bare):
        bare = bare.split("/")[0]
    if bare and _NUMBER.match(bare):
        digits = bare.translate(_DIGITS)
        return int(digits) if digits.isdigit() and len(digits) <= 6 else None
    return None


def _roman(token: str) -> int | None:
    bare = token.strip(_WRAP).lower().translate(str.maketrans("1!|", "iii"))
    if not bare or not re.match(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$", bare):
        return None
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(bare, [*bare[1:], ""]):
        total += -values[a] if b and values[a] < values[b] else values[a]
    return total


def _label(token: str) -> bool:
    bare = core(token).lower().translate(str.maketrans("1!05@", "iiosa"))
    if bare in LABELS:
        return True
    return len(bare) >= 4 and any(len(x) == len(bare) and sum(a != b for a, b in zip(x, bare)) <= 1 for x in LABELS)


@dataclass(slots=True)
class Word:
    idx: int
    text: str
    x: float
    y: float
    size: float
    kind: str | None = None
    fixed: str | None = None


@dataclass
class Page:
    number: int
    words: list[Word]
    #: smallest and largest x, smallest and largest y of the scanned image, where there is one
    frame: tuple[float, float, float, float] | None = None
    top: list[list[Word]] = field(default_factory=list)
    body: list[list[Word]] = field(default_factory=list)
    bottom: list[list[Word]] = field(default_factory=list)
    copies: list[tuple[Word, Word]] = field(default_factory=list)


#: Part of a scanned image's height, at its top and bottom, in which headers, footers and page numbers may stand.
MARGIN_DEPTH = 0.25


def lay_out(page: Page) -> None:
    """Lines by height in content order; lines apart from the body at the top and bottom are margins.

    Words beside the scanned image are not of the scan and are left alone.
    """
    if page.frame is not None:
        left, right, low, high = page.frame
        page.words = [w for w in page.words if left <= w.x <= right and low <= w.y <= high]
    lines: list[list[Word]] = []
    drawn: dict[str, list[Word]] = {}
    for w in page.words:
        same = drawn.setdefault(w.text, [])
        first = next((v for v in same if abs(v.x - w.x) <= 1.5 and abs(v.y - w.y) <= 1.5), None) if same else None
        if first is not None:
            page.copies.append((w, first))
            continue
        same.append(w)
        if lines and abs(lines[-1][-1].y - w.y) <= 0.6 * max(w.size, 1.0):
            lines[-1].append(w)
        else:
            lines.append([w])
    lines.sort(key=lambda l: -max(w.y for w in l))  # stable: equal heights stay in content order
    merged: list[list[Word]] = []
    for line in lines:
        if merged and abs(merged[-1][0].y - line[0].y) <= 0.35 * max(line[0].size, 1.0):
            merged[-1] += line
        else:
            merged.append(line)
    gap = lambda a, b: (a[0].y - b[0].y) > 2.0 * max(b[0].size, 1.0)
    n = len(merged)
    first = next((i + 1 for i in range(min(2, n - 1)) if gap(merged[i], merged[i + 1])), 0)
    last = next((i for i in range(n - 1, max(first, n - 4), -1) if gap(merged[i - 1], merged[i])), n)
    # The lowest gap may lie within the footer: take the highest one among the last lines.
    for i in range(max(first + 1, n - 3), last):
        if gap(merged[i - 1], merged[i]):
            last = i
            break
    if n == 1 and all(_value(w.text) is not None or _label(w.text) or not core(w.text) for w in merged[0]):
        first, last = 1, 1
    if page.frame is not None:
        # Margins lie in the outer part of the scanned image.
        _, _, low, high = page.frame
        while first and merged[first - 1][0].y < high - MARGIN_DEPTH * (high - low):
            first -= 1
        while last < n and merged[last][0].y > low + MARGIN_DEPTH * (high - low):
            last += 1
    page.top, page.body, page.bottom = merged[:first], merged[first:last], merged[last:]


def mark_margins(page: Page, offset: int | None) -> None:
    """Page number lines first; then numbers at either end of running lines.

    A letter that merely looks like the expected number counts only where the
    page has no page number line of its own.
    """
    mixed, numbered = [], False
    for line in (*page.top, *page.bottom):
        numbers = [_value(w.text) is not None or (_roman(w.text) is not None and len(line) <= 3) for w in line]
        rest = [w for w, n in zip(line, numbers) if not n]
        alone = any(numbers) and len(line) <= 5 and all(_label(w.text) or not core(w.text) for w in rest)
        for w in line:
            w.kind = "page_number" if alone else "running"
        numbered |= alone
        if not alone:
            mixed.append(line)
    expected = None if offset is None else page.number + offset
    for line in mixed:
        ends = (line[0], line[-1]) if len(line) > 1 else (line[0],)
        for w in ends:
            value = _value(w.text)
            if value is not None and (any(c.isdigit() for c in w.text) or (value == expected and len(line) > 1 and not numbered)):
                w.kind = "page_number"
                break
        else:
            if len(line) > 1 and not numbered:
                for w in ends:
                    roman = _roman(w.text)
                    if roman is not None and w.text.islower() and len(core(w.text)) > 1 and roman in (page.number, expected):
                        w.kind = "page_number"
                        break


def _divided(word: Word) -> bool:
    return len(word.text) > 1 and word.text[-1] in HYPHENS and any(c.isalpha() for c in word.text)


def neighbours(before: Page | None, after: Page | None) -> tuple[Word | None, Word | None]:
    """The last word of the body before and the first of the body after."""
    return (before.body[-1][-1] if before and before.body else None, after.body[0][0] if after and after.body else None)


def look_ups(page: Page, prior: Word | None, following: Word | None, channel: Channel) -> dict[int, tuple[set[str], set[int]]]:
    """For the body's lines that ask for any: words put together from two pieces, and pairs, that are not at hand.

    Which spelling of a divided word is taken may be open until they have been looked up; then both are asked for.
    """
    asked_by = {}
    for number, line in enumerate(page.body):
        words: set[str] = set()
        pairs: set[int] = set()
        row: list[tuple[str, ...]] = []
        joined: tuple[str, ...] = ()
        for position, w in enumerate(line):
            text = clean(w.text)
            if position == 0 and prior is not None and _divided(prior):
                head = core(clean(prior.text)[:-1])
                joined = (head + "-" + text, head + text.lstrip(HYPHENS))
                spelt = (head + "-" + core(text)).lower(), (head + core(text)).lower()
                open_ = set(filter(channel.maybe_rare, spelt))
                words |= open_
                if not open_:
                    joined = (joined[0 if channel.frequency(spelt[0]) > channel.frequency(spelt[1]) else 1],)
                for token in joined:
                    words.update(filter(channel.maybe_rare, channel.possible(token)))
                row.append(joined)
            elif position == len(line) - 1 and _divided(w):
                tail = page.body[number + 1][0] if number + 1 < len(page.body) else following
                if tail is not None:
                    head, end = core(text[:-1]), core(clean(tail.text))
                    words.update(filter(channel.maybe_rare, ((head + "-" + end).lower(), core(head + end).lower())))
            elif core(text):
                row.append((text,))
        prior = line[-1]
        left: tuple[str, ...] | None = None
        for right in row if channel.m.pair_sieve is not None else ():
            key = left, right, right is joined
            keys = channel.pairs_of.get(key) if left is not joined else None
            if keys is None:
                a, b = ({""} if tokens is None else set().union(*map(channel.possible, tokens)) if tokens is joined else {r.word for r in channel.candidates(tokens[0])} for tokens in (left, right))
                keys = () if len(a) == len(b) == 1 else tuple(k for k in (pair_key(x, y) for x in a for y in b) if channel.maybe_rare_pair(k))
                if left is not joined:
                    if len(channel.pairs_of) > 200_000:
                        channel.pairs_of.clear()
                    channel.pairs_of[key] = keys
            pairs.update(keys)
            left = right
        if words or pairs:
            asked_by[number] = words, pairs
    return asked_by


#: A word of digits and of letters that are taken for digits.
_DIGIT_WORD = re.compile(r"(?=.*[0-9])[0-9lOoISB!|]*[lOoISB!|][0-9lOoISB!|]*")


def mark_body(page: Page, leading: Word | None, following: Word | None, channel: Channel, numbers: Iterable[int]) -> None:
    """Kinds and corrections of the body words of the lines ``numbers`` of one page, each for itself."""
    m = channel.m
    lines = page.body
    if leading is not None and not _divided(leading):
        leading = None
    for number in numbers:
        line = lines[number]
        tokens, owners = [], []
        for position, w in enumerate(line):
            text = clean(w.text)
            prior = None
            if position == 0:
                prior = lines[number - 1][-1] if number else leading
                if prior is not None and not _divided(prior):
                    prior = None
            if prior is not None:
                # The second piece: weighed as part of the whole word.
                head = core(clean(prior.text)[:-1])
                if channel.frequency((head + "-" + core(text)).lower()) > channel.frequency((head + core(text)).lower()):
                    tokens.append(head + "-" + text)
                    owners.append((w, len(head) + 1))
                else:
                    tokens.append(head + text.lstrip(HYPHENS))
                    owners.append((w, len(head)))
            elif position == len(line) - 1 and _divided(w):
                if number + 1 < len(lines):
                    tail = clean(lines[number + 1][0].text)
                else:
                    tail = clean(following.text) if following is not None else ""
                head, joined = core(text[:-1]), core(core(text[:-1]) + core(tail))
                compound = (head + "-" + core(tail)).lower()
                # Beyond the group's edge, or where neither spelling is known, the mark divides.
                if tail and w.text[-1] not in "¬­" and channel.frequency(compound) > channel.frequency(joined.lower()):
                    continue
                w.kind = "hyphen"
                continue
            elif not core(text):
                if text not in m.marks and text not in channel.marks:
                    w.kind = "misread"
                continue
            else:
                tokens.append(text)
                owners.append((w, 0))
        for (w, lead), token, reading in zip(owners, tokens, channel.decode(tokens)):
            if w.kind is not None:
                continue
            bare = core(token)
            if reading is not None:
                if lead and all(at < lead for _, _, at in reading.edits):
                    continue  # the mistake is in the first piece
                w.kind, w.fixed = "misread", reading.word
            elif not bare.isalpha() and _DIGIT_WORD.fullmatch(bare) and not channel.frequency(bare.lower()):
                w.kind, w.fixed = "misread", bare.translate(_DIGITS)


def finish(page: Page) -> None:
    for copy, first in page.copies:
        copy.kind, copy.fixed = first.kind, first.fixed


def repaired(word: Word) -> str:
    """A corrected word with the marks and capital of what was read."""
    if word.fixed is None:
        return word.text
    bare = core(word.text)
    start = word.text.find(bare)
    text = word.fixed
    if bare.isupper() and len(bare) > 1:
        text = text.upper()
    elif bare[:1].isupper():
        text = text[:1].upper() + text[1:]
    return word.text[:start] + text + word.text[start + len(bare) :]


def paragraphs(page: Page) -> list[str]:
    """The body as continuous text; a line set in from the left edge begins a paragraph."""
    if not page.body:
        return []
    left = min(line[0].x for line in page.body)
    out: list[str] = []
    open_word = False
    for line in page.body:
        words = [w for w in line if not (w.kind == "misread" and w.fixed is None and not core(w.text))]
        if not words:
            continue
        texts = []
        for w in words:
            if w.kind == "hyphen":
                texts.append(w.text[:-1])
            else:
                texts.append(repaired(w))
        joined = " ".join(texts)
        if not out or (line[0].x - left > 0.8 * line[0].size and not open_word):
            out.append(joined)
        else:
            out[-1] += ("" if open_word or out[-1][-1:] == "-" else " ") + joined
        open_word = words[-1].kind == "hyphen"
    return out


# ---- Spark ------------------------------------------------------------------


def read_words(glyphs: DataFrame) -> DataFrame:
    """Words of origin ``ocr``, each idx of a page once."""
    rows = glyphs.where("origin = 'ocr' and text is not null and doc_id is not null and page is not null and idx is not null")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("idx").cast("int").alias("idx"), "text", *(F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c) for c, d in (("x", 0.0), ("y", 0.0), ("size", 10.0))))


def grouped(words: DataFrame) -> DataFrame:
    """Words by groups of pages; the first and last page of a group also go to its neighbour as context."""
    home = F.floor(F.col("page") / GROUP).cast("int")
    to = F.array_compact(F.array(home, F.when(F.col("page") % GROUP == 0, home - 1), F.when(F.col("page") % GROUP == GROUP - 1, home + 1)))
    return words.withColumn("part", F.explode(to))


#: How far from a page's highest and lowest word, in sizes, a page number may stand.
EDGE = 4.5


def _edges_of_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, top, bottom, numbers): one row a page, with the words on it that are numbers."""
    marks = "[" + re.sub(r"([\[\]\-])", r"\\\1", _WRAP) + "]*"
    number = F.regexp_extract("text", rf"^{marks}(\d{{1,5}})(?:/\d{{1,5}})?{marks}$", 1)
    found = F.when(number != "", F.struct(number.cast("int").alias("number"), "y", "size"))
    return words.groupBy("doc_id", "page").agg(F.max("y").alias("top"), F.min("y").alias("bottom"), F.collect_list(found).alias("numbers"))


def page_number_offsets(words: DataFrame) -> DataFrame:
    """(doc_id, offset): commonest difference between printed and actual page number at the edges of a document's pages.

    Votes are counted over the whole document, one row a page and a number
    before anything is shuffled by document; ties go to the smallest offset.
    """
    pages = _edges_of_pages(words)
    far = F.lit(EDGE) * F.greatest("n.size", F.lit(1.0))
    votes = pages.select("doc_id", "page", "top", "bottom", F.explode("numbers").alias("n")).where((F.col("top") - F.col("n.y") <= far) | (F.col("n.y") - F.col("bottom") <= far))
    votes = votes.select("doc_id", "page", F.col("n.number").alias("number"))
    counted = votes.select("doc_id", "page", (F.col("number") - F.col("page")).alias("offset")).distinct().groupBy("doc_id", "offset").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))


def frames(images: DataFrame) -> DataFrame:
    """(doc_id, page, left, right, low, high): what the images painted on each page cover."""
    at = lambda i: F.get("ctm", F.lit(i))
    span = lambda f, p, q, o: f(F.lit(0.0), at(p), at(q), at(p) + at(q)) + at(o)
    rows = images.where("doc_id is not null and page is not null and size(ctm) = 6")
    return rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(
        F.min(span(F.least, 0, 2, 4)).alias("left"), F.max(span(F.greatest, 0, 2, 4)).alias("right"), F.min(span(F.least, 1, 3, 5)).alias("low"), F.max(span(F.greatest, 1, 3, 5)).alias("high")
    )


#: Rows ahead of a group's words: the document's page number offset, the frames of its pages, and rare words.
_OFFSET, _FRAME, _RARE = -(1 << 30) - 2, -(1 << 30) - 1, -(1 << 30)
_COLUMNS = {"doc_id": "bigint", "part": "int", "page": "int", "idx": "int", "text": "string", "x": "double", "y": "double", "size": "double", "word": "string"}


def _rows(df: DataFrame, kind: Column, **given: Column) -> DataFrame:
    """Rows of one kind in the columns of a group's words; those not given are NULL."""
    given |= {"doc_id": F.col("doc_id"), "part": F.col("part"), "page": kind}
    return df.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()))


def _packed(page: Page, leading: Word | None, following: Word | None, lines: list[int], channel: Channel) -> bytes:
    """A laid out page whose ``lines`` are still to be marked, with the rare words and marks at hand for them."""
    at = {id(w): i for i, w in enumerate(page.words)}
    flat = lambda w: w and (w.idx, w.text, w.x, w.y, w.size, w.kind, w.fixed)
    rare, marks = {}, []
    for w in (w for number in lines for w in page.body[number]):
        text = clean(w.text)
        if core(text):
            rare.update((r.word, channel.rare[r.word]) for r in channel.candidates(text) if r.word in channel.rare)
        elif text in channel.marks:
            marks.append(text)
    body = [[at[id(w)] for w in line] for line in page.body]
    copies = [(at[id(a)], at[id(b)]) for a, b in page.copies]
    return zlib.compress(pickle.dumps((page.number, list(map(flat, page.words)), body, copies, flat(leading), flat(following), lines, rare, marks), 5), 1)


def _unpacked(packed: bytes) -> tuple[Page, Word | None, Word | None, list[int], dict[str, float], list[str]]:
    number, words, body, copies, leading, following, lines, rare, marks = pickle.loads(zlib.decompress(packed))
    words = [Word(*w) for w in words]
    page = Page(number, words, body=[[words[i] for i in line] for line in body], copies=[(words[i], words[j]) for i, j in copies])
    return page, leading and Word(*leading), following and Word(*following), lines, rare, marks


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=schema.names), schema=schema, preserve_index=False)


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def over_pages(words: DataFrame, model: Model, emit, schema: str, images: DataFrame | None = None) -> DataFrame:
    """The rows ``emit(doc_id, page)`` of every page, whose ``schema`` begins with doc_id and page.

    One shuffle by (doc_id, part); pages that need more looked up are shuffled once more, packed.
    """
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    want = pa.schema([(n, types[t]) for n, t in (c.strip().split(" ") for c in schema.split(","))])
    wider = want.append(pa.field("packed", pa.binary())).append(pa.field("words", pa.list_(pa.string()))).append(pa.field("pairs", pa.list_(pa.string())))
    bc = words.sparkSession.sparkContext.broadcast(model.shipped())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(bc.value)
        out: list[tuple] = []
        key, held, offset, framed = None, [], None, {}
        waiting = 0  # bytes of packed pages

        def close():
            nonlocal waiting
            if not held:
                return
            pages = _pages(held)
            for page in pages.values():
                page.frame = framed.get(page.number)
                lay_out(page)
            for number, page in pages.items():
                if number // GROUP != key[1]:
                    continue
                edges = neighbours(pages.get(number - 1), pages.get(number + 1))
                asked = look_ups(page, *edges, channel)
                mark_margins(page, offset)
                mark_body(page, *edges, channel, (i for i in range(len(page.body)) if i not in asked))
                if asked:
                    every = [sorted(set().union(*own)) for own in zip(*asked.values())]
                    packed = _packed(page, *edges, list(asked), channel)
                    waiting += len(packed)
                    out.append((key[0], number, *(None for _ in want.names[2:]), packed, every[0], list(map(str, every[1]))))
                else:
                    finish(page)
                    out.extend((*row, None, None, None) for row in emit(key[0], page))

        for batch in batches:
            for row in zip(*(_values(batch.column(c)) for c in _COLUMNS)):
                if row[:2] != key:
                    close()
                    key, held, offset, framed = row[:2], [], None, {}
                    channel.rare, channel.marks = {}, set()
                    if len(out) + (waiting >> 8) > 20_000:
                        yield _batch(out, wider)
                        out, waiting = [], 0
                if row[2] == _OFFSET:
                    offset = row[3]
                elif row[2] == _FRAME:
                    framed[row[3]] = (row[5], row[6], row[7], float(row[8]))
                elif row[2] == _RARE:
                    channel.rare[row[8]] = row[5]
                    if row[6] and not core(row[8]):
                        channel.marks.add(row[8])
                else:
                    held.append(row[2:8])
        close()
        yield _batch(out, wider)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(bc.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, found in zip(*(batch.column(c) for c in ("doc_id", "packed", "found"))):
                doc_id, packed, found = doc_id.as_py(), packed.as_py(), found.as_py()
                page, leading, following, lines, rare, marks = _unpacked(packed)
                found = found or ()
                channel.rare = rare | {f["key"]: f["n"] for f in found if not f["pair"]}
                channel.rare_pairs = {int(f["key"]): int(f["n"]) for f in found if f["pair"]}
                channel.marks = set(marks)
                mark_body(page, leading, following, channel, lines)
                finish(page)
                out.extend(emit(doc_id, page))
                if len(out) > 20_000:
                    yield _batch(out, want)
                    out = []
            yield _batch(out, want)

    zero = F.lit(0)
    placed = grouped(words).withColumn("word", F.lit(None).cast("string")).select(*_COLUMNS)
    parts = grouped(_edges_of_pages(words).select("doc_id", "page")).select("doc_id", "part").distinct()
    offsets = parts.join(page_number_offsets(words), "doc_id")
    rows = placed.unionByName(_rows(offsets, F.lit(_OFFSET), idx=F.col("offset")))
    if images is not None:
        known = grouped(frames(images)).join(parts, ["doc_id", "part"], "left_semi")
        rows = rows.unionByName(_rows(known, F.lit(_FRAME), idx=F.col("page"), x=F.col("left"), y=F.col("right"), size=F.col("low"), word=F.col("high")))
    if model.near is not None:
        met = placed.select("doc_id", "part", "text").join(model.near, "text").select("doc_id", "part", "word", "n", "mark").distinct()
        rows = rows.unionByName(_rows(met, F.lit(_RARE), idx=zero, x=F.col("n"), y=F.col("mark").cast("int"), word=F.col("word")))
    first = rows.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "page", "idx", "text").mapInArrow(run, schema + ", packed binary, words array<string>, pairs array<string>")
    looked_up = [(pair, key, df) for pair, key, df in ((False, "word", model.rare), (True, "pair", model.rare_pairs)) if df is not None]
    if not looked_up:
        return first.select(*want.names)
    first = checkpointed(first)
    left = first.where("packed is not null")
    found = [left.select("doc_id", "page", F.explode(f"{name}s").alias("key")).join(df.select(F.col(name).alias("key"), F.col("n").cast("double").alias("n")), "key").select("doc_id", "page", F.struct(F.lit(pair).alias("pair"), "key", "n").alias("found")) for pair, name, df in looked_up]
    found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    found = found.groupBy("doc_id", "page").agg(F.collect_list("found").alias("found"))
    second = left.select("doc_id", "page", "packed").join(found, ["doc_id", "page"], "left").mapInArrow(rest, schema)
    return first.where("packed is null").select(*want.names).unionByName(second)


def _pages(rows: list[tuple]) -> dict[int, Page]:
    pages: dict[int, Page] = {}
    for page, idx, text, x, y, size in rows:
        words = pages.setdefault(page, Page(page, [])).words
        if not words or words[-1].idx != idx:
            words.append(Word(idx, text, x, y, size))
    return pages


def noise(words: DataFrame, model: Model, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, idx, kind, corrected): the rows that are noise; ``images`` give each page's scanned frame."""
    emit = lambda doc_id, page: [(doc_id, page.number, w.idx, w.kind, repaired(w) if w.fixed else None) for w in page.words if w.kind]
    return over_pages(words, model, emit, "doc_id bigint, page int, idx int, kind string, corrected string", images)


def repaired_paragraphs(words: DataFrame, model: Model, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, paragraph, text): continuous text of each page's body."""
    emit = lambda doc_id, page: [(doc_id, page.number, i, t) for i, t in enumerate(paragraphs(page))]
    return over_pages(words, model, emit, "doc_id bigint, page int, paragraph int, text string", images)
