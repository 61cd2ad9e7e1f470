"""Language of pages and of their segments, with confidence.

The model averages hashed subword embeddings of a segment and puts a linear
softmax on the mean; both are trained by stochastic gradient descent in numpy on
a bounded sample of labelled pages (:data:`SAMPLE_PER_LANGUAGE`), whose stored
labels may be partly wrong.  A held-out part of the sample sets the temperature
of the softmax and the confidence below which a segment is rejected.

As averaging and softmax are linear up to the last step, a word's share of the
logits is computed once per distinct word of a worker and then added up, so
scoring is a dictionary look-up for each word of the whole text.

Segments are sentences; lines are joined and divided words put together first.
A first or last line that stands apart (no sentence mark, few words, or a page
number) is a running header or footer and no text.

Defined results: NULL texts give no rows; texts without letters, and segments of
fewer than :data:`MIN_LETTERS` letters or below the rejection level, have the
language ``und``; repeated pages count once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.appearance import Form, normaliser

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "ru")
# ISO 639 codes of the languages in their other notations.
ALIASES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "rus": "ru"}

BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 4
#: A small sample is gone through more often, to take as many steps.
MIN_STEPS = 400
RATE = 0.5
BATCH = 64
MIN_LETTERS = 12
MIN_WORDS = 3
UNDETERMINED = "und"

_FORM = Form(compatibility=True, fold_case=True, skeleton=False)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_DIVIDED = re.compile(r"[-‐‑¬­]\s*\n\s*(?=[^\W\d_])")
_END = re.compile(r"[.!?][\"')\]]*$")


def label(column: Column) -> Column:
    """A stored label as two-letter code, NULL where it names none of the languages."""
    head = F.lower(F.regexp_extract(F.trim(column), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    known = F.create_map(*(F.lit(x) for a, b in (*ALIASES.items(), *((c, c) for c in LANGUAGES)) for x in (a, b)))
    return F.try_element_at(known, head)


def segments(text: str) -> list[str]:
    """The sentences of a page, without running lines and page numbers."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    lines = [x for x in lines if x]
    # A line apart at the top or bottom: no sentence mark, short beside the others, not continued.
    widths = sorted(len(x) for x in lines)
    usual = widths[3 * len(widths) // 4] if widths else 0
    for at in (0, -1):
        while lines:
            words = _WORD.findall(lines[at])
            alone = len(lines) == 1
            if len(words) < 2 and any(c.isdigit() for c in lines[at]) or not words or (len(words) == 1 and len(words[0]) <= 5 and not _END.search(lines[at]) and not alone):
                lines.pop(at)
                continue
            if at == 0 and not alone and not _END.search(lines[0]) and len(lines[0]) < 0.8 * usual and lines[1][:1].isupper():
                lines.pop(0)
            elif at == -1 and not alone and not _END.search(lines[-1]) and len(lines[-1]) < 0.8 * usual and _END.search(lines[-2]) and lines[-1][:1].isupper():
                lines.pop()
            break
    joined = _DIVIDED.sub("", "\n".join(lines)).replace("\n", " ")
    return [s for s in _SENTENCE.split(joined) if s]


def subwords(word: str) -> list[int]:
    padded = f"<{word}>"
    grams = {padded, *(padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1))}
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in sorted(grams)]


@dataclass
class Model:
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.5

    def word_logits(self) -> np.ndarray:
        """Each bucket's share of the logits: embedding times softmax weights."""
        return self.embedding @ self.weights


def _tokens(sentence: str, norm) -> list[str]:
    return _WORD.findall(norm(sentence))


def fit(examples: list[tuple[str, str]], seed: int = 5) -> Model:
    """Train on (text of a page, label) pairs; every sentence is one example of its page's label.

    Stored labels are partly wrong, so after a first fit the sentences whose
    label it contradicts are set aside and the model is fitted again.
    """
    norm, rng = normaliser(_FORM), np.random.default_rng(seed)
    cache: dict[str, list[int]] = {}
    rows, labels, held = [], [], []
    for number, (text, lang) in enumerate(examples):
        for sentence in segments(text):
            words = _tokens(sentence, norm)
            for w in words:
                if w not in cache:
                    cache[w] = subwords(w)
            if len(words) >= MIN_WORDS:
                rows.append(np.array([i for w in words for i in cache[w]], np.int64))
                labels.append(LANGUAGES.index(lang))
                held.append(number % 5 == 0)
    if not rows:
        return _start(rng)
    y, held = np.array(labels), np.array(held)
    model = _descend(_start(rng), rows, y, np.flatnonzero(~held), rng)
    share = model.word_logits()
    agrees = np.array([share[r].mean(0) + model.bias for r in rows]).argmax(1) == y
    model = _descend(_start(rng), rows, y, np.flatnonzero(~held & agrees), rng)
    _calibrate(model, [rows[i] for i in np.flatnonzero(held & agrees)], y[held & agrees])
    return model


def _start(rng: np.random.Generator) -> Model:
    n = len(LANGUAGES)
    return Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, n), np.float32), np.zeros(n, np.float32))


def _descend(model: Model, rows: list[np.ndarray], y: np.ndarray, train: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> Model:
    """Stochastic gradient descent on the softmax loss; languages weigh the same."""
    if not len(train):
        return model
    weight = len(train) / np.maximum(np.bincount(y[train], minlength=len(LANGUAGES)), 1) / len(LANGUAGES)
    epochs = max(epochs, -(-MIN_STEPS // max(1, len(train) // BATCH)))
    steps, done = epochs * max(1, len(train) // BATCH), 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for at in range(0, len(train), BATCH):
            rate = RATE * max(0.05, 1 - done / steps)
            done += 1
            part = train[at : at + BATCH]
            ids = np.concatenate([rows[i] for i in part])
            sizes = np.array([len(rows[i]) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(model.embedding[ids], starts) / sizes[:, None]
            p = _softmax(mean @ model.weights + model.bias)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[y[part]][:, None]
            back = (p @ model.weights.T) / sizes[:, None]
            model.weights -= rate / 8 * mean.T @ p
            model.bias -= rate * p.mean(0)
            # A bucket's steps are added up before it moves.
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
            model.embedding[ids[order][first]] -= (8 * rate * np.add.reduceat(back[owner[order]], first)).astype(np.float32)
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _calibrate(model: Model, rows: list[np.ndarray], y: np.ndarray) -> None:
    """Temperature of least held-out loss; rejection level of near-best held-out precision."""
    if not len(rows):
        return
    share = model.word_logits()
    z = np.array([share[r].mean(0) for r in rows]) + model.bias
    losses = {}
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        p = _softmax(z / t)
        losses[t] = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean()
    model.temperature = min(losses, key=losses.get)
    p = _softmax(z / model.temperature)
    best, right = p.max(1), p.argmax(1) == y
    precision = {level: right[best >= level].mean() for level in np.arange(0.3, 0.95, 0.05) if (best >= level).mean() > 0.5}
    top = max(precision.values(), default=0)
    model.reject = float(min((level for level, v in precision.items() if v >= top - 0.005), default=0.5))


def train(pages: DataFrame, text: str = "text", lang: str = "lang", key: str = "page_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most about ``per_language`` labelled pages of each language, chosen by hash of the key.

    The sample is bounded; labels are counted over all pages to set its rate.
    """
    labelled = pages.select(F.col(key).alias("k"), F.col(text).alias("text"), label(F.col(lang)).alias("label")).where("label is not null and text is not null and length(text) > 40")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([])
    million = 1_000_000
    rate = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, min(million, int(million * per_language / n) + 1))))
    chosen = labelled.where(F.pmod(F.xxhash64("k"), F.lit(million)) < F.element_at(rate, F.col("label")))
    rows = chosen.select("k", "text", "label").dropDuplicates(["k"]).toPandas().sort_values("k")
    return fit(list(zip(rows["text"], rows["label"])))


class Scorer:
    """Logits of whole pages at a time: one table row for each distinct word met so far."""

    MOST_WORDS = 1 << 18

    def __init__(self, model: Model):
        self.model, self.norm = model, normaliser(_FORM)
        self.share = model.word_logits().astype(np.float64)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, len(LANGUAGES) + 1))  # summed logits, and how many subwords

    def _row(self, word: str) -> int:
        at = len(self.rows)
        if at == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        ids = subwords(word)
        self.table[at, :-1], self.table[at, -1] = self.share[ids].sum(0), len(ids)
        self.rows[word] = at
        return at

    def sentences(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each sentence."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if len(self.rows) > self.MOST_WORDS:
            self._forget()
        ids, starts, which = [], [], []
        for number, sentence in enumerate(texts):
            tokens = _tokens(sentence, self.norm)
            if len(tokens) >= MIN_WORDS and sum(map(len, tokens)) >= MIN_LETTERS:
                starts.append(len(ids))
                which.append(number)
                ids += [row if (row := self.rows.get(t)) is not None else self._row(t) for t in tokens]
        if which:
            total = np.add.reduceat(self.table[ids], starts)
            p = _softmax((total[:, :-1] / total[:, -1:] + self.model.bias) / self.model.temperature)
            best, sure = p.argmax(1).tolist(), p.max(1).tolist()
            for number, k, confidence in zip(which, best, sure):
                out[number] = (LANGUAGES[k] if confidence >= self.model.reject else UNDETERMINED, confidence)
        return out

    def segment(self, sentence: str) -> tuple[str, float]:
        return self.sentences([sentence])[0]

    def page(self, text: str) -> tuple[list[tuple[str, float, str]], list[tuple[str, float, float]]]:
        """(segments, languages): runs of one language, and per language (code, share of letters, confidence)."""
        runs: list[list] = []
        weight, trust = defaultdict(float), defaultdict(float)
        sentences = segments(text)
        closed = any(_END.search(s) for s in sentences)
        for sentence, (lang, confidence) in zip(sentences, self.sentences(sentences)):
            letters = sum(map(str.isalpha, sentence))
            # Beside whole sentences, a rest without sentence mark may be a running line: it is no evidence.
            if lang != UNDETERMINED and (not closed or _END.search(sentence)):
                weight[lang] += letters
                trust[lang] += letters * confidence
            if runs and (runs[-1][0] == lang or lang == UNDETERMINED):
                runs[-1][1] += letters * confidence
                runs[-1][2].append(sentence)
                runs[-1][3] += letters
            else:
                runs.append([lang, letters * confidence, [sentence], letters])
        whole = sum(weight.values()) or 1
        pieces = [(lang, c / max(n, 1), " ".join(s)) for lang, c, s, n in runs]
        return pieces, sorted(((k, w / whole, trust[k] / w) for k, w in weight.items()), key=lambda x: -x[1])


def page_languages(pages: DataFrame, model: Model, key: str = "page_id") -> DataFrame:
    """(page_id, label, lang, share, confidence): one row per language with running text; ``und`` where none."""
    bc = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), label(F.col("lang")).alias("label"), F.col("text")).where(F.col("page_id").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bc.value)
        for batch in batches:
            out = []
            for page_id, stored, value in zip(batch.column("page_id").to_pylist(), batch.column("label").to_pylist(), batch.column("text")):
                found = scorer.page(value.as_py())[1] or [(UNDETERMINED, 0.0, 0.0)]
                out += [(page_id, stored, *f) for f in found]
            frame = pd.DataFrame(out, columns=["page_id", "label", "lang", "share", "confidence"])
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("page_id", pa.int64()), ("label", pa.string()), ("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())]), preserve_index=False)

    return rows.mapInArrow(run, "page_id bigint, label string, lang string, share double, confidence double")


def page_segments(pages: DataFrame, model: Model, key: str = "page_id") -> DataFrame:
    """(page_id, segment, lang, confidence, text): the runs of one language in reading order."""
    bc = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col("text")).where(F.col("page_id").isNotNull() & F.col("text").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bc.value)
        for batch in batches:
            out = []
            for page_id, value in zip(batch.column("page_id").to_pylist(), batch.column("text")):
                out += [(page_id, i, *piece) for i, piece in enumerate(scorer.page(value.as_py())[0])]
            frame = pd.DataFrame(out, columns=["page_id", "segment", "lang", "confidence", "text"])
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("page_id", pa.int64()), ("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("text", pa.string())]), preserve_index=False)

    return rows.mapInArrow(run, "page_id bigint, segment int, lang string, confidence double, text string")


def mislabelled(languages: DataFrame) -> DataFrame:
    """(page_id, lang) of pages whose stored label is not exactly the one language found."""
    known = languages.where(F.col("lang") != UNDETERMINED)
    pages = known.groupBy("page_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    wrong = pages.where((F.size("langs") > 1) | F.col("label").isNull() | (F.col("langs")[0] != F.col("label")))
    return wrong.select("page_id", F.explode("langs").alias("lang"))
