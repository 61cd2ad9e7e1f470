"""Evaluation passages inside training documents: a prefix-filtered set join.

An item is the set of its shingles of :data:`SHINGLE` consecutive words.  Words
are ordered by rarity over the corpus.  Sharing a whole shingle means sharing
all its words, so the prefix that must be met is one word, its rarest: documents
are probed by these prefix words only.  A hit fixes where the shingle must lie
in the document (position bound), the window must fit (length bound), and it is
compared word by word; around the match, the item-sized window gives the
contained share.

The probe index is built for blocks of items of a bounded number of characters
(:data:`BLOCK_CHARS`); every block is set against all documents.

Defined results: NULL and empty texts and items of fewer words than a shingle
match nothing; repeated items and documents count once; whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 8
#: Largest number of characters of items whose index is shipped at once.
BLOCK_CHARS = 8_000_000

WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rarity(documents: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of the items occurs, over all documents."""
    bc = documents.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = bc.value, Counter()
        for batch in batches:
            for value in batch.column("text"):
                total.update(wanted.intersection(words(value.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = documents.select(F.col(text).alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in rows.collect()}  # at most the block's vocabulary


class Probe:
    """Prefix index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], size: int = SHINGLE):
        self.size = size
        self.sizes: dict[int, int] = {}
        self.by_word: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        self.items: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            tokens = words(text)
            self.sizes[item_id] = max(len(tokens), size, self.sizes.get(item_id, 0))
            for i in range(len(tokens) - size + 1):
                shingle = tuple(tokens[i : i + size])
                if shingle not in self.items:
                    at = min(range(size), key=lambda j: (frequency.get(shingle[j], 0), shingle[j], j))
                    self.by_word.setdefault(shingle[at], []).append((at, shingle))
                self.items.setdefault(shingle, []).append((item_id, i))
        self.prefix = frozenset(self.by_word)

    def match(self, text: str) -> list[tuple[int, int, float]]:
        """(item_id, shared shingles, best contained share of an item-sized window)."""
        tokens = words(text)
        size, n = self.size, len(tokens)
        if n < size or self.prefix.isdisjoint(tokens):
            return []
        found: dict[int, set[tuple[int, int]]] = {}
        for pos, token in enumerate(tokens):
            if token in self.prefix:
                for at, shingle in self.by_word[token]:
                    start = pos - at
                    if 0 <= start <= n - size and tuple(tokens[start : start + size]) == shingle:
                        for item_id, i in self.items[shingle]:
                            found.setdefault(item_id, set()).add((start, i))
        out = []
        for item_id, hits in found.items():
            window = self.sizes[item_id]
            best, starts = 0, sorted(hits)
            lo = 0
            for hi in range(len(starts)):
                while lo < hi and starts[hi][0] - starts[lo][0] > window - size:
                    lo += 1
                best = max(best, len({i for _, i in starts[lo : hi + 1]}))
            out.append((item_id, len({i for _, i in hits}), min(1.0, best / (window - size + 1))))
        return out


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, shared_shingles, contained): every document with every item it shares a shingle with."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    schema, out = "doc_id bigint, item_id bigint, shared_shingles int, contained double", None
    for block in range(blocks):
        own = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        frequency = rarity(docs, {w for _, t in own for w in words(t)})
        bc = spark.sparkContext.broadcast(Probe(own, frequency, size))

        def probe(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pd.DataFrame]:
            index = bc.value
            for batch in batches:
                rows = []
                for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    rows += [(doc_id, *m) for m in index.match(value.as_py())]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "item_id", "shared_shingles", "contained"]).astype({"doc_id": "int64", "item_id": "int64", "shared_shingles": "int32", "contained": "float64"}), preserve_index=False)

        part = docs.mapInArrow(probe, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("shared_shingles").alias("shared_shingles"), F.max("contained").alias("contained"))


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_documents, contained): which items leaked, and the largest contained share."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("contained").alias("contained"))
