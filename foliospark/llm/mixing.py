"""A mixture of sources with target shares of the total size in tokens.

The total is the largest one that meets every share within the repeat caps (or
a given smaller one).  It is divided into blocks of equal size; Sainte-Laguë
apportionment gives the blocks to sources by highest quotients, each source's
blocks to groups of its shards and each group's to the shards the same way, so
every (source, shard) has an integer quota before anything is selected.  Within
one, documents follow in a seeded order that is cut into blocks: whole passes
first, then the first blocks of the next pass.  A document belongs to the block
in which it begins.

Shards hold a bounded number of tokens, so the ordered scan of one task does not
grow with a source.  A source of n shards has about sqrt(n) groups of sqrt(n)
shards, and no step sees more rows of a source than one of these.

Defined results: documents without text, of zero tokens, or without a source
that has a target are not used; a target whose source has no documents keeps
its row in the report with nothing in it, and the other shares are raised in
proportion; repeated rows of a document count once.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("FOLIOSPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenising pattern that belongs to this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 512
SHARD_TOKENS = 2_000_000
SEED = 17

_encoders: dict[str, object] = {}


def encoder(path: str | None = None):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Replace ``text`` by ``n_tokens``; NULL has none."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if (t := v.as_py()) else 0 for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by highest quotients weight / (2 s + 1), ties by key; no key above its cap.

    The bulk is given at once from a lower bound of the final divisor, the rest
    by a heap, so the cost follows the number of keys and not of seats.
    """
    weights = {k: w for k, w in weights.items() if w > 0}
    total = sum(weights.values())
    caps = caps or {}
    # Below floor(share) - 1 no quotient can lose its seat to another key.
    got = {k: max(0, min(math.floor(seats * w / total) - 1, caps.get(k, seats))) for k, w in weights.items()}
    heap = [(-w / (2 * got[k] + 1), str(k), k) for k, w in weights.items() if got[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        if not heap:
            break
        _, _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < caps.get(k, seats):
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), str(k), k))
    return got


def sizes(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that can be used."""
    known = targets.where(F.col("source").isNotNull()).select("source").distinct()
    usable = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    counted = with_tokens(usable.join(known, "source", "left_semi"), "text", path).where("n_tokens > 0")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


def mixture(sized: DataFrame, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, source, n_tokens, uses): how often each document is used; unused ones are left out.

    ``sized`` is read more than once: give a written or checkpointed table.
    """
    spark = sized.sparkSession
    # One row per source: as many as there are targets.
    goals = {r.source: (r.target_share, max(1, r.max_repeats or 1)) for r in targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeats").distinct().collect()}
    have = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if r.source in goals}
    share = {s: goals[s][0] for s in have}
    whole = sum(share.values()) or 1.0
    share = {s: w / whole for s, w in share.items()}
    limit = {s: have[s] * goals[s][1] for s in have}
    most = min((limit[s] / share[s] for s in have), default=0)
    blocks = int(min(most, total_tokens or most) // block)
    quota = sainte_lague(share, blocks, {s: limit[s] // block for s in have})
    # Shards by a hash of the document; their sizes are counted, their quotas apportioned.
    shards = {s: max(1, math.ceil(have[s] / shard_tokens)) for s in have}
    per_source = spark.createDataFrame([(s, shards[s], goals[s][1]) for s in have] or [("", 1, 1)], "source string, shards int, max_repeats int")
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = sized.join(F.broadcast(per_source), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards")).cast("int"))
    loads = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("load"))
    assigned = _shard_quotas(loads, quota, {s: goals[s][1] for s in have}, shards, block)
    w = Window.partitionBy("source", "shard").orderBy(order, "doc_id")
    before = F.sum("n_tokens").over(w) - F.col("n_tokens")
    used = placed.withColumn("before", before).join(assigned, ["source", "shard"])
    passes = F.floor(F.col("want") / F.col("load"))
    extra = F.when(F.col("before") < F.col("want") - passes * F.col("load"), 1).otherwise(0)
    uses = F.least(passes + extra, F.col("max_repeats")).cast("int")
    return used.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")


def _shard_quotas(loads: DataFrame, quota: dict[str, int], repeats: dict[str, int], shards: dict[str, int], block: int) -> DataFrame:
    """(source, shard, load, want): tokens each shard owes, apportioned within its source.

    First to groups of shards, then within each group, so one task sees about the
    square root of a source's shards, never documents.
    """
    rows = [(s, quota.get(s, 0), repeats[s], math.isqrt(n - 1) + 1) for s, n in shards.items()]
    known = loads.sparkSession.createDataFrame(rows or [("", 0, 1, 1)], "source string, blocks bigint, repeats bigint, groups int")
    most = F.floor(F.col("load") * F.col("repeats") / F.lit(block)).cast("bigint").alias("most")
    placed = loads.join(F.broadcast(known), "source").select("source", F.pmod("shard", "groups").alias("part"), "shard", "load", most, "blocks")
    parts = placed.groupBy("source", "part").agg(F.sum("load").alias("load"), F.sum("most").alias("most"), F.first("blocks").alias("blocks"))
    whole = parts.groupBy("source").applyInPandas(lambda g: _apportioned(g, "part"), "source string, part int, seats bigint").withColumnRenamed("seats", "blocks")
    each = placed.drop("blocks").join(whole, ["source", "part"])
    got = each.groupBy("source", "part").applyInPandas(lambda g: _apportioned(g, "shard", "load"), "source string, shard int, load bigint, seats bigint")
    return got.select("source", "shard", "load", (F.col("seats") * block).alias("want"))


def _apportioned(group, key: str, *keep: str):
    """The rows of one group with the seats each gets of the group's ``blocks``."""
    got = sainte_lague(dict(zip(group[key], group["load"])), int(group["blocks"].iloc[0]), dict(zip(group[key], group["most"])))
    return group.assign(seats=[got.get(k, 0) for k in group[key]])[["source", key, *keep, "seats"]]


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, actual_share, n_documents, most_uses) of every target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
    rows = targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left")
    rows = rows.withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row per target
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("source", "target_share", "max_repeats", zero("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), zero("n_documents"), zero("most_uses"))
