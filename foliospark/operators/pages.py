"""Operators on the page and glyph tables.

Defined results: empty tables give empty results; pages without text are no
part of a document's text; glyph rows without text, page or document are left
out of layout; repeated glyph rows (same doc_id, page, idx) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import geometry
from foliospark.kernel.layout import Glyphs, Layout, Options


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): page texts in order, a blank line between, empty pages skipped."""
    shown = pages.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return shown.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def page_range(df: DataFrame, first: int, last: int = 0) -> DataFrame:
    """Pages from ``first`` to ``last`` inclusive, 0 for the end."""
    keep = F.col("page") >= first
    return df.where(keep & (F.col("page") <= last) if last else keep)


def glyphs_in(glyphs: DataFrame, region: Column) -> DataFrame:
    """Glyphs whose quad touches a rectangle, edges included."""
    return glyphs.where(geometry.intersects(geometry.glyph_bounds(), region))


_PACKED = "doc_id bigint, page int, idx binary, sizes binary, texts binary, numbers binary, vectors binary"


def layout_text(glyphs: DataFrame, options: Options = Options(), boxes: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, text) laid out anew from glyph rows.

    Glyphs of a page that arrive together are packed into one row of arrays
    before the one shuffle by (doc_id, page), so what is shuffled and sorted are
    pieces of pages and not glyphs; pages are put together and read off as they
    pass by, and a task never holds more than one page.  ``boxes`` may give media
    boxes (doc_id, page, media_box).  Of glyphs with one idx the first by text
    counts.
    """
    columns = ["doc_id", "page", "idx", "text", "x", "y", "advance", "size", "dir", "ascent", "descent"]
    rows = glyphs.where("doc_id is not null and page is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("idx").cast("int").alias("idx"), *columns[3:])
    packed = rows.mapInArrow(_pack, _PACKED)
    if boxes is not None:
        one = boxes.where("doc_id is not null and page is not null").groupBy("doc_id", "page").agg(F.max("media_box").alias("media_box"))
        packed = packed.join(one, ["doc_id", "page"], "left")
    else:
        packed = packed.withColumn("media_box", F.lit(None).cast("struct<min_x: double, min_y: double, max_x: double, max_y: double>"))
    placed = packed.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if pieces:
                        out.append((*key, _text_of(pieces, options)))
                    key, pieces = row[:2], []
                pieces.append(row[2:])
            yield _text_rows(out)
        if pieces:
            yield _text_rows([(*key, _text_of(pieces, options))])

    return placed.select("doc_id", "page", "idx", "sizes", "texts", "numbers", "vectors", "media_box").mapInArrow(run, "doc_id bigint, page int, text string")


def _text_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "page", "text"])


def _pairs(column: pa.Array, default: tuple[float, float]) -> np.ndarray:
    """n x 2 numbers of a struct column, the default where it is NULL."""
    if column.null_count == len(column):
        return np.tile(np.array(default), (len(column), 1))
    out = np.stack([column.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y")], axis=1)
    out[column.is_null().to_numpy(zero_copy_only=False)] = default
    return np.nan_to_num(out)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of glyphs of one page, each as one row of raw arrays."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, page = (batch.column(c).to_numpy() for c in ("doc_id", "page"))
        if ((doc[1:] == doc[:-1]) & (page[1:] == page[:-1])).mean() < 0.5 and n > 1:
            order = np.lexsort((page, doc))  # rows in no order of pages: brought together within the batch
            batch = batch.take(pa.array(order))
            doc, page = doc[order], page[order]
        starts = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (page[1:] != page[:-1])) + 1).tolist(), n]
        idx = np.nan_to_num(batch.column("idx").to_numpy(zero_copy_only=False).astype(float)).astype(np.int32)
        text = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
        raw, sizes = text.buffers()[2], np.diff(offsets).astype(np.int32)
        numbers = np.stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("x", "y", "advance", "size")], axis=1)
        toward = _pairs(batch.column("dir"), (1.0, 0.0))
        vectors = np.concatenate([toward, _pairs(batch.column("ascent"), (0.0, 0.0)), _pairs(batch.column("descent"), (0.0, 0.0))], axis=1)
        plain = (vectors == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)).all(axis=1)
        bounds = list(zip(starts, starts[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[starts[:-1]]), pa.array(page[starts[:-1]]), pa.array([idx[a:b].tobytes() for a, b in bounds], pa.binary()), pa.array([sizes[a:b].tobytes() for a, b in bounds], pa.binary()),
                pa.array([raw[int(offsets[a]) : int(offsets[b])].to_pybytes() for a, b in bounds], pa.binary()), pa.array([numbers[a:b].tobytes() for a, b in bounds], pa.binary()), pa.array([b"" if plain[a:b].all() else vectors[a:b].tobytes() for a, b in bounds], pa.binary()),
            ],
            names=["doc_id", "page", "idx", "sizes", "texts", "numbers", "vectors"],
        )


def _text_of(pieces: list[tuple], options: Options) -> str:
    """The text of a page from its pieces."""
    idx = np.concatenate([np.frombuffer(p[0], np.int32) for p in pieces])
    text: list[str] = []
    for p in pieces:
        sizes, whole = np.frombuffer(p[1], np.int32), p[2].decode()
        if len(whole) == len(sizes) and len(p[2]) == int(sizes.sum()) and len(p[2]) == len(whole):
            text += whole  # one character of one byte each
        else:
            ends = np.cumsum(sizes).tolist()
            text += [p[2][a:b].decode() for a, b in zip([0, *ends], ends)]
    numbers = np.concatenate([np.frombuffer(p[3], float).reshape(-1, 4) for p in pieces])
    vectors = np.concatenate([np.frombuffer(p[4], float).reshape(-1, 6) if p[4] else np.tile(np.array((1.0, 0.0, 0.0, 0.0, 0.0, 0.0)), (len(p[0]) // 4, 1)) for p in pieces])
    if (idx[1:] > idx[:-1]).all():
        keep = None
    else:
        order = np.argsort(idx, kind="stable")
        if (np.diff(idx[order]) == 0).any():
            order = np.array(sorted(range(len(idx)), key=lambda k: (idx[k], text[k].encode())))
        keep = order[np.concatenate([[True], np.diff(idx[order]) > 0])]
        text, numbers, vectors = [text[k] for k in keep], numbers[keep], vectors[keep]
    toward = vectors[:, :2]
    length = np.hypot(toward[:, 0], toward[:, 1])
    usable = length > 1e-9
    toward = np.where(usable[:, None], toward / np.where(usable, length, 1.0)[:, None], (1.0, 0.0))
    box = next((p[5] for p in pieces if p[5] is not None), None)
    glyphs = Glyphs(text, *(np.ascontiguousarray(numbers[:, i]) for i in range(4)), toward[:, 0], toward[:, 1], vectors[:, 2:4], vectors[:, 4:6])
    return Layout(glyphs, options, None if box is None else (box["min_x"], box["min_y"], box["max_x"], box["max_y"])).page_text()


def without_repeats(glyphs: DataFrame) -> DataFrame:
    """Glyph rows with copies painted at one place left out (first drawn kept), for text in any direction.

    Places are compared along and across the later glyph's direction (upright
    where there is none).  Glyphs meet only others of their page, text, size
    class and place cell: a grid whose cells grow with the size, joined on all
    the cells a copy may lie in, instead of all pairs of a page.
    """
    g = glyphs.where("text is not null").dropDuplicates(["doc_id", "page", "idx"])
    em = F.least(F.greatest(F.col("size"), F.lit(1.0)), F.lit(1e9))
    side = lambda level: F.pow(F.lit(2.0), level) / 2
    level = lambda c: F.floor(F.log2(c))
    dx, dy = (F.col("dir.x"), F.col("dir.y")) if "dir" in glyphs.columns else (F.lit(1.0), F.lit(0.0))
    length = F.sqrt(dx * dx + dy * dy)
    unit = lambda c, default: F.when(length > 1e-9, c / length).otherwise(default)
    placed = g.select("doc_id", "page", "text", "idx", "x", "y", "size", "advance", em.alias("em"), unit(dx, 1.0).alias("dx"), unit(dy, 0.0).alias("dy"))
    g2 = placed.withColumn("level", level("em")).withColumn("cell", F.floor(F.col("x") / side("level")))
    reach = F.when(F.abs("advance") > 0, F.least(F.col("em") * 0.1, F.abs("advance") / 3)).otherwise(F.col("em") * 0.1)
    first = placed.select("doc_id", "page", "text", F.col("idx").alias("i0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("size").alias("s0"), F.col("em").alias("e0"), reach.alias("r0"))
    # Copies have a size within a tenth, and lie within the diagonal of 0.1 x 0.2 of it.
    first = first.withColumn("level", F.explode(F.sequence(level(F.greatest(F.col("e0") * 0.89, F.lit(1.0))), level(F.col("e0") * 1.11))))
    first = first.withColumn("cell", F.explode(F.sequence(F.floor((F.col("x0") - 0.23 * F.col("e0")) / side("level")), F.floor((F.col("x0") + 0.23 * F.col("e0")) / side("level")))))
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    along, across = px * F.col("dx") + py * F.col("dy"), py * F.col("dx") - px * F.col("dy")
    later = g2.join(first, ["doc_id", "page", "text", "level", "cell"]).where(
        (F.col("i0") < F.col("idx")) & (F.abs(along) <= F.col("r0")) & (F.abs(across) <= 0.2 * F.col("e0")) & (F.abs(F.col("size") - F.col("s0")) <= 0.1 * F.col("e0"))
    )
    return g.join(later.select("doc_id", "page", "idx").distinct(), ["doc_id", "page", "idx"], "left_anti")


def ocr_selected(pages: DataFrame, policy: str = "textless", n_glyphs: str = "n_glyphs", images: str = "image_count") -> DataFrame:
    """Pages an OCR engine should read: without text, with images, or all."""
    rule = {"textless": F.coalesce(F.col(n_glyphs), F.lit(0)) == 0, "images": F.coalesce(F.col(images), F.lit(0)) > 0, "all": F.lit(True), "none": F.lit(False)}
    if policy not in rule:
        raise ValueError(f"unknown OCR policy {policy!r}")
    return pages.where(rule[policy])


def append_ocr(glyphs: DataFrame, words: DataFrame) -> DataFrame:
    """OCR words after a page's content glyphs: idx continues, origin is ``ocr``."""
    last = glyphs.groupBy("doc_id", "page").agg((F.max("idx") + 1).alias("base"))
    more = words.join(last, ["doc_id", "page"], "left").withColumn("idx", (F.col("idx") + F.coalesce("base", F.lit(0))).cast("int")).withColumn("origin", F.lit("ocr")).drop("base")
    return glyphs.unionByName(more, allowMissingColumns=True)


def tsv_words(tsv: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Word rows (level 5) of OCR engines' tab-separated output, one line for each row of ``line``.

    Adds left, top, width, height, conf and text; header, other levels, blank
    words and words below the confidence are left out.
    """
    f = F.split("line", "\t", -1)
    number = lambda i: F.try_to_number(F.get(f, F.lit(i)), F.lit("S999999.999999")).cast("double")
    word = F.get(f, F.lit(11))
    rows = tsv.where((F.size(f) == 12) & (F.get(f, F.lit(0)) == "5"))
    rows = rows.select("*", *(number(i).alias(n) for i, n in ((6, "left"), (7, "top"), (8, "width"), (9, "height"), (10, "conf"))), word.alias("word"))
    return rows.where((F.trim("word") != "") & (F.col("conf") >= least_confidence)).drop("line").withColumnRenamed("word", "text")


def merged_intervals(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, lo, hi, n): overlapping or touching intervals of a key joined into one."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(low).isNotNull() & F.col(high).isNotNull() & F.col(key).isNotNull()).withColumn("_new", F.when(before.isNull() | (F.col(low) > before), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_g").agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_g")
