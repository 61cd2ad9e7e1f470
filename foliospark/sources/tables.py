"""PDF files as relational tables.

Each table has its own reader, so what a query does not ask for is not done: no
glyph rows for page texts, no images for glyphs.  ``extract`` takes any frame
of files (``binaryFile`` rows, or ``doc_id`` and ``content``) and works in Arrow
batches, one file after another, inside one stage; the content never shuffles.

Defined results: a file that cannot be read is one row of ``documents`` with
``error`` and no rows elsewhere; NULL or empty content counts as unreadable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.kernel import extract as kernel
from foliospark.kernel import pictures
from foliospark.kernel.extract import Options

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RECT = pa.struct([(n, pa.float64()) for n in ("min_x", "min_y", "max_x", "max_y")])
DEST = pa.struct([("name", pa.string()), ("page", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("zoom", pa.float64())])

SCHEMAS = {
    "documents": pa.schema(
        [("doc_id", pa.int64()), ("page_count", pa.int32()), *((n, pa.string()) for n in kernel.KNOWN.values()), ("custom", pa.map_(pa.string(), pa.string())), ("xmp", pa.binary()), ("text", pa.string()), ("n_warnings", pa.int32()), ("error", pa.string())]
    ),
    "pages": pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("n_glyphs", pa.int32()), ("ocr_glyphs", pa.int32()), ("image_count", pa.int32()), ("media_box", RECT), ("crop_box", RECT), ("rotation", pa.int32())]),
    "glyphs": pa.schema(
        [("doc_id", pa.int64()), ("page", pa.int32()), ("idx", pa.int32()), ("text", pa.string()), *((n, pa.float64()) for n in ("x", "y", "advance", "size")), ("dir", POINT), ("ascent", POINT), ("descent", POINT), ("origin", pa.string())]
    ),
    "images": pa.schema(
        [("doc_id", pa.int64()), ("page", pa.int32()), ("idx", pa.int32()), *((n, pa.int32()) for n in ("width", "height", "bits_per_component", "components")), ("color_space", pa.string()), ("filter", pa.string()), ("image_mask", pa.bool_()), ("inline", pa.bool_()), ("ctm", pa.list_(pa.float64())), ("data", pa.binary()), ("pixels", pa.binary()), ("problem", pa.string())]
    ),
    "outlines": pa.schema([("doc_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("ordinal", pa.int32()), ("title", pa.string()), ("destination", DEST)]),
    "annotations": pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("idx", pa.int32()), ("subtype", pa.string()), ("rect", RECT), ("contents", pa.string()), ("title", pa.string()), ("url", pa.string()), ("destination", DEST)]),
    "form_fields": pa.schema([("doc_id", pa.int64()), ("idx", pa.int32()), ("name", pa.string()), ("alternate_name", pa.string()), ("type", pa.string()), ("value", pa.string()), ("page", pa.int32())]),
    "warnings": pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("code", pa.string()), ("message", pa.string())]),
}

_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary"}


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return "struct<" + ", ".join(f"{kind.field(i).name}: {_ddl(kind.field(i).type)}" for i in range(kind.num_fields)) + ">"
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_map(kind):
        return f"map<{_ddl(kind.key_type)}, {_ddl(kind.item_type)}>"
    return _DDL[kind]


def schema(table: str) -> str:
    return ", ".join(f"{f.name} {_ddl(f.type)}" for f in SCHEMAS[table])


def _rect(box) -> dict:
    return dict(zip(("min_x", "min_y", "max_x", "max_y"), box))


def _needs(table: str, options: Options) -> Options:
    """Only the work that a table's rows need."""
    if table == "images":
        return replace(options, images=True, extras=False)
    return replace(options, images=False, extras=table in ("documents", "outlines", "annotations", "form_fields"))


def rows(table: str, doc_id: int, content: bytes | None, options: Options) -> Iterator[dict]:
    """The rows of one file in one of the row tables (all but glyphs)."""
    doc = kernel.Document()
    try:
        for page in kernel.read_pages(content or b"", _needs(table, options), doc):
            if table == "pages":
                n = sum(len(r) for r in page.runs)
                yield {"doc_id": doc_id, "page": page.number, "text": page.text(options.layout) if options.region is None else page.text_in(options.region, options.layout), "n_glyphs": n, "ocr_glyphs": page.ocr_glyphs, "image_count": page.image_count, "media_box": _rect(page.media_box), "crop_box": _rect(page.crop_box), "rotation": page.rotation}
            elif table == "images":
                for idx, image in enumerate(page.images):
                    try:
                        data, problem = pictures.pixels(image, options.limits.pixels).tobytes(), None
                    except (pictures.Unsupported, ValueError, IndexError) as e:
                        data, problem = None, str(e)
                    yield {"doc_id": doc_id, "page": page.number, "idx": idx, "width": image.width, "height": image.height, "bits_per_component": image.bits, "components": image.components, "color_space": image.space.name if image.space else None, "filter": image.filter, "image_mask": image.mask, "inline": image.inline, "ctm": list(image.ctm), "data": image.data, "pixels": data, "problem": problem}
            elif table == "annotations":
                for idx, note in enumerate(page.annotations):
                    yield {"doc_id": doc_id, "page": page.number, "idx": idx, **note, "rect": _rect(note["rect"])}
            elif table == "warnings":
                for n, (code, message) in enumerate(page.warnings):
                    yield {"doc_id": doc_id, "page": page.number, "ord": n, "code": code, "message": message}
            elif table == "documents":
                doc.pages.append(page)
    except kernel.Strict as e:
        doc.error = str(e)
    if table == "documents":
        text = None if doc.error and not doc.pages else doc.text(options.layout)
        yield {"doc_id": doc_id, "page_count": doc.page_count, **{k: doc.metadata.get(k) for k in (*kernel.KNOWN.values(), "xmp")}, "custom": list((doc.metadata.get("custom") or {}).items()), "text": text, "n_warnings": len(doc.warnings) + sum(len(p.warnings) for p in doc.pages), "error": doc.error}
    elif table == "outlines":
        for item in doc.outlines:
            yield {"doc_id": doc_id, **item}
    elif table == "form_fields":
        for idx, item in enumerate(doc.fields):
            yield {"doc_id": doc_id, "idx": idx, **item}
    elif table == "warnings":
        for n, (code, message) in enumerate(doc.warnings):
            yield {"doc_id": doc_id, "page": 0, "ord": n, "code": code, "message": message}


def glyph_batches(doc_id: int, content: bytes | None, options: Options) -> Iterator[pa.RecordBatch]:
    """Glyph rows of one file, a batch for each page, built from whole arrays."""
    pair = lambda a, b: pa.StructArray.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64())], names=["x", "y"])
    try:
        for page in kernel.read_pages(content or b"", _needs("glyphs", options)):
            g = page.glyphs()
            n = len(g)
            if not n:
                continue
            origin = [r.origin for r in page.runs for _ in range(len(r))]
            columns = [np.full(n, doc_id, np.int64), np.full(n, page.number, np.int32), np.arange(n, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(g.text, pa.string()), *(pa.array(v, pa.float64()) for v in (g.x, g.y, g.advance, g.size)), pair(g.dx, g.dy), pair(g.up[:, 0], g.up[:, 1]), pair(g.down[:, 0], g.down[:, 1]), pa.array(origin, pa.string())],
                schema=SCHEMAS["glyphs"],
            )
    except kernel.Strict:
        return


def extract(files: DataFrame, table: str, options: Options = Options(), id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """One of the tables of :data:`SCHEMAS` from a frame of files."""
    if table not in SCHEMAS:
        raise ValueError(f"no table {table!r}; there are {', '.join(SCHEMAS)}")
    want = SCHEMAS[table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                content = value.as_py()
                if table == "glyphs":
                    yield from glyph_batches(doc_id, content, options)
                    continue
                for row in rows(table, doc_id, content, options):
                    out.append(row)
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=want)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=want)

    narrow = files.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    return narrow.mapInArrow(run, schema(table))


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, path, content) of the files below a path; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")
