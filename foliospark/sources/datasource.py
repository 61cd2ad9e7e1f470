"""``spark.read.format("pdf")``: the tables as a data source.

Options: ``path`` (a folder or file, local or a URI of a store that Arrow
reads), ``table`` (default ``pages``), ``pages`` (such as ``2-5,9-``),
``password`` (several by line breaks), ``mode`` (layout mode); switches
``strict``, ``appearances``, ``foldLigatures``, ``ignoreArtifacts``,
``keepDuplicates``, ``keepOffPage``, ``extras``; bounds ``maxOperators``,
``maxGlyphs``, ``maxDepth``, ``maxImages``, ``maxPixels`` (0 is the default of
each).  Filters on ``page`` reach the reader where the session allows filter
push-down for Python sources; they narrow the ranges of ``pages``.

Files are listed once and dealt out by bytes, so a task reads about
:data:`TASK_BYTES` whatever the number of files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.kernel.extract import Options
from foliospark.kernel.interpreter import Limits
from foliospark.kernel.layout import Options as LayoutOptions
from foliospark.sources import tables

TASK_BYTES, TASK_FILES = 64 << 20, 4096


def page_ranges(text: str | None) -> tuple[tuple[int, int], ...]:
    """``2-5,9-`` as inclusive ranges; an open end is 0."""
    out = []
    for part in (text or "").replace(" ", "").split(","):
        if part:
            first, dash, last = part.partition("-")
            out.append((int(first), int(last) if last else 0 if dash else int(first)))
    return tuple(out)


class FilePart(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def file_system(path: str):
    """(file system, path within it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _switch(options: dict, name: str, default: bool) -> bool:
    value = str(options.get(name, default)).lower()
    if value not in ("true", "false"):
        raise ValueError(f"option {name} is true or false, not {value!r}")
    return value == "true"


#: Option -> the limit it sets.
BOUNDS = {"maxOperators": "operators", "maxGlyphs": "glyphs", "maxDepth": "form_depth", "maxImages": "images", "maxPixels": "pixels"}


def reader_options(options: dict) -> Options:
    """What the source's options ask of the reader; raises ValueError for bad ones."""
    known = {f.name for f in fields(Limits)}
    limits = {}
    for name, limit in BOUNDS.items():
        value = int(options.get(name, 0) or 0)
        if value < 0:
            raise ValueError(f"option {name} is not negative")
        if value and limit in known:
            limits[limit] = value
    return Options(
        pages=page_ranges(options.get("pages")), passwords=tuple(p for p in (options.get("password") or "").split("\n") if p), strict=_switch(options, "strict", False), extras=_switch(options, "extras", True),
        appearances=_switch(options, "appearances", True), fold_ligatures=_switch(options, "foldLigatures", True), ignore_artifacts=_switch(options, "ignoreArtifacts", False), limits=Limits(**limits),
        layout=LayoutOptions(options.get("mode", "position"), _switch(options, "keepDuplicates", False), _switch(options, "keepOffPage", False)),
    )


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "pages")
        if self.table not in tables.SCHEMAS:
            raise ValueError(f"no table {self.table!r}")
        self.path = options["path"]
        self.options = reader_options(options)

    def partitions(self) -> list[FilePart]:
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.File:
            return [FilePart([root])]
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size or 0) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(".pdf"))
        parts, held, size = [], [], 0
        for path, n in files:
            if held and (size + n > TASK_BYTES or len(held) >= TASK_FILES):
                parts.append(FilePart(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, FilePart(held)] if held else parts

    def read(self, partition: FilePart) -> Iterator:
        import pyarrow as pa
        import xxhash

        system, _ = file_system(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            doc_id = xxhash.xxh64_intdigest(path) - (1 << 63)
            if self.table == "glyphs":
                yield from tables.glyph_batches(doc_id, content, self.options)
            else:
                found = list(tables.rows(self.table, doc_id, content, self.options))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=tables.SCHEMAS[self.table])


class PushdownReader(PdfReader):
    """With bounds on ``page`` taken from the query's filters."""

    def pushFilters(self, filters):
        from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

        low, high = 1, 0
        for f in filters:
            if getattr(f, "attribute", None) == ("page",) and self.table in ("pages", "glyphs", "images", "annotations"):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    low = max(low, f.value)
                if isinstance(f, GreaterThan):
                    low = max(low, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    high = min(high or f.value, f.value)
                if isinstance(f, LessThan):
                    high = min(high or f.value - 1, f.value - 1)
            yield f  # Spark still applies every filter
        if (low > 1 or high > 0) and (not high or high >= low):
            clipped = ((max(a, low), min(b or high, high or b)) for a, b in self.options.pages or ((1, 0),))
            narrowed = tuple((a, b) for a, b in clipped if not b or a <= b)
            if narrowed:  # no range at all would mean every page
                self.options = replace(self.options, pages=narrowed)


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return tables.schema(self.options.get("table", "pages"))

    def reader(self, schema) -> DataSourceReader:
        session = SparkSession.getActiveSession()
        pushing = session is not None and session.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
        return (PushdownReader if pushing or self.options.get("pushdown") == "true" else PdfReader)(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
