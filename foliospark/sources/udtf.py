"""``pdf_pages(content)`` as a table function: one row for each page, in SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from foliospark.kernel.extract import Options, read_pages
from foliospark.sources.datasource import page_ranges

RETURNS = "page int, text string, n_glyphs int, image_count int, rotation int"


class PdfPages:
    def eval(self, content, pages: str = "") -> Iterator[tuple]:
        """Pages as they are read; a file that cannot be read, or NULL, has none."""
        for page in read_pages(bytes(content or b""), Options(pages=page_ranges(pages), extras=False)):
            yield page.number, page.text(), sum(len(r) for r in page.runs), page.image_count, page.rotation


def register(spark: SparkSession, name: str = "pdf_pages") -> None:
    spark.udtf.register(name, udtf(PdfPages, returnType=RETURNS))
