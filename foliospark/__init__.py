"""foliospark: PDF collections as relational tables on Spark.

PDF bytes go in through :mod:`foliospark.sources`, tables (documents, pages,
glyphs, images, outlines, annotations, form fields, warnings) come out, and the
operators of :mod:`foliospark.operators` work on those tables as DataFrames.
"""

__version__ = "0.1.0"
