"""Queries of single features of the reader, each over a whole table, with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry
from foliospark.plans import feature_files as draw
from foliospark.plans import pdf_files, pdf_queries
from foliospark.session import ensure_checkpoint_dir, spread, table
from foliospark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# ---- fonts -------------------------------------------------------------------

#: Everything but controls, marks without width and scripts without spaces is drawn as it stands.
WIDE = r"[^\x20-\x7E\n\x{A1}-\x{AC}\x{AE}-\x{17F}\x{370}-\x{373}\x{376}-\x{377}\x{386}-\x{3FF}\x{400}-\x{482}\x{48A}-\x{4FF}]"
_WIDE_SQL = pdf_queries.fill(pdf_queries.DOC_SQL).replace(r"[^\x20-\x7E\n\x{A1}-\x{AC}\x{AE}-\x{FF}]", WIDE)


@query("wide_text", _WIDE_SQL)
def wide_text(spark, sf_dir):
    text = F.regexp_replace(F.translate("text", "\r\t", "  "), WIDE, "?")
    rows = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("text")))
    return tables.extract(pdf_files.files(rows, draw.wide_pdf), "documents").where("text <> ''").select("doc_id", "text")


def named(spark: SparkSession, sf_dir: str, name: str, key: str, *columns) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), *columns)


def glyph_sums(spark, sf_dir, make, origin: str = "x") -> DataFrame:
    rows = named(spark, sf_dir, "supplier", "s_suppkey", F.col("s_name").alias("name"))
    glyphs = tables.extract(pdf_files.files(rows, make), "glyphs")
    return glyphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("advance")), 6).alias("advance"), F.round(F.max(origin) - F.min(origin), 6).alias("span"))


_CHARS = "WITH c AS (SELECT s_suppkey AS doc_id, unnest(string_split(s_name, '')) AS ch, generate_subscripts(string_split(s_name, ''), 1) AS i FROM supplier), w AS (SELECT *, {width} AS w, max(i) OVER (PARTITION BY doc_id) AS last FROM c) "
_SUMS = "SELECT doc_id, count(*) AS n, round(sum(w), 6) AS advance, round(sum(CASE WHEN i < last THEN w + {more} ELSE 0 END), 6) AS span FROM w GROUP BY doc_id"
_CID = "CASE WHEN ch = ' ' THEN 2.5 WHEN ch BETWEEN '0' AND '9' THEN 5.0 WHEN ch BETWEEN 'A' AND 'Z' THEN 7.0 ELSE 4.0 END::DOUBLE"

query("cid_widths", _CHARS.replace("{width}", _CID) + _SUMS.replace("{more}", "0"))(lambda spark, sf_dir: glyph_sums(spark, sf_dir, draw.cid_widths_pdf))
query("vertical_text", _CHARS.replace("{width}", "12.0::DOUBLE") + _SUMS.replace("{more}", "0"))(lambda spark, sf_dir: glyph_sums(spark, sf_dir, draw.vertical_pdf, "y"))
# An advance is the glyph's own; spacing moves only what follows.
query("text_spacing", _CHARS.replace("{width}", "3.0::DOUBLE") + _SUMS.replace("{more}", "CASE WHEN ch = ' ' THEN 3.5 ELSE 1.0 END"))(lambda spark, sf_dir: glyph_sums(spark, sf_dir, draw.spaced_pdf))


@query("unicode_cmap_text", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS text FROM nation")
def unicode_cmap_text(spark, sf_dir):
    rows = named(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("name"))
    return tables.extract(pdf_files.files(rows, draw.unicode_cmap_pdf), "documents").select("doc_id", "text")


#: One name for each nation, and what it shows.
NAMES = {
    "Delta": "∆", "afii10017": "А", "afii10065": "а", "Alphatonos": "Ά", "sigmafinal": "ς", "afii57664": "א", "Schwa": "Ə", "Scommaaccent": "Ș", "Gcommaaccent": "Ģ", "Ohornacute": "Ớ", "kokaithai": "ก", "SF100000": "─", "onecircle": "①", "Oneroman": "Ⅰ", "foursuperior": "⁴", "twothirds": "⅔", "AEacute": "Ǽ",
    "therefore": "∴", "arrowdblright": "⇒", "club": "♣", "Amonospace": "Ａ", "afii61352": "№", "uni20AC": "€", "u1D400": "\U0001d400", "Eogonek.alt": "Ę",
}


@query("glyph_names", f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, [{', '.join(repr(t) for t in NAMES.values())}][n_nationkey + 1] AS text FROM nation")
def glyph_names(spark, sf_dir):
    rows = named(spark, sf_dir, "nation", "n_nationkey", F.get(F.array(*map(F.lit, NAMES)), F.col("n_nationkey")).alias("glyph"))
    return tables.extract(pdf_files.files(rows, draw.named_glyph_pdf), "documents").select("doc_id", "text")


#: Faces in turn, what each shows, and the sum of the public widths.
FACES = (
    ("Helvetica", "Wij—", 944 + 222 + 222 + 1000), ("Helvetica-BoldOblique", "Wi…", 944 + 278 + 1000), ("Times-Roman", "Wé“", 944 + 444 + 444), ("Times-Bold", "Wi•", 1000 + 278 + 350), ("Times-Italic", "Wv—", 833 + 444 + 889), ("Times-BoldItalic", "EÆ", 667 + 944), ("Courier-Oblique", "Wi", 1200), ("Arial,Bold", "ß", 611), ("Symbol", "ab", 631 + 549), ("ZapfDingbats", "4l", 846 + 791),
)


@query("standard_faces", f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST([{', '.join(str(w) for _, _, w in FACES)}][n_nationkey % {len(FACES)} + 1] AS DOUBLE) / 10 AS advance FROM nation")
def standard_faces(spark, sf_dir):
    pick = lambda i: F.get(F.array(*(F.lit(f[i]) for f in FACES)), F.col("n_nationkey") % len(FACES))
    rows = named(spark, sf_dir, "nation", "n_nationkey", pick(0).alias("face"), pick(1).alias("shown"))
    return tables.extract(pdf_files.files(rows, draw.face_pdf), "glyphs").groupBy("doc_id").agg(F.round(F.sum("advance"), 6).alias("advance"))


# ---- images ------------------------------------------------------------------

_LEVELS = "list_transform(embedding, lambda v: CAST(floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE)) + 1) * 127) AS BIGINT))"


def levels() -> Column:
    return F.transform("embedding", lambda v: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) + 1) * 127).cast("int"))


def first_channel(spark, sf_dir, make, channels: int = 1) -> DataFrame:
    """(doc_id, total): the sum of the first channel of each image's samples."""
    rows = named(spark, sf_dir, "embeddings", "vec_id", levels().alias("pixels"))
    found = tables.extract(pdf_files.files(rows, make), "images").select("doc_id", F.hex("pixels").alias("h"))
    places = F.sequence(F.lit(1), F.length("h"), F.lit(2 * channels))
    values = F.transform(places, lambda p: F.conv(F.substring(F.col("h"), p, F.lit(2)), 16, 10).cast("bigint"))
    return found.select("doc_id", F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


def image_query(name: str, value: str, make, channels: int = 1) -> None:
    """``value``: SQL of what a level ``p`` becomes."""
    sql = f"SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(list_sum(list_transform({_LEVELS}, lambda p: CAST({value} AS BIGINT))) AS BIGINT) AS total FROM embeddings"
    query(name, sql)(lambda spark, sf_dir: first_channel(spark, sf_dir, make, channels))


for _bits, _value in ((1, "p // 128 * 255"), (2, "p // 64 * 85"), (4, "p // 16 * 17"), (16, "p")):
    image_query(f"image_{_bits}_bit", _value, lambda pixels, n=_bits: draw.grey_pdf(pixels, n))
image_query("image_decode_inverted", "255 - p", lambda pixels: draw.grey_pdf(pixels, 8, "/Decode [1 0]"))
image_query("image_rgb", "p", lambda pixels: draw.coloured_pdf(pixels, "DeviceRGB"), 3)
image_query("image_cmyk", "255 - p", lambda pixels: draw.coloured_pdf(pixels, "DeviceCMYK"), 3)
image_query("image_indexed", "[10, 60, 110, 250][p // 64 + 1]", draw.indexed_pdf)
image_query("image_inline", "p", draw.inline_pdf)
_X = "(p / 255.0::DOUBLE)"
for _kind, _f in (("power", f"0.9 - 0.8 * {_X} * {_X}"), ("stitched", f"CASE WHEN {_X} < 0.5 THEN 2 * {_X} ELSE 2 - 2 * {_X} END"), ("sampled", f"CASE WHEN {_X} <= 0.5 THEN 2 * {_X} ELSE 1 - (2 * {_X} - 1) * 0.8 END"), ("calculator", f"1 - {_X} * {_X}")):
    image_query(f"tint_{_kind}", f"floor(least(greatest({_f}, 0), 1) * 255 + 0.5)", lambda pixels, k=_kind: draw.tint_pdf(pixels, k))


@query(
    "image_quads",
    "SELECT DISTINCT doc_id, page, idx, round(least(ctm[5], ctm[1] + ctm[5], ctm[3] + ctm[5], ctm[1] + ctm[3] + ctm[5]), 6) AS min_x, round(greatest(ctm[6], ctm[2] + ctm[6], ctm[4] + ctm[6], ctm[2] + ctm[4] + ctm[6]), 6) AS max_y FROM pdf_images",
)
def image_quads(spark, sf_dir):
    box = geometry.bounds(geometry.image_quad(F.col("ctm")))
    return table(spark, sf_dir, "pdf_images").select("doc_id", "page", "idx", F.round(box["min_x"], 6).alias("min_x"), F.round(box["max_y"], 6).alias("max_y")).distinct()


# ---- containers and filters ---------------------------------------------------

for _name, _make in (("filter_chain", draw.chained_pdf), ("filter_tiff_predictor", draw.tiff_pdf), ("filter_png_rows", draw.png_mixed_pdf)):
    query(_name, pdf_queries.fill(pdf_queries.DOC_SQL))(lambda spark, sf_dir, m=_make: pdf_queries.texts_of(spark, sf_dir, m))

query("packed_rebuilt", pdf_queries.fill(pdf_queries.DOC_SQL))(
    lambda spark, sf_dir: pdf_queries.texts_of(spark, sf_dir, lambda text: pdf_files.object_stream_pdf(text).replace(b"startxref", b"startxxxx"))
)


# ---- pages, forms, outlines ----------------------------------------------------


@query("page_boxes", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(p_size + 100 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS crop_min_x, CAST(480 AS DOUBLE) AS crop_max_y, CAST(270 AS INTEGER) AS rotation FROM part")
def page_boxes(spark, sf_dir):
    rows = named(spark, sf_dir, "part", "p_partkey", (F.col("p_size") + 100).alias("width"))
    pages = tables.extract(pdf_files.files(rows, draw.boxes_pdf), "pages")
    return pages.select("doc_id", F.col("media_box.max_x").alias("width"), F.col("crop_box.min_x").alias("crop_min_x"), F.col("crop_box.max_y").alias("crop_max_y"), "rotation")


@query("appearance_states", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_mktsegment || CASE WHEN c_nationkey % 2 = 1 THEN ' yes' ELSE ' no' END AS text FROM customer")
def appearance_states(spark, sf_dir):
    rows = named(spark, sf_dir, "customer", "c_custkey", F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 2).alias("chosen"))
    return tables.extract(pdf_files.files(rows, draw.state_pdf), "documents").select("doc_id", "text")


@query(
    "outline_fits",
    """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS ordinal, n_name AS title, CAST([0, 100 + n_regionkey, 1][i + 1] AS DOUBLE) AS x, CAST([100 + n_regionkey, 0, 2][i + 1] AS DOUBLE) AS y
    FROM nation, (SELECT unnest(range(3)) AS i)""",
)
def outline_fits(spark, sf_dir):
    rows = named(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("title"), (F.col("n_regionkey") + 100).alias("level"))
    found = tables.extract(pdf_files.files(rows, draw.fitted_outline_pdf), "outlines")
    return found.select("doc_id", "ordinal", "title", F.col("destination.x").alias("x"), F.col("destination.y").alias("y"))


# ---- streaming -----------------------------------------------------------------


#: Bytes of a row group of the arriving files.
ROW_GROUP = 1 << 20


@query("stream_arrivals", pdf_queries.fill(pdf_queries.DOC_SQL))
def stream_arrivals(spark, sf_dir):
    """Drawn files written to the shared folder, read as a stream, and their texts written by it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/arrivals-{uuid.uuid4().hex}"
    # Small row groups, so that the few files of a batch are read by all cores.
    pdf_queries.drawn(spark, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/files")
    arriving = spark.readStream.schema("doc_id bigint, content binary").option("maxFilesPerTrigger", 4).parquet(f"{folder}/files")
    texts = tables.extract(arriving, "documents").where("text <> ''").select("doc_id", "text")
    texts.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/texts").awaitTermination()
    return spark.read.parquet(f"{folder}/texts")
