"""Queries of the PDF operators over whole tables, with the SQL that says the same.

Most draw every document of ``documents`` as a PDF file — forty non-blank lines
to a page, Courier, fixed pitch — in one of many ways, and extract it again, so
plain SQL over the texts gives the expected result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry
from foliospark.functions import text as text_functions
from foliospark.kernel.extract import Options
from foliospark.kernel.interpreter import Limits
from foliospark.kernel.layout import Options as LayoutOptions
from foliospark.operators import pages as page_operators
from foliospark.plans import pdf_files as draw
from foliospark.session import spread, table
from foliospark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- expected results of drawn documents -------------------------------------

DRAWN = r"""
WITH d AS (SELECT doc_id, regexp_replace(translate(text, chr(13) || chr(9), '  '), '[^\x20-\x7E\n\x{A1}-\x{AC}\x{AE}-\x{FF}]', '?', 'g') AS t FROM documents WHERE text IS NOT NULL),
     parts AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
     raw AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM parts),
     ln AS (SELECT doc_id, trim(l) AS l, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS k FROM raw WHERE trim(l) <> ''),
     pl AS (SELECT doc_id, CAST(k // 40 + 1 AS INTEGER) AS page, k % 40 AS r, l FROM ln)
"""
TEXT = DRAWN + ", pg AS (SELECT doc_id, page, string_agg({line}, chr(10) ORDER BY r) AS text FROM pl {where} GROUP BY doc_id, page)\n"
PAGE_SQL = TEXT + "SELECT doc_id, page, text FROM pg"
DOC_SQL = TEXT + "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pg GROUP BY doc_id"


def fill(sql: str, line: str = "l", where: str = "") -> str:
    return sql.replace("{line}", line).replace("{where}", where)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", draw.drawable(F.col("text")).alias("text"))
    return spread(rows)


def drawn(spark: SparkSession, sf_dir: str, make=draw.b.text_pdf) -> DataFrame:
    one = lambda text: make(text)
    one.many = getattr(make, "many", None)
    return draw.files(documents(spark, sf_dir), one)


def styled(content) -> Callable[[str], bytes]:
    return lambda text: draw.b.text_pdf(text, content=content)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def pages_of(spark, sf_dir, make=draw.b.text_pdf, options=Options()):
    pages = tables.extract(drawn(spark, sf_dir, make), "pages", options)
    return pages.where("text <> ''").select("doc_id", "page", "text")


def texts_of(spark, sf_dir, make=draw.b.text_pdf, options=Options()):
    rows = tables.extract(drawn(spark, sf_dir, make), "documents", options)
    return rows.where("text <> ''").select("doc_id", "text")


# ---- texts -------------------------------------------------------------------


@query("document_text", fill(DOC_SQL))
def document_text(spark, sf_dir):
    return page_operators.document_text(tables.extract(drawn(spark, sf_dir), "pages"))


@query("page_text", fill(PAGE_SQL))
def page_text(spark, sf_dir):
    return pages_of(spark, sf_dir)


@query("page_range", fill(PAGE_SQL, where="WHERE page >= 2"))
def page_range(spark, sf_dir):
    return pages_of(spark, sf_dir, options=Options(pages=((2, 0),)))


@query("page_stats", DRAWN + "SELECT doc_id, page, CAST(sum(length(l)) AS INTEGER) AS n_glyphs, CAST(0 AS INTEGER) AS image_count, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height, CAST(0 AS INTEGER) AS rotation FROM pl GROUP BY doc_id, page")
def page_stats(spark, sf_dir):
    pages = tables.extract(drawn(spark, sf_dir), "pages").where("n_glyphs > 0")
    return pages.select("doc_id", "page", "n_glyphs", "image_count", F.col("media_box.max_x").alias("width"), F.col("media_box.max_y").alias("height"), "rotation")


@query(
    "glyph_positions",
    DRAWN + "SELECT doc_id, page, CAST(720 - 14 * r AS DOUBLE) AS y, CAST(length(l) AS BIGINT) AS n, CAST(72 AS DOUBLE) AS first_x, CAST(72 + 6 * (length(l) - 1) AS DOUBLE) AS last_x, CAST(6 * length(l) AS DOUBLE) AS advance FROM pl",
)
def glyph_positions(spark, sf_dir):
    glyphs = tables.extract(drawn(spark, sf_dir), "glyphs")
    return glyphs.groupBy("doc_id", "page", "y").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.round(F.sum("advance"), 6).alias("advance"))


@query("region_text", fill(PAGE_SQL, where="WHERE r <= 5"))
def region_text(spark, sf_dir):
    # Laid out where the page is read: its glyphs are all there, so no glyph rows are made and shuffled.
    return pages_of(spark, sf_dir, options=Options(region=(0.0, 660.0, 100_000.0, 720.0), layout=LayoutOptions(keep_off_page=True)))


@query("content_order_text", fill(PAGE_SQL))
def content_order_text(spark, sf_dir):
    return pages_of(spark, sf_dir, options=Options(layout=LayoutOptions("content")))


@query("relayout_text", fill(PAGE_SQL))
def relayout_text(spark, sf_dir):
    return page_operators.layout_text(tables.extract(drawn(spark, sf_dir), "glyphs"))


SINGLE = "regexp_replace(l, ' +', ' ', 'g')"
for _name, _content, _line in (
    ("kerned_tj_text", draw.by_kerning, SINGLE), ("td_text", draw.by_td, "l"), ("next_line_text", draw.by_next_line, "l"), ("quote_text", draw.by_quotes, "l"), ("fake_bold_text", draw.bold, "l"), ("off_page_dropped", draw.with_off_page, "l"),
):
    query(_name, fill(PAGE_SQL, line=_line))(lambda spark, sf_dir, c=_content: pages_of(spark, sf_dir, styled(c)))

query("fake_bold_kept", DRAWN + "SELECT doc_id, page, CAST(2 * sum(length(l)) AS INTEGER) AS n_glyphs FROM pl GROUP BY doc_id, page")(
    lambda spark, sf_dir: tables.extract(drawn(spark, sf_dir, styled(draw.bold)), "pages").where("n_glyphs > 0").select("doc_id", "page", "n_glyphs")
)
query("off_page_kept", TEXT.replace("{line}", "l").replace("{where}", "") + "SELECT doc_id, page, 'off the page' || chr(10) || text AS text FROM pg")(
    lambda spark, sf_dir: pages_of(spark, sf_dir, styled(draw.with_off_page), Options(layout=LayoutOptions(keep_off_page=True))).where("text <> 'off the page'")
)
query("actual_text", fill(PAGE_SQL, line="CASE WHEN r = 0 THEN 'replaced' ELSE l END"))(lambda spark, sf_dir: pages_of(spark, sf_dir, styled(draw.with_actual_text)))
query("artifacts_ignored", fill(PAGE_SQL))(lambda spark, sf_dir: pages_of(spark, sf_dir, styled(draw.with_artifact), Options(ignore_artifacts=True)))
query("artifacts_kept", TEXT.replace("{line}", "l").replace("{where}", "") + "SELECT doc_id, page, 'running header' || chr(10) || text AS text FROM pg")(
    lambda spark, sf_dir: pages_of(spark, sf_dir, styled(draw.with_artifact)).where("text <> 'running header'")
)

# ---- containers, filters, fonts, encryption ----------------------------------

for _name, _make in (
    ("form_xobject_text", draw.form_pdf), ("xref_stream", draw.xref_stream_pdf), ("object_stream", draw.object_stream_pdf), ("hybrid_file", draw.hybrid_pdf), ("encrypted_rc4_40", draw.encrypted_pdf(2, False)), ("encrypted_rc4_128", draw.encrypted_pdf(3, False)), ("encrypted_aes_128", draw.encrypted_pdf(4, True)),
    ("filter_flate", draw.filtered_pdf("FlateDecode")), ("filter_lzw", draw.filtered_pdf("LZWDecode")), ("filter_ascii_hex", draw.filtered_pdf("ASCIIHexDecode")), ("filter_ascii85", draw.filtered_pdf("ASCII85Decode")), ("filter_run_length", draw.filtered_pdf("RunLengthDecode")), ("filter_png_predictor", draw.filtered_pdf("png")),
    ("tounicode_text", draw.mapped_font_pdf), ("differences_text", draw.differences_pdf),
):
    query(_name, fill(DOC_SQL))(lambda spark, sf_dir, m=_make: texts_of(spark, sf_dir, m))


@query("xref_rebuilt", fill(DOC_SQL).replace("AS text FROM pg", "AS text, CAST(1 AS INTEGER) AS n_warnings FROM pg"))
def xref_rebuilt(spark, sf_dir):
    return tables.extract(drawn(spark, sf_dir, draw.broken_pdf), "documents").where("text <> ''").select("doc_id", "text", "n_warnings")


@query("wrong_password", "SELECT doc_id, CAST(0 AS INTEGER) AS page_count, 'Denied: wrong password' AS error FROM documents WHERE text IS NOT NULL")
def wrong_password(spark, sf_dir):
    make = lambda text: draw.b.text_pdf(text, build=lambda o: draw.b.encrypted(o, user=b"secret"))
    return tables.extract(drawn(spark, sf_dir, make), "documents").select("doc_id", "page_count", "error")


@query("limit_warnings", DRAWN + ", c AS (SELECT doc_id, page, sum(length(l)) AS n FROM pl GROUP BY doc_id, page) SELECT doc_id, page, CAST(0 AS INTEGER) AS ord, 'work_limit' AS code FROM c WHERE n > 100")
def limit_warnings(spark, sf_dir):
    rows = tables.extract(drawn(spark, sf_dir), "warnings", Options(limits=Limits(glyphs=100)))
    return rows.select("doc_id", "page", "ord", "code")


# ---- layout ------------------------------------------------------------------


@query(
    "two_column_text",
    """WITH n AS (SELECT s_suppkey, s_name, unnest(range(1, 11)) AS i FROM supplier),
    c AS (SELECT s_suppkey, string_agg(s_name || ' opens the left row ' || chr(CAST(96 + i AS INTEGER)), chr(10) ORDER BY i) AS a, string_agg('and here goes right line ' || chr(CAST(96 + i AS INTEGER)), chr(10) ORDER BY i) AS b FROM n GROUP BY s_suppkey)
    SELECT s_suppkey AS doc_id, a || chr(10) || b AS text FROM c""",
)
def two_column_text(spark, sf_dir):
    def make(s_name):
        letters = [chr(96 + i) for i in range(1, 11)]
        return draw.cells_pdf([f"{s_name} opens the left row {c}" for c in letters], [f"and here goes right line {c}" for c in letters], gap=340)

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name")
    return tables.extract(draw.files(rows, make), "documents").select("doc_id", "text")


CELLS = "WITH p AS (SELECT p_partkey, p_name, p_brand, p_partkey // 40 AS doc_id FROM part) "


def _cells(spark, sf_dir, options=Options()):
    p = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") / 40).cast("bigint").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand"))).alias("c"))
    make = lambda c: draw.cells_pdf([x["p_name"] for x in c], [x["p_brand"] for x in c])
    return tables.extract(draw.files(p, make), "documents", options).select("doc_id", "text")


query("table_rows", CELLS + "SELECT doc_id, string_agg(p_name || ' ' || p_brand, chr(10) ORDER BY p_partkey) AS text FROM p GROUP BY doc_id")(_cells)
query("columns_forced", CELLS + "SELECT doc_id, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) || string_agg(p_brand, chr(10) ORDER BY p_partkey) AS text FROM p GROUP BY doc_id")(
    lambda spark, sf_dir: _cells(spark, sf_dir, Options(layout=LayoutOptions("columns")))
)


@query("superscript_text", "SELECT p_partkey AS doc_id, p_brand || p_size AS text FROM part")
def superscript_text(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("raised"))
    return tables.extract(draw.files(spread(rows), draw.raised_pdf), "documents").select("doc_id", "text")


@query("bidi_text", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, translate(upper(r_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + "".join(draw.hebrew(chr(c)) for c in range(65, 91)) + "') AS text FROM region")
def bidi_text(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("name"))
    return tables.extract(draw.files(rows, draw.hebrew_pdf), "documents").select("doc_id", "text")


@query("stored_glyph_text")
def stored_glyph_text(spark, sf_dir):
    """Pages of ``pdf_glyphs`` laid out (rows only: layout of rotated and repeated lines has no SQL)."""
    glyphs = table(spark, sf_dir, "pdf_glyphs")
    return page_operators.layout_text(glyphs)


@query(
    "glyphs_without_repeats",
    """WITH g AS (SELECT DISTINCT doc_id, page, idx, text, x, y, size, advance, dir FROM pdf_glyphs WHERE text IS NOT NULL),
    u AS (SELECT *, greatest(size, 1.0) AS em, coalesce(sqrt(dir.x * dir.x + dir.y * dir.y), 0) AS len FROM g),
    v AS (SELECT *, CASE WHEN len > 1e-9 THEN dir.x / len ELSE 1.0 END AS dx, CASE WHEN len > 1e-9 THEN dir.y / len ELSE 0.0 END AS dy, CASE WHEN abs(advance) > 0 THEN least(em * 0.1, abs(advance) / 3) ELSE em * 0.1 END AS reach FROM u)
    SELECT doc_id, page, count(*) AS n FROM v b WHERE NOT EXISTS (SELECT 1 FROM v a WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.text = b.text AND a.idx < b.idx AND abs(b.size - a.size) <= 0.1 * a.em
      AND abs((b.x - a.x) * b.dx + (b.y - a.y) * b.dy) <= a.reach AND abs((b.y - a.y) * b.dx - (b.x - a.x) * b.dy) <= 0.2 * a.em) GROUP BY doc_id, page""",
)
def glyphs_without_repeats(spark, sf_dir):
    kept = page_operators.without_repeats(table(spark, sf_dir, "pdf_glyphs"))
    return kept.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


# ---- native expressions over stored tables ------------------------------------

UPRIGHT = "SELECT DISTINCT doc_id, page, idx, text, x, y, advance, size, dir, ascent, descent FROM pdf_glyphs"
BOUNDS = f"""WITH g AS ({UPRIGHT}), u AS (SELECT *, coalesce(sqrt(dir.x * dir.x + dir.y * dir.y), 0) AS len FROM g),
 v AS (SELECT doc_id, page, idx, x, y, CASE WHEN len > 1e-9 THEN dir.x / len ELSE 1 END AS dx, CASE WHEN len > 1e-9 THEN dir.y / len ELSE 0 END AS dy, abs(advance) AS w,
   coalesce(ascent.x, 0) AS ax0, coalesce(ascent.y, 0) AS ay0, coalesce(descent.x, 0) AS dl, coalesce(descent.y, 0) AS dn, size FROM u),
 q AS (SELECT *, CASE WHEN ax0 = 0 AND ay0 = 0 AND dl = 0 AND dn = 0 THEN size ELSE ay0 END AS ay, ax0 AS ax FROM v),
 b AS (SELECT doc_id, page, least(x + dl, x + dx * w + dl, x + dx * w + ax, x + ax) AS x0, least(y + dn, y + dy * w + dn, y + dy * w + ay, y + ay) AS y0, greatest(x + dl, x + dx * w + dl, x + dx * w + ax, x + ax) AS x1, greatest(y + dn, y + dy * w + dn, y + dy * w + ay, y + ay) AS y1 FROM q) """


@query("glyph_bounds", BOUNDS + "SELECT doc_id, page, round(min(x0), 4) AS min_x, round(min(y0), 4) AS min_y, round(max(x1), 4) AS max_x, round(max(y1), 4) AS max_y FROM b GROUP BY doc_id, page")
def glyph_bounds(spark, sf_dir):
    g = table(spark, sf_dir, "pdf_glyphs").dropDuplicates(["doc_id", "page", "idx"]).withColumn("b", geometry.glyph_bounds())
    return g.groupBy("doc_id", "page").agg(*(F.round(f(f"b.{n}"), 4).alias(n) for f, n in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))))


@query("region_glyphs", BOUNDS + "SELECT doc_id, page, count(*) AS n FROM b WHERE x1 >= 100 AND 300 >= x0 AND y1 >= 400 AND 600 >= y0 GROUP BY doc_id, page")
def region_glyphs(spark, sf_dir):
    region = geometry.rect(*(F.lit(float(v)) for v in (100, 400, 300, 600)))
    glyphs = page_operators.glyphs_in(table(spark, sf_dir, "pdf_glyphs").dropDuplicates(["doc_id", "page", "idx"]), region)
    return glyphs.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


_SANE = r"regexp_replace(translate(text, chr(9) || chr(160), '  '), '[\x{FFFD}\x{00}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}]', '', 'g')"
_FOLDED = _SANE
for _l, _t in text_functions.LIGATURES.items():
    _FOLDED = f"replace({_FOLDED}, '{_l}', '{_t}')"
for _name, _sql, _fold in (("ligature_fold", _FOLDED, True), ("ligature_kept", _SANE, False)):
    query(_name, f"SELECT DISTINCT page_id, {_sql} AS text FROM pdf_pages WHERE text IS NOT NULL")(
        lambda spark, sf_dir, fold=_fold: table(spark, sf_dir, "pdf_pages").where("text is not null").select("page_id", text_functions.sanitize(F.col("text"), fold).alias("text")).distinct()
    )


@query(
    "image_to_page",
    """SELECT DISTINCT doc_id, page, idx, round(ctm[1] * 0.5 + ctm[3] * 0.5 + ctm[5], 6) AS cx, round(ctm[2] * 0.5 + ctm[4] * 0.5 + ctm[6], 6) AS cy, round(ctm[3] + ctm[5], 6) AS left_x, round(ctm[4] + ctm[6], 6) AS top_y
    FROM pdf_images WHERE width > 0 AND height > 0""",
)
def image_to_page(spark, sf_dir):
    i = table(spark, sf_dir, "pdf_images").where("width > 0 and height > 0")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    centre, corner = geometry.image_to_page(w / 2, h / 2, w, h, F.col("ctm")), geometry.image_to_page(F.lit(0.0), F.lit(0.0), w, h, F.col("ctm"))
    return i.select("doc_id", "page", "idx", F.round(centre["x"], 6).alias("cx"), F.round(centre["y"], 6).alias("cy"), F.round(corner["x"], 6).alias("left_x"), F.round(corner["y"], 6).alias("top_y")).distinct()


@query("tint_exponential", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.2 + pow(least(greatest(l_discount, 0), 1), 1.5) * (0.9 - 0.2), 6) AS tint FROM lineitem")
def tint_exponential(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(geometry.exponential(F.col("l_discount"), 0.2, 0.9, 1.5), 6).alias("tint"))


_COUNTED = """WITH g AS (SELECT doc_id, page, count(DISTINCT idx) AS n FROM pdf_glyphs WHERE origin = 'content' GROUP BY doc_id, page),
 p AS (SELECT DISTINCT page_id, doc_id, page, image_count FROM pdf_pages) """


@query(
    "ocr_policy_counts",
    _COUNTED + """SELECT policy, count(*) AS n FROM (SELECT unnest(CASE WHEN coalesce(g.n, 0) = 0 AND coalesce(image_count, 0) > 0 THEN ['all', 'images', 'textless'] WHEN coalesce(g.n, 0) = 0 THEN ['all', 'textless'] WHEN coalesce(image_count, 0) > 0 THEN ['all', 'images'] ELSE ['all'] END) AS policy
    FROM p LEFT JOIN g USING (doc_id, page)) GROUP BY policy""",
)
def ocr_policy_counts(spark, sf_dir):
    glyphs = table(spark, sf_dir, "pdf_glyphs").where("origin = 'content'").groupBy("doc_id", "page").agg(F.countDistinct("idx").alias("n_glyphs"))
    pages = table(spark, sf_dir, "pdf_pages").select("page_id", "doc_id", "page", "image_count").distinct().join(glyphs, ["doc_id", "page"], "left")
    parts = [page_operators.ocr_selected(pages, p).select(F.lit(p).alias("policy")) for p in ("textless", "images", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("ocr_tsv_words", "SELECT DISTINCT doc_id, page, idx, trim(text) AS word, round(x, 3) AS \"left\", round(y, 3) AS top FROM pdf_glyphs WHERE origin = 'ocr' AND trim(text) <> ''")
def ocr_tsv_words(spark, sf_dir):
    g = table(spark, sf_dir, "pdf_glyphs").where("origin = 'ocr'")
    number = lambda c: F.format_string("%.3f", c)
    line = F.concat_ws("\t", F.lit("5\t1\t1\t1\t1"), F.col("idx").cast("string"), number("x"), number("y"), number("advance"), number("size"), F.lit("96.0"), F.trim("text"))
    words = page_operators.tsv_words(g.select("doc_id", "page", "idx", line.alias("line")), 0.0)
    return words.select("doc_id", "page", "idx", F.col("text").alias("word"), F.round("left", 3).alias("left"), F.round("top", 3).alias("top")).distinct()


@query(
    "interval_union",
    """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS hi FROM events),
    m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, k""",
)
def interval_union(spark, sf_dir):
    at = F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    e = table(spark, sf_dir, "events").select("user_id", at.alias("lo"), (at + 600).alias("hi"))
    return page_operators.merged_intervals(e, "user_id", "lo", "hi")


# ---- extras and images --------------------------------------------------------


@query("metadata", "SELECT doc_id, coalesce(path, '') AS title, coalesce(source, '') AS author, coalesce(lang, '') AS custom FROM documents")
def metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("path", "title"), ("source", "author"), ("lang", "custom"))))
    found = tables.extract(draw.files(rows, draw.info_pdf), "documents")
    return found.select("doc_id", "title", "author", F.coalesce(F.try_element_at("custom", F.lit("ShelfMark")), F.lit("")).alias("custom"))


@query(
    "outline_tree",
    """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS depth, CAST(0 AS INTEGER) AS ordinal, r_name AS title, CAST(1 AS INTEGER) AS page FROM region
    UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(1 AS INTEGER), CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER), n_name, CAST(0 AS INTEGER) FROM nation""",
)
def outline_tree(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list("n_name")).alias("children"))
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("root")).join(nations, "doc_id", "left")
    rows = rows.withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    return tables.extract(draw.files(rows, draw.outline_pdf), "outlines").select("doc_id", "depth", "ordinal", "title", F.coalesce("destination.page", F.lit(0)).alias("page"))


@query("link_annotations", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'Link' AS subtype, 'https://shelf.invalid/card/' || c_custkey AS url, CAST(10 AS DOUBLE) AS min_x, CAST(700 AS DOUBLE) AS max_y FROM customer")
def link_annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("https://shelf.invalid/card/"), F.col("c_custkey").cast("string")).alias("url"))
    return tables.extract(draw.files(rows, draw.link_pdf), "annotations").select("doc_id", "subtype", "url", F.col("rect.min_x").alias("min_x"), F.col("rect.max_y").alias("max_y"))


def _field_files(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("value"))
    return draw.files(rows, draw.field_pdf)


query("form_fields", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'ledger.' || c_custkey AS name, 'Tx' AS type, c_mktsegment AS value, CAST(1 AS INTEGER) AS page FROM customer")(
    lambda spark, sf_dir: tables.extract(_field_files(spark, sf_dir), "form_fields").select("doc_id", "name", "type", "value", "page")
)
query("form_values_painted", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_mktsegment AS text FROM customer")(lambda spark, sf_dir: tables.extract(_field_files(spark, sf_dir), "documents").select("doc_id", "text"))


def _image_files(spark, sf_dir):
    grey = F.transform("embedding", lambda v: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) + 1) * 127).cast("int"))
    return draw.files(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), grey.alias("pixels")), draw.image_pdf)


query(
    "image_inventory",
    "SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS page, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS bits_per_component, 'DeviceGray' AS color_space, CAST(80 AS DOUBLE) AS a, CAST(200 AS DOUBLE) AS f FROM embeddings",
)(lambda spark, sf_dir: tables.extract(_image_files(spark, sf_dir), "images").select("doc_id", "page", "width", "height", "bits_per_component", "color_space", F.get("ctm", F.lit(0)).alias("a"), F.get("ctm", F.lit(5)).alias("f")))


@query(
    "image_samples",
    "SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(list_sum(list_transform(embedding, lambda v: CAST(floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE)) + 1) * 127) AS BIGINT))) AS BIGINT) AS total FROM embeddings",
)
def image_samples(spark, sf_dir):
    i = tables.extract(_image_files(spark, sf_dir), "images").select("doc_id", F.hex("pixels").alias("h"))
    values = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda p: F.conv(F.substring(F.col("h"), p, F.lit(2)), 16, 10).cast("bigint"))
    return i.select("doc_id", F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))
