import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry
from foliospark.functions import text as text_functions
from foliospark.kernel import builder as b
from foliospark.kernel.extract import Options
from foliospark.kernel.layout import Options as LayoutOptions
from foliospark.operators import pages
from foliospark.plans import pdf_files as draw
from foliospark.sources import datasource, tables
from foliospark.streaming import arrivals

LINES = "\n".join(f"line number {i}" for i in range(45))


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, b.text_pdf(LINES)), (2, b""), (3, None), (4, draw.broken_pdf("one line")), (5, draw.outline_pdf("t", ["u"]))]
    return spark.createDataFrame([(i, c, "x") for i, c in rows], "doc_id bigint, content binary, text string")


def test_every_table(spark, files):
    got = {t: tables.extract(files, t).collect() for t in tables.SCHEMAS}
    docs = {r.doc_id: r for r in got["documents"]}
    assert docs[1].page_count == 2 and docs[1].text.replace("\n\n", "\n") == LINES and docs[1].error is None
    assert docs[2].error and docs[3].error and docs[2].text is None and docs[4].n_warnings == 1
    assert sorted((r.doc_id, r.page) for r in got["pages"]) == [(1, 1), (1, 2), (4, 1), (5, 1)]
    assert len([r for r in got["glyphs"] if r.doc_id == 1]) == sum(len(x) for x in LINES.split("\n"))
    assert [r.code for r in got["warnings"]] == ["malformed_document"] and len(got["outlines"]) == 2 and got["images"] == []
    with pytest.raises(ValueError):
        tables.extract(files, "nope")


def test_partitioning_does_not_matter(files):
    once = sorted(map(str, tables.extract(files.repartition(1), "pages").collect()))
    assert once == sorted(map(str, tables.extract(files.repartition(5), "pages").collect()))


def test_relayout_equals_extraction(files):
    glyphs = tables.extract(files, "glyphs")
    again = {(r.doc_id, r.page): r.text for r in pages.layout_text(glyphs.unionByName(glyphs)).collect()}
    stored = {(r.doc_id, r.page): r.text for r in tables.extract(files, "pages").collect() if r.text}
    assert again == stored
    assert pages.layout_text(glyphs.limit(0)).count() == 0
    nulls = glyphs.withColumn("dir", F.lit(None).cast("struct<x:double,y:double>")).withColumn("ascent", F.col("dir")).withColumn("descent", F.col("dir")).withColumn("extra", F.lit(1))
    assert {(r.doc_id, r.page): r.text for r in pages.layout_text(nulls).collect()} == stored


def test_document_text_and_ranges(files):
    p = tables.extract(files, "pages")
    assert {r.doc_id: r.text for r in pages.document_text(p).collect()}[1].count("\n\n") == 1
    assert pages.page_range(p, 2).count() == 1 and pages.page_range(p, 1, 1).count() == 3
    assert tables.extract(files, "pages", Options(pages=((2, 2),))).count() == 1


def test_data_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.pdf").write_bytes(b.text_pdf(LINES))
    datasource.register(spark)
    frame = spark.read.format("pdf").option("path", str(tmp_path)).option("table", "pages")
    assert frame.load().count() == 6 and frame.option("pages", "2").load().count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert spark.read.format("pdf").option("path", str(tmp_path)).load().where("page >= 2 and page <= 5").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert datasource.page_ranges("2-5, 9-,7") == ((2, 5), (9, 0), (7, 7))
    assert tables.extract(tables.read_files(spark, str(tmp_path)), "documents").count() == 3


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b.text_pdf("first"))
    args = (spark, str(tmp_path / "in"), "pages", str(tmp_path / "out"), str(tmp_path / "state"))
    arrivals.stream_table(*args).awaitTermination()
    (tmp_path / "in" / "b.pdf").write_bytes(b.text_pdf("second"))
    arrivals.stream_table(*args).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["first", "second"]


def test_geometry(spark):
    point = "struct<x: double, y: double>"
    rows = [(1, 10.0, 20.0, 6.0, 10.0, None, None, None), (2, 10.0, 20.0, -6.0, 10.0, (0.0, 2.0), (-10.0, 0.0), None), (3, 0.0, 0.0, 5.0, 1.0, (0.0, 0.0), None, None)]
    df = spark.createDataFrame(rows, f"id int, x double, y double, advance double, size double, dir {point}, ascent {point}, descent {point}")
    got = {r.id: tuple(r.b) for r in df.select("id", geometry.glyph_bounds().alias("b")).collect()}
    assert got == {1: (10, 20, 16, 30), 2: (0, 20, 10, 26), 3: (0, 0, 5, 1)}
    touching = geometry.rect(*(F.lit(v) for v in (16.0, 0.0, 99.0, 20.0)))
    assert [r.id for r in pages.glyphs_in(df, touching).collect()] == [1]
    m = df.limit(1).select(geometry.product(F.array(*map(F.lit, [2.0, 0.0, 0.0, 2.0, 1.0, 1.0])), F.array(*map(F.lit, [1.0, 0.0, 0.0, 1.0, 5.0, 6.0]))).alias("m"), geometry.rotation(F.lit(-90)).alias("r"), geometry.word_gap(F.lit(0.0)).alias("g")).first()
    assert m.m == [2, 0, 0, 2, 6, 7] and m.r == 270 and m.g == 1


def test_native_text(spark):
    df = spark.createDataFrame([("a\t �\x85\x07ﬁ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text_functions.sanitize(F.col("t"))).collect()] == ["a  fi", None, ""]
    flags = df.sparkSession.createDataFrame([("中",), ("あ",), ("a",), ("אb",), ("٣",)], "t string").select(text_functions.unspaced_script(F.col("t")), text_functions.needs_bidi(F.col("t"))).collect()
    assert [tuple(r) for r in flags] == [(True, False), (True, False), (False, False), (False, True), (False, False)]


def test_repeats_of_rotated_and_large_glyphs(spark):
    up, aside = {"x": 0.0, "y": 2.0}, None
    rows = [
        (1, 0, "a", 100.0, 200.0, 5.0, 10.0, up), (1, 1, "a", 100.0, 205.0, 5.0, 10.0, up), (1, 2, "a", 101.5, 200.5, 5.0, 10.0, up),  # 2 copies 0
        (2, 0, "T", 100.0, 300.0, 90.0, 100.0, aside), (2, 1, "T", 109.0, 300.0, 90.0, 100.0, aside), (2, 2, "T", 111.0, 300.0, 90.0, 100.0, aside), (2, 3, "T", 91.5, 318.0, 90.0, 108.0, aside),  # 1 and 3 copy 0, 2 copies 1
        (3, 0, "b", 100.0, 100.0, 6.0, 10.0, aside), (3, 1, "b", 100.5, 102.0, 6.0, 10.0, up), (3, 2, "b", None, 100.0, 6.0, 10.0, up),  # along its own direction 1 is too far
    ]
    g = spark.createDataFrame([(1, *r) for r in rows], "doc_id bigint, page int, idx int, text string, x double, y double, advance double, size double, dir struct<x: double, y: double>")
    assert sorted((r.page, r.idx) for r in pages.without_repeats(g).collect()) == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (3, 2)]


def test_repeats_ocr_and_intervals(spark):
    rows = [(1, 1, i, t, px, 700.0, 5.0, 10.0) for i, (t, px) in enumerate([("a", 72.0), ("b", 77.0), ("a", 72.3), ("b", 99.0)])]
    g = spark.createDataFrame(rows, "doc_id bigint, page int, idx int, text string, x double, y double, advance double, size double")
    assert sorted(r.idx for r in pages.without_repeats(g).collect()) == [0, 1, 3]
    words = spark.createDataFrame([(1, 1, 0, "w")], "doc_id bigint, page int, idx int, text string")
    assert [r.origin for r in pages.append_ocr(g.withColumn("origin", F.lit("content")), words).where("idx = 4").collect()] == ["ocr"]
    tsv = spark.createDataFrame([("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext",), ("5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t91.5\thello",), ("5\t1\t1\t1\t1\t2\t10\t20\t30\t8\t3\tlow",), ("4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t",)], "line string")
    assert [(r.text, r.left, r.conf) for r in pages.tsv_words(tsv, 50).collect()] == [("hello", 10.0, 91.5)]
    p = spark.createDataFrame([(1, 0, 1), (2, 5, 0), (3, None, None)], "id int, n_glyphs int, image_count int")
    assert [pages.ocr_selected(p, k).count() for k in ("textless", "images", "all", "none")] == [2, 1, 3, 0]
    i = spark.createDataFrame([("k", 1, 3), ("k", 3, 5), ("k", 7, 8), (None, 1, 2), ("k", None, 2)], "k string, lo int, hi int")
    assert sorted((r.lo, r.hi, r.n) for r in pages.merged_intervals(i, "k", "lo", "hi").collect()) == [(1, 5, 2), (7, 8, 1)]
    with pytest.raises(ValueError):
        LayoutOptions("sideways")


def test_table_function(spark, files):
    from foliospark.sources import udtf

    udtf.register(spark)
    files.createOrReplaceTempView("some_files")
    rows = spark.sql("SELECT doc_id, p.page, p.n_glyphs FROM some_files, LATERAL pdf_pages(content, '1') p ORDER BY doc_id").collect()
    assert [(r.doc_id, r.page) for r in rows] == [(1, 1), (4, 1), (5, 1)]


def test_words_of_an_ocr_program():
    from foliospark.kernel import pictures, tesseract

    image = pictures.Image(100, 200, 8, 1, None, None, False, False, (50.0, 0.0, 0.0, 100.0, 10.0, 20.0), b"")
    tsv = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t20\t40\t30\t10\t90\tHello\n5\t1\t1\t1\t1\t2\t20\t40\t30\t10\t-1\t \n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\tbroken\n5\t1\t1\t1\t1\t3\t60\t40\t30\t10\t12\tlow"
    (run,) = tesseract.words(image, tsv, 50)
    assert run.texts == ["Hello"] and run.x[0] == 20 and run.y[0] == 20 + 75 and run.advance[0] == 15 and run.size == 5 and tesseract.dpi(image) == 144


def test_feature_queries_against_sql(spark):
    """Each feature on the smallest tables, beside the same in SQL."""
    import glob
    import os

    import duckdb
    from foliospark.plans import feature_queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    if not os.path.exists(folder):
        return
    for name, run in feature_queries.QUERIES.items():
        df = run(spark, folder)
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({feature_queries.SQL[name]})").fetchall()
        clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
        assert clean(tuple(r[c] for c in columns) for r in df.collect()) == clean(want), name


def test_source_options(spark, tmp_path):
    from foliospark.sources import datasource

    text = "\n".join(f"line {i}" for i in range(90))
    for i in range(3):
        (tmp_path / f"f{i}.pdf").write_bytes(draw.b.text_pdf(text))
    (tmp_path / "note.txt").write_text("no file of ours")
    reader = datasource.PdfReader({"path": str(tmp_path), "table": "pages"})
    assert [len(p.paths) for p in reader.partitions()] == [3]
    datasource.register(spark)
    read = lambda **o: spark.read.format("pdf").options(path=str(tmp_path), **o).load()
    assert read().count() == 9 and read(pages="2-").count() == 6
    assert read(maxGlyphs="50", table="warnings").where("code = 'work_limit'").count() == 9
    assert read(strict="true", maxGlyphs="50").count() == 3  # the page at fault is the last
    for bad in ({"strict": "perhaps"}, {"maxGlyphs": "-1"}, {"mode": "spiral"}, {"table": "none"}):
        with pytest.raises(ValueError):
            datasource.PdfReader({"path": str(tmp_path), **bad})
    pushing = datasource.PushdownReader({"path": str(tmp_path), "pages": "1-2,5-"})
    from pyspark.sql.datasource import GreaterThanOrEqual

    list(pushing.pushFilters([GreaterThanOrEqual(("page",), 2)]))
    assert pushing.options.pages == ((2, 2), (5, 0))
