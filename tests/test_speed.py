"""Work that grows with the files must be done side by side or in few steps, with the same result."""

from __future__ import annotations

import time

import numpy as np
import pytest

from foliospark.kernel import builder as b
from foliospark.kernel import ciphers, extract, filters
from foliospark.kernel.layout import Layout, Options
from foliospark.plans import feature_files, pdf_files, pdf_queries


def seconds(work) -> float:
    began = time.thread_time()
    work()
    return time.thread_time() - began


def in_units(work) -> float:
    """Time of some work, in that of a fixed loop on this machine."""
    return min(seconds(work) for _ in range(3)) / min(seconds(lambda: sum(range(1_000_000))) for _ in range(3))


# ---- encrypted files


def test_messages_encrypted_side_by_side():
    rng = np.random.default_rng(3)
    keys, ivs = ([rng.bytes(16) for _ in range(80)] for _ in range(2))
    data = [rng.bytes(int(n)) for n in rng.integers(0, 700, 80)]
    together = ciphers.cbc_encrypt_many(keys, ivs, data)
    assert together == [ciphers.cbc_encrypt(*x) for x in zip(keys, ivs, data)]
    assert [ciphers.cbc_decrypt(k, v, c) for k, v, c in zip(keys, ivs, together)] == [d[: len(d) // 16 * 16] for d in data]
    assert ciphers.cbc_encrypt_many([], [], []) == []


def test_encrypted_files_drawn_together():
    make = pdf_files.encrypted_pdf(4, True)
    texts = ["", "one line", "x" * 900 + "\nmore", "\n".join(f"line {i}" for i in range(130))]
    rows = [{"text": t} for t in texts] * 64
    assert make.many(rows[:4]) == [make(t) for t in texts]
    assert in_units(lambda: make.many(rows)) < 25


# ---- rows of predicted data


def naive_rows(data: bytes, row: int, step: int) -> bytes:
    out, above = [], [0] * row
    for at in range(0, len(data), row + 1):
        kind, line = data[at], list(data[at + 1 : at + 1 + row])
        have = len(line)
        line += [0] * (row - have)
        for i in range(row):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            line[i] = (line[i] + [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]) & 255
        out.append(bytes(line[:have]))
        above = line
    return b"".join(out)


@pytest.mark.parametrize("colors,columns", [(1, 1), (1, 16), (3, 5), (4, 24), (1, 95), (1, 200), (3, 70)])
def test_png_rows_against_naive(colors, columns):
    rng = np.random.default_rng(colors * columns)
    row = colors * columns
    data = b"".join(bytes([int(rng.integers(5))]) + rng.bytes(row) for _ in range(60))
    for cut in (len(data), len(data) - row // 2, len(data) - row):
        assert filters.unpredict(data[:cut], {"Predictor": 15, "Colors": colors, "Columns": columns}) == naive_rows(data[:cut], row, colors)


def test_short_png_rows_are_cheap():
    rng = np.random.default_rng(1)
    data = b"".join(bytes([n % 5]) + rng.bytes(16) for n in range(5000))
    text = "\n".join("some words of a line %d" % i for i in range(2000))
    assert in_units(lambda: filters.unpredict(data, {"Predictor": 15, "Columns": 16})) < 1.05
    assert in_units(lambda: feature_files.png_mixed_pdf(text)) < 1.1


# ---- shown strings and plain pages


def page_of(content: bytes) -> extract.PageResult:
    objects = b.page_tree(1, 4, "/Font <</F1 3 0 R>>") | {3: b.COURIER, 5: b.stream("", content)}
    return extract.read(b.classic(objects)).pages[0]


def test_words_set_apart_are_still_a_plain_page():
    lines = [f"some words of line {k} set  apart" for k in range(40)]
    page = page_of(pdf_files.by_kerning(lines))
    quick = Layout(page.glyphs(), Options(), page.media_box)._quick_text()
    assert quick == page.text() == "\n".join(" ".join(line.split()) for line in lines)


def test_line_over_the_edge_is_still_a_plain_page():
    page = page_of(b.lines_content(["short", "x" * 200, "another"]))
    assert Layout(page.glyphs(), Options(), page.media_box)._quick_text() == page.text() == "short\n" + "x" * 200 + "\nanother"


def test_strings_are_placed_together_as_one_by_one():
    """One run for what shares size and direction; a string far longer than the others; escapes, spacing, rise, another size."""
    long = "y" * 3000
    content = b"BT /F1 10 Tf 2 Tc 1 Tw 1 0 0 1 72 700 Tm (a b\\)) Tj [(c) -500 (d\\(e) 250.5 (f)] TJ 1 0 0 1 5 600 Tm (%s) Tj /F1 5 Tf 3 Ts (up) Tj ET" % long.encode()
    page = page_of(content)
    g = page.glyphs()
    assert "".join(g.text) == "a b)cd(ef" + long + "up" and len(page.runs) == 3
    steps = [8.0, 9.0, 8.0, 8.0, 8.0 + 5.0, 8.0, 8.0, 8.0 - 2.505]
    assert np.allclose(g.x[:9], 72 + np.cumsum([0.0, *steps])) and (g.y[:9] == 700).all()
    assert np.allclose(g.x[9:3009], 5 + 8 * np.arange(3000)) and np.allclose(g.x[3009:], 5 + 8 * 3000 + np.array([0, 5.0])) and (g.y[3009:] == 603).all()


def test_glyph_limit_inside_pending_strings():
    page = extract.read(b.text_pdf("abcdef\nghijkl"), extract.Options(limits=extract.Limits(glyphs=9))).pages[0]
    assert page.text() == "abcdef\nghi" and page.warnings[0][0] == "work_limit"


# ---- tables of one small file


def test_small_table_is_drawn_by_all_cores(spark, tmp_path):
    spark.range(40).selectExpr("id as p_partkey", "concat('Brand#', id) as p_brand", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = pdf_queries.QUERIES["superscript_text"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r.doc_id, r.text) for r in found.collect()} == {(i, f"Brand#{i}{i % 50}") for i in range(40)}


# ---- regions of pages


def test_region_is_laid_out_where_the_page_is_read(spark, tmp_path):
    texts = [(1, "\n".join(f"line {k}" for k in range(50))), (2, ""), (3, "one " + "x" * 150)]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = pdf_queries.QUERIES["region_text"](spark, str(tmp_path))
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(1, 1, "\n".join(f"line {k}" for k in range(6))), (1, 2, "\n".join(f"line {k}" for k in range(40, 46))), (3, 1, texts[2][1])}


# ---- arriving files


def test_arriving_files_can_be_read_in_parts(spark, tmp_path, monkeypatch):
    from pathlib import Path

    import pyarrow.parquet as pq

    from foliospark.plans import feature_queries

    rng = np.random.default_rng(5)
    texts = [(i, "\n".join(rng.bytes(30).hex() for _ in range(30))) for i in range(1000)]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(feature_queries, "ROW_GROUP", 1 << 16, raising=False)
    feature_queries.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    known = set(folder.glob("arrivals-*"))
    found = feature_queries.QUERIES["stream_arrivals"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == set(texts)
    (made,) = set(folder.glob("arrivals-*")) - known
    assert all(pq.ParquetFile(p).num_row_groups > 1 for p in made.glob("files/*.parquet"))
