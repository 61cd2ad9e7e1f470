"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import appearance, language, leakage, mixing, mojibake, naming, scans, truncation
from foliospark.session import checkpointed, table


def _page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance.page_keys(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "pdf_glyphs"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance.look_pairs(_page_keys(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance.look_classes(_page_keys(spark, sf_dir))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = appearance.page_texts(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "pdf_glyphs"))
    return texts.withColumn("text", appearance.canonical_column()(F.col("text"))).distinct()


def p1_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs = table(spark, sf_dir, "pdf_glyphs").select("doc_id", "page", "idx", "text")
    return glyphs.withColumn("text", appearance.canonical_column()(F.col("text")))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_pages": p1_pages, "p1_glyphs": p1_glyphs}
SQL: dict[str, str] = {}


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata, fields = table(spark, sf_dir, "pdf_metadata"), table(spark, sf_dir, "pdf_form_fields")
    model = mojibake.train(mojibake.training_texts(metadata, fields, table(spark, sf_dir, "pdf_pages")))
    return mojibake.restored(mojibake.field_values(metadata, fields), model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("doc_id", "idx", "field").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir)


QUERIES |= {"p4_found": p4_found, "p4_restored": p4_restored}


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_targets")
    return mixing.mixture(checkpointed(mixing.sizes(table(spark, sf_dir, "documents"), targets)), targets)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(checkpointed(_mixture(spark, sf_dir)), table(spark, sf_dir, "source_targets"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target with documents has its share (raised where others have none) and keeps its cap."""
    rows = p9_shares(spark, sf_dir)
    reach = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # one row per target
    met = F.abs(F.col("actual_share") - F.when(F.col("tokens") > 0, F.col("target_share") / reach).otherwise(0.0)) <= 0.01
    return rows.select("source", (F.col("tokens") > 0).alias("used"), met.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("cap_kept"))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return truncation.scored(documents.select("doc_id", "source", "lang", "n_chars", "text"), *truncation.train(documents))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).where("cut").select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.source_rates(_cuts(spark, sf_dir))


QUERIES |= {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_checks": p9_checks, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}

SQL["p9_checks"] = """
SELECT source, source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL) AS used, TRUE AS share_met, TRUE AS cap_kept FROM source_targets
"""

SQL["p8_found"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
     di AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
     bi AS (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8),
     ds AS (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM di),
     bs AS (SELECT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM bi)
SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (s)
"""


_LEAKS = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
     di AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
     bi AS (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i, len(w) - 7 AS places FROM b WHERE len(w) >= 8),
     ds AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM di),
     bs AS (SELECT item_id, i AS t, places, array_to_string(w[i:i + 7], ' ') AS s FROM bi),
     h AS (SELECT DISTINCT doc_id, item_id, i, t, places FROM ds JOIN bs USING (s)),
     win AS (SELECT a.doc_id, a.item_id, a.i, count(DISTINCT z.t) AS n FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND z.i BETWEEN a.i AND a.i + a.places - 1 GROUP BY ALL),
     leaks AS (SELECT doc_id, item_id, CAST(count(DISTINCT t) AS INTEGER) AS shared_shingles, least(1.0::DOUBLE, (SELECT max(n) FROM win WHERE win.doc_id = h.doc_id AND win.item_id = h.item_id) / max(places)) AS contained FROM h GROUP BY doc_id, item_id)
"""
SQL["p8_leaks"] = _LEAKS + "SELECT * FROM leaks"
SQL["p8_items"] = _LEAKS + "SELECT item_id, count(*) AS n_documents, max(contained) AS contained FROM leaks GROUP BY item_id"


def _language(spark: SparkSession, sf_dir: str):
    pages = table(spark, sf_dir, "pdf_pages").select("page_id", "text", "lang")
    return pages, language.train(pages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(language.page_languages(*_language(spark, sf_dir)))


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(*_language(spark, sf_dir)).distinct()


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_segments(*_language(spark, sf_dir))


QUERIES |= {"p2_found": p2_found, "p2_pages": p2_pages, "p2_segments": p2_segments}


def _scans(spark: SparkSession, sf_dir: str):
    words = scans.read_words(table(spark, sf_dir, "pdf_glyphs"))
    return words, scans.train(table(spark, sf_dir, "pdf_pages"), words), table(spark, sf_dir, "pdf_images").select("doc_id", "page", "ctm")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(*_scans(spark, sf_dir)).select("doc_id", "page", "idx", "kind")


def p5_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(*_scans(spark, sf_dir)).where("corrected is not null")


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_paragraphs(*_scans(spark, sf_dir))


QUERIES |= {"p5_found": p5_found, "p5_corrections": p5_corrections, "p5_paragraphs": p5_paragraphs}


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata, fields = table(spark, sf_dir, "pdf_metadata"), table(spark, sf_dir, "pdf_form_fields")
    names = checkpointed(naming.field_names(metadata))
    model = mojibake.train(mojibake.training_texts(metadata, fields, table(spark, sf_dir, "pdf_pages")))
    garbled = mojibake.restored(names.where("field = 'author'").select("field", F.col("name").alias("text")), model)
    return naming.entities(names.join(garbled.select("field", F.col("text").alias("name")), ["field", "name"], "left_anti"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.pairs(checkpointed(_entities(spark, sf_dir)))


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


QUERIES |= {"p7_found": p7_found, "p7_entities": p7_entities}
