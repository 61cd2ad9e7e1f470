"""Scanned pages and names."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import naming, scans

SENTENCES = ["The harbour office sold the second cargo ledger with great care.", "A visiting inspector could not find the flood figures.", "Every parish clerk remembers the low-water marks between two tides.", "During the long strike the bridge engineer had checked every page of the logbook."]


def kept_pages(spark, n=300):
    rng = random.Random(2)
    return spark.createDataFrame([("\n".join(rng.choices(SENTENCES, k=5)), 0) for _ in range(n)] + [(None, 0), ("ignored tokens zzzz", 5)], "text string, ocr_glyphs int")


def words(spark, doc_id, page, lines, top=728.0):
    """lines: (y, x, text)."""
    rows, idx = [], 0
    for y, x, line in lines:
        for token in line.split(" "):
            rows.append((doc_id, page, idx, token, float(x), float(y), 10.0, "ocr"))
            x += 5 * (len(token) + 1)
            idx += 1
    return rows


@pytest.fixture(scope="module")
def scanned(spark):
    lines = [
        (762, 72, "The flood figures 23"), (728, 86, "The harb0ur office sold the sccond car-"), (714, 72, "go ledger with great care. A visiting ¦¦"), (700, 72, "inspector remembers the low-"), (686, 72, "water marks between two tid-"), (24, 290, "Page 9"),
    ]
    rows = words(spark, 1, 31, lines) + words(spark, 1, 32, [(762, 72, "24 The flood figures"), (728, 72, "es. Every parish cleik could not find"), (714, 72, "the second cargo ledger.")])
    rows += [rows[0], (2, 1, 0, "xii", 290.0, 24.0, 10.0, "ocr"), (3, 1, 0, None, 1.0, 1.0, 10.0, "ocr"), (3, 1, 1, "Every", 72.0, 700.0, 10.0, "content"), (4, 1, 0, "qqqqq", 72.0, 700.0, 10.0, "ocr")]
    glyphs = spark.createDataFrame(rows, "doc_id bigint, page int, idx int, text string, x double, y double, size double, origin string").withColumn("kind", F.lit("clash"))
    w = scans.read_words(glyphs)
    return w, scans.train(kept_pages(spark), w)


def test_noise_kinds(spark, scanned):
    w, model = scanned
    texts = {(r.doc_id, r.page, r.idx): r.text for r in w.collect()}
    got = sorted((r.page, texts[r.doc_id, r.page, r.idx], r.kind, r.corrected) for r in scans.noise(w, model).where("doc_id = 1").collect())
    assert got == sorted(
        [
            *((31, t, "running", None) for t in ("The", "flood", "figures")), (31, "23", "page_number", None), (31, "Page", "page_number", None), (31, "9", "page_number", None), (31, "harb0ur", "misread", "harbour"), (31, "sccond", "misread", "second"), (31, "car-", "hyphen", None),
            (31, "¦¦", "misread", None), (31, "tid-", "hyphen", None), (32, "24", "page_number", None), *((32, t, "running", None) for t in ("The", "flood", "figures")), (32, "cleik", "misread", "clerk"),
        ]
    )


def test_paragraphs_and_edge_cases(scanned):
    w, model = scanned
    text = {(r.doc_id, r.page, r.paragraph): r.text for r in scans.repaired_paragraphs(w, model).collect()}
    assert text[1, 31, 0] == "The harbour office sold the second cargo ledger with great care. A visiting inspector remembers the low-water marks between two tid"
    assert text[1, 32, 0].endswith("clerk could not find the second cargo ledger.") and text[4, 1, 0] == "qqqqq"
    assert {(r.doc_id, r.kind) for r in scans.noise(w, model).where("doc_id > 1").collect()} <= {(2, "page_number")}
    assert scans.noise(w.limit(0), model).count() == 0


def test_random_misreadings_are_found(spark):
    rng = random.Random(4)
    confusions = [("e", "c"), ("o", "0"), ("i", "!"), ("l", "1"), ("d", "cl"), ("a", "@"), ("n", "ri")]
    rows, truth = [], set()
    for page in range(1, 60):
        y, idx = 728.0, 0
        for _ in range(12):
            x = 72.0
            for token in rng.choice(SENTENCES).split(" "):
                a, c = rng.choice(confusions)
                if rng.random() < 0.06 and a in token[1:-1] and len(token) > 4:
                    at = token.index(a, 1)
                    token = token[:at] + c + token[at + 1 :]
                    truth.add((page, idx))
                rows.append((1, page, idx, token, x, y, 10.0, "ocr"))
                x += 5 * (len(token) + 1)
                idx += 1
            y -= 14
    w = scans.read_words(spark.createDataFrame(rows, "doc_id bigint, page int, idx int, text string, x double, y double, size double, origin string"))
    found = {(r.page, r.idx) for r in scans.noise(w, scans.train(kept_pages(spark), w)).where("kind = 'misread'").collect()}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.02 * len(truth)


def misread_page(seed, doc_id, pages):
    rng, rows = random.Random(seed), []
    for page in range(1, pages + 1):
        y, idx = 728.0, 0
        for line in range(6):
            x = 72.0
            for token in rng.choice(SENTENCES).split(" "):
                if len(token) > 5 and rng.random() < 0.1 and "e" in token[1:-1]:
                    at = token.index("e", 1)
                    token = token[:at] + "c" + token[at + 1 :]
                rows.append((doc_id, page, idx, token, x, y, 10.0, "ocr"))
                x += 5 * (len(token) + 1)
                idx += 1
            y -= 14
        rows.append((doc_id, page, idx, str(page + 7), 290.0, 24.0, 10.0, "ocr"))
    return rows


WORDS = "doc_id bigint, page int, idx int, text string, x double, y double, size double, origin string"


def test_margins_lie_in_the_outer_part_of_the_scan(spark):
    lines = [(560, 72, "The harbour office"), (500, 86, "sold the second cargo ledger with great care."), *((y, 72, "Every parish clerk remembers the bridge engineer.") for y in (486, 472, 458)), (24, 290, "Page 9")]
    w = scans.read_words(spark.createDataFrame(words(spark, 1, 2, lines) + words(spark, 2, 2, lines) + words(spark, 3, 2, lines), WORDS))
    images = spark.createDataFrame([(1, 2, [612.0, 0.0, 0.0, 792.0, 0.0, 0.0]), (1, 2, [612.0, 0.0, 0.0, 792.0, 0.0, 0.0]), (2, 2, [612.0, 0.0, 0.0, -530.0, 0.0, 530.0]), (None, 2, None)], "doc_id bigint, page int, ctm array<double>").withColumn("text", F.lit("clash"))
    rows = scans.noise(w, scans.train(kept_pages(spark), w), images).where("kind in ('running', 'page_number')").collect()
    got = {d: sorted((r.kind, r.idx) for r in rows if r.doc_id == d) for d in (1, 2, 3)}
    number = [("page_number", 32), ("page_number", 33)]
    # A heading in the middle of the scan is body; above the scan it is no word of it; without an image distance decides.
    assert got[1] == got[2] == number and got[3] == [*number, ("running", 0), ("running", 1), ("running", 2)], got


def test_rare_words_are_met_by_a_join(spark, monkeypatch):
    """The same words are found whether the lexicon is shipped or looked up."""
    w = scans.read_words(spark.createDataFrame(misread_page(3, 1, 12), WORDS))
    kinds = []
    for share in (scans.COMMON, 64):
        monkeypatch.setattr(scans, "COMMON", share)
        model = scans.train(kept_pages(spark), w)
        kinds.append({tuple(r) for r in scans.noise(w, model).collect()})
        shipped = len(model.words)
    assert shipped < 40 and model.rare is not None and kinds[0] == kinds[1] and any(k[3] == "misread" for k in kinds[0])


def test_what_is_shipped_changes_no_result(spark, scanned, monkeypatch):
    """Pairs, words of two pieces, marks and confusion rates are those of the whole lexicon."""
    sentences = ["The hungry dogs eat fresh bread.", "A sleepy cat rests & sleeps.", *SENTENCES]
    kept = kept_pages(spark).unionByName(spark.createDataFrame([(" ".join(sentences), 0)] * 20, "text string, ocr_glyphs int"))
    lines = [(728, 86, "The hungry dogs cat fresh bread."), (714, 72, "A sleepy cat rests & sleeps."), (700, 72, "A visiting inspector remembers the low-"), (686, 72, "water marks between two tides. Every par-"), (672, 72, "ish cleik could not find the sccond ¦¦ car-"), (658, 72, "go lcdger with great care.")]
    w = scanned[0].unionByName(scans.read_words(spark.createDataFrame(words(spark, 9, 1, lines) + misread_page(3, 8, 12), WORDS)))
    found, rates, paragraphs = [], [], []
    for words_share, pairs_share in ((scans.COMMON, scans.PAIRS), (scans.COMMON, 24), (24, scans.PAIRS), (24, 24)):
        monkeypatch.setattr(scans, "COMMON", words_share)
        monkeypatch.setattr(scans, "PAIRS", pairs_share)
        model = scans.train(kept, w)
        found.append(sorted(tuple(r) for r in scans.noise(w, model).collect()))
        rates.append(model.confusion)
        paragraphs.append(sorted(tuple(r) for r in scans.repaired_paragraphs(w, model).collect()))
    assert len(model.words) < 20 and len(model.pairs) < 20
    assert (9, 1, 3, "misread", "eat") in found[0] and (9, 1, 10, "misread", None) not in found[0]
    assert all(f == found[0] for f in found) and all(p == paragraphs[0] for p in paragraphs)
    assert all(r == pytest.approx(rates[0]) for r in rates)


def test_a_page_is_judged_alike_beside_many_more(spark):
    part, rest = misread_page(3, 1, 40), [r for d in range(2, 22) for r in misread_page(d, d, 40)]
    found = []
    for rows in (part, part + rest):
        w = scans.read_words(spark.createDataFrame(rows, WORDS))
        found.append({tuple(r)[:4] for r in scans.noise(w, scans.train(kept_pages(spark), w)).where("doc_id = 1").collect()})
    assert found[0] == found[1] and sum(k == "page_number" for *_, k in found[0]) == 40


# ---- names


def linked(spark, names):
    df = spark.createDataFrame([(f, n, c) for f, n, c in names], "field string, name string, n bigint")
    groups = {}
    for r in naming.entities(df).collect():
        groups.setdefault((r.field, r.entity), set()).add(r.name)
    return {frozenset(v) for v in groups.values()}


def test_people(spark):
    robert = {"Robert Halvgard", "HALVGARD, ROBERT", "R. Halvgard", "Halvgard R. M.", "Bob Halvgard", "robert.halvgard", "Dr. Robert Halvgard", "Robert M. Halvgard", "Robret Halvgard", "R. Halvgrad"}
    zoe = {"Zoë Halvgard", "Zoe Halvgard", "Z. Halvgard"}
    double = {"Nina Berg-Strom", "Berg Strom, Nina", "Nina Berg Strom", "Berg-Strom N."}
    lone = {"T. Halvgard"}
    filler = [("author", f"{g} Person{i}", 3) for i in range(8) for g in ("Robert", "Zoë", "Nina")]
    got = linked(spark, [("author", n, 5) for group in (robert, zoe, double, lone) for n in group] + filler)
    assert {frozenset(robert), frozenset(zoe), frozenset(double), frozenset(lone)} <= got


@pytest.mark.parametrize("times", [1, 100])
def test_slips_link_at_every_size(spark, times):
    rng = random.Random(3)
    surnames = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(25 * times)]
    slipped = surnames[:times]
    names = [("author", f"{g} {s}", 2) for s in surnames for g in ("Dorothea", "Ludmila", "Ludmilo")] + [("author", f"Doothea {s}", 1) for s in slipped]
    groups = {n: g for g in linked(spark, names) for n in g}
    assert all(f"Doothea {s}" in groups[f"Dorothea {s}"] for s in slipped)
    assert not any(f"Ludmilo {s}" in groups[f"Ludmila {s}"] for s in surnames)  # both common: two names


def test_ambiguous_initials_link_nobody(spark):
    got = linked(spark, [("author", n, 1) for n in ("Anna Velt", "Alma Velt", "A. Velt", "Velt, A.")])
    assert frozenset({"A. Velt", "Velt, A."}) in got and frozenset({"Anna Velt"}) in got


def test_organisations_and_products(spark):
    org = {"Norfels Survey Office", "Survey Office, Norfels", "NORFELS SURVEY OFF.", "Office of Survey Norfels", "The Norfels Survey Office", "Norffels Survey Office"}
    other = {"Norfels Canal Authority", "Norfels Authority for Canals"}
    writer = {"Penmark Writer 4.2", "penmark-writer/5.0", "Writer (Penmark)", "PENMARK WRITER", "Penmark® Writer", "Penmrak Writer", "Pmark Writer 2", "PenmarkWriter 3"}
    viewer = {"Penmark Viewer", "Viewer by Penmark"}
    names = [("author", n, 2) for n in org | other] + [("creator", n, 2 + len(n)) for n in writer | viewer] + [("producer", "Penmark Writer 4.2", 1), ("producer", "®", 1)]
    got = linked(spark, names)
    assert {frozenset(org), frozenset(other), frozenset(viewer), frozenset({"®"})} <= got
    assert any(writer - {"PenmarkWriter 3"} <= g and not g & viewer for g in got)


def test_organisations_outside_the_list(spark):
    places = ["Norfels", "Zufkev", "Pazmeb", "Lolnav", "Tubgog"]
    names = [("author", n, 2) for p in places for n in (f"{p} Lighthouse Brigade", f"The {p} Lighthouse Brigade", f"Lighthouse Brigade of {p}", f"{p} Lighth. Brig.")]
    names += [("author", f"{g} {s}", 3) for g in ("Robert", "Zoe", "Nina") for s in ("Halvgard", "Strom")]
    got = linked(spark, names)
    assert {frozenset(n for _, n, _ in names[i : i + 4]) for i in range(0, 20, 4)} <= got
    assert frozenset({"Robert Halvgard"}) in got
    words = naming.organisation_words(spark.createDataFrame([(n,) for _, n, _ in names], "name string"))
    assert words == {"lighthouse", "brigade"} and naming.shortened("brig", words) == "brigade" and naming.shortened("xy", words) is None


def test_fields_and_pairs(spark):
    meta = spark.createDataFrame([("A B", None, ""), ("A B", " ", "P"), ("B, A", "x" * 3000, "P")], "author string, creator string, producer string").withColumn("field", F.lit("clash"))
    names = naming.field_names(meta)
    assert sorted((r.field, r.name[:3], r.n) for r in names.collect()) == [("author", "A B", 2), ("author", "B, ", 1), ("creator", "xxx", 1), ("producer", "P", 2)]
    assert naming.entities(names).count() == 4
    linked_rows = spark.createDataFrame([("f", "b", "e"), ("f", "a", "e"), ("f", "c", "e"), ("g", "a", "e")], "field string, name string, entity string")
    assert sorted(map(tuple, naming.pairs(linked_rows).collect())) == [("f", "a", "b"), ("f", "a", "c"), ("f", "b", "c")]
    assert naming.entities(names.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [("f", f"n{rng.randrange(200):03}", f"n{rng.randrange(200):03}") for _ in range(170)] + [("f", f"chain{i:02}", f"chain{i + 1:02}") for i in range(40)]
    parent = {}

    def top(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for _, a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.node: r.root for r in naming.components(spark.createDataFrame(edges, "field string, a string, b string")).collect()}
    assert got == {a: top(a) for a in got} and set(got) == {n for _, a, b in edges if a != b for n in (a, b)}
