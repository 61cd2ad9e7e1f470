"""Look-alikes, garbled encodings, languages, leakage, mixing and truncation."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import appearance, language, leakage, mixing, mojibake, truncation

# ---- look-alikes


def test_canonical_form():
    assert appearance.canonical("Ｆｕｌｌ ｗｉｄｔｈ  Straße​") == "full width strasse"
    assert appearance.canonical("é­ﬁ") == "éfi" and appearance.canonical(None) is None and appearance.canonical(" ​　") == ""
    assert appearance.canonical("арр") == "app"


def test_looks_keep_what_a_reader_sees():
    same = ["file size", "ﬁle size", "ﬁle siｚe", "f​ile­ size", "\U0001d5bfile sіzе"]
    looks = appearance.normaliser(appearance.LOOKS)
    assert len({looks(s) for s in same}) == 1
    differ = ["m2", "m²", "M2", "ḿ2", "m-2", "m—2", "m_2", "m3"]
    assert len({looks(s) for s in differ}) == len(differ)
    assert looks("ё") == looks("ё") == looks("ë")


def test_form_is_closed_for_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in (appearance.CANONICAL, appearance.LOOKS, appearance.Form(skeleton=False)):
        f = appearance.normaliser(form)
        assert not [c for c in points if f(f(c)) != f(c)]
    f = appearance.normaliser()
    assert not [c for c in points if not f(c) == f(c.upper()) == f(c.lower())]
    rng = random.Random(2)
    odd = [c for c in points if not c.isascii() and c.isprintable()]
    for form in (appearance.CANONICAL, appearance.LOOKS):
        f = appearance.normaliser(form)
        for _ in range(3000):
            text = "".join(rng.choices(odd, k=3)) + rng.choice("aео́") + rng.choice("\u0301\u0327\u200d ")
            assert f(f(text)) == f(text), text


def test_look_alikes_of_other_scripts():
    looks, folded = appearance.normaliser(appearance.LOOKS), appearance.normaliser()
    assert looks("Ꭺνοсаԁο ΤΙΜΕ ɡо ҮЕЅ") == looks("Avocado TIME go YES")
    for a, b in (("РУКА", "рука"), ("ТУ", "ту"), ("Һ", "һ"), ("ΣΟΦΙΑ", "σοφια")):
        assert folded(a) == folded(b) and looks(a) != looks(b)
    for a, b in (("г", "r"), ("5 μm", "5 mm"), ("ү", "у"), ("н", "һ"), ("ё", "е"), ("й", "и")):
        assert folded(a) != folded(b)


def test_hot_variants_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(appearance, "PAIR_BLOCK", 16)
    rows = [(i, b"l", b"s0") for i in range(300)] + [(1000 + i, b"l", b"s1") for i in range(40)] + [(2000, b"l", b"s2"), (3000, b"m", b"s0"), (3001, b"m", b"s0")]
    keys = spark.createDataFrame(rows, "page_id bigint, look binary, stored binary")
    want = {(a, b) for a, la, sa in rows for b, lb, sb in rows if a < b and la == lb and sa != sb}
    got = appearance.look_pairs(keys).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def pages_and_glyphs(spark):
    text = "A page with some text"
    pages = spark.createDataFrame(
        [(1, 9, 1, text, "x"), (2, 9, 2, text.replace(" ", " "), "x"), (3, 9, 3, None, "x"), (4, 9, 4, text, "x"), (4, 9, 4, text, "x"), (5, 9, 5, "", "x"), (6, 9, 6, "​", "x"), (7, 9, 7, None, "x"), (8, 9, 8, text.upper(), "x"), (None, 9, 9, text, "x")],
        "page_id bigint, doc_id bigint, page int, text string, idx string",
    )
    letters = [(9, 3, i, c) for i, c in enumerate(text.replace("A", "Α"))]
    glyphs = spark.createDataFrame([*letters, *letters, (9, 1, 0, "z"), (9, 3, 50, None)], "doc_id bigint, page int, idx int, text string")
    return pages, glyphs


def test_look_pairs_and_classes(spark):
    pages, glyphs = pages_and_glyphs(spark)
    keys = appearance.page_keys(pages, glyphs)
    assert sorted(map(tuple, appearance.look_pairs(keys).collect())) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    classes = {r.page_id: (r.class_id, r.n_pages, r.n_variants) for r in appearance.look_classes(keys).collect()}
    assert classes == {1: (1, 4, 3), 2: (1, 4, 3), 3: (1, 4, 3), 4: (1, 4, 3), 8: (8, 1, 1)}
    assert appearance.look_pairs(appearance.page_keys(pages.limit(0), glyphs.limit(0))).count() == 0
    long = spark.createDataFrame([("é" * 300_000,), (None,)], "t string").select(F.length(appearance.canonical_column()(F.col("t"))))
    assert [r[0] for r in long.collect()] == [300_000, None]


# ---- encodings

CLEAN = ["Jürgen prüft die Brücke für Müller", "señor García pequeñas", "élève très près de l'hôtel", "Список разбитых фонарей", "под другим именем", "não são três irmãos", "größer schön", "Hélène Frédéric Thérèse"]


@pytest.fixture(scope="module")
def restorer(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 30 + [None, ""]], "text string")
    return mojibake.Restorer(mojibake.train(df))


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251"])
def test_round_trip_through_wrong_pages(restorer, read):
    for text in CLEAN:
        try:
            wrong = text.encode("utf-8").decode(read)
        except UnicodeDecodeError:
            wrong = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode("utf-8"))
        assert restorer.restore(wrong) == (text, True), (read, wrong)


def test_double_swapped_wide_partial_and_lost(restorer):
    assert restorer.restore("Jürgen".encode().decode("cp1252").encode().decode("cp1252")) == ("Jürgen", True)
    assert restorer.restore("für Müller".encode("cp1252").decode("cp850")) == ("für Müller", True)
    assert restorer.restore("под другим".encode("cp1251").decode("cp1252")) == ("под другим", True)
    assert restorer.restore("þÿ" + "".join("\0" + c for c in "Hélène")) == ("Hélène", True)
    assert restorer.restore("für MÃ¼ller") == ("für Müller", True)
    assert restorer.restore("H�lène")[1] is False
    assert all(restorer.restore(t) is None for t in (*CLEAN, "plain", "", "x" * 100_000))


def test_one_garbled_word_beside_right_ones(restorer):
    right = "Jürgen prüft die Brücke für Müller"
    for true, read in (("cp1252", "cp437"), ("cp1252", "mac_roman"), ("utf-8", "cp1252"), ("utf-8", "cp850")):
        for word in ("Jürgen", "prüft", "Brücke", "Müller"):
            wrong = right.replace(word, word.encode(true).decode(read))
            assert restorer.restore(wrong) == (right, True), wrong
    both = right.replace("Jürgen", "JÃ¼rgen").replace("Brücke", "Brücke".encode("cp1252").decode("cp437"))
    assert restorer.restore(both) == (right, True)


def test_wide_contexts_are_exact():
    text = "für Müller für Müller"
    dense, wide = mojibake.cells(text)
    assert len(dense) == 4 and len(set(wide.tolist())) == 2 and mojibake.cells("plain")[0].tolist() == []
    assert mojibake.cells("a\n\nü")[1].tolist() == mojibake.cells("ü")[1].tolist()


def test_restored_rows(spark, restorer):
    df = spark.createDataFrame([(1, "MÃ¼ller"), (1, "MÃ¼ller"), (2, None), (3, ""), (4, "Müller")], "doc_id bigint, text string").withColumn("restorable", F.lit("clash")).drop("restorable")
    rows = mojibake.restored(df, (restorer.dense, restorer.wide)).collect()
    assert [(r.doc_id, r.restored) for r in rows] == [(1, "Müller")] * 2
    assert mojibake.restored(df.limit(0), (restorer.dense, restorer.wide)).count() == 0


# ---- languages

SENTENCES = {
    "en": ["The ferry company sold the old ledger.", "Every clerk remembers the rules for small boats.", "Nobody could find the names of the missing buoys."],
    "de": ["Die Gesellschaft verkaufte das alte Buch.", "Jeder Schreiber kennt die Regeln für kleine Boote.", "Niemand fand die Namen der verschwundenen Bojen."],
    "fr": ["La compagnie a vendu le vieux registre.", "Chaque greffier connaît les règles pour les petits bateaux.", "Personne n'a trouvé les noms des bouées perdues."],
    "es": ["La compañía vendió el viejo libro.", "Cada escribano recuerda las reglas para barcas pequeñas.", "Nadie encontró los nombres de las boyas perdidas."],
    "it": ["La società ha venduto il vecchio registro.", "Ogni segretario ricorda le regole per le barche piccole.", "Nessuno ha trovato i nomi delle boe scomparse."],
    "pt": ["A companhia vendeu o velho livro.", "Cada escrivão recorda as regras para barcos pequenos.", "Ninguém encontrou os nomes das boias perdidas."],
    "ru": ["Компания продала старую книгу.", "Каждый писарь помнит правила для малых лодок.", "Никто не нашёл имена пропавших буёв."],
}


def test_segments_leave_running_lines_out():
    assert language.segments("The harbour log\nThe old ferry company of the town com-\npletely sold it. It was then a very\nold.\n— 3 —") == ["The old ferry company of the town completely sold it.", "It was then a very old."]
    assert language.segments("") == [] and language.segments("12 / 30") == []


def test_language_pages(spark):
    rng = random.Random(1)
    notation = {"en": "en-GB", "de": "deu", "fr": "FR", "es": "es_MX", "it": "ita", "pt": "pt", "ru": "rus"}
    rows = []
    for lang, sentences in SENTENCES.items():
        for _ in range(40):
            wrong = rng.random() < 0.1
            rows.append((len(rows), "\n".join(rng.choices(sentences, k=4)), rng.choice(list(notation.values())) if wrong else notation[lang]))
    n = len(rows)
    mixed = "\n".join(SENTENCES["de"] + SENTENCES["ru"])
    rows += [(n, mixed, "de"), (n, mixed, "de"), (n + 1, SENTENCES["it"][0] + "\n" + SENTENCES["it"][1], None), (n + 2, None, "en"), (n + 3, "", "en"), (n + 4, "\n".join(SENTENCES["es"]), "es_MX")]
    pages = spark.createDataFrame(rows, "page_id bigint, text string, lang string")
    model = language.train(pages)
    found = language.page_languages(pages, model)
    right = {i: lang for i, lang in enumerate(lang for lang in SENTENCES for _ in range(40))}
    got = {r.page_id: r.lang for r in found.where(F.col("page_id") < n).collect()}
    assert sum(got[i] == right[i] for i in right) >= 0.98 * len(right)
    late = sorted((r.page_id - n, r.lang) for r in language.mislabelled(found).where(F.col("page_id") >= n).collect())
    assert late == [(0, "de"), (0, "ru"), (1, "it")]
    pieces = language.page_segments(pages, model).where(F.col("page_id") == n).orderBy("segment").collect()
    assert [p.lang for p in pieces] == ["de", "ru"] and all(0.3 <= p.confidence <= 1 for p in pieces)
    assert language.page_languages(pages.limit(0), language.train(pages.limit(0))).count() == 0


# ---- leakage


def brute_leaks(docs, items, size=8):
    grams = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {(d, i) for d, t in docs for i, s in items if t and s and grams(leakage.words(t)) & grams(leakage.words(s))}


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 40)))) for i in range(30)] + [(90, None), (91, ""), (5, "Totally other words")]
    docs = []
    for d in range(200):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        if d % 3 == 0:
            w = leakage.words(items[rng.randrange(30)][1])
            at = rng.randrange(max(1, len(w) - 9))
            text += " -- " + "!\n".join(w[at : at + rng.randint(6, 12)]).upper() + " end"
        docs.append((d, text))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    for chars in (leakage.BLOCK_CHARS, 500):  # one block of items, and several
        monkeypatch.setattr(leakage, "BLOCK_CHARS", chars)
        rows = leakage.leaks(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and all(0 < r.contained <= 1 for r in rows)
    assert leakage.leaks(df.limit(0), bench).count() == 0 and leakage.leaks(df, bench.limit(0)).count() == 0
    assert sum(r.n_documents for r in leakage.leaked_items(leakage.leaks(df, bench)).collect()) == len(want)


# ---- mixing


def by_quotients(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        k = max(weights, key=lambda k: (weights[k] / (2 * got[k] + 1), [-ord(c) for c in k]))
        got[k] += 1
    return got


def test_apportionment():
    rng = random.Random(5)
    for _ in range(60):
        weights = {f"s{i}": rng.random() + 0.001 for i in range(rng.randint(1, 9))}
        seats = rng.randint(0, 400)
        assert mixing.sainte_lague(weights, seats) == by_quotients(weights, seats)
    assert mixing.sainte_lague({"a": 1.0, "b": 1.0}, 10, {"a": 2}) == {"a": 2, "b": 8} and mixing.sainte_lague({}, 5) == {}


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "none", None]), rng.randint(50, 900)) for i in range(3000)]
    sized = spark.createDataFrame([r for r in rows if r[1] in ("big", "small")], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(sized, targets, block=256, shard_tokens=60_000)
    caps = {"big": 1, "small": 3}
    assert all(r.uses <= caps[r.source] for r in mixed.collect()) and mixed.count() == mixed.select("doc_id").distinct().count()
    shares = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(shares["big"].actual_share - 2 / 3) < 0.01 and abs(shares["small"].actual_share - 1 / 3) < 0.01 and shares["absent"].tokens == 0
    again = mixing.mixture(sized.repartition(7), targets, block=256, shard_tokens=60_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    some = mixing.shares(mixing.mixture(sized, targets, total_tokens=100_000), targets).agg(F.sum("tokens")).first()[0]
    assert abs(some - 100_000) < 4000
    assert mixing.mixture(sized.limit(0), targets).count() == 0


def test_shards_grow_with_a_source(spark):
    sized = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "100 + id % 57 AS n_tokens")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    for shard_tokens in (10**9, 2_000):  # one shard a source, and over a thousand
        mixed = mixing.mixture(sized, targets, block=128, shard_tokens=shard_tokens)
        rows = {r.source: r for r in mixing.shares(mixed, targets).collect()}
        assert abs(rows["a"].actual_share - 0.5) < 0.02 and rows["a"].most_uses <= 3 and rows["b"].most_uses == 1, shard_tokens


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world <|endoftext|>", "a"), (1, "hello world <|endoftext|>", "a"), (2, "", "a"), (3, None, "a"), (4, "x", "other"), (5, "x", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a",)], "source string")
    rows = mixing.sizes(docs, targets).collect()
    assert [(r.doc_id, r.source) for r in rows] == [(1, "a")] and rows[0].n_tokens == len(mixing.encoder().encode_ordinary("hello world <|endoftext|>"))


# ---- truncation


def source_file(rng):
    names = [rng.choice(["alpha", "beta", "gamma"]) + "_" + rng.choice(["cache", "index", "header", "record"]) for _ in range(6)]
    lines = ["import tools", "", f"def {names[0]}({names[1]}, {names[2]}):"]
    for _ in range(rng.randint(4, 20)):
        a, c = rng.choice(names), rng.choice(names)
        lines.append(rng.choice([f"    {a} = {c}.get('value', {rng.randint(1, 999)})", f"    for item in {a}:\n        {c}.append(item * {rng.randint(1, 99)})", f"    log.debug('%s', {a})"]))
    return "\n".join([*lines, f"    return {rng.choice(names)}"]) + "\n"


def test_cut_texts_are_told_from_whole_ones(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        text = source_file(rng)
        cut = i % 12 == 0
        if cut:
            text = text[: rng.randint(60, len(text) - 12)]
        elif i % 5 == 0:
            text = text.rstrip("\n")
        rows.append((i, text, "python", "s", len(text), cut))
    rows += [(9001, None, None, "s", 0, False), (9002, "", None, "s", 0, False), (9003, " \n", None, "s", 2, False), (9004, rows[1][1] * 400, "python", None, 1, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, truth boolean")
    interior, final = truncation.train(df)
    marked = truncation.scored(df, interior, final).collect()
    hit = [r for r in marked if r.cut]
    right = sum(r.truth for r in hit)
    assert right / max(len(hit), 1) > 0.85 and right / sum(r.truth for r in marked) > 0.6, (len(hit), right)
    assert not any(r.cut for r in marked if r.doc_id > 9000)
    rates = {r.source: r for r in truncation.source_rates(truncation.scored(df, interior, final)).collect()}
    assert rates["s"].n_cut == len(hit) and 0 < rates["s"].share_cut < 1
    assert truncation.scored(df.limit(0), *truncation.train(df.limit(0))).count() == 0


def test_finished():
    whole = ["def a(x):\n    return x\n", "A sentence that has its end.", "{\n  a();\n}", "key: 12\n", "", "/* note */"]
    broken = ["def a(x):\n    return x.ge", "A sentence that stops in the mid", "f(a, ", "x = [1, 2", "value = total +", "some words and then...", "let xyz = foob"]
    assert all(map(truncation.finished, whole)) and not any(map(truncation.finished, broken))


def test_cuts_inside_a_statement_with_balanced_brackets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        text = source_file(rng)
        if i % 60 == 0:  # after the dot of a name known from before, before the call
            at = [m.end() for m in re.finditer(r"\.(?=get|append|debug)", text)]
            text = text[: rng.choice(at)]
        rows.append((i, text, "python", "s", len(text), i % 60 == 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, truth boolean")
    marked = truncation.scored(df, *truncation.train(df)).collect()
    assert sum(r.cut for r in marked if r.truth) >= 0.8 * 15 and not any(r.cut for r in marked if not r.truth)
    assert truncation.ending("x = item\nitem.") == truncation.ending("item = 1\n    item") == truncation.OPEN
    assert truncation.ending("a = 3\nb = a - 3") == truncation.PLAUSIBLE and truncation.ending("a = 3\nb = a - 3\n") == truncation.COMPLETE


def test_counts_of_interior_contexts():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab\n c", k=rng.randint(1, 60))) for _ in range(80)]
    raw = [t.encode() for t in texts]
    whole = {n: [r[max(0, i - n + 1) : i + 1] for r in raw for i in range(len(r) - 1) if r[i] not in b" \t" and i + 1 >= n] for n in truncation.ORDERS}
    ends = [r for r in raw]
    keys, there = truncation.context_keys(ends)
    kept = [np.unique(keys[there[:, row], row]) for row in range(len(truncation.ORDERS))]
    contexts = truncation.Contexts(kept)
    counts = [np.zeros(len(k), np.int64) for k in kept]
    data = b"".join(raw)
    places = truncation.interior_counts(np.frombuffer(data, np.uint8), np.cumsum([len(r) for r in raw]) - 1, contexts, counts)
    assert places == len(whole[1])
    for row, n in enumerate(truncation.ORDERS):
        for key in kept[row]:
            (context,) = {e[-n:] for e, k, t in zip(ends, keys[:, row], there[:, row]) if t and k == key}
            assert counts[row][np.searchsorted(kept[row], key)] == whole[n].count(context)
    assert truncation.interior_counts(np.zeros(0, np.uint8), np.zeros(0, np.int64), contexts, counts) == 0


def test_thresholds_lie_between_whole_and_cut_ends():
    bins, rng = truncation._bin(truncation.HIGHEST) + 1, np.random.default_rng(2)
    given, cuts = np.zeros((4, bins)), np.zeros((4, bins))
    for o in rng.normal(4, 1, 60):
        given[0, truncation._bin(o)] += 1
    for o in rng.normal(-4, 1, 1000):
        given[3, truncation._bin(o)] += 1
    for o in rng.normal(4, 1, 4000):
        cuts[0, truncation._bin(o)] += 1
    found = {how: truncation.LOWEST + at * truncation.BIN for how, at in truncation.fewest_errors(given, cuts).items()}
    assert -3 < found[0] < 2.5 and found[3] > -1 and 1 not in found


def test_thresholds_are_learnt_from_every_text(spark, monkeypatch):
    monkeypatch.setattr(truncation, "SAMPLE", 200, raising=False)
    rng = random.Random(8)
    rows = [(source_file(rng), rng.choice(["go", "java"])) for _ in range(1600)] + [(source_file(rng), f"rare{i}") for i in range(20)]
    rows = [(t[: rng.randint(60, len(t) - 12)] if i % 8 == 0 else t, x) for i, (t, x) in enumerate(rows)]
    rows += [(rows[0][0], None), *[(t, "java") for t, x in rows[:300] if x == "java"], (None, "go"), ("", "go")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = truncation.count_contexts(df)
    tables = {}
    for text, lang in {t: x for t, x in rows if t and x}.items():
        for inside, pieces in enumerate(([text], truncation.random_cuts(text))):
            for p in pieces:
                odds = truncation.log_odds([truncation.final_context(p[-truncation.TAIL :].encode())], model, bool(inside))[0]
                for key in (lang, None):
                    tables.setdefault(key, np.zeros((2, 4, truncation._bin(truncation.HIGHEST) + 1)))[inside, truncation.ending(p), truncation._bin(odds)] += 1
    usual = truncation.fewest_errors(*tables[None])
    bins = {(None, how): at for how, at in usual.items()} | {(x, how): at for x in ("go", "java") for how, at in truncation.fewest_errors(*tables[x], usual).items()}
    assert truncation.learn_thresholds(df, model).of == {k: truncation.LOWEST + at * truncation.BIN for k, at in bins.items()}


def test_a_part_is_judged_alike_beside_much_more(spark):
    rng = random.Random(6)

    def inside(text):  # behind a character of a line, not behind a whole one
        return text[: rng.choice([i for i in range(60, len(text) - 12) if not text[i - 1].isspace() and text[i] != "\n"])]

    part = [(i, source_file(rng)) for i in range(2400)]
    part = [(i, inside(t) if i % 10 == 0 else t) for i, t in part]
    rest = [(10_000 + i, source_file(rng)) for i in range(24_000)]
    rest = [(i, inside(t) if i % 10 == 0 else t) for i, t in rest]
    cut = []
    for rows in (part, part + rest):
        df = spark.createDataFrame([(i, t, "python") for i, t in rows], "doc_id bigint, text string, lang string")
        cut.append({r.doc_id for r in truncation.scored(df, *truncation.train(df)).where("cut and doc_id < 10000").collect()})
    truth = {i for i, _ in part if i % 10 == 0}
    assert all(len(c & truth) >= 0.85 * len(truth) and len(c - truth) <= 12 for c in cut) and len(cut[0] ^ cut[1]) <= 24, [(len(c & truth), len(c - truth)) for c in cut]
