import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.kernel import builder as b
from foliospark.kernel import ccitt, ciphers, encodings, filters, fonts, functions, objects
from foliospark.kernel import extract as x
from foliospark.kernel.interpreter import Limits
from foliospark.kernel.layout import Glyphs, Layout, Options, logical_order
from foliospark.plans import pdf_files as draw


def one_page(content: bytes, resources="/Font <</F1 3 0 R>>", font=b.COURIER, more=None, page=""):
    objs = b.page_tree(1, 4, resources)
    if page:
        objs[4] = f"<</Type /Page /Parent 2 0 R /Contents 5 0 R {page}>>".encode()
    return b.classic(objs | {3: font, 5: b.stream("", content)} | (more or {}))


def run(text, px, py, advance=5.0, size=10.0):
    return [(c, px + i * advance, py, advance, size, None, None, None) for i, c in enumerate(text)]


def lay(rows, mode="position", box=None, **k):
    return Layout(Glyphs.of_rows(rows), Options(mode, **k), box).page_text()


# ---- objects and filters


@pytest.mark.parametrize("word,value", [(b"12", 12), (b"-3.5", -3.5), (b"+7", 7), (b"--4", 4), (b".5", 0.5), (b"4.", 4.0), (b"1_0", None), (b"nan", None), (b"12-3", 12)])
def test_numbers(word, value):
    assert objects.number(word) == value


def test_values():
    scan = objects.Scanner(b"<</A [3 0 R (a\\(b\\051) <4 1>] /B#20C true>> % note\n null")
    assert scan.value() == {"A": [objects.Ref(3, 0), b"a(b)", b"A"], "B C": True} and scan.value() is None
    assert objects.Scanner(b"[5 0 R (x) /N#41]").value() == [objects.Ref(5, 0), b"x", "NA"]
    assert objects.Scanner(b"(a\\\nb\\101\\n)").value() == b"abA\n"


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_filters_round_trip(data):
    import base64

    assert filters.lzw(draw.lzw_encode(data)) == data
    assert filters.flate(zlib.compress(data)) == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    packed = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"
    assert filters.run_length(packed) == data


def test_damaged_flate_keeps_its_prefix():
    plain = bytes(np.random.default_rng(2).integers(0, 40, 20_000, dtype=np.uint8))
    data = zlib.compress(plain)
    try:
        out = filters.flate(data[:6000] + b"\xff" * 90 + data[6090:])
    except filters.Problem as e:
        out = e.kept
    assert out.startswith(plain[:6000])
    assert filters.flate(zlib.compress(b"abc")[:-2] + b"zz") == b"abc"
    assert filters.flate(zlib.compress(b"abc")[2:-4]) == b"abc"


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_rows(kind):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    out, above = b"", bytes(12)
    for row in rows.tolist():
        enc = []
        for i, v in enumerate(row):
            a, u, c = (row[i - 3] if i >= 3 else 0), above[i], (above[i - 3] if i >= 3 else 0)
            p = a + u - c
            paeth = min((a, u, c), key=lambda q: (abs(p - q), (a, u, c).index(q)))
            enc.append((v - (0, a, u, (a + u) // 2, paeth)[kind]) & 255)
        out += bytes([kind, *enc])
        above = bytes(row)
    assert filters.unpredict(out, {"Predictor": 15, "Colors": 3, "Columns": 4}) == rows.tobytes()


def test_unknown_filter_and_misplaced_codec():
    with pytest.raises(filters.Problem):
        filters.decode(b"", [("Nope", {})])
    with pytest.raises(filters.Problem):
        filters.decode(b"", [("DCTDecode", {}), ("FlateDecode", {})])
    assert filters.decode(b"x", [("DCTDecode", {})])[1] == "DCTDecode"


# ---- ciphers


def test_cipher_vectors():
    assert ciphers.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert ciphers.cbc_encrypt(key, bytes(16), plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert ciphers.cbc_decrypt(key, bytes(16), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")) == plain
    long = bytes(range(32))
    assert ciphers.cbc_decrypt(long, bytes(16), ciphers.cbc_encrypt(long, bytes(16), plain * 9)) == plain * 9


@pytest.mark.parametrize("revision,aes", [(2, False), (3, False), (4, True)])
def test_passwords(revision, aes):
    objs = b.page_tree(1, 4, "/Font <</F1 3 0 R>>") | {3: b.COURIER, 5: b.stream("", b.lines_content(["secret text"]))}
    data = b.encrypted(objs, user=b"user", owner=b"owner", revision=revision, aes=aes)
    assert "Denied" in x.read(data).error
    for password in ("user", "owner"):
        assert x.read(data, x.Options(passwords=(password,))).text() == "secret text"


def test_revision_6_key():
    import hashlib
    import os

    key, salt = os.urandom(32), os.urandom(16)
    user = ciphers.hash_2b(b"pw", salt[:8], b"", 6) + salt
    wrapped = ciphers.cbc_encrypt(ciphers.hash_2b(b"pw", salt[8:], b"", 6), bytes(16), key)
    entry = {"V": 5, "R": 6, "U": user, "UE": wrapped, "O": bytes(48), "OE": bytes(32), "CF": {"StdCF": {"CFM": "AESV3"}}, "StmF": "StdCF", "StrF": "StdCF"}
    assert ciphers.Security(entry, b"", (b"pw",)).key == key
    with pytest.raises(ciphers.Denied):
        ciphers.Security(entry, b"", (b"no",))
    assert ciphers.hash_2b(b"a", b"b" * 8, b"", 5) == hashlib.sha256(b"a" + b"b" * 8).digest()


# ---- documents


@pytest.mark.parametrize("make", [draw.xref_stream_pdf, draw.object_stream_pdf, draw.hybrid_pdf, draw.broken_pdf, draw.form_pdf, draw.mapped_font_pdf, draw.differences_pdf, *map(draw.filtered_pdf, ("FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "png"))])
def test_same_text_through_every_container(make):
    text = "\n".join(f"line {i} with (some) words \\ and é" for i in range(50))
    assert x.read(make(text)).text().replace("\n\n", "\n") == text


def test_hostile_files():
    assert x.read(b"").error and x.read(b"%PDF-1.4 nothing").error and x.read(b"\xff" * 5000).error
    cyclic = b.classic({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [2 0 R 3 0 R] /Count 2>>", 3: b"<</Type /Page /Parent 2 0 R>>"})
    d = x.read(cyclic)
    assert d.page_count == 1 and d.warnings[0][0] == "malformed_document"
    own = one_page(b"/X0 Do", "/XObject <</X0 6 0 R>>", more={6: b.stream("/Subtype /Form /BBox [0 0 9 9] /Resources <</XObject <</X0 6 0 R>>>>", b"/X0 Do")})
    assert x.read(own).pages[0].warnings == [("malformed_page", "form XObject draws itself")]
    good = b.text_pdf("some words here")
    for cut in range(0, len(good), 37):
        x.read(good[:cut])
        x.read(good[:cut] + b"\0" + good[cut + 1 :])


@given(st.binary(max_size=400))
@settings(max_examples=80, deadline=None)
def test_any_content_is_survived(data):
    x.read(one_page(data))


def test_junk_before_the_header_and_wrong_count():
    assert x.read(b"junk\n" + b.text_pdf("hello there")).text() == "hello there"
    data = b.text_pdf("\n".join(map(str, range(100)))).replace(b"/Count 3", b"/Count 9")
    assert x.read(data).page_count == 3
    assert [p.number for p in x.read(data, x.Options(pages=((2, 0),))).pages] == [2, 3]
    with pytest.raises(ValueError):
        x.Options(pages=((3, 2),))
    with pytest.raises(ValueError):
        Limits(glyphs=-1)


def test_limits_and_strict():
    data = b.text_pdf("x" * 50)
    d = x.read(data, x.Options(limits=Limits(glyphs=10)))
    assert d.text() == "x" * 10 and d.pages[0].warnings[0][0] == "work_limit"
    d = x.read(one_page(b"1 Tf (a) Tj BT /F1 10 Tf 1 0 0 1 72 700 Tm (ok) Tj ET"), x.Options(strict=True))
    assert d.error.startswith("malformed_page")
    assert len(x.read(one_page(b"Q " * 1000)).pages[0].warnings) == 1
    many = x.read(one_page(b"/X0 Do " * 400, "/XObject <</X0 6 0 R>>", more={6: b.stream("/Subtype /Form", b"Q")})).pages[0].warnings
    assert len(many) == 256 and "suppressed" in many[-1][1]


def test_marked_content():
    t = b"BT /F1 10 Tf 1 0 0 1 72 700 Tm "
    assert x.read(one_page(b"/Span <</ActualText (fi)>> BDC " + t + b"(xyz) Tj ET EMC")).text() == "fi"
    assert x.read(one_page(b"/Span <</ActualText <FEFF00E9>>> BDC EMC")).text() == "é"
    assert x.read(one_page(t + b"(kept) Tj ET EMC " + t + b"(lost) Tj ET")).text() == "kept"
    d = x.read(one_page(b"/Artifact BMC " + t + b"(head) Tj ET EMC " + t + b"(body) Tj ET"), x.Options(ignore_artifacts=True))
    assert d.text() == "body"


def test_extras():
    page = "/MediaBox [300 400 0 0] /CropBox [5 6 290 390] /Rotate 450 /Annots [<</Subtype /Link /Rect [0 0 9 9] /Dest [4 0 R /XYZ 1 2 3] /Contents (note)>>]"
    p = x.read(one_page(b"", page=page)).pages[0]
    assert p.media_box == (0, 0, 300, 400) and p.crop_box == (5, 6, 290, 390) and p.rotation == 90
    assert p.annotations[0]["destination"] == {"name": "", "page": 1, "x": 1.0, "y": 2.0, "zoom": 3.0} and p.annotations[0]["contents"] == "note"
    d = x.read(draw.outline_pdf("top", ["a", "b"]))
    assert [(o["title"], o["depth"], o["ordinal"], o["parent"]) for o in d.outlines] == [("top", 0, 0, None), ("a", 1, 0, 0), ("b", 1, 1, 0)]
    d = x.read(draw.field_pdf("7", "AUTO"))
    assert d.fields == [{"name": "ledger.7", "alternate_name": "", "type": "Tx", "value": "AUTO", "page": 1}] and d.text() == "AUTO"


def test_ocr_hook():
    from foliospark.kernel.interpreter import Run

    engine = lambda page: [Run(["word"], np.array([72.0]), np.array([700.0]), np.array([40.0]), 10.0, (1.0, 0.0), (0.0, 10.0))]
    d = x.read(one_page(b""), x.Options(ocr=engine, ocr_policy="textless"))
    assert d.text() == "word" and d.pages[0].ocr_glyphs == 1
    assert x.read(b.text_pdf("t"), x.Options(ocr=engine, ocr_policy="textless")).text() == "t"
    d = x.read(one_page(b""), x.Options(ocr=lambda p: 1 / 0, ocr_policy="all"))
    assert d.pages[0].warnings[0][0] == "ocr"


# ---- fonts


def test_glyph_names():
    cases = {"A": "A", "eacute": "é", "Ccedilla": "Ç", "alpha": "α", "f_i": "fi", "uni00410042": "AB", "u1F600": "😀", "a.alt": "a", "nothing": "", ".notdef": "", "Zcaron": "Ž", "fi": "ﬁ"}
    assert {k: encodings.glyph_text(k) for k in cases} == cases
    assert encodings.table("WinAnsiEncoding")[0x80] == "€" and encodings.table("MacRomanEncoding")[0x80] == "Ä" and encodings.table("StandardEncoding")[0xAE] == "ﬁ"
    assert encodings.text_string(b"\xfe\xff\x00a") == "a" and encodings.text_string(b"\xef\xbb\xbf\xc3\xa9") == "é" and encodings.text_string(b"\x80") == "•"
    assert encodings.sanitize("a b\t�ﬁ") == "a b fi" and encodings.sanitize("ﬁ", False) == "ﬁ"


def test_cmaps():
    c = fonts.parse_cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0001> <0003> <0041> <0010> <0011> [<0061> <00620063>] endbfrange 1 begincidrange <0020> <0030> 5 endcidrange")
    assert c.texts[2, 3] == "C" and c.texts[2, 17] == "bc" and c.cid(2, 0x22) == 7 and list(c.codes(b"\0\x01\0\x02")) == [(2, 1), (2, 2)]
    font = b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<</DW 600 /W [1 [500]]>>] /ToUnicode 6 0 R>>"
    cmap = b.stream("", b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <4E2D> endbfchar")
    d = x.read(one_page(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <00010001> Tj ET", font=font, more={6: cmap}))
    g = d.pages[0].glyphs()
    assert d.text() == "中中" and g.advance.tolist() == [5.0, 5.0]
    d = x.read(one_page(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <4E2D> Tj ET", font=font.replace(b"Identity-H", b"UniGB-UCS2-V").replace(b"/ToUnicode 6 0 R", b"")))
    assert d.text() == "中" and d.pages[0].glyphs().dy[0] == -1


def test_standard_widths():
    assert fonts.standard_widths("ABCDEF+Arial-BoldMT")["a"] == 556 and fonts.standard_widths("Times New Roman")["i"] == 278
    assert fonts.standard_widths("CourierNew") == 600 and fonts.standard_widths("Other") is None and fonts.standard_widths("Helvetica")["é"] == 556


# ---- layout


def test_columns_title_and_table():
    left = ["the first column holds a line", "of prose that goes on and on", "until the column comes to end", "and then one more full line."]
    right = ["while this second column tells", "another story of equal length", "that must not be mixed in with", "the first one beside it here."]
    rows = run("A title across the whole page of the document here and more", 72, 760)
    for i, (a, c) in enumerate(zip(left, right)):
        rows += run(a, 72, 720 - 12 * i) + run(c, 300, 720 - 12 * i)
    assert lay(rows).split("\n")[1:] == left + right
    cells = [r for i, (a, c) in enumerate([("apple", "12"), ("pear", "7"), ("plum", "30")]) for r in run(a, 72, 700 - 12 * i) + run(c, 300, 700 - 12 * i)]
    assert lay(cells) == "apple 12\npear 7\nplum 30" and lay(cells, "columns") == "apple\npear\nplum\n12\n7\n30"


def test_duplicates_overlays_scripts_and_edges():
    bold = run("Bold", 72, 700) + run("Bold", 72.3, 700.1)
    assert lay(bold) == "Bold" and lay(bold, keep_duplicates=True) != "Bold"
    overlaid = run("under the stamp", 72, 700) + run("STAMP", 90.5, 700)
    assert lay(overlaid) == "under the stamp\nSTAMP"
    assert lay(run("x", 72, 700) + run("2", 77, 704, 3, 6) + run("y", 80, 700)) == "x2y"
    assert lay(run("in", 72, 700) + run("out", 900, 700), box=(0, 0, 612, 792)) == "in"
    assert lay(run("in", 72, 700) + run("out", 900, 700), box=(0, 0, 612, 792), keep_off_page=True) == "in out"
    assert lay(run("two", 72, 700) + run("words", 89, 700)) == "two words"
    assert lay(run("c", 77, 700) + run("b", 72, 700)) == "bc" and lay(run("  a  ", 72, 700)) == "a" and lay([]) == ""
    assert lay(run("b", 72, 600) + run("a", 72, 700), "content") == "b\na" and lay(run("b", 72, 600) + run("a", 72, 700)) == "a\nb"


@pytest.mark.parametrize("painted,read", [("אבג", "גבא"), ("abc", "abc"), ("12 גבא", "אבג 12"), ("abc גבא def", "abc אבג def")])
def test_right_to_left(painted, read):
    assert lay(run(painted, 72, 700)) == read


@given(st.lists(st.sampled_from(["a", "1", ".", " ", "א", "ب", "-", "中"]), max_size=30))
def test_logical_order_is_a_permutation(pieces):
    assert sorted(logical_order(pieces)) == sorted(pieces)


@given(st.lists(st.tuples(st.sampled_from("abcאה fi1,"), st.integers(0, 40), st.integers(0, 20), st.integers(1, 24), st.sampled_from([(1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.7, 0.7)])), max_size=60))
@settings(max_examples=80, deadline=None)
def test_layout_keeps_every_letter(cells):
    rows = [(c, px * 2.5, py * 2.5, 5.0, float(s), d, None, None) for c, px, py, s, d in cells]
    kept = sorted(lay(rows, keep_duplicates=True).replace(" ", "").replace("\n", ""))
    assert kept == sorted(c for c, *_ in cells if c != " ")


# ---- functions and images


class Plain:
    def get(self, v):
        return v

    def items(self, v):
        return list(v) if isinstance(v, list) else []

    def body(self, s):
        return s.raw


def calc(code, inputs, outs=1):
    s = objects.Stream({"FunctionType": 4, "Domain": [-100, 100] * len(inputs), "Range": [-1000, 1000] * outs}, code)
    return functions.Function(Plain(), s)(inputs)


@pytest.mark.parametrize(
    "code,inputs,want",
    [(b"{add}", [2, 3], [5]), (b"{dup mul}", [4], [16]), (b"{0.5 gt {7} {8} ifelse}", [1], [7]), (b"{3 1 roll pop pop}", [1, 2, 3], [3]), (b"{pop 1 0 div}", [1], [0]), (b"{2.5 round add}", [0], [3]), (b"{-1 0 atan add}", [0], [270]), (b"{cvi 3 bitshift}", [2], [16]), (b"{exch sub}", [5, 2], [-3]), (b"{1 index add add}", [1, 2], [4])],
)
def test_calculator(code, inputs, want):
    assert calc(code, inputs) == want


def test_other_functions():
    f = functions.Function(Plain(), {"FunctionType": 2, "Domain": [0, 1], "C0": [0.0], "C1": [2.0], "N": 2})
    assert f([0.5]) == [0.5] and f([5]) == [2.0]
    g = functions.Function(Plain(), {"FunctionType": 3, "Domain": [0, 1], "Functions": [{"FunctionType": 2, "Domain": [0, 1], "N": 1}] * 2, "Bounds": [0.5], "Encode": [0, 1, 1, 0]})
    assert g([0.25]) == [0.5] and g([0.75]) == [0.5]
    s = functions.Function(Plain(), objects.Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}, bytes([0, 255, 0])))
    assert s([0.25]) == [0.5] and s([0.5]) == [1.0]


def test_images():
    indexed = one_page(b"q 10 0 0 10 5 5 cm /I Do Q", "/XObject <</I 6 0 R>>", more={6: b.stream("/Subtype /Image /Width 2 /Height 1 /BitsPerComponent 4 /ColorSpace [/Indexed /DeviceRGB 1 <FF000000FF00>]", b"\x01")})
    from foliospark.kernel import pictures

    image = x.read(indexed, x.Options(images=True)).pages[0].images[0]
    assert pictures.pixels(image).tolist() == [[[255, 0, 0], [0, 255, 0]]] and image.to_page(0, 0) == (5.0, 15.0)
    inline = x.read(one_page(b"q 8 0 0 8 0 0 cm BI /W 2 /H 2 /BPC 8 /CS /G ID \x00\x40\x80\xff EI Q BT /F1 10 Tf 1 0 0 1 72 700 Tm (t) Tj ET"), x.Options(images=True))
    assert inline.text() == "t" and pictures.pixels(inline.pages[0].images[0]).ravel().tolist() == [0, 64, 128, 255]


def fax_row(edges, width, colour_words=(ccitt.WHITE.split(), ccitt.BLACK.split())):
    out, at = "", 0
    for k, e in enumerate([*edges, width]):
        n = e - at
        words = colour_words[k % 2]
        while n >= 64:
            m = min(n // 64, 27)
            out += words[63 + m]
            n -= 64 * m
        out += words[n]
        at = e
    return out


def test_fax_one_dimensional():
    rows, width = [[3, 10], [0, 100, 190], [], [199]], 200
    bits = "".join(fax_row(r, width) for r in rows)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    page = np.unpackbits(np.frombuffer(ccitt.decode(data, {"K": 0, "Columns": width, "BlackIs1": True}, width, 4), np.uint8).reshape(4, -1), axis=1)
    for row, edges in zip(page, rows):
        want = np.zeros(width, int)
        marks = [*edges, width]
        for i in range(0, len(marks) - 1, 2):
            want[marks[i] : marks[i + 1]] = 1
        assert row[:width].tolist() == want.tolist()


def test_fax_two_dimensional():
    # Two equal rows: the first by horizontal mode, the second by three vertical codes.
    first = "001" + ccitt.WHITE.split()[3] + ccitt.BLACK.split()[4] + "1"
    bits = first + "1" + "1" + "1"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    page = np.unpackbits(np.frombuffer(ccitt.decode(data, {"K": -1, "Columns": 16, "BlackIs1": True}, 16, 2), np.uint8).reshape(2, -1), axis=1)
    assert page.tolist() == [[0] * 3 + [1] * 4 + [0] * 9] * 2


# ---- arithmetic coding and bilevel images


class Coder:
    """Encoder for the arithmetic decoder, after the published flow charts."""

    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray([0])

    def bit(self, contexts, i, d):
        from foliospark.kernel.mq import STATES

        qe, good, bad, switch = STATES[contexts.state[i]]
        self.a -= qe
        if d == contexts.likely[i]:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            contexts.state[i] = good
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            if switch:
                contexts.likely[i] ^= 1
            contexts.state[i] = bad
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if self.ct == 0:
                self.byte()

    def byte(self):
        if self.out[-1] == 0xFF or (self.c >= 0x8000000 and self.out[-1] == 0xFE):
            if self.out[-1] != 0xFF:
                self.out[-1] += 1
                self.c &= 0x7FFFFFF
            self.out.append(self.c >> 20)
            self.c &= 0xFFFFF
            self.ct = 7
            return
        if self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        self.out.append(self.c >> 19)
        self.c &= 0x7FFFF
        self.ct = 8

    def finish(self):
        t = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= t:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self.byte()
        return bytes(self.out[1:]) + b"\xff\xac"


def test_arithmetic_decoder_vector():
    from foliospark.kernel.mq import Contexts, Decoder

    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    plain = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
    decoder, contexts = Decoder(coded), Contexts(1)
    bits = [decoder.bit(contexts, 0) for _ in range(8 * len(plain))]
    assert np.packbits(bits).tobytes() == plain
    coder, contexts = Coder(), Contexts(1)
    for b in np.unpackbits(np.frombuffer(plain, np.uint8)).tolist():
        coder.bit(contexts, 0, b)
    assert coder.finish()[:28] == coded[:28]


class Recorder:
    """Stands in for a decoder: takes its bits from a bitmap being coded."""

    def __init__(self, bits):
        self.bits, self.coder = iter(bits), Coder()

    def bit(self, contexts, i):
        b = next(self.bits)
        self.coder.bit(contexts, i, b)
        return b


def segment(number, kind, body, referred=()):
    import struct

    return struct.pack(">IBB", number, kind, len(referred) << 5) + bytes(referred) + b"\x01" + struct.pack(">I", len(body)) + body


def integer_bits(v):
    from foliospark.kernel.mq import Integers

    if v is None:
        return [1, 0, 0, 0]
    sign, m = int(v < 0), abs(v)
    kind = max(k for k, (_, lo) in enumerate(Integers.RANGES) if m >= lo)
    n, lo = Integers.RANGES[kind]
    return [sign] + [1] * kind + ([0] if kind < 5 else []) + [(m - lo) >> i & 1 for i in range(n - 1, -1, -1)]


@pytest.mark.parametrize("template", [0, 1, 2, 3])
def test_bilevel_generic_region(template):
    import struct

    from foliospark.kernel import jbig2

    bits = (np.random.default_rng(3).random((19, 37)) < 0.3).astype(int)
    recorder = Recorder(bits.ravel().tolist())
    adaptive = jbig2.DEFAULT_ADAPTIVE[template]
    jbig2.generic(recorder, 37, 19, template, adaptive, False)
    body = struct.pack(">IIIIB", 37, 19, 2, 1, 0) + bytes([template << 1]) + b"".join(struct.pack(">bb", *p) for p in adaptive) + recorder.coder.finish()
    page = np.unpackbits(np.frombuffer(jbig2.decode(segment(0, 48, bytes(19)) + segment(1, 38, body), None, 40, 24), np.uint8).reshape(24, -1), axis=1)
    assert (page[1:20, 2:39] == bits).all() and page.sum() == bits.sum()


def test_bilevel_symbols_and_text():
    import struct

    from foliospark.kernel import jbig2
    from foliospark.kernel.mq import Contexts, Integers

    shapes = [np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]]), np.array([[0, 1], [0, 1], [0, 1]])]
    stream = integer_bits(3) + integer_bits(3) + shapes[0].ravel().tolist() + integer_bits(-1) + shapes[1].ravel().tolist() + integer_bits(None) + integer_bits(0) + integer_bits(2)
    recorder = Recorder(stream)
    numbers, contexts = Integers(recorder), Contexts(1 << 16)
    numbers.integer("height")
    for w in (3, 2):
        numbers.integer("width")
        jbig2.generic(recorder, w, 3, 0, jbig2.DEFAULT_ADAPTIVE[0], False, contexts)
    numbers.integer("width")
    numbers.integer("export")
    numbers.integer("export")
    adaptive = b"".join(struct.pack(">bb", *p) for p in jbig2.DEFAULT_ADAPTIVE[0])
    dictionary = segment(0, 0, struct.pack(">H", 0) + adaptive + struct.pack(">II", 2, 2) + recorder.coder.finish())
    recorder = Recorder(integer_bits(0) + integer_bits(2) + integer_bits(1) + [0] + integer_bits(2) + [1] + integer_bits(None))
    numbers = Integers(recorder)
    numbers.integer("strip")
    numbers.integer("strip")
    numbers.integer("first")
    numbers.symbol(1)
    numbers.integer("gap")
    numbers.symbol(1)
    numbers.integer("gap")
    text = segment(2, 6, struct.pack(">IIIIB", 16, 8, 0, 0, 0) + struct.pack(">H", 1 << 4) + struct.pack(">I", 2) + recorder.coder.finish(), (0,))
    page = np.unpackbits(np.frombuffer(jbig2.decode(segment(1, 48, bytes(19)) + text, dictionary, 16, 8), np.uint8).reshape(8, -1), axis=1)
    want = np.zeros((8, 16), int)
    want[2:5, 1:4] = shapes[0]
    want[2:5, 5:7] = shapes[1]
    assert (page == want).all()


def test_compact_font_encoding():
    import struct

    def index(items):
        marks = [1]
        for i in items:
            marks.append(marks[-1] + len(i))
        return struct.pack(">H", len(items)) + (b"\x02" + b"".join(struct.pack(">H", m) for m in marks) + b"".join(items) if items else b"")

    def number(v):
        return b"\x1d" + struct.pack(">i", v)

    head, names, strings, subrs = b"\1\0\4\1", index([b"F"]), index([b"Zcaron.alt"]), index([])
    make = lambda *at: index([number(at[0]) + b"\x0f" + number(at[1]) + b"\x10" + number(at[2]) + b"\x11"])
    base = len(head + names + make(0, 0, 0) + strings + subrs)
    charset = b"\0" + struct.pack(">HHH", 34, 171, 391)  # A, Aacute, own string
    encoding = b"\x01\x01" + bytes([65, 2])
    data = head + names + make(base, base + len(charset), base + len(charset) + len(encoding)) + strings + subrs + charset + encoding + index([b"\x0e"] * 4)
    assert fonts.cff_encoding(data) == {65: "A", 66: "Á", 67: "Ž"}
    assert len(fonts._cff_standard()) == 229
    font = b"<</Type /Font /Subtype /Type1 /BaseFont /X /FontDescriptor <</Flags 4 /FontFile3 6 0 R>>>>"
    d = x.read(one_page(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (ABC) Tj ET", font=font, more={6: b.flate("/Subtype /Type1C", data)}))
    assert d.text() == "AÁŽ"


def test_glyph_names_by_rule():
    want = {
        "Delta": "∆", "Omega": "Ω", "Schwa": "Ə", "Scommaaccent": "Ș", "pe": "פ", "pecyrillic": "п", "Alphatonos": "Ά", "iotadieresistonos": "ΐ", "lambda": "λ", "mugreek": "μ", "afii10017": "А", "afii10023": "Ё", "afii10110": "ў", "afii57664": "א", "afii57434": "غ", "afii57799": "ְ", "Acircumflexacute": "Ấ", "Gcommaaccent": "Ģ",
        "asmallhiragana": "ぁ", "shikatakana": "シ", "kokaithai": "ก", "aavowelsigndeva": "ा", "behfinalarabic": "ﺐ", "Aybarmenian": "Ա", "kiyeokkorean": "ㄱ", "Amonospace": "Ａ", "onecircle": "①", "oneparen": "⑴", "oneroman": "ⅰ", "foursuperior": "⁴", "acutecomb": "\u0301", "SF540000": "╪", "twothirds": "⅔", "AEacute": "Ǽ", "finalkaf": "ך", "g12": "", "foobar": "", "a_b.alt": "ab",
    }
    assert {n: encodings.glyph_text(n) for n in want} == want


def test_standard_faces_and_symbol_fonts():
    w = fonts.standard_widths
    assert (w("Times-Italic")["—"], w("Times-BoldItalic")["E"], w("Helvetica-Oblique")["í"], w("ABCDEF+TimesNewRoman,Bold")["“"]) == (889, 667, 278, 500)
    assert w("Symbol")[97] == 631 and w("ZapfDingbats")[0x34] == 846 and len(w("Symbol")) == 256


def type3(names, text=b"!A"):
    objects = b.page_tree(1, 4, "/Font <</F1 3 0 R>>")
    objects[3] = b"<</Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /FontBBox [0 0 50 100] /CharProcs <<>> /FirstChar 33 /Widths [50] /Encoding <</Differences [%s]>>>>" % names
    objects[5] = b.stream("", b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (%s) Tj ET" % text)
    return x.read(b.classic(objects)).text()


def test_names_that_carry_a_code():
    assert type3(b"33 /a33 65 /a65") == "!A"
    assert type3(b"34 /a34 65 /a65", b'"A') == "A"  # a quote in TeX's encodings is another sign
    assert type3(b"0 " + b" ".join(b"/a%d" % i for i in range(70))) == ""  # numbered in order of use


def test_fonts_that_forms_take_for_granted():
    objects = b.page_tree(1, 4, "")
    objects[5] = b.stream("", b"BT /Helv 10 Tf 1 0 0 1 72 700 Tm (Yes) Tj /ZaDb 10 Tf 1 0 0 1 120 700 Tm (4) Tj /Gone 10 Tf (x) Tj ET")
    assert x.read(b.classic(objects)).text().split() == ["Yes", "✔"]


def test_simple_fonts_select_glyphs_by_byte():
    sub = bytes(262)
    sub = b"\0\0\x01\x06\0\0" + bytes(3 if c == 0x41 else 0 for c in range(256))  # Mac table: byte 0x41 shows glyph 3
    four = struct.pack(">HHHHHHHHHHHHHH", 4, 32, 0, 4, 4, 1, 0, 0x5A, 0xFFFF, 0, 0x5A, 0xFFFF, (3 - 0x5A) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)  # Unicode table: Z is glyph 3
    cmap = struct.pack(">HHHHIHHI", 0, 2, 1, 0, 20, 3, 1, 20 + len(sub)) + sub + four
    data = b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + struct.pack(">4sIII", b"cmap", 0, 28, len(cmap)) + cmap
    by_glyph, by_byte = fonts.sfnt_map(data), fonts.sfnt_bytes(data)
    assert by_byte[0x41] == 3 and by_glyph[3] in ("A", "Z")


def test_damaged_outlines_and_fields_are_warned_of():
    cyclic = draw.outline_pdf("top", ["a", "b"]).replace(b"/Parent 11 0 R >>", b"/Next 11 0 R>>   ")
    d = x.read(cyclic)
    assert [o["title"] for o in d.outlines] == ["top", "a", "b"] and [w[0] for w in d.warnings] == ["malformed_document"]
    objects = b.page_tree(1, 4, "", extra="/AcroForm <</Fields [6 0 R 6 0 R 7 0 R]>>") | {5: b.stream("", b""), 6: b"<</T (a) /FT /Tx /V (1)>>", 7: b"<</T (b) /FT /Tx /V (2)>>"}
    d = x.read(b.classic(objects))
    assert [f["name"] for f in d.fields] == ["a"] and [w[0] for w in d.warnings] == ["malformed_document"]
    with pytest.raises(ValueError):
        Limits(glyphs=-1)
