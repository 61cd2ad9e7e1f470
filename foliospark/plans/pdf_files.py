"""Example files drawn from the tables, for the queries of the PDF operators."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.kernel import builder as b

#: Characters a WinAnsi font shows as themselves; others are drawn as a question mark.
ODD = r"[^\x20-\x7E\n¡-¬®-ÿ]"


#: Rows drawn at one time.
TOGETHER = 512


def drawable(text):
    return F.regexp_replace(F.translate(text, "\r\t", "  "), ODD, "?")


def files(rows: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """(doc_id, content): ``make`` is called with the other columns of each row, by name.

    A ``make`` with an attribute ``many`` is given ``TOGETHER`` rows at a time instead.
    """
    names = [c for c in rows.columns if c != "doc_id"]
    many = getattr(make, "many", None) or (lambda values: (make(**v) for v in values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, content, size = [], [], 0
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER).to_pylist()
                for row, made in zip(part, many([{n: row[n] for n in names} for row in part])):
                    ids.append(row["doc_id"])
                    content.append(made)
                    size += len(made)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.binary())], names=["doc_id", "content"])
                        ids, content, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, content binary")


# ---- ways to draw the same lines --------------------------------------------


def _placed(lines: list[str], show: Callable[[str], bytes]) -> bytes:
    return b"BT /F1 10 Tf\n" + b"\n".join(b"1 0 0 1 72 %d Tm " % (720 - 14 * k) + show(line) for k, line in enumerate(lines)) + b"\nET"


def by_kerning(lines: list[str]) -> bytes:
    """Words set apart by TJ offsets, no space glyphs."""
    return _placed(lines, lambda line: b"[" + b" -600 ".join(b.literal(w) for w in line.split(" ") if w) + b"] TJ")


def by_td(lines: list[str]) -> bytes:
    return b"BT /F1 10 Tf 72 734 Td\n" + b"\n".join(b"0 -14 Td %s Tj" % b.literal(line) for line in lines) + b"\nET"


def by_next_line(lines: list[str]) -> bytes:
    return b"BT /F1 10 Tf 14 TL 72 734 Td\n" + b"\n".join(b"T* %s Tj" % b.literal(line) for line in lines) + b"\nET"


def by_quotes(lines: list[str]) -> bytes:
    shown = (b"%s '" % b.literal(line) if k % 2 else b'0 0 %s "' % b.literal(line) for k, line in enumerate(lines))
    return b"BT /F1 10 Tf 72 734 TD 0 -14 TD 0 14 Td\n" + b"\n".join(shown) + b"\nET"


def bold(lines: list[str]) -> bytes:
    """Every line painted twice, a third of a point apart."""
    return b.lines_content(lines) + b"\n" + b.lines_content(lines, x=72.3)


def with_off_page(lines: list[str]) -> bytes:
    return b.lines_content(lines) + b"\nBT /F1 10 Tf 1 0 0 1 72 2000 Tm (off the page) Tj ET"


def with_actual_text(lines: list[str]) -> bytes:
    return b"/Span <</ActualText (replaced)>> BDC\n" + b.lines_content(lines[:1]) + b"\nEMC\n" + b.lines_content(lines[1:], top=706)


def with_artifact(lines: list[str]) -> bytes:
    return b"/Artifact BMC BT /F1 10 Tf 1 0 0 1 72 770 Tm (running header) Tj ET EMC\n" + b.lines_content(lines)


def form_pdf(text: str) -> bytes:
    """Each page draws a form that holds the lines, moved by a matrix."""
    lines = [s for s in (line.strip(" ") for line in text.split("\n")) if s]
    pages = [lines[i : i + 40] for i in range(0, len(lines), 40)] or [[]]
    forms = 4 + 2 * len(pages)
    objects = b.page_tree(len(pages), 4, "/Font <</F1 3 0 R>> /XObject <<" + " ".join(f"/X{i} {forms + i} 0 R" for i in range(len(pages))) + ">>")
    objects[3] = b.COURIER
    for i, page in enumerate(pages):
        objects[5 + 2 * i] = b.stream("", b"q 1 0 0 1 10 0 cm /X%d Do Q" % i)
        objects[forms + i] = b.stream("/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Matrix [1 0 0 1 -10 0]", b.lines_content(page))
    return b.classic(objects)


def xref_stream_pdf(text: str) -> bytes:
    return b.text_pdf(text, build=b.with_xref_stream)


def _packing(objects: dict[int, bytes], hybrid: bool = False) -> bytes:
    plain = {n: v for n, v in objects.items() if b"stream\n" in v or (hybrid and n == 1)}
    return b.with_xref_stream(plain, {n: v for n, v in objects.items() if n not in plain}, hybrid=hybrid)


def object_stream_pdf(text: str) -> bytes:
    return b.text_pdf(text, build=_packing)


def hybrid_pdf(text: str) -> bytes:
    return b.text_pdf(text, build=lambda o: _packing(o, True))


def broken_pdf(text: str) -> bytes:
    """The cross-reference table is lost."""
    return b.text_pdf(text).replace(b"startxref", b"startxxxx")


def encrypted_pdf(revision: int, aes: bool) -> Callable[[str], bytes]:
    make = lambda text: b.text_pdf(text, build=lambda o: b.encrypted(o, revision=revision, aes=aes))
    make.many = lambda rows: b.encrypted_many([b.text_pdf(row["text"], build=lambda o: o) for row in rows], revision=revision, aes=aes)
    return make


def filtered_pdf(name: str) -> Callable[[str], bytes]:
    encoders = {
        "FlateDecode": zlib.compress,
        "ASCIIHexDecode": lambda d: d.hex().encode() + b">",
        "ASCII85Decode": lambda d: base64.a85encode(d) + b"~>",
        "RunLengthDecode": lambda d: b"".join(bytes([len(d[i : i + 128]) - 1]) + d[i : i + 128] for i in range(0, len(d), 128)) + b"\x80",
        "LZWDecode": lzw_encode,
    }
    if name == "png":
        return lambda text: b.text_pdf(text, wrap=lambda a, d: b.flate(f"{a} /DecodeParms <</Predictor 15 /Columns 16>>", png_up(d)))
    return lambda text: b.text_pdf(text, wrap=lambda a, d: b.stream(f"{a} /Filter /{name}", encoders[name](d)))


def png_up(data: bytes, columns: int = 16) -> bytes:
    data += b" " * (-len(data) % columns)
    out, above = [], bytes(columns)
    for i in range(0, len(data), columns):
        row = data[i : i + columns]
        out.append(b"\x02" + bytes((a - u) & 255 for a, u in zip(row, above)))
        above = row
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Nine- to twelve-bit codes with early change, cleared when the table is full."""
    bits, table, width, now = [format(256, "09b")], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for c in data:
        more = now + bytes([c])
        if more in table:
            now = more
            continue
        bits.append(format(table[now], f"0{width}b"))
        table[more] = size
        size += 1
        if size == 4094:
            bits.append(format(256, f"0{width}b"))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        elif size >= (1 << width) and width < 12:
            width += 1
        now = bytes([c])
    if now:
        bits.append(format(table[now], f"0{width}b"))
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    bits.append(format(257, f"0{width}b"))
    joined = "".join(bits)
    joined += "0" * (-len(joined) % 8)
    return int(joined, 2).to_bytes(len(joined) // 8, "big")


# ---- fonts ------------------------------------------------------------------


def mapped_font_pdf(text: str) -> bytes:
    """Codes shifted by one; a ToUnicode CMap says what they mean."""
    pairs = [(c + 1, c) for c in (*range(0x20, 0x7E), *range(0xA1, 0xFF))] + [(0x20, 0x7E), (0xA0, 0xFF)]
    cmap = "/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <00> <FF> endcodespacerange\n" + "".join(f"{len(part)} beginbfchar\n" + "".join(f"<{a:02X}> <{c:04X}>\n" for a, c in part) + "endbfchar\n" for part in (pairs[i : i + 100] for i in range(0, len(pairs), 100))) + "endcmap end"
    shift = {c: a for a, c in pairs}
    shifted = lambda line: b"<" + bytes(shift.get(ord(ch), 0x40) for ch in line).hex().encode() + b">"

    def build(o):
        n = max(o) + 1
        return b.classic(o | {3: b"<</Type /Font /Subtype /Type1 /BaseFont /Courier /ToUnicode %d 0 R>>" % n, n: b.stream("", cmap.encode())})

    return b.text_pdf(text, content=lambda lines: b"BT /F1 10 Tf\n" + b"\n".join(b"1 0 0 1 72 %d Tm %s Tj" % (720 - 14 * k, shifted(line)) for k, line in enumerate(lines)) + b"\nET", build=build)


def differences_pdf(text: str) -> bytes:
    """Letters a and e are drawn by other codes, named in /Differences."""
    font = b"<</Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding <</BaseEncoding /WinAnsiEncoding /Differences [1 /a /e /uni0041]>>>>"
    codes = str.maketrans({"a": "\x01", "e": "\x02", "A": "\x03"})
    literal = lambda line: b.literal(line.translate(codes))
    return b.text_pdf(text, font=font, content=lambda lines: _placed(lines, lambda line: literal(line) + b" Tj"))


HEBREW = "אבגדהוזחטיכלמנסעפצקרשת"


def hebrew_pdf(name: str) -> bytes:
    """Letters as Hebrew ones, painted in visual order through a ToUnicode CMap."""
    letters = sorted({c for c in name.upper() if c.isalpha()})
    text = [hebrew(c) for c in letters]
    cmap = "1 begincodespacerange <00> <FF> endcodespacerange\n" + f"{len(letters) + 1} beginbfchar\n" + "".join(f"<{i + 1:02X}> <{ord(t):04X}>\n" for i, t in enumerate(text)) + "<20> <0020>\nendbfchar"
    code = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0x20}
    painted = bytes(code[c] for c in reversed(name.upper()) if c in code)
    objects = b.page_tree(1, 4, "/Font <</F1 3 0 R>>")
    objects[3] = b"<</Type /Font /Subtype /Type1 /BaseFont /Courier /ToUnicode 6 0 R>>"
    objects[5] = b.stream("", b"BT /F1 10 Tf 1 0 0 1 72 720 Tm <%s> Tj ET" % painted.hex().encode())
    objects[6] = b.stream("", cmap.encode())
    return b.classic(objects)


def hebrew(c: str) -> str:
    return HEBREW[(ord(c) - 65) % len(HEBREW)]


# ---- tables as pages --------------------------------------------------------


def cells_pdf(left: list[str], right: list[str], gap: float = 300) -> bytes:
    """Rows of two cells."""
    body = b"\n".join(b"1 0 0 1 72 %g Tm %s Tj 1 0 0 1 %g %g Tm %s Tj" % (720 - 14 * k, b.literal(a), gap, 720 - 14 * k, b.literal(c)) for k, (a, c) in enumerate(zip(left, right)))
    objects = b.page_tree(1, 4, "/Font <</F1 3 0 R>>")
    objects[3], objects[5] = b.COURIER, b.stream("", b"BT /F1 10 Tf\n" + body + b"\nET")
    return b.classic(objects)


def raised_pdf(name: str, raised: str) -> bytes:
    """A word with a small raised number at its end."""
    objects = b.page_tree(1, 4, "/Font <</F1 3 0 R>>")
    objects[3] = b.COURIER
    objects[5] = b.stream("", b"BT /F1 10 Tf 1 0 0 1 72 720 Tm %s Tj /F1 6 Tf 4 Ts %s Tj ET" % (b.literal(name), b.literal(raised)))
    return b.classic(objects)


def _string(text: str) -> bytes:
    return b"<FEFF" + text.encode("utf-16-be").hex().upper().encode() + b">"


def info_pdf(title: str, author: str, custom: str) -> bytes:
    objects = b.page_tree(1, 4, "/Font <</F1 3 0 R>>")
    objects |= {3: b.COURIER, 5: b.stream("", b""), 6: b"<</Title %s /Author %s /ShelfMark %s>>" % tuple(map(_string, (title, author, custom)))}
    return b.classic(objects, trailer="/Info 6 0 R")


def outline_pdf(root: str, children: list[str]) -> bytes:
    objects = b.page_tree(1, 4, "", extra="/Outlines 10 0 R")
    objects[5] = b.stream("", b"")
    objects[10] = b"<</First 11 0 R /Last 11 0 R>>"
    objects[11] = b"<</Title %s /Dest [4 0 R /XYZ 10 20 2] %s>>" % (_string(root), b"/First 12 0 R" if children else b"")
    for i, c in enumerate(children):
        objects[12 + i] = b"<</Title %s /Parent 11 0 R %s>>" % (_string(c), b"/Next %d 0 R" % (13 + i) if i + 1 < len(children) else b"")
    return b.classic(objects)


def link_pdf(url: str) -> bytes:
    objects = b.page_tree(1, 4, "")
    objects[4] = b"<</Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [<</Type /Annot /Subtype /Link /Rect [72 600 10 700] /A <</S /URI /URI %s>>>>]>>" % b.literal(url)
    objects[5] = b.stream("", b"")
    return b.classic(objects)


def field_pdf(name: str, value: str) -> bytes:
    """A form with one field below a parent, its value painted by the viewer."""
    objects = b.page_tree(1, 4, "", extra="/AcroForm <</Fields [6 0 R] /NeedAppearances true>>")
    objects[4] = b"<</Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [7 0 R]>>"
    objects[5] = b.stream("", b"")
    objects[6] = b"<</T (ledger) /Kids [7 0 R]>>"
    objects[7] = b"<</Type /Annot /Subtype /Widget /FT /Tx /T %s /V %s /Parent 6 0 R /P 4 0 R /Rect [100 100 400 120] /DA (/Helv 10 Tf)>>" % (b.literal(name), _string(value))
    return b.classic(objects)


def image_pdf(pixels: list[int]) -> bytes:
    """An 8 by 8 grey image painted at 80 by 160 points, lower left corner (100, 200)."""
    objects = b.page_tree(1, 4, "/XObject <</I 6 0 R>>")
    objects[5] = b.stream("", b"q 80 0 0 160 100 200 cm /I Do Q")
    objects[6] = b.flate("/Type /XObject /Subtype /Image /Width 8 /Height 8 /BitsPerComponent 8 /ColorSpace /DeviceGray", bytes(pixels))
    return b.classic(objects)
