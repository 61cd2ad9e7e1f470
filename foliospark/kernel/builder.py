"""Small PDF files written from parts, for tests and example data."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

from foliospark.kernel import ciphers


def stream(attributes: str, body: bytes) -> bytes:
    return b"<<%s /Length %d>>\nstream\n%s\nendstream" % (attributes.encode(), len(body), body)


def flate(attributes: str, body: bytes) -> bytes:
    return stream(f"{attributes} /Filter /FlateDecode", zlib.compress(body))


def literal(text: str) -> bytes:
    """A WinAnsi literal string."""
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def classic(objects: dict[int, bytes], root: int = 1, trailer: str = "") -> bytes:
    """Objects with a cross-reference table."""
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for number in range(1, size):
        out += b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 00000 f \n"
    return bytes(out) + b"trailer\n<</Size %d /Root %d 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (size, root, trailer.encode(), start)


def with_xref_stream(objects: dict[int, bytes], packed: dict[int, bytes] | None = None, root: int = 1, hybrid: bool = False) -> bytes:
    """Objects with a cross-reference stream; ``packed`` ones go into one object stream."""
    packed = packed or {}
    size = max([*objects, *packed]) + 1
    holder, table = size, size + 1
    entries: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    out = bytearray(b"%PDF-1.7\n")
    if packed:
        heads, bodies = [], b""
        for number, body in packed.items():
            heads.append(f"{number} {len(bodies)}")
            bodies += body + b" "
        head = (" ".join(heads) + " ").encode()
        objects = objects | {holder: flate(f"/Type /ObjStm /N {len(packed)} /First {len(head)}", head + bodies)}
        entries |= {n: (2, holder, i) for i, n in enumerate(packed)}
    for number, body in objects.items():
        entries[number] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    if not hybrid:
        entries[table] = (1, at, 0)
    rows = b"".join(k.to_bytes(1, "big") + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in (entries.get(n, (0, 0, 0)) for n in range(table + 1)))
    out += b"%d 0 obj\n%s\nendobj\n" % (table, flate(f"/Type /XRef /Size {table + 1} /W [1 4 2] /Root {root} 0 R", rows))
    if hybrid:
        start = len(out)
        out += b"xref\n0 %d\n" % size
        for n in range(size):
            kind, a, _ = entries.get(n, (0, 0, 0))
            out += b"%010d 00000 n \n" % a if kind == 1 else b"0000000000 65535 f \n"
        out += b"trailer\n<</Size %d /Root %d 0 R /XRefStm %d>>\n" % (size, root, at)
        at = start
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at


def page_tree(pages: int, first: int, resources: str, box: str = "0 0 612 792", extra: str = "") -> dict[int, bytes]:
    """Catalog 1, tree 2, pages from ``first`` in steps of two: page, then its content."""
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(pages))
    out = {1: f"<</Type /Catalog /Pages 2 0 R {extra}>>".encode(), 2: f"<</Type /Pages /Kids [{kids}] /Count {pages} /MediaBox [{box}] /Resources <<{resources}>>>>".encode()}
    for i in range(pages):
        out[first + 2 * i] = f"<</Type /Page /Parent 2 0 R /Contents {first + 2 * i + 1} 0 R>>".encode()
    return out


COURIER = b"<</Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding>>"


def lines_content(lines: list[str], x: float = 72, top: float = 720, pitch: float = 14, size: float = 10) -> bytes:
    out = [b"BT /F1 %g Tf" % size]
    for k, line in enumerate(lines):
        out.append(b"1 0 0 1 %g %g Tm %s Tj" % (x, top - pitch * k, literal(line)))
    return b"\n".join(out) + b"\nET"


def text_pdf(text: str, per_page: int = 40, content=lines_content, wrap=stream, build=classic, font: bytes = COURIER, extra: str = "") -> bytes:
    """A text as a file: its non-blank lines in Courier, ``per_page`` to a page."""
    lines = [s for s in (line.strip(" ") for line in text.split("\n")) if s]
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    objects = page_tree(len(pages), 4, "/Font <</F1 3 0 R>>", extra=extra)
    objects[3] = font
    for i, page in enumerate(pages):
        objects[5 + 2 * i] = wrap("", content(page))
    return build(objects)


# Fixed value: what fills up a password in the standard security handler.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _file_key(user: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, size: int) -> bytes:
    """The key of a file by the standard's own steps, apart from the reader's, which it is to prove."""
    digest = hashlib.md5()
    for part in ((user + PADDING)[:32], owner, (permissions & 0xFFFFFFFF).to_bytes(4, "little"), file_id):
        digest.update(part)
    key = digest.digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
    return key[:size]


@lru_cache(64)
def _entry(user: bytes, owner: bytes, revision: int, size: int, file_id: bytes, permissions: int) -> tuple[bytes, bytes, bytes]:
    """The file's key, and the owner and user strings."""
    key = hashlib.md5((owner + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    o = (user + PADDING)[:32]
    for i in range(20 if revision >= 3 else 1):
        o = ciphers.rc4(bytes(b ^ i for b in key[:size]), o)
    key = _file_key(user, o, permissions, file_id, revision, size)
    if revision == 2:
        u = ciphers.rc4(key, PADDING)
    else:
        u = ciphers.rc4(key, hashlib.md5(PADDING + file_id).digest())
        for i in range(1, 20):
            u = ciphers.rc4(bytes(b ^ i for b in key), u)
        u += bytes(16)
    return key, o, u


def encrypted(objects: dict[int, bytes], user: bytes = b"", owner: bytes = b"owner", revision: int = 3, aes: bool = False) -> bytes:
    """Streams encrypted by the standard handler, revisions 2 to 4."""
    return encrypted_many([objects], user, owner, revision, aes)[0]


def encrypted_many(files: list[dict[int, bytes]], user: bytes = b"", owner: bytes = b"owner", revision: int = 3, aes: bool = False) -> list[bytes]:
    """Several files; AES works on the streams of all of them side by side."""
    size, file_id, permissions = (5 if revision == 2 else 16), b"folio-file-id-16", -4
    key, o, u = _entry(user, owner, revision, size, file_id, permissions)
    places, heads, keys, bodies = [], [], [], []
    for k, objects in enumerate(files):
        for number, body in objects.items():
            head, mark, rest = body.partition(b"stream\n")
            if mark and rest.endswith(b"\nendstream"):
                seed = key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")
                places.append((k, number))
                heads.append(head.strip()[2:-2].rpartition(b"/Length")[0].decode("latin-1"))
                keys.append(hashlib.md5(seed).digest()[: min(16, len(key) + 5)])
                bodies.append(rest[: -len(b"\nendstream")])
    if aes:
        padded = [d + bytes([16 - len(d) % 16]) * (16 - len(d) % 16) for d in bodies]
        bodies = [b"\x07" * 16 + d for d in ciphers.cbc_encrypt_many(keys, [b"\x07" * 16] * len(keys), padded)]
    else:
        bodies = [ciphers.rc4(own, d) for own, d in zip(keys, bodies)]
    outs = [dict(objects) for objects in files]
    for (k, number), head, data in zip(places, heads, bodies):
        outs[k][number] = stream(head, data)
    filters = "/CF <</StdCF <</CFM /AESV2 /Length 16>>>> /StmF /StdCF /StrF /StdCF" if aes else ""
    version = 4 if aes else 1 if revision == 2 else 2
    entry = f"<</Filter /Standard /V {version} /R {4 if aes else revision} /Length {size * 8} /P {permissions} /O <{o.hex()}> /U <{u.hex()}> {filters}>>".encode()
    made = []
    for out in outs:
        number = max(out) + 1
        out[number] = entry
        made.append(classic(out, trailer=f"/Encrypt {number} 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]"))
    return made
