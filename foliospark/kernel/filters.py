"""Stream filters.  Each keeps what it decoded before an error, up to a limit."""

from __future__ import annotations

import re
import zlib
from itertools import accumulate, count

import numpy as np

from foliospark.kernel.objects import Name, unhex

MAX_FILTERS = 8
STREAM_LIMIT = 64 << 20
ROW_LIMIT = 1 << 20

# Full and abbreviated filter names.
FULL = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
IMAGE_CODECS = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode")


class Problem(Exception):
    """A filter that cannot go on; ``kept`` is what came out before."""

    def __init__(self, reason: str, kept: bytes = b""):
        super().__init__(reason)
        self.kept = kept


def flate(data: bytes, limit: int = STREAM_LIMIT) -> bytes:
    """zlib data, or raw deflate where the header is none; the checksum is not looked at."""
    header = len(data) >= 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0
    out, problem = _inflate(data[2:] if header else data, limit)
    if problem and header and not out:
        out, problem = _inflate(data, limit)
    if problem:
        raise Problem(f"flate: {problem}", out)
    return out


def _inflate(data: bytes, limit: int) -> tuple[bytes, str]:
    """(what could be read, why no more)."""
    engine, out, size = zlib.decompressobj(-15), [], 0
    for at in range(0, len(data), 65536):
        step = data[at : at + 65536]
        saved, kept = engine.copy(), len(out)
        try:
            while step and size < limit:
                piece = engine.decompress(step, limit - size)
                out.append(piece)
                size += len(piece)
                step = engine.unconsumed_tail
        except zlib.error as e:
            # Again in single bytes from before this step, for what its damaged block still gives.
            exact = bytearray()
            try:
                for i in range(at, min(at + 65536, len(data))):
                    exact += saved.decompress(data[i : i + 1])
            except zlib.error:
                pass
            return (b"".join(out[:kept]) + bytes(exact))[:limit], str(e)
        if engine.eof or size >= limit:
            break
    return b"".join(out), ""


def lzw(data: bytes, early: int = 1, limit: int = STREAM_LIMIT) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends."""
    total, used = len(data) * 8, 0
    table: list[bytes] = []
    width, last, out = 9, None, []
    size = 0
    first = [bytes([i]) for i in range(256)]
    # A window of the data as one number: shifting all of it for every code would be quadratic.
    window, window_bits, base = 0, 0, 0
    while used + width <= total and size < limit:
        if used + width > base + window_bits:
            start, end = used // 8, min(len(data), used // 8 + 512)
            window, window_bits, base = int.from_bytes(data[start:end], "big"), (end - start) * 8, start * 8
        code = window >> (window_bits - (used - base) - width) & ((1 << width) - 1)
        used += width
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, None
            continue
        if code < 256:
            entry = first[code]
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif code - 258 == len(table) and last is not None:
            entry = last + last[:1]
        else:
            raise Problem("lzw: code out of range", b"".join(out))
        out.append(entry)
        size += len(entry)
        if last is not None and len(table) < 4096 - 258:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (258 + len(table) + early).bit_length()))
    return b"".join(out)[:limit]


def ascii_hex(data: bytes, limit: int = STREAM_LIMIT) -> bytes:
    body = data.split(b">", 1)[0]
    bad = re.search(rb"[^0-9A-Fa-f\x00\t\n\x0c\r ]", body)
    if bad:
        raise Problem("hex: not a digit", unhex(body[: bad.start()])[:limit])
    return unhex(body)[:limit]


def ascii85(data: bytes, limit: int = STREAM_LIMIT) -> bytes:
    body = data.lstrip(b"\x00\t\n\x0c\r ")
    if body.startswith(b"<~"):
        body = body[2:]
    body = re.sub(rb"[\x00\t\n\x0c\r ]", b"", body.split(b"~", 1)[0])
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 33)
            if len(group) == 5:
                value = 0
                for d in group:
                    value = value * 85 + d
                out += (value & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise Problem("ascii85: not a digit", bytes(out))
    if len(group) > 1:
        value = 0
        for d in group + [84] * (5 - len(group)):
            value = value * 85 + d
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out[:limit])


def run_length(data: bytes, limit: int = STREAM_LIMIT) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        n = data[at]
        if n == 128:
            break
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out[:limit])


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undo TIFF (2, eight bits only) and PNG (10–15) prediction."""
    kind = int(parms.get("Predictor") or 1)
    if kind < 2:
        return data
    colors, bits, columns = (max(1, int(parms.get(k) or d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    row = (colors * bits * columns + 7) // 8
    step = max(1, colors * bits // 8)
    if row > ROW_LIMIT:
        raise Problem("predictor: row too long")
    if kind == 2:
        if bits != 8:
            raise Problem("predictor: only eight bits")
        whole = len(data) // row * row
        block = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(block, axis=1, dtype=np.uint64).astype(np.uint8).tobytes() + data[whole:]
    out, above, at = [], bytes(row), 0
    while at < len(data):
        kind, line = data[at], data[at + 1 : at + 1 + row]
        if not line:
            break
        short = row - len(line)
        above = _png_row(kind, line + bytes(short), above, step)
        out.append(above[: row - short] if short else above)
        at += row + 1
    return b"".join(out)


def _png_row(kind: int, line: bytes, above: bytes, step: int) -> bytes:
    if kind == 0:
        return line
    if kind == 2:
        return _added(line, above)
    if kind == 1:
        if len(line) < _LONG_ROW and step == 1:
            return bytes([v & 255 for v in accumulate(line)])
        pad = -len(line) % step
        grid = np.frombuffer(line + bytes(pad), np.uint8).reshape(-1, step)
        return np.cumsum(grid, axis=0, dtype=np.uint64).astype(np.uint8).tobytes()[: len(line)]
    if kind not in (3, 4):
        raise Problem("predictor: unknown row filter")
    # Values to the left start with zeros, so that no place is special.
    out, before = bytearray(step), bytes(step) + above
    add = out.append
    if kind == 3:
        for i, v in enumerate(line):
            add((v + (out[i] + above[i] >> 1)) & 255)
    else:
        for v, a_at, b, c in zip(line, count(), above, before):
            a = out[a_at]
            pa, pb = b - c, a - c
            pc = pa + pb
            if pa < 0:
                pa = -pa
            if pb < 0:
                pb = -pb
            if pc < 0:
                pc = -pc
            add((v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255)
    return bytes(out[step:])


#: Rows shorter than this many bytes are worked on without arrays.
_LONG_ROW = 96


def _added(line: bytes, above: bytes) -> bytes:
    """Sums of bytes, each modulo 256: as two numbers without their highest bits, which are put back."""
    n = len(line)
    if n >= _LONG_ROW:
        return (np.frombuffer(line, np.uint8) + np.frombuffer(above, np.uint8)).tobytes()
    low = _LOW[n]
    a, b = int.from_bytes(line, "big"), int.from_bytes(above, "big")
    return ((a & low) + (b & low) ^ (a ^ b) & ~low & _FULL_ROW[n]).to_bytes(n, "big")


_LOW = [int.from_bytes(b"\x7f" * n, "big") for n in range(_LONG_ROW)]
_FULL_ROW = [(1 << 8 * n) - 1 for n in range(_LONG_ROW)]


def chain(names: list, parms: list) -> list[tuple[str, dict]]:
    """Filter names in full with their parameters."""
    out = []
    for i, n in enumerate(names):
        p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
        out.append((FULL.get(str(n), str(n)) if isinstance(n, Name) else "", p))
    return out


def decode(data: bytes, steps: list[tuple[str, dict]], limit: int = STREAM_LIMIT) -> tuple[bytes, str | None, dict]:
    """(bytes, image codec that was left, its parameters); raises Problem with what was kept."""
    if len(steps) > MAX_FILTERS:
        raise Problem("too many filters")
    for i, (name, parms) in enumerate(steps):
        if name in IMAGE_CODECS:
            if i + 1 < len(steps):
                raise Problem("image codec is not the last filter")
            return data, name, parms
        data = _apply(name, data, parms, limit)
    return data, None, {}


def _apply(name: str, data: bytes, parms: dict, limit: int) -> bytes:
    if name == "FlateDecode":
        return _predicted(flate, data, parms, limit)
    if name == "LZWDecode":
        early = parms.get("EarlyChange")
        return _predicted(lambda d, n: lzw(d, 1 if early is None else int(early), n), data, parms, limit)
    if name == "ASCIIHexDecode":
        return ascii_hex(data, limit)
    if name == "ASCII85Decode":
        return ascii85(data, limit)
    if name == "RunLengthDecode":
        return run_length(data, limit)
    if name == "Crypt":
        return data
    raise Problem(f"unknown filter {name}")


def _predicted(decoder, data: bytes, parms: dict, limit: int) -> bytes:
    try:
        return unpredict(decoder(data, limit), parms)
    except Problem as e:
        if e.kept:
            e.kept = unpredict(e.kept, parms)
        raise
