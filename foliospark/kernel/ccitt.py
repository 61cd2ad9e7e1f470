"""CCITT fax data, groups 3 (one- and two-dimensional) and 4, to packed rows (0 black unless BlackIs1)."""

from __future__ import annotations

import numpy as np

# Run-length code words, terminating codes 0 to 63 then make-up codes in steps of 64.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
)
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
EXTENDED = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
MODES = {"0001": "pass", "001": "across", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


def _words(text: str) -> dict[str, int]:
    words = text.split()
    out = {w: i if i < 64 else (i - 63) * 64 for i, w in enumerate(words)}
    return out | {w: 1792 + 64 * i for i, w in enumerate(EXTENDED.split())}


RUNS = (_words(WHITE), _words(BLACK))


class Ended(Exception):
    pass


class _Bits:
    def __init__(self, data: bytes):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def word(self, table: dict, longest: int = 13):
        for n in range(1, longest + 1):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        raise Ended

    def end_of_line(self) -> bool:
        """Skip fill bits and an end-of-line code, if one comes here."""
        one = self.bits.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        return False


def _run(bits: _Bits, colour: int) -> int:
    total = 0
    while True:
        n = bits.word(RUNS[colour])
        total += n
        if n < 64:
            return total


def _row_1d(bits: _Bits, width: int) -> list[int]:
    """Positions where the colour changes, white first."""
    at, colour, out = 0, 0, []
    while at < width:
        at = min(at + _run(bits, colour), width)
        out.append(at)
        colour ^= 1
    return out


def _row_2d(bits: _Bits, above: list[int], width: int) -> list[int]:
    a0, colour, out = -1, 0, []
    while a0 < width:
        b1 = next((p for k, p in enumerate(above) if p > a0 and k % 2 == colour), width) if a0 >= 0 or colour else next((p for k, p in enumerate(above) if k % 2 == 0 and p >= 0 and (p > a0)), width)
        later = [p for p in above if p > b1]
        b2 = later[0] if later else width
        mode = bits.word(MODES, 7)
        if mode == "pass":
            a0 = b2
        elif mode == "across":
            start = max(a0, 0)
            first = min(start + _run(bits, colour), width)
            second = min(first + _run(bits, colour ^ 1), width)
            out += [first, second]
            a0 = second
        else:
            a0 = min(max(b1 + mode, 0), width)
            out.append(a0)
            colour ^= 1
        if a0 >= width:
            break
    return out


def decode(data: bytes, parms: dict, width: int, height: int) -> bytes:
    """Packed rows; rows that are missing or damaged end the image."""
    k = int(parms.get("K") or 0)
    columns = int(parms.get("Columns") or 1728) if "Columns" in parms or not width else width
    rows = int(parms.get("Rows") or 0) or height
    align, black_is_1 = parms.get("EncodedByteAlign") is True, parms.get("BlackIs1") is True
    bits, out, above = _Bits(data), [], [columns]
    while len(out) < rows:
        try:
            if align and bits.at % 8:
                skipped = bits.bits[bits.at : (bits.at + 7) // 8 * 8]
                if "1" in skipped:
                    align = False
                else:
                    bits.at += len(skipped)
            marks = 0
            while bits.end_of_line():
                marks += 1
                if k > 0 and marks < 2:
                    tag = bits.bits[bits.at : bits.at + 1]
                if marks >= 2:
                    raise Ended
                if k > 0:
                    break
            two = k < 0
            if k > 0:
                two = bits.bits[bits.at : bits.at + 1] == "0"
                bits.at += 1
            if bits.at >= len(bits.bits):
                raise Ended
            changes = _row_2d(bits, above, columns) if two else _row_1d(bits, columns)
        except Ended:
            break
        line = np.zeros(columns, np.uint8)
        edges = [*changes, columns]
        for i in range(0, len(edges) - 1, 2):
            line[edges[i] : edges[i + 1]] = 1
        out.append(line)
        above = changes
    if not out:
        return b""
    page = np.array(out)
    return np.packbits(page if black_is_1 else 1 - page, axis=1).tobytes()
