"""The adaptive binary arithmetic decoder of the bilevel codec."""

from __future__ import annotations

# Probability states as (estimate, next if likely, next if unlikely, switch).
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)


class Contexts:
    """States and likely bits of a set of contexts."""

    __slots__ = ("state", "likely")

    def __init__(self, n: int):
        self.state, self.likely = bytearray(n), bytearray(n)


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.code = self._byte(0) << 16
        self.waiting = 0
        self._more()
        self.code <<= 7
        self.waiting -= 7
        self.range = 0x8000

    def _byte(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _more(self) -> None:
        if self._byte(self.at) == 0xFF:
            if self._byte(self.at + 1) > 0x8F:
                self.code += 0xFF00
                self.waiting = 8
            else:
                self.at += 1
                self.code += self._byte(self.at) << 9
                self.waiting = 7
        else:
            self.at += 1
            self.code += self._byte(self.at) << 8
            self.waiting = 8

    def bit(self, contexts: Contexts, i: int) -> int:
        estimate, good, bad, switch = STATES[contexts.state[i]]
        likely = contexts.likely[i]
        self.range -= estimate
        if self.code >> 16 < estimate:
            # The lower part, which is the unlikely one unless the intervals have changed places.
            as_expected = self.range < estimate
            self.range = estimate
        else:
            self.code -= estimate << 16
            if self.range & 0x8000:
                return likely
            as_expected = self.range >= estimate
        if as_expected:
            out = likely
            contexts.state[i] = good
        else:
            out = likely ^ 1
            if switch:
                contexts.likely[i] = out
            contexts.state[i] = bad
        while True:
            if self.waiting == 0:
                self._more()
            self.range <<= 1
            self.code = self.code << 1 & 0xFFFFFFFF
            self.waiting -= 1
            if self.range & 0x8000:
                return out


class Integers:
    """Signed integers and symbol numbers over a decoder, one context set for each use."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.sets = decoder, {}

    # Prefix lengths as (bits that follow, offset).
    RANGES = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))

    def integer(self, use: str) -> int | None:
        """The next integer of a use; None is out of band."""
        contexts = self.sets.setdefault(use, Contexts(512))
        before = 1

        def bit() -> int:
            nonlocal before
            b = self.decoder.bit(contexts, before)
            before = before << 1 | b if before < 256 else ((before << 1 | b) & 511) | 256
            return b

        negative = bit()
        kind = 0
        while kind < 5 and bit():
            kind += 1
        n, offset = self.RANGES[kind]
        value = 0
        for _ in range(n):
            value = value << 1 | bit()
        value += offset
        return (None if value == 0 else -value) if negative else value

    def symbol(self, length: int) -> int:
        contexts = self.sets.setdefault(f"symbol{length}", Contexts(1 << (length + 1)))
        before = 1
        for _ in range(length):
            before = before << 1 | self.decoder.bit(contexts, before)
        return before - (1 << length)
