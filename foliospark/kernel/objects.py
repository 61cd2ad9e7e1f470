"""PDF values as Python values, and the tokenizer that reads them.

null, booleans, integers, reals, strings, names, arrays and dictionaries are
None, bool, int, float, bytes, :class:`Name`, list and dict; an indirect
reference is a :class:`Ref` and a stream a :class:`Stream`.  Reading never
fails: what makes no sense is skipped or read as None.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_DEPTH = 64
SPACES = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"

_TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*(?:(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<paren>\()|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[|\{)|(?P<close>>>|\]|\})|<(?P<hex>[^>]*)(?:>|$)|(?P<stray>[)>]))"
)
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?$")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.)|$)", re.DOTALL)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")


class Name(str):
    """A name, distinct from a string of the same letters."""

    __slots__ = ()


class Keyword(str):
    """A bare word: an operator or ``obj``, ``R``, ``stream`` …"""

    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


class Stream:
    """A stream's dictionary and its raw body, with the object it belongs to."""

    __slots__ = ("attributes", "raw", "owner")

    def __init__(self, attributes: dict, raw: bytes, owner: Ref | None = None):
        self.attributes, self.raw, self.owner = attributes, raw, owner


END = Keyword("")


def number(word: bytes) -> int | float | None:
    """A number as files really write them: extra signs, and a minus inside ends it."""
    if not _NUMBER.match(word):
        return None
    negative = word[:1] == b"-" and word[:2] != b"--" or word[:2] == b"+-"
    digits = word.lstrip(b"+-").split(b"-")[0]
    value = float(digits) if b"." in digits else int(digits)
    return -value if negative else value


def unescape(body: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1] is not None:
            return bytes([int(m[1], 8) & 0xFF])
        if m[2] is not None or m[3] is None:
            return b""
        return _PLAIN.get(m[3], m[3])

    body = body.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if b"\r" in body and b"\\" not in body else body
    return _ESCAPE.sub(one, body) if b"\\" in body else body


def unhex(body: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def name_of(raw: bytes) -> Name:
    if b"#" in raw:
        raw = _HASH.sub(lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("latin-1"))


class Scanner:
    """Values one after another from a buffer."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references = data, at, references

    def _parenthesised(self) -> bytes:
        data, at, depth = self.data, self.at, 1
        while depth:
            m = _PAREN.search(data, at)
            if m is None:
                at = len(data) + 1
                break
            at = m.end()
            c = m[0][:1]
            depth += (c == b"(") - (c == b")")
        body = data[self.at : at - 1]
        self.at = min(at, len(data))
        return unescape(body)

    def token(self):
        """The next value without structure: openers, closers and words come as Keyword."""
        m = _TOKEN.match(self.data, self.at)
        if m is None:  # nothing but space is left
            self.at = len(self.data)
            return END
        self.at = m.end()
        kind = m.lastgroup
        if kind == "word":
            word = m["word"]
            if word.isdigit():
                return int(word)
            value = number(word)
            return Keyword(word.decode("latin-1")) if value is None else value
        if kind == "paren":
            return self._parenthesised()
        if kind == "name":
            return name_of(m["name"])
        if kind == "hex":
            return unhex(m["hex"])
        return Keyword(m[kind].decode())

    def value(self, depth: int = 0):
        """The next object; END at the end of data, a Keyword where no object stands."""
        token = self.token()
        if not isinstance(token, Keyword):
            if self.references and type(token) is int and token >= 0:
                return self._reference(token)
            return token
        if token in ("<<", "[", "{"):
            return self._collect(token, depth)
        return {"true": True, "false": False, "null": None}.get(token, token)

    def _reference(self, first: int):
        mark = self.at
        m = _REFERENCE.match(self.data, mark)
        if m is None:
            return first
        self.at = m.end()
        return Ref(first, int(m[1]))

    def _collect(self, opener: str, depth: int):
        closer = {"<<": ">>", "[": "]", "{": "}"}[opener]
        items: list = []
        while True:
            if depth >= MAX_DEPTH:
                token = self.token()
                item = token if isinstance(token, Keyword) else None
            else:
                item = self.value(depth + 1)
            if isinstance(item, Keyword):
                if item == closer or item == END:
                    break
                if item in (">>", "]", "}", "endobj", "stream"):
                    if item in ("endobj", "stream"):
                        self.at -= len(item)
                        break
                    continue
                if opener != "{":
                    continue
            items.append(item)
        if opener == "[":
            return items
        if opener == "{":
            return Keyword("{}")
        out: dict = {}
        key = None
        for item in items:
            if key is None:
                key = item if isinstance(item, Name) else None
            else:
                out[str(key)] = item
                key = None
        return out


_PAREN = re.compile(rb"\\.|[()]", re.DOTALL)
_REFERENCE = re.compile(rb"[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
