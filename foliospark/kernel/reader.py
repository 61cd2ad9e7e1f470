"""Objects of one file: cross-reference tables and streams, repair, object streams, page list."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from foliospark.kernel import ciphers, filters
from foliospark.kernel.objects import Keyword, Name, Ref, Scanner, Stream

MAX_SECTIONS = 64
MAX_HOPS = 32
MAX_PAGES = 50_000
MAX_DEPTH_TREE = 64
MAX_PACKED = 100_000

_HEADER = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_EOL = re.compile(rb"\r\n|\n|\r")


class Unreadable(Exception):
    pass


@dataclass
class File:
    data: bytes
    passwords: tuple[bytes, ...] = (b"",)
    shift: int = 0
    #: object number -> offset, or (stream number, index) for packed objects
    entries: dict[int, int | tuple[int, int] | None] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    rebuilt: bool = False
    security: ciphers.Security | None = None
    _cache: dict[int, object] = field(default_factory=dict)
    _packed: dict[int, dict[int, tuple[int, object]]] = field(default_factory=dict)
    _open: set[int] = field(default_factory=set)

    def __post_init__(self):
        at = self.data[:1024].find(b"%PDF-")
        self.shift = max(at, 0)
        try:
            self._read_sections()
            if "Root" not in self.trailer or not isinstance(self.get(self.trailer.get("Root")), dict):
                raise Unreadable("no catalog")
            self._unlock()
        except (Unreadable, ValueError, IndexError, OverflowError):
            self.repair()

    # ---- cross references ----

    def _read_sections(self) -> None:
        tail = self.data[-2048:]
        at = tail.rfind(b"startxref")
        if at < 0:
            raise Unreadable("no startxref")
        m = re.match(rb"startxref[\x00\t\n\x0c\r ]*(\d+)", tail[at:])
        if m is None:
            raise Unreadable("no startxref")
        todo, seen = [int(m[1])], set()
        while todo and len(seen) < MAX_SECTIONS:
            offset = todo.pop(0)
            if offset in seen:
                continue
            seen.add(offset)
            section = self._section(offset + self.shift)
            for key, value in section.items():
                self.trailer.setdefault(key, value)
            # The hybrid stream of a section comes before older sections.
            todo[:0] = [int(section[k]) for k in ("XRefStm", "Prev") if isinstance(section.get(k), (int, float)) and section[k] >= 0]

    def _section(self, at: int) -> dict:
        m = re.compile(rb"[\x00\t\n\x0c\r ]*xref").match(self.data, at)
        return self._table(m.end()) if m else self._stream_section(at)

    def _table(self, at: int) -> dict:
        scan, free = Scanner(self.data, at, references=False), []
        while True:
            first = scan.token()
            if first == "trailer":
                break
            count = scan.token()
            if type(first) is not int or type(count) is not int or count < 0:
                raise Unreadable("bad cross-reference table")
            for i in range(count):
                offset, generation, kind = scan.token(), scan.token(), scan.token()
                if kind not in ("n", "f"):
                    raise Unreadable("bad cross-reference entry")
                if i == 0 and first == 1 and kind == "f" and generation == 65535:
                    first = 0  # a table that starts one too high
                if kind == "n" and offset:
                    self.entries.setdefault(first + i, offset + self.shift)
                else:
                    free.append(first + i)
        trailer = Scanner(self.data, scan.at).value()
        if not isinstance(trailer, dict):
            raise Unreadable("no trailer")
        hidden = trailer.get("XRefStm")
        if type(hidden) is int and hidden >= 0:
            # Objects hidden in a hybrid file's stream are marked free in its table.
            self._stream_section(hidden + self.shift)
        for number in free:
            self.entries.setdefault(number, None)
        return trailer

    def _stream_section(self, at: int) -> dict:
        _, value = self._at(at)
        if not isinstance(value, Stream):
            raise Unreadable("no cross-reference stream")
        info = value.attributes
        widths = [int(w) for w in self.get(info.get("W")) or [] if isinstance(w, int)]
        if len(widths) != 3 or min(widths) < 0 or sum(widths) == 0 or sum(widths) > 64:
            raise Unreadable("bad field widths")
        body = self.body(value, crypt=False)
        index = [int(i) for i in self.get(info.get("Index")) or [0, int(self.get(info.get("Size")) or 0)] if isinstance(i, int)]
        step, at = sum(widths), 0
        for first, count in zip(index[::2], index[1::2]):
            for n in range(first, first + count):
                row = body[at : at + step]
                at += step
                if len(row) < step:
                    break
                kind = int.from_bytes(row[: widths[0]], "big") if widths[0] else 1
                a = int.from_bytes(row[widths[0] : widths[0] + widths[1]], "big")
                b = int.from_bytes(row[widths[0] + widths[1] :], "big")
                entry = {1: a + self.shift, 2: (a, b)}.get(kind)
                self.entries.setdefault(n, entry)
        return info

    def repair(self) -> None:
        """Find objects by their headers; the last of a number wins, packed ones only fill gaps."""
        self.rebuilt = True
        self._cache.clear()
        self._packed.clear()
        self.security = None
        found: dict[int, int] = {}
        for m in _HEADER.finditer(self.data):
            found[int(m[1])] = m.start()
        bound = min(4 << 20, max(4096, 64 * len(found)))
        self.entries = {n: at for n, at in found.items() if n <= bound}
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            value = Scanner(self.data, m.end()).value()
            if isinstance(value, dict) and "Root" in value:
                self.trailer = value
        streams = []
        for n, at in list(self.entries.items()):
            try:
                _, value = self._at(at)
            except (Unreadable, ValueError):
                continue
            info = value.attributes if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            if isinstance(value, Stream) and info.get("Type") == "XRef" and "Root" in info and "Root" not in self.trailer:
                self.trailer = info
            if isinstance(value, Stream) and info.get("Type") == "ObjStm":
                streams.append(n)
            if info.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n, 0))
        self._unlock()
        for n in streams:
            for index, packed in enumerate(self._load_packed(n)):
                if packed not in found:
                    self.entries[packed] = (n, index)
                    value = self.get(Ref(packed, 0))
                    if isinstance(value, dict) and value.get("Type") == "Catalog":
                        self.trailer.setdefault("Root", Ref(packed, 0))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise Unreadable("no catalog")

    def _unlock(self) -> None:
        entry = self.trailer.get("Encrypt")
        if entry is None or self.security is not None:
            return
        secret = self.get(entry)
        if not isinstance(secret, dict):
            return
        resolved = {k: self.get(v) for k, v in secret.items()}
        if isinstance(resolved.get("CF"), dict):
            resolved["CF"] = {k: {a: self.get(b) for a, b in (self.get(v) or {}).items()} for k, v in resolved["CF"].items()}
        ids = self.get(self.trailer.get("ID"))
        first = self.get(ids[0]) if isinstance(ids, list) and ids else b""
        self.security = ciphers.Security(resolved, first if isinstance(first, bytes) else b"", self.passwords)
        keep = {entry.number} if isinstance(entry, Ref) else set()
        self._cache = {n: v for n, v in self._cache.items() if n in keep}
        self._packed.clear()

    # ---- objects ----

    def _at(self, at: int) -> tuple[Ref, object]:
        """The indirect object at an offset, strings still as stored."""
        m = re.compile(rb"[\x00\t\n\x0c\r ]*").match(self.data, at)
        head = _HEADER.match(self.data, m.end())
        if head is None:
            raise Unreadable("no object here")
        owner = Ref(int(head[1]), int(head[2]))
        scan = Scanner(self.data, head.end())
        value = scan.value()
        if isinstance(value, Keyword):
            return owner, None
        if isinstance(value, dict):
            m = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])*stream").match(self.data, scan.at)
            if m:
                start = m.end()
                if self.data[start : start + 2] == b"\r\n":
                    start += 2
                elif self.data[start : start + 1] in (b"\n", b"\r"):
                    start += 1
                return owner, Stream(value, self.data[start : self._stream_end(value, start)], owner)
        return owner, value

    def _stream_end(self, info: dict, start: int) -> int:
        length = info.get("Length")
        if isinstance(length, Ref):
            length = self.get(length) if length.number not in self._open else None
        if type(length) is int and length > 0 and re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, start + length):
            return start + length
        end = self.data.find(b"endstream", start, start + filters.STREAM_LIMIT)
        if end < 0:
            return min(len(self.data), start + filters.STREAM_LIMIT)
        if self.data[end - 2 : end] == b"\r\n":
            return max(start, end - 2)
        return max(start, end - 1) if self.data[end - 1 : end] in (b"\n", b"\r") else end

    def _decrypted(self, value, owner: Ref):
        if isinstance(value, bytes):
            return self.security.string(value, *owner)
        if isinstance(value, list):
            return [self._decrypted(v, owner) for v in value]
        if isinstance(value, dict):
            return {k: self._decrypted(v, owner) for k, v in value.items()}
        if isinstance(value, Stream):
            return Stream(self._decrypted(value.attributes, owner), value.raw, owner)
        return value

    def _load_packed(self, n: int) -> dict[int, tuple[int, object]]:
        """Objects of an object stream: number -> (index, value)."""
        if n in self._packed:
            return self._packed[n]
        self._packed[n] = {}
        stream = self.get(Ref(n, 0))
        if not isinstance(stream, Stream):
            return {}
        try:
            body = self.body(stream)
        except filters.Problem as e:
            body = e.kept
        count, first = (int(self.get(stream.attributes.get(k)) or 0) for k in ("N", "First"))
        scan, heads = Scanner(body, 0, references=False), []
        for _ in range(min(count, MAX_PACKED)):
            number, offset = scan.token(), scan.token()
            if type(number) is not int or type(offset) is not int:
                break
            heads.append((number, offset))
        out = {}
        for index, (number, offset) in enumerate(heads):
            value = Scanner(body, first + offset).value()
            out[number] = (index, None if isinstance(value, Keyword) else value)
        self._packed[n] = out
        return out

    def load(self, number: int):
        if number in self._cache:
            return self._cache[number]
        entry = self.entries.get(number)
        if entry is None or number in self._open:
            return None
        self._open.add(number)
        value = None
        try:
            if isinstance(entry, tuple):
                value = self._load_packed(entry[0]).get(number, (0, None))[1]
            else:
                owner, value = self._at(entry)
                if owner.number != number:
                    value = None
                elif self.security is not None and not self._is_secret(number):
                    value = self._decrypted(value, owner)
        except (Unreadable, ValueError, RecursionError):
            value = None
        finally:
            self._open.discard(number)
        self._cache[number] = value
        return value

    def _is_secret(self, number: int) -> bool:
        entry = self.trailer.get("Encrypt")
        return isinstance(entry, Ref) and entry.number == number

    def get(self, value):
        """What a value stands for, through references; None for anything circular or missing."""
        for _ in range(MAX_HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.load(value.number)
        return None

    def key(self, container, name: str):
        container = self.get(container)
        if isinstance(container, Stream):
            container = container.attributes
        return self.get(container.get(name)) if isinstance(container, dict) else None

    def items(self, value) -> list:
        value = self.get(value)
        return [self.get(v) for v in value] if isinstance(value, list) else []

    def steps(self, stream: Stream) -> list[tuple[str, dict]]:
        names, parms = self.key(stream, "Filter"), self.get(stream.attributes.get("DecodeParms", stream.attributes.get("DP")))
        names = [names] if isinstance(names, Name) else self.items(names)
        parms = [parms] if isinstance(parms, dict) else self.items(parms)
        parms = [{k: v if k == "JBIG2Globals" else self.get(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in parms]
        return filters.chain(names, parms)

    def raw(self, stream: Stream, crypt: bool = True) -> bytes:
        if crypt and self.security is not None and stream.owner is not None and stream.attributes.get("Type") != "XRef":
            return self.security.stream(stream.raw, *stream.owner)
        return stream.raw

    def body(self, stream: Stream, crypt: bool = True, limit: int = filters.STREAM_LIMIT) -> bytes:
        data, codec, _ = filters.decode(self.raw(stream, crypt), self.steps(stream), limit)
        if codec:
            raise filters.Problem(f"image codec {codec} in a data stream", data)
        return data

    def image_body(self, stream: Stream, limit: int = filters.STREAM_LIMIT) -> tuple[bytes, str | None, dict]:
        return filters.decode(self.raw(stream), self.steps(stream), limit)

    # ---- pages ----

    def pages(self, warn=lambda code, text: None) -> list[dict]:
        """Page dictionaries with inherited attributes filled in."""
        out: list[dict] = []
        seen: set[int] = set()
        stack = [(self.trailer_pages(), {}, 0)]
        nodes = 0
        while stack and nodes < MAX_PAGES and len(out) < MAX_PAGES:
            node, inherited, depth = stack.pop()
            nodes += 1
            info = self.get(node)
            if not isinstance(info, dict):
                continue
            mine = inherited | {k: info[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in info}
            kids = self.get(info.get("Kids"))
            is_tree = info.get("Type") == "Pages" or (info.get("Type") != "Page" and isinstance(kids, list))
            if is_tree and isinstance(kids, list):
                if isinstance(node, Ref):
                    if node.number in seen:
                        warn("malformed_document", f"page tree node {node.number} repeats")
                        continue
                    seen.add(node.number)
                if depth < MAX_DEPTH_TREE:
                    stack.extend((k, mine, depth + 1) for k in reversed(kids))
            elif not is_tree:
                out.append(mine | info | {"": node})
        return out

    def trailer_pages(self):
        catalog = self.get(self.trailer.get("Root"))
        return catalog.get("Pages") if isinstance(catalog, dict) else None

