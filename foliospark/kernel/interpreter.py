"""Page content to positioned glyphs, image records and warnings.

Shown strings are kept as runs: one array of positions for each string rather
than an object for each glyph, so a page costs numpy work per shown string.
"""

from __future__ import annotations

import codecs
import math
import re
from dataclasses import dataclass, field, replace

import numpy as np

from foliospark.kernel import encodings, filters, fonts
from foliospark.kernel.objects import END, Keyword, Name, Scanner, Stream, unescape
from foliospark.kernel.reader import File

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_OPERANDS = 4096
SETTLED_AT_ONCE, LONG_STRING = 1024, 512


@dataclass(frozen=True)
class Limits:
    operators: int = 2_000_000
    glyphs: int = 500_000
    form_depth: int = 8
    images: int = 10_000
    pixels: int = 64 << 20
    stream_bytes: int = filters.STREAM_LIMIT
    warnings: int = 256

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            value = getattr(self, name)
            if not isinstance(value, int) or value < 0:
                raise ValueError(f"limit {name} must be a non-negative integer")
            if value == 0:
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)


def product(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def moved(m: Matrix, x: float, y: float) -> Matrix:
    return (*m[:4], x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])


@dataclass
class Run:
    """Glyphs of one shown string: texts and parallel arrays, with what they share."""

    texts: list[str]
    x: np.ndarray
    y: np.ndarray
    advance: np.ndarray
    size: float
    direction: tuple[float, float]
    ascent: tuple[float, float]
    descent: tuple[float, float] = (0.0, 0.0)
    origin: str = "content"

    def __len__(self) -> int:
        return len(self.texts)

    def cut(self, n: int) -> Run:
        return replace(self, texts=self.texts[:n], x=self.x[:n], y=self.y[:n], advance=self.advance[:n])


@dataclass
class Painted:
    """An image painting, still undecoded."""

    ctm: Matrix
    stream: Stream | None = None
    attributes: dict | None = None
    data: bytes = b""
    resources: object = None


@dataclass
class State:
    ctm: Matrix = IDENTITY
    font: fonts.Font | None = None
    size: float = 0.0
    spacing: float = 0.0
    word_spacing: float = 0.0
    leading: float = 0.0
    rise: float = 0.0
    stretch: float = 1.0


class Stop(Exception):
    """A work limit ends the page; what was read is kept."""


class Strict(Exception):
    """Strict reading stops at the first warning."""


@dataclass
class Mark:
    start: int
    artifact: bool
    actual: str | None
    matrix: Matrix
    state: State


@dataclass
class Walker:
    file: File
    limits: Limits = field(default_factory=Limits)
    fold_ligatures: bool = True
    ignore_artifacts: bool = False
    strict: bool = False
    resolve: object = None
    collections: dict | None = None
    runs: list[Run] = field(default_factory=list)
    images: list[Painted] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    glyphs: int = 0
    operators: int = 0
    depth: int = 0
    drawing: list[int] = field(default_factory=list)
    fonts: dict = field(default_factory=dict)
    #: Strings shown but not placed yet: (codes, texts by code, widths, steps, matrix, rise along x and y, what the glyphs share)
    pending: list[tuple] = field(default_factory=list)

    def warn(self, code: str, text: str) -> None:
        n = len(self.warnings)
        if n < self.limits.warnings - 1:
            self.warnings.append((code, text))
        elif n == self.limits.warnings - 1:
            self.warnings.append((code, "further warnings on this page are suppressed"))
        if self.strict:
            raise Strict(f"{code}: {text}")

    def stop(self, text: str) -> None:
        self.warn("work_limit", text)
        raise Stop(text)

    # ---- glyphs ----

    def add(self, run: Run) -> None:
        self.settle()
        room = self.limits.glyphs - self.glyphs
        if len(run) > room:
            run = run.cut(room)
            if len(run):
                self.runs.append(run)
            self.glyphs += len(run)
            self.stop("glyph count exceeds per-page limit")
        if len(run):
            self.runs.append(run)
            self.glyphs += len(run)

    def drop_after(self, start: int) -> list[Run]:
        """Take back the glyphs from number ``start`` on."""
        self.settle()
        taken: list[Run] = []
        while self.glyphs > start:
            run = self.runs.pop()
            extra = self.glyphs - start
            if extra < len(run):
                keep = len(run) - extra
                self.runs.append(run.cut(keep))
                taken.insert(0, replace(run, texts=run.texts[keep:], x=run.x[keep:], y=run.y[keep:], advance=run.advance[keep:]))
                self.glyphs = start
            else:
                taken.insert(0, run)
                self.glyphs -= len(run)
        return taken

    def font(self, resources, name: str):
        info = self.file.key(resources, "Font")
        value = info.get(name) if isinstance(info, dict) else None
        number = fonts.reference_number(value)
        if number in self.fonts and number is not None:
            return self.fonts[number]
        loaded = self.file.get(value)
        font = fonts.load(self.file, loaded, self.resolve, self.collections) if isinstance(loaded, dict) else fonts.stand_in(self.file, name)
        if number is not None:
            self.fonts[number] = font
        return font

    def place(self, text: str, trm: Matrix, size: float, rise: float, width: float) -> Run:
        """One horizontal glyph at the text rendering matrix."""
        return self._line([text], np.zeros(1), np.array([width]), trm, size, rise)

    def _line(self, texts, offsets, widths, trm: Matrix, size: float, rise: float) -> Run:
        a, b, c, d, e, f = trm
        length = math.hypot(a, b)
        direction = (a / length, b / length) if length > 0 else (1.0, 0.0)
        if len(widths) and widths[0] < 0 and length > 0:
            direction = (-direction[0], -direction[1])
        x, y = e + offsets * a + rise * c, f + offsets * b + rise * d
        return Run(texts, x, y, widths * length, abs(size) * math.hypot(c, d), direction, (size * c, size * d))

    def settle(self) -> None:
        """Place the pending strings, many at a time; those that share everything but their places are one run."""
        while self.pending:
            part = self.pending[:SETTLED_AT_ONCE]
            del self.pending[:SETTLED_AT_ONCE]
            sizes = np.array([len(p[0]) for p in part])
            longest = int(sizes.max())
            if longest > LONG_STRING and longest * len(part) > 4 * int(sizes.sum()):
                # One string that is much longer than the others goes by itself.
                at = int(sizes.argmax())
                groups = [g for g in (part[:at], part[at : at + 1], part[at + 1 :]) if g]
                self.pending[:0] = [p for g in groups[1:] for p in g]
                part = groups[0]
                sizes = sizes[: len(part)]
            self._place(part, sizes)

    def _place(self, part: list[tuple], sizes: np.ndarray) -> None:
        codes = np.frombuffer(b"".join(p[0] for p in part), np.uint8)
        tables: dict[int, int] = {}
        which = np.array([tables.setdefault(id(p[3]), len(tables)) for p in part])
        chosen = {tables[id(p[3])]: p for p in part}
        if len(chosen) == 1:
            widths, steps = (part[0][k][codes] for k in (2, 3))
        else:
            row = np.repeat(which, sizes)
            widths, steps = (np.stack([chosen[n][k] for n in range(len(chosen))])[row, codes] for k in (2, 3))
        # Steps are added up string by string, each in a row of its own.
        filled = np.arange(int(sizes.max())) < sizes[:, None]
        grid = np.zeros(filled.shape)
        grid[filled] = steps
        grid = np.cumsum(grid, axis=1)
        grid[:, 1:] = grid[:, :-1]
        grid[:, 0] = 0.0
        offsets = grid[filled]
        a, b, e, f, up, over = np.repeat(np.array([(p[4][0], p[4][1], p[4][4], p[4][5], p[5], p[6]) for p in part], float), sizes, axis=0).T
        x, y = e + offsets * a + up, f + offsets * b + over
        begin, at, ends = 0, 0, np.cumsum(sizes).tolist()
        while at < len(part):
            upto = at + 1
            while upto < len(part) and part[upto][7] == part[at][7]:
                upto += 1
            texts = [t for p in part[at:upto] for t in _shown(p[0], p[1])]
            length, size, direction, ascent = part[at][7]
            end = ends[upto - 1]
            self.runs.append(Run(texts, x[begin:end], y[begin:end], widths[begin:end] * length, size, direction, ascent))
            begin, at = end, upto

    # ---- content ----

    def walk(self, stream, resources, state: State) -> None:
        try:
            data = self._content(stream)
            Content(self, resources, state).run(data)
        except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError, RecursionError) as e:
            self.warn("malformed_page", f"content cannot be read: {e}")

    def _content(self, value) -> bytes:
        value = self.file.get(value)
        parts, room = [], self.limits.stream_bytes
        for piece in self.file.items(value) if isinstance(value, list) else [value]:
            if not isinstance(piece, Stream):
                continue
            try:
                body = self.file.body(piece, limit=room)
            except filters.Problem as e:
                body = e.kept
                self.warn("stream_error", str(e))
            parts.append(body[:room])
            room -= len(parts[-1])
            if room <= 0:
                self.warn("stream_limit", "content exceeds its size limit")
                break
        return b"\n".join(parts)


def _shown(raw: bytes, texts: Texts) -> list[str]:
    """The texts of a string's codes."""
    try:
        return list(codecs.charmap_decode(raw, "strict", texts.single)[0])
    except UnicodeDecodeError:  # a code of several characters
        table = texts.table
        return [table[c] for c in raw]


class Texts:
    """The texts a simple font shows for its codes."""

    def __init__(self, table: list[str]):
        self.table = table
        self.empty = bytes(c for c, t in enumerate(table) if not t)
        self.single = "".join(t if len(t) == 1 else "\ufffe" for t in table)


_WHITE = re.compile(rb"[\x00\t\n\x0c\r ]")
_GAP = rb"[\x00\t\n\x0c\r ]"
_REAL = rb"[+-]?(?:\d{1,15}+(?:\.\d{0,15}+)?|\.\d{1,15}+)"
_LITERAL = rb"\(((?:[^()\\]++|\\.)*+)\)"
#: The commonest operations in the form nearly every file has them: a text matrix, and strings shown alone or with offsets.
_COMMON = re.compile(
    rb"(?:" + _GAP + rb"*+" + (rb"(" + _REAL + rb")" + _GAP + rb"++") * 6 + rb"Tm(?=" + _GAP + rb"|[(\[]|$))?+"
    rb"(?:" + _GAP + rb"*+(?:" + _LITERAL + rb"|\[((?:" + _GAP + rb"*+(?:\((?:[^()\\]++|\\.)*+\)|" + _REAL + rb"(?=" + _GAP + rb"|[(\]])))*+)" + _GAP + rb"*+\])" + _GAP + rb"*+T([jJ])(?=" + _GAP + rb"|[(\[]|$))?+",
    re.DOTALL,
)
_ITEM = re.compile(_LITERAL + rb"|(" + _REAL + rb")", re.DOTALL)
_END_IMAGE = re.compile(rb"(?<=[\x00\t\n\x0c\r ])EI(?=[\x00\t\n\x0c\r ]|$)")
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]*$")
# Abbreviations in inline images.
SHORT_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
SHORT_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


class Content:
    """One content stream, run against a walker."""

    def __init__(self, walker: Walker, resources, state: State):
        self.w, self.resources, self.s = walker, walker.file.get(resources) or {}, replace(state)
        self.stack: list[State] = []
        self.tm = self.lm = IDENTITY
        self.marks: list[Mark] = []
        self.complained: set[str] = set()
        self.metric_of: tuple | None = None
        self.metric_font: fonts.Font | None = None  # held, so that no other font has its identity

    def run(self, data: bytes) -> None:
        scan, args, w = Scanner(data, 0, references=False), [], self.w
        handlers = self.HANDLERS
        ended = False
        while True:
            if not args:
                self._common(scan)
            value = scan.value()
            if not isinstance(value, Keyword):
                if len(args) < MAX_OPERANDS:
                    args.append(value)
                continue
            if value == END and scan.at >= len(data):
                break
            w.operators += 1
            if w.operators > w.limits.operators:
                w.stop("operator count exceeds per-page limit")
            if value == "BI":
                self._inline(scan)
            else:
                entry = handlers.get(value)
                if entry is not None:
                    pattern, handler = entry
                    if self._fits(pattern, args):
                        if handler(self, *args) is False:
                            ended = True
                            break
                    elif value not in self.complained:
                        self.complained.add(str(value))
                        w.warn("malformed_page", f"operator {value} has wrong operands")
            args = []
        if self.marks and not ended:
            for mark in reversed(self.marks):
                self._finish(mark)
            w.warn("malformed_page", "unterminated marked-content sequence")

    def _common(self, scan: Scanner) -> None:
        """Run operations as long as they have their common form; the others are left to the tokenizer."""
        data, w, match = scan.data, self.w, _COMMON.match
        while True:
            m = match(data, scan.at)
            if m.end() == scan.at or w.operators + 2 > w.limits.operators:
                return
            a, b, c, d, e, f, literal, items, kind = m.groups()
            if items is not None if kind == b"j" else literal is not None:
                return  # operands of the other operator
            if items is not None:
                items = [unescape(m[1]) if m[1] is not None else float(m[2]) for m in _ITEM.finditer(items)]
            if a is not None:
                w.operators += 1
                self.tm = self.lm = (float(a), float(b), float(c), float(d), float(e), float(f))
            if literal is not None:
                w.operators += 1
                self.show(unescape(literal))
            elif items is not None:
                w.operators += 1
                self.show_array(items)
            scan.at = m.end()

    @staticmethod
    def _fits(pattern: str, args: list) -> bool:
        """n number, / name, s string, a array of numbers and strings, p name or dictionary."""
        if len(args) != len(pattern):
            return False
        for kind, v in zip(pattern, args):
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            ok = number if kind == "n" else isinstance(v, Name) if kind == "/" else isinstance(v, bytes) if kind == "s" else isinstance(v, (Name, dict)) if kind == "p" else isinstance(v, list) and all(isinstance(i, (bytes, int, float)) and not isinstance(i, bool) for i in v)
            if not ok:
                return False
        return True

    # graphics state

    def save(self):
        self.stack.append(replace(self.s))

    def restore(self):
        if self.stack:
            self.s = self.stack.pop()
        elif "Q" not in self.complained:
            self.complained.add("Q")
            self.w.warn("malformed_page", "Q without q")

    def concat(self, *m):
        self.s.ctm = product(tuple(map(float, m)), self.s.ctm)

    # text state and position

    def text(self):
        self.tm = self.lm = IDENTITY

    def set_font(self, name, size):
        self.s.size = float(size)
        font = self.w.font(self.resources, str(name))
        self.s.font = font
        if font is not None and font.warnings:
            for text in font.warnings:
                self.w.warn("unsupported", text)
            font.warnings = []

    def shift(self, x, y):
        self.lm = self.tm = moved(self.lm, x, y)

    def shift_leading(self, x, y):
        self.s.leading = -y
        self.shift(x, y)

    def set_matrix(self, *m):
        self.tm = self.lm = tuple(map(float, m))

    def next_line(self):
        self.shift(0, -self.s.leading)

    def set_leading(self, v):
        self.s.leading = v

    def set_spacing(self, v):
        self.s.spacing = v

    def set_word_spacing(self, v):
        self.s.word_spacing = v

    def set_stretch(self, v):
        self.s.stretch = v / 100

    def set_rise(self, v):
        self.s.rise = v

    # showing

    def show(self, raw: bytes):
        s = self.s
        font = s.font
        if font is None or not raw:
            return
        if font.composite:
            self._show_composite(font, raw)
            return
        w, texts = self.w, self._clean(font)
        key = (id(font), s.size, s.stretch, s.spacing, s.word_spacing)
        if key != self.metric_of:
            self.metric_of, self.metric_font, self.metric = key, font, self._metric(font)
        widths, steps, listed = self.metric
        tm, ctm = self.tm, s.ctm
        trm = product(tm, ctm)
        size = s.size * font.em if font.em > 0 else s.size
        end = 0.0
        for c in raw:
            end += listed[c]
        self.tm = moved(tm, end, 0)
        if raw.translate(None, texts.empty) != raw or w.glyphs + len(raw) > w.limits.glyphs or widths[raw[0]] < 0:
            self._show_at_once(raw, texts.table, widths, steps, trm, size)
            return
        ma, mb, mc, md, _, _ = trm
        length = math.hypot(ma, mb)
        shared = (length, abs(size) * math.hypot(mc, md), (ma / length, mb / length) if length > 0 else (1.0, 0.0), (size * mc, size * md))
        w.pending.append((raw, texts, widths, steps, trm, s.rise * mc, s.rise * md, shared))
        w.glyphs += len(raw)

    def _metric(self, font: fonts.Font) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Widths and steps of a font's codes in the present text state."""
        s = self.s
        widths = font.widths / 1000 * s.size * s.stretch
        steps = widths + s.spacing * s.stretch
        if s.word_spacing:
            steps = steps + (np.arange(256) == 32) * (s.word_spacing * s.stretch)
        return widths, steps, steps.tolist()

    def _show_at_once(self, raw: bytes, table: list[str], widths, steps, trm: Matrix, size: float) -> None:
        codes = np.frombuffer(raw, np.uint8)
        widths, ends = widths[codes], np.cumsum(steps[codes])
        offsets = np.concatenate([[0.0], ends[:-1]])
        texts = [table[c] for c in raw]
        if not all(texts):
            kept = [i for i, t in enumerate(texts) if t]
            texts, offsets, widths = [texts[i] for i in kept], offsets[kept], widths[kept]
        if texts:
            self.w.add(self.w._line(texts, offsets, widths, trm, size, self.s.rise))

    def _clean(self, font: fonts.Font) -> Texts:
        """The font's texts as shown, made once for each ligature setting."""
        table = font.shown.get(self.w.fold_ligatures)
        if table is None:
            table = font.shown[self.w.fold_ligatures] = Texts([encodings.sanitize(t, self.w.fold_ligatures) for t in font.texts])
        return table

    def _show_composite(self, font: fonts.Font, raw: bytes):
        s, w = self.s, self.w
        texts, offsets, widths, at = [], [], [], 0.0
        start = self.tm
        for text, width, space, (w1, vx, vy) in font.decode(raw):
            clean = encodings.sanitize(text, w.fold_ligatures)
            if font.vertical:
                trm = product(self.tm, s.ctm)
                length = w1 / 1000 * s.size
                if clean:
                    w.add(self._vertical(clean, moved(trm, -vx / 1000 * s.size, -vy / 1000 * s.size + s.rise), length))
                self.tm = moved(self.tm, 0, length + s.spacing + (s.word_spacing if space else 0))
                continue
            own = width / 1000 * s.size * s.stretch
            if clean:
                texts.append(clean)
                offsets.append(at)
                widths.append(own)
            at += own + (s.spacing + (s.word_spacing if space else 0)) * s.stretch
        if not font.vertical:
            self.tm = moved(start, at, 0)
            if texts:
                w.add(w._line(texts, np.array(offsets), np.array(widths), product(start, s.ctm), s.size, s.rise))

    def _vertical(self, text: str, trm: Matrix, length: float) -> Run:
        a, b, c, d, e, f = trm
        dx, dy = length * c, length * d
        run = math.hypot(dx, dy)
        half = (self.s.size * a / 2, self.s.size * b / 2)
        return Run([text], np.array([e]), np.array([f]), np.array([run]), abs(self.s.size) * math.hypot(a, b), (dx / run, dy / run) if run > 0 else (0.0, -1.0), half, (-half[0], -half[1]))

    def show_next(self, raw):
        self.next_line()
        self.show(raw)

    def show_spaced(self, word, char, raw):
        self.s.word_spacing, self.s.spacing = word, char
        self.show_next(raw)

    def show_array(self, items):
        for item in items:
            if isinstance(item, bytes):
                self.show(item)
            else:
                back = -item / 1000 * self.s.size
                vertical = self.s.font is not None and self.s.font.vertical
                self.tm = moved(self.tm, 0, back) if vertical else moved(self.tm, back * self.s.stretch, 0)

    # marked content

    def mark(self, tag, properties=None):
        w = self.w
        if isinstance(properties, Name):
            properties = w.file.key(w.file.key(self.resources, "Properties"), str(properties))
        own = properties if isinstance(properties, dict) else {}
        actual = w.file.get(own.get("ActualText"))
        artifact = tag == "Artifact" or w.file.get(own.get("Type")) == "Artifact"
        self.marks.append(Mark(w.glyphs, artifact, encodings.text_string(actual) if isinstance(actual, bytes) else None, self.tm, replace(self.s)))

    def end_mark(self):
        if not self.marks:
            self.w.warn("malformed_page", "marked-content EMC without BMC or BDC")
            return False
        self._finish(self.marks.pop())

    def _finish(self, mark: Mark):
        w = self.w
        if mark.start > w.glyphs:
            return
        if mark.artifact and w.ignore_artifacts:
            w.drop_after(mark.start)
            return
        if mark.actual is None:
            return
        covered = w.drop_after(mark.start)
        if not mark.actual:
            return
        if not covered:
            size = mark.state.size or 1.0
            w.add(w.place(mark.actual, product(mark.matrix, mark.state.ctm), size, mark.state.rise, len(mark.actual) * size / 2))
            return
        first, last = covered[0], covered[-1]
        x, y = float(first.x[0]), float(first.y[0])
        dx = float(last.x[-1]) + last.direction[0] * abs(float(last.advance[-1])) - x
        dy = float(last.y[-1]) + last.direction[1] * abs(float(last.advance[-1])) - y
        length = math.hypot(dx, dy)
        w.add(replace(first, texts=[mark.actual], x=first.x[:1], y=first.y[:1], advance=np.array([length]), direction=(dx / length, dy / length) if length > 0 else first.direction))

    # external objects and inline images

    def draw(self, name):
        w, file = self.w, self.w.file
        table = file.key(self.resources, "XObject")
        value = table.get(str(name)) if isinstance(table, dict) else None
        stream = file.get(value)
        if not isinstance(stream, Stream):
            return
        kind = file.key(stream, "Subtype")
        if kind == "Image":
            self._record(Painted(self.s.ctm, stream))
            return
        if kind != "Form":
            return
        number = fonts.reference_number(value)
        if number is not None and number in w.drawing:
            w.warn("malformed_page", "form XObject draws itself")
            return
        if w.depth >= w.limits.form_depth:
            w.warn("work_limit", "form XObject nesting exceeds limit")
            return
        state = replace(self.s)
        matrix = [float(v) for v in file.items(stream.attributes.get("Matrix")) if isinstance(v, (int, float))]
        if len(matrix) == 6:
            state.ctm = product(tuple(matrix), state.ctm)
        resources = file.key(stream, "Resources")
        w.depth += 1
        w.drawing.append(number if number is not None else -1)
        try:
            w.walk(stream, resources if isinstance(resources, dict) else self.resources, state)
        finally:
            w.drawing.pop()
            w.depth -= 1

    def _record(self, painted: Painted):
        if len(self.w.images) >= self.w.limits.images:
            self.w.stop("image count exceeds per-page limit")
        self.w.images.append(painted)

    def _inline(self, scan: Scanner):
        attributes: dict = {}
        while True:
            key = scan.value()
            if isinstance(key, Keyword):
                break
            value = scan.value()
            if isinstance(value, Keyword):
                break
            if isinstance(key, Name):
                attributes[SHORT_KEYS.get(str(key), str(key))] = value
        if key != "ID":
            return
        data = scan.data
        start = scan.at + (1 if _WHITE.match(data, scan.at) else 0)
        end = self._inline_end(attributes, data, start)
        scan.at = end[1]
        self._record(Painted(self.s.ctm, None, attributes, data[start : end[0]], self.resources))

    def _inline_end(self, attributes: dict, data: bytes, start: int) -> tuple[int, int]:
        """(end of the data, position after EI)."""
        first = attributes.get("Filter")
        first = first[0] if isinstance(first, list) and first else first
        begin = start
        if not first:
            bits = 1 if attributes.get("ImageMask") else attributes.get("BitsPerComponent") or 8
            space = attributes.get("ColorSpace")
            parts = {"G": 1, "DeviceGray": 1, "RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}.get(str(space), 1)
            if all(type(attributes.get(k)) is int for k in ("Width", "Height")) and type(bits) is int:
                length = (attributes["Width"] * bits * parts + 7) // 8 * attributes["Height"]
                m = re.compile(rb"[\x00\t\n\x0c\r ]*EI(?=[\x00\t\n\x0c\r ]|$)").match(data, start + length)
                if m:
                    return start + length, m.end()
        elif str(first) in ("A85", "ASCII85Decode", "AHx", "ASCIIHexDecode"):
            stop = data.find(b"~>" if str(first).startswith(("A85", "ASCII85")) else b">", start)
            begin = stop + 1 if stop >= 0 else start
        for m in _END_IMAGE.finditer(data, begin):
            if _PRINTABLE.match(data[m.end() : m.end() + 16]):
                return m.start() - 1, m.end()
        return len(data), len(data)

    HANDLERS = {
        "q": ("", save), "Q": ("", restore), "cm": ("nnnnnn", concat), "BT": ("", text), "ET": ("", text), "Tf": ("/n", set_font), "Td": ("nn", shift), "TD": ("nn", shift_leading), "Tm": ("nnnnnn", set_matrix), "T*": ("", next_line),
        "TL": ("n", set_leading), "Tc": ("n", set_spacing), "Tw": ("n", set_word_spacing), "Tz": ("n", set_stretch), "Ts": ("n", set_rise), "Tj": ("s", show), "'": ("s", show_next), '"': ("nns", show_spaced), "TJ": ("a", show_array),
        "Do": ("/", draw), "BMC": ("/", mark), "BDC": ("/p", mark), "EMC": ("", end_mark),
    }
