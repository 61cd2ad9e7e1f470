"""Glyphs to reading-order text.

A page is a set of parallel arrays.  Glyphs become lines (nearest baseline),
lines lose repeated and off-page glyphs, overlaid text is separated, rows are
read column by column where prose stands side by side, and each line is written
with the spaces its gaps imply, right-to-left text in logical order.

Lines that simply run forward — the usual case — are handled by comparing whole
arrays; only the others are looked at glyph by glyph.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np

# Thresholds of the layout, in font sizes unless said otherwise.
LINE_REACH, LINE_REACH_MOST, SAME_DIRECTION = 0.55, 64.0, 0.985
WORD_GAP, OFF_PAGE_GAP = 0.1, 2.0
COPY_ALONG, COPY_ACROSS, STEP_BACK = 0.1, 0.2, 0.3
SCRIPT_SIZE, SCRIPT_UP, SCRIPT_DOWN, SCRIPT_NEAR = 0.8, 0.5, 0.25, 0.5
GUTTER, COLUMN, PROSE_WIDTH, PROSE_WORDS, PROSE_LETTERS, PROSE_FILL = 1.0, 4.0, 12.0, 3.0, 0.6, 0.7
BAND_PITCHES, BAND_HOLE, TAIL_PITCHES, BAND_ROWS, LOOK_AHEAD, SWITCHES = 2.5, 4.0, 1.3, 3, 3, 0.75
CONTENT_WINDOW = 256

SPACE = " \t\n\v\f\r\x85\xa0" + "".join(chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_HAN = re.compile("[⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003fffd]")


@dataclass(frozen=True)
class Options:
    """``mode``: position, columns or content."""

    mode: str = "position"
    keep_duplicates: bool = False
    keep_off_page: bool = False

    def __post_init__(self):
        if self.mode not in ("position", "columns", "content"):
            raise ValueError(f"unknown layout mode {self.mode!r}")


@dataclass
class Glyphs:
    """Parallel arrays of a page's glyphs in content order."""

    text: list[str]
    x: np.ndarray
    y: np.ndarray
    advance: np.ndarray
    size: np.ndarray
    dx: np.ndarray
    dy: np.ndarray
    up: np.ndarray  # n x 2: ascent
    down: np.ndarray  # n x 2: descent

    def __len__(self) -> int:
        return len(self.text)

    @classmethod
    def of_runs(cls, runs) -> Glyphs:
        if not runs:
            none = np.zeros(0)
            return cls([], none, none, none, none, none, none, np.zeros((0, 2)), np.zeros((0, 2)))
        sizes = [len(r) for r in runs]
        spread = lambda values: np.repeat(np.array(values, float), sizes, axis=0)
        return cls(
            [t for r in runs for t in r.texts], *(np.concatenate([getattr(r, a) for r in runs]) for a in ("x", "y", "advance")),
            spread([r.size for r in runs]), spread([r.direction[0] for r in runs]), spread([r.direction[1] for r in runs]), spread([r.ascent for r in runs]), spread([r.descent for r in runs]),
        )

    @classmethod
    def of_rows(cls, rows) -> Glyphs:
        """From (text, x, y, advance, size, dir, ascent, descent); None for upright horizontal."""
        rows = list(rows)
        pair = lambda v, d: d if v is None else (float(v[0]), float(v[1]))
        n = len(rows)
        col = lambda i: np.array([float(r[i] or 0) for r in rows])
        directions = np.array([_unit(pair(r[5], (1.0, 0.0))) for r in rows]).reshape(n, 2)
        ups = np.array([pair(r[6], (0.0, 0.0)) for r in rows]).reshape(n, 2)
        downs = np.array([pair(r[7], (0.0, 0.0)) for r in rows]).reshape(n, 2)
        out = cls([r[0] for r in rows], col(1), col(2), col(3), col(4), directions[:, 0], directions[:, 1], ups, downs)
        return out

    def take(self, keep) -> Glyphs:
        keep = np.asarray(keep, int)
        return Glyphs([self.text[i] for i in keep], *(getattr(self, a)[keep] for a in ("x", "y", "advance", "size", "dx", "dy", "up", "down")))

    def boxes(self) -> np.ndarray:
        """n x 4: smallest x, y and largest x, y of each glyph's quad."""
        up = self.up.copy()
        bare = ~self.up.any(axis=1) & ~self.down.any(axis=1)
        up[bare, 0], up[bare, 1] = 0.0, self.size[bare]
        length = np.abs(self.advance)
        ex, ey = self.x + self.dx * length, self.y + self.dy * length
        xs = np.stack([self.x + self.down[:, 0], ex + self.down[:, 0], ex + up[:, 0], self.x + up[:, 0]])
        ys = np.stack([self.y + self.down[:, 1], ey + self.down[:, 1], ey + up[:, 1], self.y + up[:, 1]])
        return np.stack([xs.min(0), ys.min(0), xs.max(0), ys.max(0)], axis=1)

    def within(self, box) -> np.ndarray:
        """Which glyphs touch a rectangle, edges included."""
        b = self.boxes()
        return (b[:, 2] >= box[0]) & (box[2] >= b[:, 0]) & (b[:, 3] >= box[1]) & (box[3] >= b[:, 1])


def _unit(v):
    length = math.hypot(*v)
    return (v[0] / length, v[1] / length) if length > 1e-9 else (1.0, 0.0)


@dataclass
class Line:
    """Glyph numbers in reading order along one baseline."""

    at: list[int]
    dx: float
    dy: float
    offset: float
    size: float = 0.0
    end: float = -math.inf

    @property
    def first(self) -> int:
        return min(self.at)


class Layout:
    def __init__(self, glyphs: Glyphs, options: Options = Options(), media_box=None):
        self.g, self.options = glyphs, options
        box = media_box if media_box and media_box[2] > media_box[0] and media_box[3] > media_box[1] else None
        self.box = None if options.keep_off_page else box
        self.width = np.abs(glyphs.advance)
        self.em = np.maximum(glyphs.size, 1.0)
        self._codes: np.ndarray | None = None

    def codes(self) -> np.ndarray:
        """A number for each glyph that is the same for equal texts."""
        if self._codes is None:
            known: dict[str, int] = {}
            self._codes = np.array([known.setdefault(t, len(known)) for t in self.g.text], np.int64)
        return self._codes

    # ---- lines ----

    def along(self, line: Line, at=None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of a line's glyphs along its direction."""
        i = np.asarray(line.at if at is None else at, int)
        g = self.g
        start = g.x[i] * line.dx + g.y[i] * line.dy
        return start, (g.x[i] + line.dx * self.width[i]) * line.dx + (g.y[i] + line.dy * self.width[i]) * line.dy

    def lines(self) -> list[Line]:
        g = self.g
        lines: list[Line] = []
        shelf: dict[tuple[int, int], list[int]] = {}  # (direction sector, 4-point cell) -> lines
        offset = -g.dy * g.x + g.dx * g.y
        n = len(g)
        # Stretches that share baseline, direction and size exactly need one decision.
        change = np.ones(n, bool)
        if n > 1:
            change[1:] = (offset[1:] != offset[:-1]) | (g.dx[1:] != g.dx[:-1]) | (g.dy[1:] != g.dy[:-1]) | (g.size[1:] != g.size[:-1])
        starts = np.flatnonzero(change).tolist() + [n]
        ends = (g.x + g.dx * self.width) * g.dx + (g.y + g.dy * self.width) * g.dy
        last, largest = -1, 0.0
        for a, b in zip(starts, starts[1:]):
            i = a
            while i < b:
                o, size, dx, dy = float(offset[i]), float(g.size[i]), float(g.dx[i]), float(g.dy[i])
                sector = int((math.atan2(dy, dx) + math.pi) / (2 * math.pi) * 72) % 72
                into, script = -1, False
                if last >= 0 and o == lines[last].offset and dx * lines[last].dx + dy * lines[last].dy >= SAME_DIRECTION:
                    into = last
                else:
                    into = self._nearest(lines, shelf, sector, dx, dy, o, size)
                    if into < 0 and size < SCRIPT_SIZE * largest:
                        into = self._script(lines, shelf, sector, dx, dy, o, size, float(g.x[i] * dx + g.y[i] * dy), largest)
                        script = into >= 0
                largest = max(largest, size)
                upto = i + 1 if script else b
                part = list(range(i, upto))
                reach = float(ends[i:upto].max())
                if into < 0:
                    into = len(lines)
                    lines.append(Line(part, dx, dy, o, size, reach))
                    shelf.setdefault((sector, math.floor(o / 4.0)), []).append(into)
                else:
                    line = lines[into]
                    line.at += part
                    line.size, line.end = max(line.size, size), max(line.end, reach)
                last = into
                i = upto
        extra: list[Line] = []
        for line in lines:
            extra += self._tidy(line)
        return lines + extra

    def _candidates(self, shelf, sectors, o: float, radius: int):
        cell = math.floor(o / 4.0)
        for s in sectors:
            for c in range(cell - radius, cell + radius + 1):
                yield from shelf.get((s % 72, c), ())

    def _nearest(self, lines, shelf, sector, dx, dy, o, size) -> int:
        reach = min(LINE_REACH * size, LINE_REACH_MOST)
        if reach <= 0:
            reach = 5.0
        best, distance = -1, math.inf
        for j in self._candidates(shelf, range(sector - 3, sector + 4), o, math.ceil(reach / 4.0) + 1):
            line = lines[j]
            d = abs(o - line.offset)
            if d <= reach and d < distance and dx * line.dx + dy * line.dy >= SAME_DIRECTION:
                best, distance = j, d
        return best

    def _script(self, lines, shelf, sector, dx, dy, o, size, start, largest) -> int:
        best, distance = -1, math.inf
        for j in self._candidates(shelf, (sector,), o, math.ceil(0.5 * largest / 4.0) + 1):
            line = lines[j]
            rise = o - line.offset
            fits = -SCRIPT_DOWN * line.size <= rise <= SCRIPT_UP * line.size and abs(start - line.end) <= SCRIPT_NEAR * line.size
            if fits and size <= SCRIPT_SIZE * line.size and abs(rise) < distance and dx * line.dx + dy * line.dy >= SAME_DIRECTION:
                best, distance = j, abs(rise)
        return best

    def _tidy(self, line: Line) -> list[Line]:
        """Order and de-duplicate a line; overlaid text becomes lines of its own."""
        start, _ = self.along(line)
        front = np.maximum.accumulate(start)
        forward = len(start) < 2 or bool((start[1:] >= front[:-1] - 0.1 * self.em[line.at[1:]]).all())
        if forward:
            self._drop_copies(line)
            return []
        self._sort(line)
        self._drop_copies(line)
        return self._split(line)

    def _sort(self, line: Line) -> None:
        start, _ = self.along(line)
        numbers = np.asarray(line.at, int)
        order = np.lexsort((numbers, start))
        line.at = numbers[order].tolist()
        at, pos = line.at, start[order]
        # A glyph kerned back over the space drawn just before it.
        if not (numbers[order][1:] == numbers[order][:-1] - 1).any():
            return
        pos = pos.tolist()
        for k in range(1, len(at)):
            if at[k] == at[k - 1] - 1 and not self.g.text[at[k]].strip(SPACE) and pos[k] - pos[k - 1] <= 0.1 * self.em[at[k - 1]]:
                at[k - 1], at[k] = at[k], at[k - 1]
                pos[k - 1], pos[k] = pos[k], pos[k - 1]

    def same_place(self, i: int, j: int, dx: float, dy: float) -> bool:
        """Whether glyph j repeats glyph i."""
        g = self.g
        if g.text[i] != g.text[j]:
            return False
        em = self.em[i]
        if abs(g.size[i] - g.size[j]) > COPY_ALONG * em:
            return False
        along = COPY_ALONG * em
        if self.width[i] > 0:
            along = min(along, self.width[i] / 3)
        px, py = g.x[j] - g.x[i], g.y[j] - g.y[i]
        return abs(px * dx + py * dy) <= along and abs(py * dx - px * dy) <= COPY_ACROSS * em

    def same_places(self, i: np.ndarray, j: np.ndarray, dx: float, dy: float) -> np.ndarray:
        """Which glyphs ``j`` repeat the glyphs ``i`` beside them."""
        g, codes, em = self.g, self.codes(), self.em[i]
        along = COPY_ALONG * em
        along = np.where(self.width[i] > 0, np.minimum(along, self.width[i] / 3), along)
        px, py = g.x[j] - g.x[i], g.y[j] - g.y[i]
        near = (np.abs(px * dx + py * dy) <= along) & (np.abs(py * dx - px * dy) <= COPY_ACROSS * em)
        return near & (codes[i] == codes[j]) & (np.abs(g.size[i] - g.size[j]) <= COPY_ALONG * em)

    def _drop_copies(self, line: Line) -> None:
        if self.options.keep_duplicates or len(line.at) < 2:
            return
        start, _ = self.along(line)
        reach = COPY_ALONG * self.em[line.at]
        if bool((start[1:] - start[:-1] > reach[1:]).all()):
            return  # no two glyphs are close enough
        if len(start) < 3 or bool((start[2:] - start[:-2] > reach[2:]).all()):
            # Copies can only be direct neighbours, as in bold type painted twice.
            at = np.asarray(line.at, int)
            close = np.flatnonzero(start[1:] - start[:-1] <= reach[1:]) + 1
            close = close[self.same_places(at[close - 1], at[close], line.dx, line.dy)]
            gone: set[int] = set()
            if len(close) > 1 and (np.diff(close) == 1).any():
                for k in close.tolist():
                    if k - 1 not in gone:
                        gone.add(k if line.at[k] > line.at[k - 1] else k - 1)
            else:
                gone.update(np.where(at[close] > at[close - 1], close, close - 1).tolist())
            if gone:
                keep = np.ones(len(at), bool)
                keep[list(gone)] = False
                line.at = at[keep].tolist()
            return
        kept: list[int] = []
        places: list[float] = []
        for k, i in enumerate(line.at):
            twin = None
            for back in range(len(kept) - 1, -1, -1):
                if start[k] - places[back] > reach[k]:
                    break
                if self.same_place(kept[back], i, line.dx, line.dy):
                    twin = back
                    break
            if twin is None:
                kept.append(i)
                places.append(float(start[k]))
            elif i < kept[twin]:
                kept[twin], places[twin] = i, float(start[k])
        line.at = kept

    def _split(self, line: Line) -> list[Line]:
        """Separate text painted over other text of the line."""
        if len(line.at) < 4:
            return []
        drawn = sorted(line.at)
        start, end = self.along(line, drawn)
        if (start[1:] >= np.maximum.accumulate(end)[:-1] - STEP_BACK * self.em[drawn[1:]]).all():
            return []  # one stroke
        strokes: list[list] = []  # [glyph positions in drawn, start, end]
        for k in range(len(drawn)):
            if strokes and start[k] >= strokes[-1][2] - STEP_BACK * self.em[drawn[k]]:
                strokes[-1][0].append(k)
                strokes[-1][2] = max(strokes[-1][2], end[k])
            else:
                strokes.append([[k], start[k], end[k]])
        if len(strokes) < 2:
            return []
        strokes.sort(key=lambda s: s[1])
        tracks: list[tuple[list[int], list[tuple[float, float]]]] = []
        for members, lo, hi in strokes:
            s, tolerance = start[members], STEP_BACK * self.em[[drawn[k] for k in members]]
            for glyphs, spans in tracks:
                if all(int(((s > a - tolerance) & (s < b - tolerance)).sum()) < 2 for a, b in spans):
                    glyphs += members
                    spans.append((lo, hi))
                    break
            else:
                tracks.append((list(members), [(lo, hi)]))
        if len(tracks) < 2:
            return []
        parts = [Line([drawn[k] for k in glyphs], line.dx, line.dy, line.offset, line.size, line.end) for glyphs, _ in tracks]
        for part in parts:
            self._sort(part)
        line.at = parts[0].at
        return parts[1:]

    def on_page(self, line: Line, touching: np.ndarray) -> bool:
        """Drop stretches off the page; False if nothing is left."""
        inside = touching[line.at]
        if inside.all() or not inside.any():
            return bool(inside.any())
        start, end = self.along(line)
        gap = OFF_PAGE_GAP * max(line.size, 1.0)
        kept: list[int] = []
        stretch, furthest = [0], float(end[0])
        for k in range(1, len(line.at) + 1):
            if k < len(line.at) and start[k] - furthest <= gap:
                stretch.append(k)
                furthest = max(furthest, float(end[k]))
                continue
            if inside[stretch].any():
                kept += [line.at[m] for m in stretch]
            if k < len(line.at):
                stretch, furthest = [k], float(end[k])
        line.at = kept
        line.size = float(self.g.size[kept].max())
        line.end = float(self.along(line)[1].max())
        return True

    # ---- text ----

    def page_text(self) -> str:
        if not len(self.g):
            return ""
        if self.options.mode == "content":
            return self.content_text()
        if self.options.mode == "position":
            quick = self._quick_text()
            if quick is None and not self.options.keep_duplicates:
                quick = self._quick_without_copies()
            if quick is not None:
                return quick
        lines = self.lines()
        if self.box is not None:
            touching = self.g.within(self.box)
            if not touching.all():
                lines = [line for line in lines if self.on_page(line, touching)]
        ordered = Columns(self, self.options.mode == "columns").order(lines)
        out = []
        for line in ordered:
            texts = [self.g.text[i] for i in line.at]
            if any(t.strip(SPACE) for t in texts):
                out.append(self.line_text(line, texts))
        return "\n".join(out)

    def _quick_text(self) -> str | None:
        """A page of plain separate lines, by comparing whole arrays; None if anything calls for more.

        Every stretch of one baseline must be a line of its own, run forward
        without gaps a gutter could fill, and share some width with every other
        line, so that no line joins another and no columns can stand.
        """
        g, text = self.g, self.g.text
        if (g.dx != 1.0).any() or (g.dy != 0.0).any() or (self.width <= 0.01 * self.em).any():
            return None
        start, end = g.x, g.x + self.width
        change = (g.y[1:] != g.y[:-1]) | (g.size[1:] != g.size[:-1])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(text)]
        firsts = np.array(edges[:-1])
        height = g.y[firsts]
        order = np.argsort(-height, kind="stable")
        if len(order) > 1 and (-np.diff(height[order]) <= LINE_REACH * max(float(g.size.max()), 10.0)).any():
            return None
        lefts, rights = np.minimum.reduceat(start, firsts), np.maximum.reduceat(end, firsts)
        if lefts.max() >= rights.min() or (self.box is not None and not np.logical_or.reduceat(g.within(self.box), firsts).all()):
            return None  # a line that reaches over the page's edge is kept whole, as nothing in it stands apart
        middle = (start + end) / 2
        within = ~change
        gap = start[1:] - end[:-1]
        if (within & ((start[1:] < middle[:-1]) | (end[:-1] > middle[1:]) | (gap >= GUTTER * self.em[1:]))).any():
            return None
        whole = "".join(text)
        if not whole.isascii() and any(right_to_left(c) for c in set(whole)):
            return None
        if len(whole) != len(text) and any(len(t) > 1 and (t[0] in SPACE or t[-1] in SPACE) for t in text):
            return None
        wide = np.flatnonzero(within & (gap > np.where(g.size[1:] > 0, WORD_GAP * g.size[1:], 1.0))) + 1
        if len(wide):
            if not whole.isascii() and any(unspaced(c) for c in set(whole)):
                return None
            text = list(text)
            for k in reversed(wide.tolist()):
                if text[k].strip(SPACE) and text[k - 1].strip(SPACE):
                    text[k] = " " + text[k]
        lines = ("".join(text[edges[k] : edges[k + 1]]).strip(SPACE) for k in order.tolist())
        return "\n".join(line for line in lines if line)

    def _rows(self) -> np.ndarray:
        """A number for each glyph of upright text that is the same for heights that copies may have."""
        order = np.argsort(self.g.y, kind="stable")
        row = np.zeros(len(self.g), np.int64)
        row[order[1:]] = np.cumsum(np.diff(self.g.y[order]) > COPY_ACROSS * float(self.em.max()))
        return row

    def _quick_without_copies(self) -> str | None:
        """A plain page whose glyphs were painted twice; None where it is not plain what repeats what."""
        g, n = self.g, len(self.g)
        if n < 4 or (g.dx != 1.0).any() or (g.dy != 0.0).any():
            return None
        row = self._rows()
        order = np.lexsort((np.arange(n), g.x, row))
        a, b = order[:-1], order[1:]
        near = np.flatnonzero((row[a] == row[b]) & (g.x[b] - g.x[a] <= COPY_ALONG * self.em[b]))
        a, b = a[near], b[near]
        twins = self.same_places(a, b, 1.0, 0.0) & self.same_places(b, a, 1.0, 0.0)
        if not twins.any() or not twins.all() or (np.diff(near) == 1).any():
            return None
        keep = np.ones(n, bool)
        keep[np.maximum(a, b)] = False
        return Layout(g.take(np.flatnonzero(keep)), self.options, self.box)._quick_text()

    def line_text(self, line: Line, texts: list[str]) -> str:
        if any(right_to_left(c) for t in texts if not t.isascii() for c in t):
            return "".join(logical_order(self._pieces(self._marks_first(line))))
        plain = self._plain(line, texts)
        return plain if plain is not None else "".join(self._pieces(line))

    def _plain(self, line: Line, texts: list[str]) -> str | None:
        """A line that only runs forward, written by comparing arrays; None if it does not."""
        at = np.asarray(line.at, int)
        start, end = self.along(line)
        if (self.width[at] <= 0.01 * self.em[at]).any():
            return None
        if len(at) > 1:
            middle = (start + end) / 2
            if (start[1:] < middle[:-1]).any() or (end[:-1] > middle[1:]).any():
                return None
        blank = [not t.strip(SPACE) for t in texts]
        if any(len(t) > 1 and (t[0] in SPACE or t[-1] in SPACE) for t in texts):
            return None
        if len(at) == 1:
            return texts[0].strip(SPACE)
        size = self.g.size[at]
        gap = np.where(size * WORD_GAP > 0, size * WORD_GAP, 1.0)
        wide = np.flatnonzero(start[1:] - end[:-1] > gap[1:]) + 1
        if len(wide):
            texts = list(texts)
            for k in wide.tolist():
                if not blank[k] and not blank[k - 1]:
                    if unspaced(texts[k - 1][-1:]) and unspaced(texts[k]) and start[k] - end[k - 1] <= max(size[k], 1.0):
                        continue
                    texts[k] = " " + texts[k]
        return "".join(texts).strip(SPACE)

    def _belongs(self, mark: int, glyph: int, p: float, a: float, b: float) -> bool:
        """Whether a glyph without advance is a mark of the glyph after it."""
        return self.width[glyph] > 0.01 * self.em[glyph] and glyph > mark and min(a, b) - 0.25 * self.em[glyph] <= p < max(a, b)

    def _pieces(self, line: Line) -> list[str]:
        """Glyph texts and the spaces between them, glyph by glyph."""
        at = line.at
        start, end = self.along(line)
        out: list[str] = []
        held, held_middle, held_index, text_end = "", 0.0, 0, 0.0
        before_index, before_text, glued = -1, "", False
        lo = hi = 0.0
        for k, i in enumerate(at):
            text, a, b = self.g.text[i], float(start[k]), float(end[k])
            if not text.strip(SPACE):
                middle = (a + b) / 2
                if out and (hi <= middle or i == before_index + 1):
                    if not held:
                        text_end = hi
                    held += text
                    held_middle, held_index, hi = middle, i, b
                continue
            measured, leads, trails = a, False, False
            if self.width[i] <= 0.01 * self.em[i]:
                if k + 1 < len(at) and self._belongs(i, at[k + 1], a, float(start[k + 1]), float(end[k + 1])):
                    leads, measured = True, float(start[k + 1])
                else:
                    trails = bool(out) and min(lo, hi) <= a < max(lo, hi)
            if held and measured < held_middle and i != held_index + 1:
                held, hi = "", text_end
            if out:
                if held:
                    out.append(held)
                elif not (glued or trails or text[0] == " "):
                    size = float(self.g.size[i])
                    gap = max(size, 1.0) if unspaced(before_text) and unspaced(text) else size * WORD_GAP if size > 0 else 1.0
                    if measured - hi > gap:
                        out.append(" ")
            bare = text.rstrip(SPACE)
            out.append(bare)
            held, held_middle, held_index = text[len(bare) :], b, i
            before_index, glued = i, leads
            if not leads and not trails:
                lo, hi, before_text = a, b, bare
        return out

    def _marks_first(self, line: Line) -> Line:
        """Right-to-left letters' marks moved before them, so that reversal puts them after."""
        at = list(line.at)
        place = {i: k for k, i in enumerate(at)}
        start, end = self.along(line)
        light = lambda i: self.width[i] <= 0.01 * self.em[i]
        moves: dict[int, list[int]] = {}
        gone: set[int] = set()
        for k, i in enumerate(at):
            if not light(i):
                continue
            nxt = next((j for j in range(i + 1, i + 9) if j not in place or not light(j)), None)
            if nxt is None or nxt not in place:
                continue
            base = place[nxt]
            if base < k and right_to_left(self.g.text[nxt][:1]) and min(start[base], end[base]) <= start[k] < max(start[base], end[base]):
                moves.setdefault(base, []).append(k)
                gone.add(k)
        if not gone:
            return line
        order = [m for k in range(len(at)) if k not in gone for m in (*moves.get(k, ()), k)]
        return Line([at[k] for k in order], line.dx, line.dy, line.offset, line.size, line.end)

    def content_text(self) -> str:
        """Glyphs as drawn, a new line wherever the height jumps."""
        g = self.g
        n = len(g)
        off = ~g.within(self.box) if self.box is not None else np.zeros(n, bool)
        if not off[0] and (self.options.keep_duplicates or self._no_copies()):
            quick = self._content_quick(off)
            if quick is not None:
                return quick
        first = next((i for i in range(n) if not off[i]), None)
        if first is None:
            return ""
        out, before, began = [g.text[first]], first, first
        for i in range(first + 1, n):
            reach = LINE_REACH * max(g.size[i], g.size[before])
            jump = abs(g.y[i] - g.y[before]) > (reach if reach > 0 else 5.0)
            if jump and off[i]:
                continue
            if jump:
                began = i
                out.append("\n")
            else:
                if not self.options.keep_duplicates and g.text[i].strip(SPACE):
                    since = range(i - 1, max(began, i - CONTENT_WINDOW) - 1, -1)
                    if any(g.text[j] == g.text[i] and self.same_place(j, i, g.dx[i], g.dy[i]) for j in since):
                        continue
                size = max(float(g.size[i]), 1.0)
                gap = size if unspaced(g.text[before]) and unspaced(g.text[i]) else WORD_GAP * size
                if g.x[i] - (g.x[before] + g.advance[before]) > gap and out[-1][-1:] != " " and g.text[i][:1] != " ":
                    out.append(" ")
            out.append(g.text[i])
            before = i
        return "".join(out)


    def _no_copies(self) -> bool:
        """Whether equal upright glyphs all lie further apart than copies do; False where that is not plain."""
        g = self.g
        if (g.dx != 1.0).any() or (g.dy != 0.0).any():
            return False
        em, row = float(self.em.max()), self._rows()
        code = self.codes()
        order = np.lexsort((g.x, row, code))
        same = (code[order][1:] == code[order][:-1]) & (row[order][1:] == row[order][:-1])
        close = np.flatnonzero(same & (np.diff(g.x[order]) <= COPY_ALONG * em))
        return not any(g.text[i].strip(SPACE) for i in order[close].tolist())

    def _content_quick(self, off: np.ndarray) -> str | None:
        """Content order by comparing each glyph with the one before it in arrays; None if a line off the page is left out."""
        g, texts = self.g, list(self.g.text)
        larger = np.maximum(g.size[1:], g.size[:-1])
        jump = np.abs(np.diff(g.y)) > np.where(larger > 0, LINE_REACH * larger, 5.0)
        if (jump & off[1:]).any():
            return None
        size = np.maximum(g.size[1:], 1.0)
        gap = g.x[1:] - (g.x[:-1] + g.advance[:-1])
        for k in (np.flatnonzero(~jump & (gap > WORD_GAP * size)) + 1).tolist():
            before, text = g.text[k - 1], g.text[k]
            if before[-1:] == " " or text[:1] == " " or (unspaced(before) and unspaced(text) and gap[k - 1] <= size[k - 1]):
                continue
            texts[k] = " " + text
        for k in (np.flatnonzero(jump) + 1).tolist():
            texts[k] = "\n" + texts[k]
        return "".join(texts)


def unspaced(text: str) -> bool:
    """Whether text begins in a script written without spaces between words."""
    c = text[:1]
    return c > "⹿" and ("　" <= c <= "ヿ" or "＀" <= c <= "￯" or "ㇰ" <= c <= "ㇿ" or bool(_HAN.match(c)))


# ---- columns ----------------------------------------------------------------


@dataclass
class Piece:
    """A stretch of a row between gaps that a gutter could fill."""

    lo: int
    hi: int
    left: float
    right: float
    words: int
    letters: int
    chars: int


@dataclass
class Row:
    line: Line
    pieces: list[Piece]
    size: float

    @property
    def offset(self) -> float:
        return self.line.offset

    def column(self, gutters) -> int:
        """The one column the row lies in, or -1."""
        found = {column_of(p, gutters) for p in self.pieces}
        return found.pop() if len(found) == 1 else -1


def column_of(piece: Piece, gutters) -> int:
    return sum(piece.left >= hi for _, hi in gutters)


def by_offset(a: Line, b: Line) -> int:
    if a.dx * b.dx + a.dy * b.dy >= SAME_DIRECTION and a.offset != b.offset:
        return -1 if a.offset > b.offset else 1
    return a.first - b.first


@dataclass
class Band:
    """Text extents of consecutive rows, kept as disjoint intervals in order."""

    every: bool
    covered: list[tuple[float, float]] = field(default_factory=list)
    size: float = 0.0

    def add(self, row: Row) -> None:
        self.size = max(self.size, row.size)
        for p in row.pieces:
            lo, hi = p.left, p.right
            apart = [c for c in self.covered if c[1] < lo or c[0] > hi]
            for c in self.covered:
                if not (c[1] < lo or c[0] > hi):
                    lo, hi = min(lo, c[0]), max(hi, c[1])
            bisect.insort(apart, (lo, hi))
            self.covered = apart

    def gutters(self) -> list[tuple[float, float]]:
        em = max(self.size, 1.0)
        found, left = [], self.covered[0][0]
        for (_, lo), (hi, _) in zip(self.covered, self.covered[1:]):
            if hi - lo >= GUTTER * em and (self.every or lo - left >= COLUMN * em):
                found.append((lo, hi))
                left = hi
        if found and not self.every and self.covered[-1][1] - found[-1][1] < COLUMN * em:
            found.pop()
        return found


class Columns:
    """Reading order of a page's lines."""

    def __init__(self, layout: Layout, every: bool):
        self.layout, self.every = layout, every

    def row(self, line: Line) -> Row:
        lay, g, at = self.layout, self.layout.g, np.asarray(line.at, int)
        right = g.x[at] + lay.width[at]
        cuts = [0]
        if len(at) > 1:
            gap = g.x[at[1:]] - right[:-1]
            cuts += (np.flatnonzero(gap >= GUTTER * np.maximum(np.maximum(g.size[at[1:]], g.size[at[:-1]]), 1.0)) + 1).tolist()
        cuts.append(len(at))
        pieces = []
        for lo, hi in zip(cuts, cuts[1:]):
            part = at[lo:hi]
            pieces.append(Piece(lo, hi, float(g.x[part].min()), float(right[lo:hi].max()), 0, 0, 0))
        return Row(line, pieces, float(g.size[at].mean()))

    def _measure(self, row: Row) -> None:
        """Words and letters of the pieces, needed only where columns may stand."""
        g, lay = self.layout.g, self.layout
        for p in row.pieces:
            if p.words:
                continue
            p.words = 1
            part = row.line.at[p.lo : p.hi]
            before = None
            for i in part:
                text = g.text[i]
                p.letters += sum(c.isalpha() for c in text)
                p.chars += sum(c not in SPACE for c in text)
                blank = not text.strip(SPACE)
                if before is not None:
                    was_blank = not g.text[before].strip(SPACE)
                    if blank and not was_blank:
                        p.words += 1
                    elif not blank and not was_blank and g.x[i] - (g.x[before] + lay.width[before]) > WORD_GAP * lay.em[i]:
                        p.words += 1
                before = i

    def order(self, lines: list[Line]) -> list[Line]:
        from functools import cmp_to_key

        level = [line for line in lines if line.at and line.dx >= 0.97]
        turned = [(float(self.layout.g.y[line.at[0]]), line) for line in lines if line.at and line.dx < 0.97]
        level.sort(key=cmp_to_key(by_offset))
        turned.sort(key=cmp_to_key(lambda a, b: (-1 if a[0] > b[0] else 1) if a[0] != b[0] else by_offset(a[1], b[1])))
        rows = [self.row(line) for line in level]
        out: list[Line] = []
        at = 0
        while at < len(rows):
            while turned and turned[0][0] > rows[at].offset:
                out.append(turned.pop(0)[1])
            end, gutters = self._band(rows, at)
            for later in range(at + 1, min(end, at + 1 + LOOK_AHEAD)):
                far, its = self._band(rows, later)
                if far - later > end - at and its and (self.every or self._beside(rows[later:far], its)):
                    end, gutters = later, []
                    break
            self._emit(out, rows[at:end], gutters)
            at = end
        return out + [line for _, line in turned]

    def _band(self, rows: list[Row], start: int) -> tuple[int, list[tuple[float, float]]]:
        """How far rows from ``start`` keep a common gutter, and the gutters."""
        band = Band(self.every)
        band.add(rows[start])
        kept: list[tuple[float, float]] = []
        pitches: list[float] = []
        column_pitches: list[float] = []
        latest: dict[int, float] = {}
        before, several = -1, 0
        end = start + 1
        while end < len(rows):
            row = rows[end]
            gap = rows[end - 1].offset - row.offset
            if pitches and gap > BAND_PITCHES * pitches[len(pitches) // 2] or gap > BAND_HOLE * max(band.size, row.size):
                break
            column = row.column(kept) if kept else -1
            if column >= 0 and column == before and several >= 2 and len(column_pitches) >= 2 and latest.get(column, math.nan) - row.offset > TAIL_PITCHES * column_pitches[len(column_pitches) // 2]:
                break
            band.add(row)
            found = band.gutters()
            if not found:
                break
            kept = found
            if gap >= 0.5 * max(band.size, row.size):
                bisect.insort(pitches, gap)
            several = 2 if column < 0 or (column != before and before >= 0) else max(several, 1)
            if column >= 0:
                if column in latest:
                    bisect.insort(column_pitches, latest[column] - row.offset)
                latest[column] = row.offset
            before = column
            end += 1
        return end, kept if end - start >= (2 if self.every else BAND_ROWS) else []

    def _beside(self, rows: list[Row], gutters) -> bool:
        """Whether a band's columns are read one after another."""
        if not self._prose(rows, gutters):
            return False
        columns = [r.column(gutters) for r in rows]
        lo, hi = 0, len(columns) - 1
        while lo < hi and columns[lo] >= 0 and columns[lo] == columns[lo + 1]:
            lo += 1
        while hi > lo and columns[hi] >= 0 and columns[hi] == columns[hi - 1]:
            hi -= 1
        if hi == lo:
            return False
        switches = sum(a < 0 or b < 0 or a != b for a, b in zip(columns[lo:hi], columns[lo + 1 : hi + 1]))
        return switches >= SWITCHES * (hi - lo)

    def _prose(self, rows: list[Row], gutters) -> bool:
        by_column: dict[int, list[tuple[Piece, float]]] = {}
        for row in rows:
            self._measure(row)
            for p in row.pieces:
                by_column.setdefault(column_of(p, gutters), []).append((p, row.size))
        for members in by_column.values():
            pieces = [p for p, _ in members]
            chars = sum(p.chars for p in pieces)
            if len(pieces) < BAND_ROWS or not chars:
                continue
            width = max(p.right for p in pieces) - min(p.left for p in pieces)
            full = sum(p.right - p.left >= PROSE_FILL * width for p in pieces)
            if sum(p.words for p in pieces) >= PROSE_WORDS * len(pieces) and sum(p.letters for p in pieces) >= PROSE_LETTERS * chars and width >= PROSE_WIDTH * max(max(s for _, s in members), 1.0) and 2 * full >= len(pieces):
                return True
        return False

    def _emit(self, out: list[Line], rows: list[Row], gutters) -> None:
        if not gutters or not (self.every or self._beside(rows, gutters)):
            out += [r.line for r in rows]
            return
        columns = list(range(len(gutters) + 1))
        letters = [c for r in rows for i in r.line.at for c in self.layout.g.text[i]]
        if sum(map(right_to_left, letters)) > sum(c >= "A" and not right_to_left(c) for c in letters):
            columns.reverse()
        for column in columns:
            for r in rows:
                own = [p for p in r.pieces if column_of(p, gutters) == column]
                if own:
                    line = r.line
                    out.append(Line(line.at[own[0].lo : own[-1].hi], line.dx, line.dy, line.offset, line.size, line.end))


# ---- right-to-left ----------------------------------------------------------


def right_to_left(c: str) -> bool:
    """A strong right-to-left character."""
    if c < "֐":
        return False
    inside = c <= "ࣿ" or "יִ" <= c <= "﷿" or "ﹰ" <= c <= "﻿" or "\U00010800" <= c <= "\U00010fff" or "\U0001e800" <= c <= "\U0001efff"
    return inside and not ("٠" <= c <= "٩" or "۰" <= c <= "۹") and unicodedata.category(c) != "Mn"


def _bidi_class(piece: str) -> str:
    """R, L, N (number), S (separator) or '' (neutral)."""
    digits = False
    for c in piece:
        if right_to_left(c):
            return "R"
        if unicodedata.category(c) == "Nd":
            digits = True
        elif c.isalpha():
            return "L"
    return "N" if digits else "S" if len(piece) == 1 and piece in ",.:/+-" else ""


def logical_order(pieces: list[str]) -> list[str]:
    """Pieces painted left to right, in the order they are read: a permutation."""
    if not pieces:
        return []
    kinds = [_bidi_class(p) for p in pieces]
    for i in range(1, len(kinds) - 1):
        if kinds[i] == "S" and kinds[i - 1] == kinds[i + 1] == "N":
            kinds[i] = "N"
    rtl = kinds.count("R") > kinds.count("L")
    base = 1 if rtl else 0
    # The direction each piece lends to its neighbours: numbers count as right-to-left
    # unless left-to-right text leads them in a left-to-right line.
    strong, lent = "R" if rtl else "L", []
    for kind in kinds:
        if kind == "N":
            lent.append("L" if not rtl and strong == "L" else "R")
        else:
            lent.append(kind if kind in ("L", "R") else "")
        if kind in ("L", "R"):
            strong = kind
    ahead, behind = [""] * len(kinds), [""] * len(kinds)
    for i in range(1, len(kinds)):
        behind[i] = lent[i - 1] or behind[i - 1]
    for i in range(len(kinds) - 2, -1, -1):
        ahead[i] = lent[i + 1] or ahead[i + 1]
    levels = []
    for i, kind in enumerate(kinds):
        if kind == "R":
            levels.append(1)
        elif kind == "L":
            levels.append(2 * base)
        elif kind == "N":
            levels.append(0 if lent[i] == "L" else 2)
        else:
            same = behind[i] if behind[i] == ahead[i] else ""
            levels.append({"R": 1, "L": 2 * base}.get(same, base))
    order = list(range(len(pieces)))
    for level in range(max(levels), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            if j > i:
                order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return [pieces[i] for i in order]
