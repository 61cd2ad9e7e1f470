"""One file to rows: documents, pages, glyphs, images, outlines, annotations, form fields, warnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from foliospark.kernel import ciphers, encodings, filters, fonts, pictures
from foliospark.kernel.interpreter import IDENTITY, Limits, Run, State, Stop, Strict, Walker, product
from foliospark.kernel.layout import Glyphs, Layout
from foliospark.kernel.layout import Options as LayoutOptions
from foliospark.kernel.objects import Name, Ref, Stream
from foliospark.kernel.reader import File, Unreadable

#: Codes a warning may have.
CODES = ("malformed_document", "malformed_page", "stream_error", "stream_limit", "work_limit", "unsupported", "ocr")
OCR_POLICIES = ("none", "textless", "images", "all")


@dataclass(frozen=True)
class Options:
    """What to read.  ``pages`` are inclusive 1-based ranges, 0 for the end."""

    pages: tuple[tuple[int, int], ...] = ()
    passwords: tuple[str, ...] = ()
    images: bool = False
    extras: bool = True
    appearances: bool = True
    fold_ligatures: bool = True
    ignore_artifacts: bool = False
    strict: bool = False
    layout: LayoutOptions = LayoutOptions()
    limits: Limits = Limits()
    resolve_cmap: object = None
    collections: dict | None = None
    ocr: object = None
    ocr_policy: str = "none"
    #: Page texts are laid out from the glyphs that touch this rectangle: min_x, min_y, max_x, max_y.
    region: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        for first, last in self.pages:
            if first < 1 or last < 0 or (last and last < first):
                raise ValueError(f"bad page range {first}-{last}")
        if self.ocr_policy not in OCR_POLICIES:
            raise ValueError(f"unknown OCR policy {self.ocr_policy!r}")

    def wants(self, number: int) -> bool:
        return not self.pages or any(a <= number and (not b or number <= b) for a, b in self.pages)


@dataclass
class PageResult:
    number: int
    media_box: tuple[float, float, float, float]
    crop_box: tuple[float, float, float, float]
    rotation: int
    runs: list[Run]
    image_count: int = 0
    images: list[pictures.Image] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    ocr_glyphs: int = 0

    def glyphs(self) -> Glyphs:
        return Glyphs.of_runs(self.runs)

    def text(self, options: LayoutOptions = LayoutOptions()) -> str:
        return Layout(self.glyphs(), options, self.media_box).page_text()

    def text_in(self, box, options: LayoutOptions = LayoutOptions()) -> str:
        """Text laid out anew from the glyphs that touch a rectangle."""
        g = self.glyphs()
        return Layout(g.take(np.flatnonzero(g.within(box))), options, self.media_box).page_text()


@dataclass
class Document:
    page_count: int = 0
    pages: list[PageResult] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    outlines: list[dict] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    error: str | None = None

    def text(self, options: LayoutOptions = LayoutOptions()) -> str:
        return "\n\n".join(t for t in (p.text(options) for p in self.pages) if t)


def rectangle(file: File, value) -> tuple[float, float, float, float]:
    n = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0 for v in file.items(value)]
    if len(n) != 4:
        return (0.0, 0.0, 0.0, 0.0)
    return (min(n[0], n[2]), min(n[1], n[3]), max(n[0], n[2]), max(n[1], n[3]))


def text_of(file: File, value) -> str:
    value = file.get(value)
    if isinstance(value, bytes):
        return encodings.text_string(value)
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, float):
        return repr(value) if value != int(value) or abs(value) >= 1e21 else str(int(value))
    if isinstance(value, list):
        return ", ".join(t for t in (text_of(file, v) for v in value) if t)
    return str(value) if isinstance(value, (Name, int)) else ""


def read(content: bytes, options: Options = Options()) -> Document:
    """A whole document; one that cannot be read has ``error`` and no pages."""
    doc = Document()
    try:
        for page in read_pages(content, options, doc):
            doc.pages.append(page)
    except Strict as e:
        doc.error = str(e)
    return doc


def read_pages(content: bytes, options: Options = Options(), doc: Document | None = None) -> Iterator[PageResult]:
    """Pages one at a time; ``doc`` receives what belongs to the document."""
    doc = doc if doc is not None else Document()

    def warn(code: str, text: str) -> None:
        doc.warnings.append((code, text))
        if options.strict:
            raise Strict(f"{code}: {text}")

    passwords = tuple(dict.fromkeys((*(p.encode("utf-8") for p in options.passwords), b"")))
    try:
        file = File(bytes(content), passwords)
        cycles: list[tuple[str, str]] = []
        pages = file.pages(lambda *w: cycles.append(w))
        if not pages and not file.rebuilt:
            file.repair()
            pages = file.pages(lambda *w: cycles.append(w))
    except (Unreadable, ciphers.Denied, filters.Problem, ValueError, RecursionError) as e:
        doc.error = f"{type(e).__name__}: {e}"
        return
    if file.rebuilt:
        warn("malformed_document", "cross-reference table was rebuilt")
    for w in cycles:
        warn(*w)
    doc.page_count = len(pages)
    numbers = {p[""].number: i + 1 for i, p in enumerate(pages) if isinstance(p[""], Ref)}
    if options.extras:
        doc.metadata = metadata(file)
        doc.outlines = outlines(file, numbers, warn)
        doc.fields = form_fields(file, numbers, warn)
    cache: dict = {}
    for number, info in enumerate(pages, 1):
        if options.wants(number):
            page = read_page(file, info, number, numbers, options, cache)
            yield page
            if options.strict and page.warnings:
                raise Strict(f"{page.warnings[0][0]}: {page.warnings[0][1]}")


def read_page(file: File, info: dict, number: int, numbers: dict, options: Options, cache: dict) -> PageResult:
    media = rectangle(file, info.get("MediaBox"))
    crop = rectangle(file, info.get("CropBox")) if file.get(info.get("CropBox")) is not None else media
    turn = file.get(info.get("Rotate"))
    walker = Walker(file, options.limits, options.fold_ligatures, options.ignore_artifacts, options.strict, options.resolve_cmap, options.collections, fonts=cache)
    page = PageResult(number, media, crop, int(turn) % 360 if isinstance(turn, (int, float)) else 0, walker.runs)
    try:
        if options.extras:
            page.annotations = annotations(file, info, numbers)
        walker.walk(info.get("Contents"), info.get("Resources"), State())
        if options.appearances:
            appearances(walker, info)
    except (Stop, Strict):
        pass
    walker.settle()
    page.image_count = len(walker.images)
    chosen = options.ocr is not None and {"none": False, "all": True, "textless": not walker.glyphs, "images": bool(walker.images)}[options.ocr_policy]
    try:
        if options.images or chosen:
            spent, failed = 0, set()
            for painted in walker.images:
                try:
                    image = pictures.load(file, painted, min(options.limits.stream_bytes, pictures.PAGE_BYTES - spent))
                    spent += len(image.data)
                    page.images.append(image)
                except (pictures.Unsupported, filters.Problem, ValueError, TypeError) as e:
                    key = id(painted.stream)
                    if painted.stream is None or key not in failed:
                        walker.warn("unsupported", f"image: {e}")
                    failed.add(key)
        if chosen:
            try:
                for run in options.ocr(page):
                    run.origin = "ocr"
                    walker.runs.append(run)
                    page.ocr_glyphs += len(run)
            except Exception as e:  # the caller's engine: keep the page
                walker.warn("ocr", f"{type(e).__name__}: {e}")
        if not options.images:
            page.images = []
    except Strict:
        pass
    page.warnings = walker.warnings
    return page


# ---- document extras --------------------------------------------------------

# Keys of the information dictionary.
KNOWN = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modified_date", "Trapped": "trapped"}


def metadata(file: File) -> dict:
    info = file.get(file.trailer.get("Info"))
    out = {v: "" for v in KNOWN.values()} | {"custom": {}, "xmp": None}
    for key, value in (info if isinstance(info, dict) else {}).items():
        text = text_of(file, value)
        if key in KNOWN:
            out[KNOWN[key]] = text
        elif text:
            out["custom"][key] = text
    xmp = file.key(file.trailer.get("Root"), "Metadata")
    if isinstance(xmp, Stream):
        try:
            out["xmp"] = file.body(xmp)
        except filters.Problem as e:
            out["xmp"] = e.kept
    return out


def destination(file: File, value, numbers: dict) -> dict | None:
    value = file.get(value)
    if isinstance(value, (Name, bytes)):
        return {"name": text_of(file, value), "page": 0, "x": 0.0, "y": 0.0, "zoom": 0.0}
    if not isinstance(value, list) or not value:
        return None
    n = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0 for v in map(file.get, value[2:6])] + [0.0] * 4
    page = numbers.get(value[0].number, 0) if isinstance(value[0], Ref) else 0
    kind = str(file.get(value[1])) if len(value) > 1 else ""
    x, y, zoom = {"XYZ": (n[0], n[1], n[2]), "FitH": (0.0, n[0], 0.0), "FitBH": (0.0, n[0], 0.0), "FitV": (n[0], 0.0, 0.0), "FitBV": (n[0], 0.0, 0.0), "FitR": (n[0], n[1], 0.0)}.get(kind, (0.0, 0.0, 0.0))
    return {"name": "", "page": page, "x": x, "y": y, "zoom": zoom}


def outlines(file: File, numbers: dict, warn=lambda *w: None) -> list[dict]:
    """Adjacency rows in reading order: node, parent, depth, ordinal, title, destination."""
    out: list[dict] = []
    seen: set[int] = set()
    first = file.key(file.trailer.get("Root"), "Outlines")
    stack = [(first.get("First") if isinstance(first, dict) else None, None, 0, 0)]
    while stack and len(out) < 50_000:
        value, parent, depth, ordinal = stack.pop()
        item = file.get(value)
        if isinstance(item, dict) and depth > 64:
            warn("malformed_document", "outline is nested too deeply")
            continue
        if not isinstance(item, dict):
            if value is not None:
                warn("malformed_document", "outline entry is no dictionary")
            continue
        if isinstance(value, Ref):
            if value.number in seen:
                warn("malformed_document", f"outline entry {value.number} repeats")
                continue
            seen.add(value.number)
        target = item.get("Dest")
        if file.get(target) is None:
            target = (file.key(item, "A") or {}).get("D") if isinstance(file.key(item, "A"), dict) else None
        node = len(out)
        out.append({"node": node, "parent": parent, "depth": depth, "ordinal": ordinal, "title": text_of(file, item.get("Title")), "destination": destination(file, target, numbers)})
        stack.append((item.get("Next"), parent, depth, ordinal + 1))
        stack.append((item.get("First"), node, depth + 1, 0))
    if stack:
        warn("malformed_document", "outline has too many entries")
    return out


def annotations(file: File, page: dict, numbers: dict) -> list[dict]:
    out = []
    for note in file.items(page.get("Annots")):
        if not isinstance(note, dict):
            continue
        action = file.key(note, "A")
        action = action if isinstance(action, dict) else {}
        target = note.get("Dest") if file.get(note.get("Dest")) is not None else action.get("D")
        out.append(
            {
                "subtype": str(file.key(note, "Subtype") or ""), "rect": rectangle(file, note.get("Rect")), "contents": text_of(file, note.get("Contents")), "title": text_of(file, note.get("T")),
                "url": text_of(file, action.get("URI")) if file.get(action.get("S")) == "URI" else "", "destination": destination(file, target, numbers),
            }
        )
    return out


def form_fields(file: File, numbers: dict, warn=lambda *w: None) -> list[dict]:
    """Terminal fields with dotted names; type, value and page come from ancestors where missing."""
    out: list[dict] = []
    seen: set[int] = set()
    form = file.key(file.trailer.get("Root"), "AcroForm")
    roots = file.get(form.get("Fields")) if isinstance(form, dict) else None
    stack = [(v, "", "", "", 0) for v in reversed(roots)] if isinstance(roots, list) else []
    nodes = 0
    while stack and nodes < 50_000:
        value, path, kind, text, page = stack.pop()
        nodes += 1
        item = file.get(value)
        if not isinstance(item, dict):
            continue
        if isinstance(value, Ref):
            if value.number in seen:
                warn("malformed_document", f"form field {value.number} repeats")
                stack = []
                break
            seen.add(value.number)
        name = ".".join(p for p in (path, text_of(file, item.get("T"))) if p)
        kind = str(file.key(item, "FT") or "") or kind
        text = text_of(file, item.get("V")) or text
        if isinstance(item.get("P"), Ref):
            page = numbers.get(item["P"].number, 0)
        inner = []
        for kid in file.get(item.get("Kids")) or [] if isinstance(file.get(item.get("Kids")), list) else []:
            widget = file.get(kid)
            if isinstance(widget, dict) and file.key(widget, "Subtype") == "Widget" and "FT" not in widget and "T" not in widget:
                if not page and isinstance(widget.get("P"), Ref):
                    page = numbers.get(widget["P"].number, 0)
            else:
                inner.append(kid)
        if inner:
            stack += [(k, name, kind, text, page) for k in reversed(inner)]
        elif name or kind or text:
            out.append({"name": name, "alternate_name": text_of(file, item.get("TU")), "type": kind, "value": text, "page": page})
    if stack:
        warn("malformed_document", "form has too many fields")
    return out


# ---- appearances ------------------------------------------------------------

HIDDEN, NO_VIEW = 2, 32
MULTILINE, PASSWORD, RADIO, PUSHBUTTON, COMBO = 1 << 12, 1 << 13, 1 << 15, 1 << 16, 1 << 17
MAX_RUNES = 4096


def _above(file: File, node, key: str):
    """An attribute of a field or of the nearest field above it."""
    for _ in range(64):
        if not isinstance(node, dict):
            return None
        if file.get(node.get(key)) is not None:
            return file.get(node[key])
        node = file.get(node.get("Parent"))
    return None


def appearances(walker: Walker, page: dict) -> None:
    """What annotations paint: their appearance streams, or a field's own value."""
    file = walker.file
    form = file.key(file.trailer.get("Root"), "AcroForm")
    form = form if isinstance(form, dict) else {}
    anew = file.get(form.get("NeedAppearances")) is True
    for note in file.items(page.get("Annots")):
        if not isinstance(note, dict):
            continue
        normal = (file.key(note, "AP") or {}).get("N") if isinstance(file.key(note, "AP"), dict) else None
        stream = file.get(normal)
        if isinstance(stream, dict):
            normal = stream.get(str(file.key(note, "AS") or ""))
            stream = file.get(normal)
        is_field = file.key(note, "Subtype") == "Widget"
        flags = file.key(note, "F")
        if (not isinstance(stream, Stream) and not is_field) or (type(flags) is int and flags & (HIDDEN | NO_VIEW)):
            continue
        if is_field and (anew or not isinstance(stream, Stream)) and draw_value(walker, note):
            continue
        if not isinstance(stream, Stream):
            continue
        fit = _fit(file, stream, rectangle(file, note.get("Rect")))
        if fit is None:
            continue
        resources = next((r for r in (file.key(stream, "Resources"), file.get(form.get("DR")), file.get(page.get("Resources"))) if isinstance(r, dict)), {})
        if walker.depth >= walker.limits.form_depth:
            walker.warn("work_limit", "form XObject nesting exceeds limit")
            return
        walker.depth += 1
        walker.drawing.append(fonts.reference_number(normal) or -1)
        walker.walk(stream, resources, State(ctm=fit))
        walker.drawing.pop()
        walker.depth -= 1


def _fit(file: File, stream: Stream, rect):
    """Form space onto the annotation's rectangle."""
    box = rectangle(file, stream.attributes.get("BBox"))
    m = [float(v) for v in file.items(stream.attributes.get("Matrix")) if isinstance(v, (int, float))]
    m = tuple(m) if len(m) == 6 else IDENTITY
    corners = [product((1, 0, 0, 1, x, y), m)[4:] for x in (box[0], box[2]) for y in (box[1], box[3])]
    lo = [min(c[i] for c in corners) for i in (0, 1)]
    hi = [max(c[i] for c in corners) for i in (0, 1)]
    if hi[0] <= lo[0] or hi[1] <= lo[1] or rect[2] <= rect[0] or rect[3] <= rect[1]:
        return None
    sx, sy = (rect[2] - rect[0]) / (hi[0] - lo[0]), (rect[3] - rect[1]) / (hi[1] - lo[1])
    return product(m, (sx, 0.0, 0.0, sy, rect[0] - lo[0] * sx, rect[1] - lo[1] * sy))


def font_size(appearance: str) -> float:
    words = appearance.split()
    for i in range(len(words) - 1, 0, -1):
        if words[i] == "Tf":
            try:
                size = float(words[i - 1])
            except ValueError:
                continue
            if 0 < size < 1000:
                return size
    return 0.0


def draw_value(walker: Walker, note: dict) -> bool:
    """Paint a field's value as a viewer would; False if it is no field that is drawn so."""
    file = walker.file
    up = lambda key: _above(file, note, key)
    flags = up("Ff") if type(up("Ff")) is int else 0
    kind, centred = str(up("FT") or ""), False
    if kind == "Btn":
        if flags & PUSHBUTTON:
            return False
        value = up("V")
        states = file.key(file.key(note, "AP"), "N")
        if not isinstance(value, Name) or value == "Off" or not isinstance(states, dict) or str(value) not in states:
            return True
        caption = text_of(file, (file.key(note, "MK") or {}).get("CA")) or ("l" if flags & RADIO else "4")
        lines, centred = [encodings.table("ZapfDingbatsEncoding")[ord(caption[0]) & 255]], True
    elif kind == "Tx":
        value = text_of(file, up("V"))
        if flags & PASSWORD:
            value = "*" * len(value)
        lines = value.replace("\r\n", "\n").replace("\r", "\n").split("\n") if flags & MULTILINE else [value]
    elif kind == "Ch":
        chosen = up("V")
        if flags & COMBO:
            lines = [text_of(file, chosen[0] if isinstance(chosen, list) and chosen else chosen)]
        else:
            lines = _options(file, note, up, chosen)
    else:
        return False
    x0, y0, x1, y1 = rectangle(file, note.get("Rect"))
    if x1 <= x0 or y1 <= y0:
        return True
    size = font_size(text_of(file, up("DA"))) or min(12.0, max(1.0, (y1 - y0 - 4) * 0.8))
    align = 1 if centred else up("Q") if type(up("Q")) is int else 0
    step, painted = size / 2, 0
    for i, line in enumerate(lines):
        base = y0 + (y1 - y0 - size) / 2 + 0.22 * size
        if len(lines) > 1:
            base = y1 - 2 - (i + 1) * size * 1.15 + 0.22 * size
            if base < y0:
                break
        long = len(line) * step
        x = x0 + (x1 - x0 - long) / 2 if align == 1 else x1 - 2 - long if align == 2 else x0 + 2
        room = MAX_RUNES - painted
        kept = [(k, c) for k, c in enumerate(line[:room]) if c != " "]
        painted += len(line)
        if kept:
            at = x + np.array([k for k, _ in kept]) * step
            walker.add(Run([c for _, c in kept], at, np.full(len(kept), base), np.full(len(kept), step), size, (1.0, 0.0), (0.0, size), origin="appearance"))
        if painted > MAX_RUNES:
            break
    return True


def _options(file: File, note: dict, up, chosen) -> list[str]:
    """The options a list box shows, from its top index or the selection on."""
    shown, exported = [], []
    for option in up("Opt") or []:
        option = file.get(option)
        pair = isinstance(option, list)
        shown.append(text_of(file, option[1] if len(option) > 1 else None) if pair else text_of(file, option))
        exported.append(text_of(file, option[0] if option else None) if pair else text_of(file, option))
    top = up("TI")
    if type(top) is int and 0 < top < len(shown):
        return shown[top:]
    picked = {text_of(file, v) for v in chosen} if isinstance(chosen, list) else {text_of(file, chosen)} - {""}
    first = next((i for i, e in enumerate(exported) if e in picked), 0)
    _, y0, _, y1 = rectangle(file, note.get("Rect"))
    size = font_size(text_of(file, up("DA"))) or 12.0
    return shown[first:] if first >= max(1, int((y1 - y0 - 2) / (size * 1.15))) else shown
