"""Deeply nested records to flat tables through Merkle subtree identities.

Every object of a payload (a bookmark or a destination) is brought to one
canonical form and hashed bottom-up, so the identity of an object covers its
whole subtree and every attribute in it, known to these tables or not.  Two
objects with the same identity are the same object and are stored once in the
object table; each place where one stands is a bridge row ``(record_id, entity,
path, parent_path, ordinal, node, parent_node)``.  Attributes without a column
of their own are rows of :func:`attribute_rows`; a payload as a whole, with what
its wrappers say beside the list, is a row of :func:`record_rows`.

Accepted notations: key spellings in any letter case (``Title``/``title``,
``Destination``/``Dest``, ``Children``/``Kids``, ``Outlines``/``Outline``/
``Bookmarks``), wrapper objects around the list, children as a list, as one
bare object, as an object with numeric keys or as a JSON string of any of
these; destinations as an object, as ``[page, kind, x, y, zoom]`` or as a bare
name.

Nesting has no bound: parser, walk, hashing and canonical text keep their own
stacks, and a batch of rows ends by its characters, as a path is as long as its
place is deep.

Defined results: a NULL, empty or ill-formed payload gives no rows and is
counted in the ``readable`` column of :func:`payload_status`; NULL entries of a
list are not counted in the path; a destination without name and page (page 0
is none) gives no row and stays an attribute of its bookmark; of two spellings
of one key the first non-null one counts and the other is an attribute; repeated
records (same ``record_id`` and payload) count once, differing payloads under
one id are kept by the smallest one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE, DEST, KIDS = ("title",), ("destination", "dest"), ("children", "kids")
PLACE = ("name", "page", "x", "y", "zoom")
ROOTS = ("outlines", "outline", "bookmarks")
#: Rows, and characters of paths, after which a batch of rows is handed on.
BATCH_ROWS, BATCH_CHARS = 50_000, 16_000_000

BRIDGE = (
    "record_id bigint, entity string, path string, parent_path string, depth int, ordinal int, node string, parent_node string, "
    "title string, dest_name string, dest_page bigint, dest_x double, dest_y double, dest_zoom double, n_children int, attributes array<struct<name: string, value: string>>"
)


class Malformed(ValueError):
    pass


# ---- JSON without a bound on nesting ----------------------------------------


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


def _whole(digits: str) -> int | float:
    return int(digits) if len(digits) < 400 else float(digits)


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_whole)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?P<number>(?P<whole>-?(?:0|[1-9][0-9]*))(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}
_OPEN = object()


def _loads(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _loads_deep(text)
    except ValueError as e:
        raise Malformed(str(e)) from None


def _loads_deep(text: str):
    """The same value as the library's parser, with a stack of open containers instead of recursion."""
    skip = lambda at: _SPACE.match(text, at).end()
    stack: list[tuple[list | dict, str | None]] = []
    at, end = skip(0), len(text)

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise Malformed("key expected")
        try:
            name, at = scanstring(text, at + 1, True)
        except ValueError as e:
            raise Malformed(str(e)) from None
        at = skip(at)
        if text[at : at + 1] != ":":
            raise Malformed("colon expected")
        return name, skip(at + 1)

    while True:
        sign = text[at : at + 1]
        value = _OPEN
        if sign == "{":
            at = skip(at + 1)
            if text[at : at + 1] == "}":
                value, at = {}, at + 1
            else:
                name, at = key(at)
                stack.append(({}, name))
        elif sign == "[":
            at = skip(at + 1)
            if text[at : at + 1] == "]":
                value, at = [], at + 1
            else:
                stack.append(([], None))
        elif sign == '"':
            try:
                value, at = scanstring(text, at + 1, True)
            except ValueError as e:
                raise Malformed(str(e)) from None
        else:
            found = _SCALAR.match(text, at)
            if found is None:
                raise Malformed("value expected")
            at = found.end()
            whole = found["whole"]
            value = _WORDS[found[0]] if whole is None else _whole(whole) if whole == found[0] else float(found[0])
        while value is not _OPEN:
            at = skip(at)
            if not stack:
                if at != end:
                    raise Malformed("text after the value")
                return value
            holder, name = stack[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            sign, at = text[at : at + 1], skip(at + 1)
            if sign == ("]" if name is None else "}"):
                value = holder
                stack.pop()
                at = at if at <= end else end
                continue
            if sign != ",":
                raise Malformed("comma expected")
            if name is not None:
                name, at = key(at)
                stack[-1] = (holder, name)
            value = _OPEN


def canonical_json(value) -> str:
    """Text of a value with sorted keys and no spaces, at any depth."""
    try:
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [value]
    text = type("Text", (str,), {})  # what is written as it stands
    while stack:
        item = stack.pop()
        if isinstance(item, text):
            out.append(item)
        elif isinstance(item, dict):
            parts: list = [text("{")]
            for i, k in enumerate(sorted(item)):
                parts += [text(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), item[k]]
            stack += reversed([*parts, text("}")])
        elif isinstance(item, list):
            parts = [text("[")]
            for i, v in enumerate(item):
                parts += [text(","), v] if i else [v]
            stack += reversed([*parts, text("]")])
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


# ---- notations --------------------------------------------------------------


def _field(obj: dict, names: tuple[str, ...]):
    """(key, first non-null value under any spelling of a key)."""
    for key, value in obj.items():
        if value is not None and key.lower() in names:
            return key, value
    return None, None


_ROLES = {name: role for role, names in enumerate((TITLE, DEST, KIDS)) for name in names}


def _parts(obj: dict) -> tuple[list, list[tuple[str, object]]]:
    """([title, destination, children], everything else): one pass over the keys of a bookmark."""
    found, rest = [None, None, None], []
    for key, value in obj.items():
        role = _ROLES.get(key)
        if role is None:
            role = _ROLES.get(key.lower())
        if role is None:
            rest.append((key, value))
        elif value is not None:
            if found[role] is None:
                found[role] = value
            else:  # a second spelling
                rest.append((key, value))
    return found, rest


def _attributes(obj: dict, used: set[str | None], drop: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(key in lower case, canonical value) of what is not in ``used``; NULLs under the names in ``drop`` say nothing."""
    found = []
    for key, value in obj.items():
        if key not in used and not (value is None and key.lower() in drop):
            found.append((key.lower(), canonical_json(value)))
    return sorted(found)


def _entries(value) -> list[dict]:
    """The bookmarks that a children value stands for, NULL entries left out."""
    while isinstance(value, str):
        if not value.strip():
            return []
        value = _loads(value)
    if isinstance(value, dict):
        if value and all(k.isdigit() for k in value):
            value = [value[k] for k in sorted(value, key=lambda k: (int(k), k))]
        else:
            value = [value] if value else []
    if not isinstance(value, list):
        return []
    out = []
    for item in value:
        while isinstance(item, str) and item.strip()[:1] in ("{", '"'):
            item = _loads(item)
        if isinstance(item, dict):
            out.append(item)
    return out


def _roots(value):
    """(the top list, attributes of the wrappers), through wrappers such as {"doc": {"Outlines": …}}."""
    beside: list[tuple[str, str]] = []
    while True:
        if isinstance(value, str):
            if not value.strip():
                return [], beside
            value = _loads(value)
            continue
        if not isinstance(value, dict):
            return value, beside
        key, inner = _field(value, ROOTS)
        if inner is not None:
            beside += _attributes(value, {key}, ROOTS)
            value = inner
            continue
        if any(k.lower() in ROOTS for k in value):
            return [], beside + _attributes(value, set(), ROOTS)
        lower = {k.lower() for k in value}
        if lower & {*TITLE, *DEST, *KIDS} or (value and all(k.isdigit() for k in value)):
            return value, beside
        nested = [k for k, v in value.items() if isinstance(v, dict)]
        if not nested:
            return [], beside + _attributes(value, set())
        key = next((k for k in nested if any(x.lower() in ROOTS for x in value[k])), nested[0])
        beside += _attributes(value, {key})
        value = value[key]


def _number(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _destination(value) -> tuple[tuple[str | None, int | None, float | None, float | None, float | None] | None, list[tuple[str, str]]]:
    """((name, page, x, y, zoom), attributes); the first is None where neither a name nor a page is given."""
    name = page = x = y = zoom = None
    beside: list[tuple[str, str]] = []
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            value = _loads(value)
        except Malformed:
            pass
    if isinstance(value, str):
        name = value
    elif isinstance(value, dict):
        picked: dict = dict.fromkeys(PLACE)
        for key, v in value.items():
            low = key.lower()
            if low in picked and picked[low] is None:
                picked[low] = v
            elif v is not None or low not in picked:
                beside.append((low, canonical_json(v)))
        name, page, x, y, zoom = picked.values()
        name = None if name is None else name if isinstance(name, str) else canonical_json(name)
        page, x, y, zoom = _number(page), _number(x), _number(y), _number(zoom)
        beside.sort()
    elif isinstance(value, list) and value:
        if isinstance(value[0], str) and _number(value[0]) is None:
            name = value[0]
        else:
            page = _number(value[0])
        rest = [_number(v) for v in value[2:5]]
        x, y, zoom = [*rest, None, None, None][:3]
        beside = [(f"#{i}", canonical_json(v)) for i, v in enumerate(value) if v is not None and (i == 1 or i > 4)]
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        page = float(value)
    if page is not None and (page != page or page < 1 or abs(page) > 2**53):
        page = None
    if name is not None and not name.strip():
        name = None
    if name is None and page is None:
        return None, []
    return (name, None if page is None else int(page), x, y, zoom), beside


_TEXT = json.JSONEncoder(ensure_ascii=True, separators=(",", ":")).encode


def _hash(*parts) -> str:
    return hashlib.blake2b(_TEXT(parts).encode(), digest_size=16).hexdigest()


# ---- one payload ------------------------------------------------------------


class Tree:
    """The bookmarks of one payload in reading order, each with the identity of its subtree."""

    __slots__ = ("parent", "ordinal", "depth", "title", "dest", "dest_attributes", "attributes", "kids", "node", "dest_node", "top", "root")

    def __init__(self, payload: str | None):
        if payload is None or not payload.strip():
            raise Malformed("empty")
        entries, self.top = _roots(_loads(payload))
        for name in ("parent", "ordinal", "depth", "title", "dest", "dest_attributes", "attributes", "kids"):
            setattr(self, name, [])
        stack = [(item, i, None, 0) for i, item in enumerate(_entries(entries))][::-1]
        while stack:
            item, ordinal, parent, depth = stack.pop()
            at = len(self.parent)
            (title, dest, kids), rest = _parts(item)
            place, beside = (None, []) if dest is None else _destination(dest)
            kids = [] if kids is None else _entries(kids)
            if place is None and dest is not None and dest != "":
                rest.append(("destination", dest))
            self.parent.append(parent)
            self.ordinal.append(ordinal)
            self.depth.append(depth)
            self.title.append(title if title is None or isinstance(title, str) else canonical_json(title))
            self.dest.append(place)
            self.dest_attributes.append(beside)
            self.attributes.append(sorted((k.lower(), canonical_json(v)) for k, v in rest) if rest else rest)
            self.kids.append([])
            if parent is not None:
                self.kids[parent].append(at)
            stack += [(kid, i, at, depth + 1) for i, kid in enumerate(kids)][::-1]
        n = len(self.parent)
        self.node, self.dest_node = [""] * n, [None] * n
        for at in range(n - 1, -1, -1):  # children stand behind their parent
            if self.dest[at]:
                self.dest_node[at] = _hash("destination", *self.dest[at], self.dest_attributes[at])
            self.node[at] = _hash("outline", self.title[at], self.dest_node[at], self.attributes[at], [self.node[k] for k in self.kids[at]])
        self.root = _hash("record", self.top, [self.node[k] for k in range(n) if self.parent[k] is None])

    def rows(self, record_id: int) -> Iterator[tuple]:
        """Bridge rows in reading order; paths are written one at a time, so none is held."""
        trail: list[str] = []
        none = (None,) * 5
        for at, parent in enumerate(self.parent):
            depth = self.depth[at]
            del trail[depth:]
            above = ".".join(trail)
            trail.append(str(self.ordinal[at]))
            path = f"{above}.{trail[-1]}" if depth else trail[-1]
            up = None if parent is None else self.node[parent]
            yield record_id, "outline", path, above, depth, self.ordinal[at], self.node[at], up, self.title[at], *none, len(self.kids[at]), self.attributes[at]
            if self.dest[at]:
                yield record_id, "destination", path, path, depth, 0, self.dest_node[at], self.node[at], None, *self.dest[at], 0, self.dest_attributes[at]


def flatten(record_id: int, payload: str | None) -> list[tuple]:
    """Bridge rows of one payload; raises :class:`Malformed` if it cannot be read."""
    return list(Tree(payload).rows(record_id))


COLUMNS = [c.strip().split(" ")[0] for c in BRIDGE.split(", attributes ")[0].split(",")] + ["attributes"]
_PAIR = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_TYPES = {"record_id": pa.int64(), "depth": pa.int32(), "ordinal": pa.int32(), "dest_page": pa.int64(), "dest_x": pa.float64(), "dest_y": pa.float64(), "dest_zoom": pa.float64(), "n_children": pa.int32(), "attributes": _PAIR}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(COLUMNS)
    columns[-1] = [[{"name": k, "value": v} for k, v in pairs] if pairs else () for pairs in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES.get(n, pa.string())) for n, c in zip(COLUMNS, columns)], names=COLUMNS)


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        chars = 0
        for record_id, payload in zip(batch.column("record_id").to_pylist(), batch.column("payload")):
            try:
                tree = Tree(payload.as_py())
            except Malformed:
                continue
            for row in tree.rows(record_id):
                rows.append(row)
                chars += len(row[2])
                if len(rows) >= BATCH_ROWS or chars > BATCH_CHARS:
                    yield _batch(rows)
                    rows, chars = [], 0
        yield _batch(rows)


def _records(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """One row per record; re-delivered copies fall together before any parsing."""
    pair = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).cast("string").alias("payload"))
    return pair.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min("payload").alias("payload"))


def bridge_rows(df: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """One row per occurrence of an object, with its own and its parent's identity."""
    return _records(df, id_col, payload_col).mapInArrow(_flatten_batches, BRIDGE)


def object_rows(bridge: DataFrame) -> DataFrame:
    """Each distinct object once, with the number of its occurrences.

    Objects of one identity have equal content, so ``first`` is exact; the count
    is combined before the shuffle, which keeps a subtree that occurs in a third
    of all records from becoming one task's work.
    """
    content = ["entity", "title", "dest_name", "dest_page", "dest_x", "dest_y", "dest_zoom", "n_children"]
    return bridge.groupBy("node").agg(*(F.first(c, ignorenulls=False).alias(c) for c in content), F.count(F.lit(1)).alias("occurrences"))


def attribute_rows(bridge: DataFrame) -> DataFrame:
    """(node, entity, name, value, occurrences): attributes without a column of their own, once per distinct object.

    ``name`` is the key in lower case (``#i`` for a position of a destination's
    list), ``value`` its canonical JSON.
    """
    some = bridge.where(F.size("attributes") > 0).select("node", "entity", "attributes")
    once = some.groupBy("node", "entity").agg(F.first("attributes").alias("attributes"), F.count(F.lit(1)).alias("occurrences"))
    return once.select("node", "entity", F.explode("attributes").alias("a"), "occurrences").select("node", "entity", "a.name", "a.value", "occurrences")


def edge_rows(bridge: DataFrame) -> DataFrame:
    """Parent-child links between distinct objects, with the ordinal in the parent."""
    links = bridge.where(F.col("parent_node").isNotNull())
    return links.groupBy("parent_node", "entity", "ordinal", "node").agg(F.count(F.lit(1)).alias("occurrences"))


def record_rows(df: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, node, n_top, attributes): identity of each readable payload as a whole, and what its wrappers say."""
    types = pa.schema([("record_id", pa.int64()), ("node", pa.string()), ("n_top", pa.int32()), ("attributes", _PAIR)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record_id, payload in zip(batch.column("record_id").to_pylist(), batch.column("payload")):
                try:
                    tree = Tree(payload.as_py())
                except Malformed:
                    continue
                out.append({"record_id": record_id, "node": tree.root, "n_top": tree.parent.count(None), "attributes": [{"name": k, "value": v} for k, v in tree.top]})
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return _records(df, id_col, payload_col).mapInArrow(read, "record_id bigint, node string, n_top int, attributes array<struct<name: string, value: string>>")


def payload_status(df: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, readable, n_outlines, n_destinations) for every record."""
    types = pa.schema([("record_id", pa.int64()), ("readable", pa.bool_()), ("n_outlines", pa.int32()), ("n_destinations", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record_id, payload in zip(batch.column("record_id").to_pylist(), batch.column("payload")):
                try:
                    tree = Tree(payload.as_py())
                    row = (record_id, True, len(tree.parent), sum(d is not None for d in tree.dest))
                except Malformed:
                    row = (record_id, False, 0, 0)
                out.append(dict(zip(types.names, row)))
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return _records(df, id_col, payload_col).mapInArrow(count, "record_id bigint, readable boolean, n_outlines int, n_destinations int")
