"""PDF functions of types 0, 2, 3 and 4, as used by tint transforms."""

from __future__ import annotations

import itertools
import math
import operator
import re

from foliospark.kernel import filters
from foliospark.kernel.objects import Stream

MAX_STACK, MAX_NESTING, MAX_STEPS = 100, 64, 65536


def _finite(v: float) -> float:
    return v if isinstance(v, int) or math.isfinite(v) else 0.0


def _clip(values, limits):
    return [min(max(v, lo), hi) for v, lo, hi in zip(values, limits[::2], limits[1::2])] if limits else list(values)


class Function:
    """``f(inputs)`` gives the outputs; both are clipped to domain and range."""

    def __init__(self, file, value, depth: int = 0):
        value = file.get(value)
        info = value.attributes if isinstance(value, Stream) else value
        if not isinstance(info, dict) or depth > 8:
            raise ValueError("no function")
        numbers = lambda k: [float(v) for v in file.items(info.get(k)) if isinstance(v, (int, float))]
        self.domain, self.range = numbers("Domain"), numbers("Range")
        kind = file.get(info.get("FunctionType"))
        if kind == 2:
            self.c0, self.c1 = numbers("C0") or [0.0], numbers("C1") or [1.0]
            self.power = float(file.get(info.get("N")) or 0)
            self._run = self._exponential
        elif kind == 3:
            self.parts = [Function(file, f, depth + 1) for f in file.get(info.get("Functions")) or []]
            self.bounds, self.encode = numbers("Bounds"), numbers("Encode")
            if not self.parts or len(self.bounds) != len(self.parts) - 1:
                raise ValueError("stitching function without parts")
            self._run = self._stitched
        elif kind in (0, 4) and isinstance(value, Stream):
            try:
                body = file.body(value)
            except filters.Problem as e:
                body = e.kept
            if kind == 4:
                self.program = _parse(body)
                self._run = self._calculated
            else:
                self._load_samples(file, info, numbers, body)
                self._run = self._sampled
        else:
            raise ValueError(f"function type {kind}")

    def __call__(self, inputs) -> list[float]:
        inputs = _clip([float(v) for v in inputs], self.domain)
        return [_finite(v) for v in _clip(self._run(inputs), self.range)]

    def _exponential(self, inputs):
        try:
            t = _finite(inputs[0] ** self.power)
        except (ZeroDivisionError, OverflowError):
            t = 0.0
        if isinstance(t, complex):
            t = 0.0
        return [a + t * (b - a) for a, b in zip(self.c0, self.c1)]

    def _stitched(self, inputs):
        x = inputs[0]
        k = sum(x >= b for b in self.bounds)
        lo = self.bounds[k - 1] if k else self.domain[0]
        hi = self.bounds[k] if k < len(self.bounds) else self.domain[1]
        a, b = self.encode[2 * k : 2 * k + 2] or (0.0, 1.0)
        return self.parts[k]([a if hi == lo else a + (x - lo) * (b - a) / (hi - lo)])

    def _load_samples(self, file, info, numbers, body):
        self.sizes = [int(v) for v in numbers("Size")]
        bits = int(file.get(info.get("BitsPerSample")) or 8)
        outputs = len(self.range) // 2
        self.encode = numbers("Encode") or [v for n in self.sizes for v in (0.0, n - 1.0)]
        self.decode = numbers("Decode") or self.range
        count = math.prod(self.sizes) * outputs
        if count > 1 << 22 or bits not in (1, 2, 4, 8, 12, 16, 24, 32):
            raise ValueError("sample table out of bounds")
        whole = int.from_bytes(body, "big") if bits < 8 or bits == 12 else 0
        if whole or bits < 8 or bits == 12:
            total = len(body) * 8
            self.samples = [whole >> max(total - (i + 1) * bits, 0) & ((1 << bits) - 1) if (i + 1) * bits <= total else 0 for i in range(count)]
        else:
            step = bits // 8
            self.samples = [int.from_bytes(body[i * step : (i + 1) * step], "big") for i in range(count)]
        self.top, self.outputs = (1 << bits) - 1, outputs

    def _sampled(self, inputs):
        corners = []
        for i, (x, n) in enumerate(zip(inputs, self.sizes)):
            lo, hi = self.domain[2 * i : 2 * i + 2]
            a, b = self.encode[2 * i : 2 * i + 2]
            e = a if hi == lo else a + (x - lo) * (b - a) / (hi - lo)
            e = min(max(e, 0.0), n - 1.0)
            low = min(int(e), max(n - 2, 0))
            corners.append(((low, 1 - (e - low)), (min(low + 1, n - 1), e - low)))
        out = [0.0] * self.outputs
        for corner in itertools.product(*corners):
            weight = math.prod(w for _, w in corner)
            if not weight:
                continue
            at, step = 0, 1
            for (i, _), n in zip(corner, self.sizes):
                at += i * step
                step *= n
            for k in range(self.outputs):
                out[k] += weight * self.samples[at * self.outputs + k]
        return [a + v * (b - a) / self.top for v, a, b in zip(out, self.decode[::2], self.decode[1::2])]

    def _calculated(self, inputs):
        stack = list(inputs)
        try:
            _execute(self.program, stack, [0])
        except (IndexError, ZeroDivisionError, OverflowError, ValueError, TypeError):
            pass
        want = len(self.range) // 2 or len(stack)
        top = [float(v) for v in stack[-want:]] if want else []
        return [0.0] * (want - len(top)) + top


def _parse(body: bytes):
    words = re.findall(rb"[{}]|[^\s{}%]+", re.sub(rb"%[^\r\n]*", b"", body))
    at = 0

    def block(depth: int):
        nonlocal at
        if depth > MAX_NESTING:
            raise ValueError("procedures nest too deep")
        out = []
        while at < len(words):
            w = words[at].decode("latin-1")
            at += 1
            if w == "}":
                return out
            if w == "{":
                out.append(block(depth + 1))
            else:
                try:
                    out.append(float(w) if any(c in w for c in ".eE") else int(w))
                except ValueError:
                    if w not in OPERATORS and w not in ("if", "ifelse"):
                        raise ValueError(f"unknown operator {w}") from None
                    out.append(w)
        return out

    program = block(0)
    return program[0] if len(program) == 1 and isinstance(program[0], list) else program


def _push(stack: list, v) -> None:
    if len(stack) >= MAX_STACK:
        raise OverflowError
    stack.append(_finite(v))


def _execute(program, stack: list, steps: list) -> None:
    i = 0
    while i < len(program):
        item = program[i]
        steps[0] += 1
        if steps[0] > MAX_STEPS:
            raise OverflowError
        if isinstance(item, (int, float)):
            _push(stack, item)
        elif isinstance(item, list):
            choice = program[i + 1 : i + 3]
            if choice[:1] == ["if"]:
                if stack.pop():
                    _execute(item, stack, steps)
                i += 1
            elif len(choice) == 2 and isinstance(choice[0], list) and choice[1] == "ifelse":
                _execute(item if stack.pop() else choice[0], stack, steps)
                i += 2
        else:
            OPERATORS[item](stack)
        i += 1


def _unary(f):
    return lambda s: _push(s, f(s.pop()))


def _binary(f):
    def run(s):
        b, a = s.pop(), s.pop()
        _push(s, f(a, b))

    return run


def _small(f):
    """Integers stay integers only while they fit 32 bits."""

    def run(a, b):
        v = f(a, b)
        return float(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 0x7FFFFFFF else v

    return run


def _logic(on_bool, on_int):
    return lambda a, b: on_bool(a, b) if isinstance(a, bool) and isinstance(b, bool) else on_int(int(a), int(b))


def _copy(s):
    n = int(s.pop())
    if n < 0 or n > len(s) or len(s) + n > MAX_STACK:
        raise IndexError
    s += s[len(s) - n :]


def _index(s):
    n = int(s.pop())
    _push(s, s[-1 - n]) if 0 <= n < len(s) else s[len(s) + 1]


def _roll(s):
    j, n = int(s.pop()), int(s.pop())
    if n < 0 or n > len(s):
        raise IndexError
    if n:
        part = s[-n:]
        j %= n
        s[-n:] = part[-j:] + part[:-j] if j else part


def _shift(a, b):
    a, b = int(a), int(b)
    if abs(b) >= 32:
        return 0
    v = (a << b if b > 0 else (a & 0xFFFFFFFF) >> -b) & 0xFFFFFFFF
    return v - (1 << 32) if v & 0x80000000 else v


def _whole(a, b):
    q = abs(int(a)) // abs(int(b))
    return q if (a < 0) == (b < 0) else -q


OPERATORS = {
    "abs": _unary(abs), "add": _binary(_small(operator.add)), "sub": _binary(_small(operator.sub)), "mul": _binary(_small(operator.mul)), "div": _binary(operator.truediv), "idiv": _binary(_whole), "mod": _binary(lambda a, b: int(math.fmod(int(a), int(b)))), "neg": _unary(operator.neg),
    "ceiling": _unary(lambda v: v if isinstance(v, int) else float(math.ceil(v))), "floor": _unary(lambda v: v if isinstance(v, int) else float(math.floor(v))), "round": _unary(lambda v: v if isinstance(v, int) else float(math.floor(v + 0.5))), "truncate": _unary(lambda v: v if isinstance(v, int) else float(math.trunc(v))), "cvi": _unary(int), "cvr": _unary(float),
    "sqrt": _unary(math.sqrt), "exp": _binary(lambda a, b: float(a) ** b), "ln": _unary(math.log), "log": _unary(math.log10), "sin": _unary(lambda v: math.sin(math.radians(v))), "cos": _unary(lambda v: math.cos(math.radians(v))), "atan": _binary(lambda a, b: math.degrees(math.atan2(a, b)) % 360),
    "and": _binary(_logic(operator.and_, operator.and_)), "or": _binary(_logic(operator.or_, operator.or_)), "xor": _binary(_logic(operator.xor, operator.xor)), "not": _unary(lambda v: not v if isinstance(v, bool) else ~int(v)), "bitshift": _binary(_shift),
    "eq": _binary(operator.eq), "ne": _binary(operator.ne), "gt": _binary(operator.gt), "ge": _binary(operator.ge), "lt": _binary(operator.lt), "le": _binary(operator.le), "true": lambda s: _push(s, True), "false": lambda s: _push(s, False),
    "pop": lambda s: s.pop(), "exch": lambda s: s.insert(len(s) - 2, s.pop()) if len(s) > 1 else s[2], "dup": lambda s: _push(s, s[-1]), "copy": _copy, "index": _index, "roll": _roll,
}
