"""Colours of PDF content in any colour space, as red, green and blue.

Spaces: gray, RGB and CMYK, by device or calibrated; Lab; profiles by the number of their components; palettes; Separation and DeviceN
through their tint functions (sampled, exponential, stitched, calculator). What can't be evaluated, patterns too, is None: unknown, and
never a guess.
"""

from __future__ import annotations

import itertools
import math

_GRAY, _RGB, _CMYK = ("DeviceGray", "G", "CalGray"), ("DeviceRGB", "RGB", "CalRGB"), ("DeviceCMYK", "CMYK")
_MOST = 16  # components, spaces inside spaces, nested procedures

Rgb = tuple[float, float, float]


class Unknown(Exception):
    """A colour that can't be evaluated."""


def device(values: list[float]) -> Rgb:
    """Of one, three or four components."""
    v = [min(1.0, max(0.0, x)) for x in values]
    if len(v) == 1:
        return v[0], v[0], v[0]
    if len(v) == 3:
        return v[0], v[1], v[2]
    if len(v) == 4:
        return tuple((1 - c) * (1 - v[3]) for c in v[:3])
    raise Unknown


def rgb(doc, space, values: list, depth: int = 0) -> Rgb | None:
    """The colour with these components in a colour space; None if it is unknown."""
    try:
        return _convert(doc, space, [float(x) for x in values], depth)
    except (Unknown, TypeError, ValueError, KeyError, IndexError, ArithmeticError, AttributeError):
        return None


def start(doc, space) -> Rgb | None:
    """The colour that a space begins with."""
    try:
        space, name = doc.get(space), _name(doc, space)
        if name in _CMYK:
            return 0.0, 0.0, 0.0
        if name in ("Separation", "DeviceN"):
            n = len(doc.get(space[1])) if name == "DeviceN" else 1
            return rgb(doc, space, [1.0] * n)
        n = {"Lab": 3}.get(name, 1 if name in (*_GRAY, "Indexed", "I") else 3)
        if name == "ICCBased":
            n = doc.get(doc.get(space[1]).head["N"])
            if n == 4:
                return 0.0, 0.0, 0.0
        return rgb(doc, space, [0.0] * n)
    except (TypeError, KeyError, IndexError, AttributeError):
        return None


def _name(doc, space) -> str:
    space = doc.get(space)
    return str(doc.get(space[0])) if isinstance(space, list) and space else str(space)


def _convert(doc, space, v: list[float], depth: int) -> Rgb:
    if depth > _MOST:
        raise Unknown
    space, name = doc.get(space), _name(doc, space)
    if name in _GRAY + _RGB + _CMYK:
        if len(v) != (1 if name in _GRAY else 3 if name in _RGB else 4):
            raise Unknown
        return device(v)
    if not isinstance(space, list):
        raise Unknown
    if name == "ICCBased":
        head = doc.get(space[1]).head
        n = doc.get(head["N"])
        if len(v) != n:
            raise Unknown
        other = doc.get(head.get("Alternate"))
        return _convert(doc, other, v, depth + 1) if _name(doc, other) == "Lab" else device(v)
    if name == "Lab":
        return _lab(v, [float(doc.get(x)) for x in doc.get(doc.get(space[1])["WhitePoint"])])
    if name in ("Indexed", "I"):
        base, table = space[1], doc.get(space[3])
        table = table if isinstance(table, bytes) else doc.data(table)
        n = _components(doc, base)
        k = min(max(0, int(v[0])), doc.get(space[2]))
        own = [b / 255 for b in table[k * n:(k + 1) * n]]
        if len(own) != n:
            raise Unknown
        if _name(doc, base) == "Lab":
            own = [lo + x * (hi - lo) for x, (lo, hi) in zip(own, _lab_ranges(doc, base))]
        return _convert(doc, base, own, depth + 1)
    if name in ("Separation", "DeviceN"):
        names = doc.get(space[1])
        names = [doc.get(x) for x in names] if isinstance(names, list) else [names]
        if len(v) != len(names) or len(names) > _MOST or all(x == "None" for x in names):
            raise Unknown  # colorants of the name None leave no mark
        return _convert(doc, space[2], call(doc, space[3], v), depth + 1)
    raise Unknown


def _components(doc, space) -> int:
    name = _name(doc, space)
    if name == "ICCBased":
        return doc.get(doc.get(doc.get(space)[1]).head["N"])
    if name == "DeviceN":
        return len(doc.get(doc.get(space)[1]))
    return 1 if name in (*_GRAY, "Separation") else 4 if name in _CMYK else 3


def _lab_ranges(doc, space) -> list[tuple[float, float]]:
    r = [float(doc.get(x)) for x in doc.get(doc.get(doc.get(space)[1]).get("Range")) or (-100, 100, -100, 100)]
    return [(0.0, 100.0), (r[0], r[1]), (r[2], r[3])]


def _lab(v: list[float], white: list[float]) -> Rgb:
    """By way of XYZ, relative to the white point, to the RGB of screens."""
    m = (v[0] + 16) / 116
    g = [x ** 3 if x >= 6 / 29 else 108 / 841 * (x - 4 / 29) for x in (m + v[1] / 500, m, m - v[2] / 200)]
    x, y, z = (a * b for a, b in zip(g, (0.9505, 1.0, 1.089)))  # white stays white, whatever the light it was measured under
    if not all(w > 0 for w in white):
        raise Unknown
    linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z)
    return tuple(min(1.0, max(0.0, 12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055)) for c in linear)


# ---- functions ------------------------------------------------------------------------------------------------------------------


def call(doc, function, inputs: list[float], depth: int = 0) -> list[float]:
    """The outputs of a PDF function; of an array of functions, those of all."""
    function = doc.get(function)
    if depth > _MOST:
        raise Unknown
    if isinstance(function, list):
        return [x for f in function for x in call(doc, f, inputs, depth + 1)]
    head = function if isinstance(function, dict) else function.head
    numbers = lambda key, other=None: [float(doc.get(x)) for x in doc.get(head.get(key)) or other or []]
    v = _clip(inputs, numbers("Domain"))
    kind = doc.get(head["FunctionType"])
    if kind == 0:
        out = _sampled(doc, function, v, numbers)
    elif kind == 2:
        c0, c1, n = numbers("C0", [0.0]), numbers("C1", [1.0]), float(doc.get(head["N"]))
        out = [a + v[0] ** n * (b - a) for a, b in zip(c0, c1)]
    elif kind == 3:
        out = _stitched(doc, head, v[0], numbers, depth)
    elif kind == 4:
        out = run(parse(doc.data(function)), v)
    else:
        raise Unknown
    return _clip(out, numbers("Range"))


def _clip(v: list[float], bounds: list[float]) -> list[float]:
    if not bounds:
        return list(v)
    if len(bounds) < 2 * len(v):
        v = v[len(v) - len(bounds) // 2:]  # a procedure may leave more below its results
    return [min(max(x, lo), hi) for x, lo, hi in zip(v, bounds[::2], bounds[1::2])]


def _between(x: float, a: float, b: float, c: float, d: float) -> float:
    return c if a == b else c + (x - a) * (d - c) / (b - a)


def _sampled(doc, function, v: list[float], numbers) -> list[float]:
    """Between the samples around a point, by the distance to each."""
    size, bits, data = [int(x) for x in numbers("Size")], doc.get(function.head["BitsPerSample"]), doc.data(function)
    domain, limits = numbers("Domain"), numbers("Range")
    ways = numbers("Encode", [x for n in size for x in (0, n - 1)])
    decode, n_out, m = numbers("Decode", limits), len(limits) // 2, len(size)
    if m > 8:
        raise Unknown
    at = [min(max(_between(x, domain[2 * i], domain[2 * i + 1], ways[2 * i], ways[2 * i + 1]), 0.0), size[i] - 1.0) for i, x in enumerate(v)]
    low = [min(int(x), max(0, n - 2)) for x, n in zip(at, size)]
    out = [0.0] * n_out
    for corner in itertools.product((0, 1), repeat=m):
        share = math.prod(x - k if c else 1 - (x - k) for x, k, c in zip(at, low, corner))
        if not share:
            continue
        place = 0
        for i in reversed(range(m)):
            place = place * size[i] + low[i] + corner[i]
        for j in range(n_out):
            out[j] += share * _bits(data, (place * n_out + j) * bits, bits)
    top = (1 << bits) - 1
    return [_between(x, 0, top, decode[2 * j], decode[2 * j + 1]) for j, x in enumerate(out)]


def _bits(data: bytes, at: int, n: int) -> int:
    last = at + n
    whole = data[at // 8:-(-last // 8)]
    if 8 * len(whole) < n:
        raise Unknown
    return int.from_bytes(whole, "big") >> (-last % 8) & (1 << n) - 1


def _stitched(doc, head: dict, x: float, numbers, depth: int) -> list[float]:
    parts, bounds, ways, domain = doc.get(head["Functions"]), numbers("Bounds"), numbers("Encode"), numbers("Domain")
    k = sum(x >= b for b in bounds)
    edges = [domain[0], *bounds, domain[1]]
    return call(doc, parts[k], [_between(x, edges[k], edges[k + 1], ways[2 * k], ways[2 * k + 1])], depth + 1)


def parse(data: bytes) -> list:
    """A calculator procedure as a list of numbers, operators and procedures."""
    words, stack = data.replace(b"{", b" { ").replace(b"}", b" } ").split(), [[]]
    for w in words:
        if w == b"{":
            stack.append([])
            if len(stack) > _MOST:
                raise Unknown
        elif w == b"}":
            done = stack.pop()
            stack[-1].append(done)
        else:
            try:
                stack[-1].append(float(w) if b"." in w or b"e" in w.lower() and w[:1].isdigit() else int(w))
            except ValueError:
                stack[-1].append(w.decode("latin-1"))
    if len(stack) != 1 or len(stack[0]) != 1:
        raise Unknown
    return stack[0][0]


def _divide(a, b):
    return int(math.copysign(abs(a) // abs(b), a * b)) if a * b else 0


_ONE = {"abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc,
        "sqrt": math.sqrt, "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": math.log, "log": math.log10,
        "cvi": int, "cvr": float, "not": lambda a: not a if isinstance(a, bool) else ~a}
_TWO = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "idiv": _divide, "mod": math.fmod,
        "exp": lambda a, b: a ** b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
        "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": lambda a, b: a & b,
        "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "bitshift": lambda a, b: a << b if b >= 0 else a >> -b}


def run(procedure: list, inputs: list[float]) -> list[float]:
    """What a calculator procedure leaves on the stack. There are no loops, so it ends."""
    s: list = list(inputs)

    def go(steps: list) -> None:
        for k, x in enumerate(steps):
            if isinstance(x, list):
                if k + 1 == len(steps) or not (steps[k + 1] in ("if", "ifelse") or isinstance(steps[k + 1], list)):
                    raise Unknown
            elif not isinstance(x, str):
                s.append(x)
            elif x in _ONE:
                s.append(_ONE[x](s.pop()))
            elif x in _TWO:
                b, a = s.pop(), s.pop()
                s.append(_TWO[x](a, b))
            elif x in ("true", "false"):
                s.append(x == "true")
            elif x == "if":
                if s.pop():
                    go(steps[k - 1])
            elif x == "ifelse":
                go(steps[k - 2] if s.pop() else steps[k - 1])
            elif x == "pop":
                s.pop()
            elif x == "exch":
                s[-1], s[-2] = s[-2], s[-1]
            elif x == "dup":
                s.append(s[-1])
            elif x == "copy":
                n = int(s.pop())
                if not 0 <= n <= 100:
                    raise Unknown
                s.extend(s[len(s) - n:])
            elif x == "index":
                s.append(s[-1 - int(s.pop())])
            elif x == "roll":
                j, n = int(s.pop()), int(s.pop())
                if not 0 <= n <= len(s):
                    raise Unknown
                if n:
                    part = s[len(s) - n:]
                    s[len(s) - n:] = part[-(j % n):] + part[:-(j % n)] if j % n else part
            else:
                raise Unknown
            if len(s) > 200:
                raise Unknown

    go(procedure)
    return [float(x) for x in s]
