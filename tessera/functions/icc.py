"""ICC profiles as chains of steps over arrays of RGB values: curves, matrices, three-dimensional tables, Lab.

A profile is parsed once on the driver; its steps work on (n, 3) arrays, so a task converts a batch of pixels at a time. Which tag counts:
for GRAY profiles the tone curve; else the first of A2B0, A2B1, A2B2 (tables and mAB/mBA chains), else of B2A0, B2A1, B2A2 (mBA, whose
results are device values already), else matrix and curves. What isn't handled raises ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# XYZ to linear sRGB by media white, and the whites.
D50_TO_SRGB = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
D65_TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITES = ((0.9642, 1.0, 0.8249), (0.9505, 1.0, 1.0890))
#: Parameters of a parametric curve by function, and device classes that are handled.
PARAMETERS = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}
CLASSES = (b"scnr", b"mntr", b"prtr", b"spac")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"unsupported profile: {what}")


@dataclass(frozen=True)
class Reader:
    """Big-endian numbers of a profile."""

    data: bytes

    def take(self, at: int, n: int) -> bytes:
        _need(0 <= at and at + n <= len(self.data), "truncated")
        return self.data[at : at + n]

    def u16(self, at: int) -> int:
        return int.from_bytes(self.take(at, 2), "big")

    def u32(self, at: int) -> int:
        return int.from_bytes(self.take(at, 4), "big")

    def fixed(self, at: int, n: int) -> np.ndarray:
        """n numbers of 16 bits before the point and 16 after it."""
        return np.array(struct.unpack(f">{n}i", self.take(at, 4 * n))) / 65536.0

    def values(self, at: int, n: int, wide: int) -> np.ndarray:
        """n table values as 16 bits; single bytes are replicated."""
        raw = np.frombuffer(self.take(at, n * wide), np.uint8 if wide == 1 else ">u2").astype(np.float64)
        return raw * 257 if wide == 1 else raw

    def tags(self) -> dict[bytes, tuple[int, int]]:
        """Offset and size of every tag; the first of a name counts."""
        _need(len(self.data) >= 132, "truncated header")
        size, n = self.u32(0), self.u32(128)
        _need(132 <= size <= len(self.data) and 132 + 12 * n <= size, "size")
        out: dict[bytes, tuple[int, int]] = {}
        for at in range(132, 132 + 12 * n, 12):
            offset, length = self.u32(at + 4), self.u32(at + 8)
            _need(offset >= 132 and length >= 8 and offset + length <= size, "tag outside")
            out.setdefault(self.take(at, 4), (offset, length))
        return out


# --- steps


@dataclass
class Curve:
    """One channel's curve: identity, power, table or parametric."""

    kind: str = "identity"
    numbers: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "identity":
            return x
        if self.kind == "gamma":
            return np.maximum(x, 0.0) ** self.numbers[0]
        if self.kind == "table":
            return between(self.numbers, x)
        return self._parametric(np.clip(x, 0.0, 1.0))

    def _parametric(self, x: np.ndarray) -> np.ndarray:
        p = [*self.numbers, *[0.0] * 6]
        power = np.maximum(p[1] * x + p[2], 0.0) ** p[0]
        match self.kind:
            case "para0":
                out = x ** p[0]
            case "para1":
                out = np.where(x >= -p[2] / p[1], power, 0.0)
            case "para2":
                out = np.where(x >= -p[2] / p[1], power + p[3], p[3])
            case "para3":
                out = np.where(x >= p[4], power, p[3] * x)
            case _:
                out = np.where(x >= p[4], power + p[5], p[3] * x + p[6])
        return np.clip(out, 0.0, 1.0)

    def straight(self) -> bool:
        if self.kind == "table":
            n = len(self.numbers)
            return n > 1 and bool((np.abs(self.numbers - np.arange(n) / (n - 1) * 65535) <= 2).all())
        return self.kind == "identity" or (self.kind in ("gamma", "para0") and abs(self.numbers[0] - 1) <= 1e-9)


def between(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Linear interpolation in a table of 16-bit values over 0..1."""
    at = np.clip(x, 0.0, 1.0) * (len(table) - 1)
    low = np.floor(at).astype(np.int64)
    return (table[low] + (table[np.minimum(low + 1, len(table) - 1)] - table[low]) * (at - low)) / 65535.0


@dataclass
class Curves:
    each: list[Curve]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([c(x[:, i]) for i, c in enumerate(self.each)], 1)

    def linear(self) -> np.ndarray | None:
        return np.eye(3) if all(c.straight() for c in self.each) else None


@dataclass
class Matrix:
    m: np.ndarray
    offset: np.ndarray
    clip: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.m.T + self.offset
        return np.clip(out, 0.0, 1.0) if self.clip else out

    def linear(self) -> np.ndarray | None:
        return self.m if (np.abs(self.offset) <= 1e-9).all() else None


@dataclass
class Table:
    """A three-dimensional table, red fastest, with trilinear interpolation."""

    values: np.ndarray  # blue, green, red, channel
    wide: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        points = np.array(self.values.shape[2::-1])
        at = np.clip(x, 0.0, 1.0) * (points - 1)
        low = np.floor(at).astype(np.int64)
        high, part = np.minimum(low + 1, points - 1), at - low
        out = np.zeros_like(x)
        for corner in range(8):
            up = [corner >> c & 1 for c in range(3)]
            r, g, b = (high[:, c] if up[c] else low[:, c] for c in range(3))
            weight = np.prod([part[:, c] if up[c] else 1 - part[:, c] for c in range(3)], axis=0)
            out += weight[:, None] * self.values[b, g, r]
        return out / 65535.0

    def linear(self) -> np.ndarray | None:
        """The matrix that the table holds, if it does up to its precision."""
        near = 3.0 / (255.0 if self.wide == 1 else 65535.0)
        v = self.values / 65535.0
        m = np.stack([v[0, 0, -1], v[0, -1, 0], v[-1, 0, 0]], 1)
        b, g, r = (np.linspace(0, 1, n) for n in v.shape[:3])
        want = np.einsum("ij,bgrj->bgri", m, np.stack(np.broadcast_arrays(r[None, None, :], g[None, :, None], b[:, None, None]), -1))
        return m if (np.abs(v[0, 0, 0]) <= near).all() and (np.abs(v - want) <= near).all() else None


@dataclass
class Lab:
    """Lab of the connection space to XYZ."""

    white: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        c = np.clip(x, 0.0, 1.0)
        fy = (c[:, 0] * 100 + 16) / 116
        f = np.stack([fy + (c[:, 1] * 255 - 128) / 500, fy, fy - (c[:, 2] * 255 - 128) / 200], 1)
        cube = f**3
        return self.white * np.where(cube > 216 / 24389, cube, (116 * f - 16) * 27 / 24389)

    def linear(self) -> None:
        return None


@dataclass
class Grey:
    curve: Curve
    white: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.curve(x[:, 0])[:, None] * self.white

    def linear(self) -> None:
        return None


@dataclass
class Profile:
    """steps, then from XYZ by `display` to sRGB; None: the steps' results are shown as they are. backward: a chain from the connection space."""

    steps: list
    display: np.ndarray | None
    backward: bool = False

    def apply(self, rgb: np.ndarray) -> np.ndarray:
        """16-bit display values of (n, 3) values of 0..65535."""
        x = rgb / 65535.0
        for step in self.steps:
            x = step(x)
        if self.display is None:
            return np.floor(np.clip(x, 0.0, 1.0) * 65535 + 0.5).astype(np.int64)
        x = np.clip(x @ self.display.T, 0.0, 1.0)
        return np.floor(np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055) * 65535 + 0.5).astype(np.int64)

    def linear_matrix(self) -> np.ndarray:
        """Linear RGB of the profile to linear sRGB, for gain maps: curves of a matrix profile are left out, all other steps must be linear."""
        _need(self.display is not None and not self.backward, "reverse chain")
        total = np.eye(3)
        for step in self.steps:
            m = np.eye(3) if isinstance(step, Curves) and len(self.steps) == 2 and isinstance(self.steps[1], Matrix) and not self.steps[1].clip else step.linear()
            _need(m is not None, "not linear")
            total = m @ total
        return self.display @ total


# --- parsing


def _curve(r: Reader, at: int, size: int) -> Curve:
    _need(size >= 12, "curve")
    kind = r.take(at, 4)
    if kind == b"para":
        function = r.u16(at + 8)
        _need(function in PARAMETERS and size >= 12 + 4 * PARAMETERS[function], "parametric curve")
        p = r.fixed(at + 12, PARAMETERS[function])
        _need(function not in (1, 2) or p[1] != 0, "parametric curve divides by zero")
        return Curve(f"para{function}", p)
    _need(kind == b"curv", "curve kind")
    n = r.u32(at + 8)
    if n == 0:
        return Curve()
    if n == 1 and size >= 14:
        return Curve("gamma", np.array([r.u16(at + 12) / 256.0]))
    _need(n <= 65536 and size >= 12 + 2 * n, "curve table")
    return Curve("table", r.values(at + 12, n, 2))


def _three_curves(r: Reader, at: int, end: int) -> Curves:
    out = []
    for _ in range(3):
        _need(at + 12 <= end, "curve")
        if r.take(at, 4) == b"curv":
            n = r.u32(at + 8)
            size = 14 if n == 1 else 12 + 2 * n
        else:
            _need(r.take(at, 4) == b"para" and r.u16(at + 8) in PARAMETERS, "curve kind")
            size = 12 + 4 * PARAMETERS[r.u16(at + 8)]
        _need(at + size <= end, "curve")
        out.append(_curve(r, at, size))
        at += -(-size // 4) * 4
    return Curves(out)


def _xyz(r: Reader, tags: dict, name: bytes) -> np.ndarray:
    _need(name in tags and tags[name][1] >= 20 and r.take(tags[name][0], 4) == b"XYZ ", f"tag {name.decode()}")
    return r.fixed(tags[name][0] + 8, 3)


def _display(white: np.ndarray) -> np.ndarray:
    for known, m in zip(WHITES, (D50_TO_SRGB, D65_TO_SRGB), strict=True):
        if (np.abs(white - known) <= 0.002).all():
            return np.array(m)
    raise ValueError("unsupported profile: white point")


def _lut(r: Reader, at: int, size: int) -> list:
    wide = 1 if r.take(at, 4) == b"mft1" else 2
    _need(size >= 48, "table")
    inputs, outputs, points = r.take(at + 8, 3)
    _need((inputs, outputs) == (3, 3) and 2 <= points <= 65, "table channels or points")
    n_in, n_out, data = (256, 256, at + 48) if wide == 1 else (r.u16(at + 48), r.u16(at + 50), at + 52)
    _need(2 <= n_in <= 4096 and 2 <= n_out <= 4096, "table entries")
    cells = 3 * points**3
    _need(data + wide * (3 * n_in + cells + 3 * n_out) <= at + size, "truncated table")
    first = r.values(data, 3 * n_in, wide).reshape(3, n_in)
    grid = r.values(data + wide * 3 * n_in, cells, wide).reshape(points, points, points, 3)
    last = r.values(data + wide * (3 * n_in + cells), 3 * n_out, wide).reshape(3, n_out)
    return [Matrix(r.fixed(at + 12, 9).reshape(3, 3), np.zeros(3)), Curves([Curve("table", t) for t in first]), Table(grid, wide), Curves([Curve("table", t) for t in last])]


def _chain(r: Reader, at: int, size: int, backward: bool) -> list:
    _need(size >= 32 and tuple(r.take(at + 8, 2)) == (3, 3), "chain channels")
    end, starts = at + size, {}
    for name, place in (("b", 12), ("matrix", 16), ("m", 20), ("clut", 24), ("a", 28)):
        start = r.u32(at + place)
        _need(start == 0 or 32 <= start < size, "chain element outside")
        starts[name] = at + start if start else None
    _need(starts["a"] is None or starts["clut"] is not None, "curves without their table")
    _need((starts["m"] is None) == (starts["matrix"] is None), "curves without their matrix")
    found: dict = {k: _three_curves(r, starts[k], end) for k in ("a", "m", "b") if starts[k] is not None}
    if (start := starts["matrix"]) is not None:
        _need(start + 48 <= end, "matrix")
        p = r.fixed(start, 12)
        found["matrix"] = Matrix(p[:9].reshape(3, 3), p[9:], clip=True)
    if (start := starts["clut"]) is not None:
        _need(start + 20 <= end, "table")
        points, wide = list(r.take(start, 3)), r.take(start + 16, 1)[0]
        _need(all(2 <= p <= 65 for p in points) and wide in (1, 2), "table points or precision")
        n = 3 * points[0] * points[1] * points[2]
        _need(start + 20 + n * wide <= end, "truncated table")
        found["clut"] = Table(r.values(start + 20, n, wide).reshape(points[2], points[1], points[0], 3), wide)
    order = ("b", "matrix", "m", "clut", "a") if backward else ("a", "clut", "m", "matrix", "b")
    return [found[k] for k in order if k in found]


def parse(data: bytes) -> Profile:
    """The profile's chain."""
    r = Reader(data)
    tags, space, pcs = r.tags(), data[16:20], data[20:24]
    first = lambda *names: next((tags[n] for n in names if n in tags), None)
    if space == b"GRAY":
        _need(data[12:16] in CLASSES and pcs == b"XYZ " and b"kTRC" in tags, "gray")
        white = _xyz(r, tags, b"wtpt")
        return Profile([Grey(_curve(r, *tags[b"kTRC"]), white)], _display(white))
    forward, reverse = first(b"A2B0", b"A2B1", b"A2B2"), first(b"B2A0", b"B2A1", b"B2A2")
    if forward is not None or reverse is not None:
        at, size = forward or reverse
        kind = r.take(at, 4)
        _need(kind in ((b"mft1", b"mft2", b"mAB ", b"mBA ") if forward else (b"mBA ",)), "tag kind")
        _need(space == b"RGB " and (pcs == b"XYZ " or (pcs == b"Lab " and kind[:1] == b"m" and kind[1:2] != b"f")), "colour space")
        white = _xyz(r, tags, b"wtpt")
        display = _display(white)
        if kind in (b"mft1", b"mft2"):
            return Profile(_lut(r, at, size), display)
        steps = _chain(r, at, size, kind == b"mBA ")
        if forward is None:
            return Profile(steps, None, True)
        return Profile([*steps, Lab(white)] if pcs == b"Lab " else steps, display, kind == b"mBA ")
    _need(data[12:16] in CLASSES and space == b"RGB " and pcs == b"XYZ ", "class or colour space")
    columns = [_xyz(r, tags, n) for n in (b"rXYZ", b"gXYZ", b"bXYZ")]
    _need(all(n in tags for n in (b"rTRC", b"gTRC", b"bTRC")), "curves")
    curves = Curves([_curve(r, *tags[n]) for n in (b"rTRC", b"gTRC", b"bTRC")])
    return Profile([curves, Matrix(np.stack(columns, 1), np.zeros(3))], _display(_xyz(r, tags, b"wtpt")))


def converted(pixels: DataFrame, profile: bytes, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """pixels with the 16-bit columns r, g and b as the profile shows them. One narrow pass; the profile's chain goes to the tasks once."""
    chain = pixels.sparkSession.sparkContext.broadcast(parse(profile))
    names = pixels.columns
    at = [names.index(c) for c in (r, g, b)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], 1).astype(np.float64)
            out = chain.value.apply(rgb) if len(rgb) else np.empty((0, 3), np.int64)
            columns = list(batch.columns)
            for k, i in enumerate(at):
                columns[i] = pa.array(out[:, k], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {'long' if f.name in (r, g, b) else f.dataType.simpleString()}" for f in pixels.schema.fields)
    return pixels.mapInArrow(run, schema)


def profile_bytes(tags: dict[bytes, bytes], space: bytes = b"RGB ", pcs: bytes = b"XYZ ", kind: bytes = b"mntr") -> bytes:
    """A profile of the given tags, for tests and queries."""
    head, body, table = 132 + 12 * len(tags), b"", b""
    for name, data in tags.items():
        table += name + struct.pack(">II", head + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    size = head + len(body)
    return struct.pack(">I", size) + bytes(8) + kind + space + pcs + bytes(128 - 24) + struct.pack(">I", len(tags)) + table + body
