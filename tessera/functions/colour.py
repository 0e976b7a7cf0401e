"""Colour rules as Columns: sample ranges, matrices, transfer curves, primaries, tone mapping, gain maps.

What depends on a frame's description only is worked out when the query is planned (Unsupported descriptions raise ValueError there);
what depends on samples is one expression. 16-bit results are 0..65535, rounded half away from zero.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import let, lets

TOP = 65535.0
#: Fixed values: (kr, kb) by matrix code.
LUMA = {1: (0.2126, 0.0722), 2: (0.2126, 0.0722), 4: (0.30, 0.11), 5: (0.299, 0.114), 6: (0.299, 0.114), 7: (0.212, 0.087), 9: (0.2627, 0.0593), 10: (0.2627, 0.0593)}
#: X and y of red, green, blue and white by code of the primaries.
D65 = (0.3127, 0.3290)
PRIMARIES = {
    1: ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), D65), 4: ((0.670, 0.330), (0.210, 0.710), (0.140, 0.080), (0.310, 0.316)), 5: ((0.640, 0.330), (0.290, 0.600), (0.150, 0.060), D65),
    6: ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), D65), 7: ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), D65), 8: ((0.681, 0.319), (0.243, 0.692), (0.145, 0.049), (0.310, 0.316)),
    9: ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), D65), 11: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.314, 0.351)), 12: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), D65),
    22: ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), D65),
}
#: Transfer codes that pass samples on as they are, and the curve of the others.
PASSED = (1, 2, 6, 7, 11, 12, 13, 14, 15)
CURVES = {4: "gamma22", 5: "gamma28", 8: "linear", 9: "log", 10: "log_sqrt", 16: "pq", 17: "st428", 18: "hlg"}
#: BT.709 luminance, and the white that the shoulder maps to 1.
BT709 = (0.2126, 0.7152, 0.0722)
WHITE = 4.0


# --- planned once


def sample_range(depth: int, full: bool) -> tuple[float, float, float, float]:
    """Offset and scale of luma, then of chroma."""
    if not 8 <= depth <= 16:
        raise ValueError(f"unsupported depth {depth}")
    unit, top = float(1 << (depth - 8)), float((1 << depth) - 1)
    return (0.0, top, float(1 << (depth - 1)), top) if full else (16 * unit, 219 * unit, 128 * unit, 224 * unit)


def matrix_code(described: int | None, full: bool) -> int:
    """The matrix of a frame; without a description full-range frames take 6, others 2."""
    return described if described is not None else 6 if full else 2


def _product(a: list, b: list) -> list:
    return [[sum(x * y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)] for row in a]


def _inverse(m: list) -> list:
    """Of a 3 x 3 matrix of fractions, by Gauss and Jordan."""
    rows = [[*row, *(Fraction(int(i == j)) for j in range(3))] for i, row in enumerate(m)]
    for k in range(3):
        pivot = next((r for r in range(k, 3) if rows[r][k]), None)
        if pivot is None:
            raise ValueError("unsupported: singular primaries")
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(3):
            if r != k:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [row[3:] for row in rows]


def rgb_to_xyz(primaries: int) -> list:
    """The matrix of a set of primaries, in exact fractions of the table's decimals."""
    if primaries not in PRIMARIES:
        raise ValueError(f"unsupported primaries {primaries}")
    red, green, blue, white = ([Fraction(str(v)) for v in p] for p in PRIMARIES[primaries])
    xyz = [[p[0] / p[1], Fraction(1), (1 - p[0] - p[1]) / p[1]] for p in (red, green, blue, white)]
    columns = [list(r) for r in zip(*xyz[:3], strict=True)]
    scale = _product(_inverse(columns), [[v] for v in xyz[3]])
    return [[v * scale[i][0] for i, v in enumerate(row)] for row in columns]


def primaries_matrix(source: int, target: int) -> list[list[float]]:
    """Linear RGB of one set of primaries in another."""
    if source == target:
        return [[float(i == j) for j in range(3)] for i in range(3)]
    return [[float(v) for v in row] for row in _product(_inverse(rgb_to_xyz(target)), rgb_to_xyz(source))]


def luma_weights(primaries: int) -> tuple[float, float]:
    """(kr, kb) that the chromaticities imply: the Y row of their matrix."""
    row = rgb_to_xyz(primaries)[1]
    return float(row[0]), float(row[2])


def transfer_curve(code: int | None) -> str | None:
    """Name of the curve to undo, None for those that are passed on."""
    if code is None or code in PASSED:
        return None
    if code not in CURVES:
        raise ValueError(f"unsupported transfer {code}")
    return CURVES[code]


def shared_primaries(base: int, alternate: int | None) -> tuple[int, int]:
    """Primaries of base and alternate image, where an unspecified side (2) takes the other's."""
    alternate = base if alternate is None else alternate
    if base == 2 and alternate != 2:
        base = alternate
    return base, base if alternate == 2 else alternate


def gain_weight(headroom: float, base: float, alternate: float, backward: bool = False) -> float:
    """Share of a gain map to apply at a display headroom, negative for a backward map; ValueError unless it is finite and not negative."""
    if not 0 <= headroom < float("inf"):
        raise ValueError("headroom must be finite and not negative")
    share = 0.0 if alternate == base else max(0.0, min(1.0, (headroom - base) / (alternate - base)))
    return -share if backward else share


# --- of samples


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_16(c: Column) -> Column:
    """0..1 as 16 bits."""
    return F.round(clamped(c) * TOP).cast("long")


def decoded(y: Column, u: Column, v: Column, matrix: int, depth: int, full: bool, primaries: int = 1) -> Column:
    """array(r, g, b) of 16-bit values, of samples of one depth. Matrix codes that aren't known raise ValueError."""
    y_off, y_scale, c_off, c_scale = sample_range(depth, full)

    def rgb(l: Column, b: Column, r: Column) -> Column:
        if matrix == 8:
            return F.array(to_16(l - b + r), to_16(l + b), to_16(l - b - r))
        if matrix == 11:
            return F.array(to_16(2.0 * r + 0.991902 * l), to_16(l), to_16((2.0 * b + l) / 0.986566))
        if matrix == 14:
            lms = [l + 0.008609037037932756 * b + 0.11102962500302596 * r, l - 0.008609037037932756 * b - 0.11102962500302596 * r, l + 0.5600313357106791 * b - 0.32062717498731885 * r]
            rows = ((3.4366066943330784, -2.50645211865627, 0.06984542432319148), (-0.7913295555989287, 1.9836004517922907, -0.192270896193362), (-0.025949899690592672, -0.09891371471172644, 1.1248636144023192))  # fixed values
            return lets(lms, lambda *x: F.array(*(to_16(k[0] * x[0] + k[1] * x[1] + k[2] * x[2]) for k in rows)))
        kr, kb = luma_weights(primaries) if matrix in (12, 13) else LUMA.get(matrix, (None, None))
        if kr is None:
            raise ValueError(f"unsupported matrix {matrix}")
        if matrix in (10, 13):  # each side of the axis has a scale of its own
            red = l + F.when(r < 0, 2 * (1 - kr) * r).otherwise(2 * kr * r)
            blue = l + F.when(b < 0, 2 * (1 - kb) * b).otherwise(2 * kb * b)
        else:
            red, blue = l + 2 * (1 - kr) * r, l + 2 * (1 - kb) * b
        return lets([l, red, blue], lambda l, red, blue: F.array(to_16(red), to_16((l - kr * red - kb * blue) / (1 - kr - kb)), to_16(blue)))

    return lets([clamped((y - y_off) / y_scale), (u - c_off) / c_scale, (v - c_off) / c_scale], rgb)


def to_linear(encoded: Column, curve: str) -> Column:
    """Linear light of an encoded value in 0..1; 1 is the curve's own white."""
    e = encoded
    match curve:
        case "gamma22":
            return F.pow(e, F.lit(2.2))
        case "gamma28":
            return F.pow(e, F.lit(2.8))
        case "linear":
            return e
        case "log":
            return F.when(e <= 0, F.lit(0.01)).otherwise(F.pow(F.lit(10.0), 2.0 * (e - 1.0)))
        case "log_sqrt":
            return F.when(e <= 0, F.lit(10.0**0.5 / 1000)).otherwise(F.pow(F.lit(10.0), 2.5 * (e - 1.0)))
        case "st428":
            return F.pow(clamped(e), F.lit(2.6)) * (52.37 / 48.0)
        case "pq":
            ratio = lambda p: F.greatest(p - 0.8359375, F.lit(0.0)) / F.greatest(18.8515625 - 18.6875 * p, F.lit(2.2250738585072014e-308))
            return F.when(e <= 0, F.lit(0.0)).otherwise(F.pow(let(F.pow(e, F.lit(1 / 78.84375)), ratio), F.lit(1 / 0.1593017578125)))
        case "hlg":
            high = F.least(F.pow((F.exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12.0, F.lit(1.2)), F.lit(1.0))
            return F.when(e <= 0, F.lit(0.0)).when(e <= 0.5, F.pow(e * e / 3.0, F.lit(1.2))).otherwise(high)
    raise ValueError(f"unknown curve {curve}")


def srgb_encoded(linear: Column) -> Column:
    return let(linear, lambda l: F.when(l <= 0.0031308, l * 12.92).otherwise(1.055 * F.pow(l, F.lit(1 / 2.4)) - 0.055))


def srgb_linear(encoded: Column) -> Column:
    return let(encoded, lambda e: F.when(e <= 0.04045, e / 12.92).otherwise(F.pow((e + 0.055) / 1.055, F.lit(2.4))))


def _times(matrix: list[list[float]], rgb: Column) -> Column:
    at = lambda i: F.get(rgb, F.lit(i))
    return F.array(*(row[0] * at(0) + row[1] * at(1) + row[2] * at(2) for row in matrix))


def shoulder(linear: Column) -> Column:
    return clamped(linear / (1.0 + linear) * ((WHITE + 1.0) / WHITE))


def in_gamut(rgb: Column) -> Column:
    """array(r, g, b) moved towards its luminance just so far that no channel is negative."""
    def move(c: Column) -> Column:
        at = [F.get(c, F.lit(i)) for i in range(3)]
        light = F.greatest(at[0] * BT709[0] + at[1] * BT709[1] + at[2] * BT709[2], F.lit(0.0))

        def with_light(l: Column) -> Column:
            each = F.transform(c, lambda v: F.when(v < 0, F.when(v - l < 0, l / (l - v)).otherwise(0.0)).otherwise(1.0))
            share = F.greatest(F.least(F.array_min(each), F.lit(1.0)), F.lit(0.0))
            return let(share, lambda s: F.transform(c, lambda v: F.when(s >= 1, v).otherwise(l + s * (v - l))))

        return let(light, with_light)

    return let(rgb, move)


def displayed(rgb16: Column, transfer: int | None, primaries: int = 1) -> Column:
    """array(r, g, b) of 16-bit values for display: curves undone and encoded anew; PQ and HLG by way of BT.709 and the shoulder."""
    curve = transfer_curve(transfer)
    if curve is None:
        return rgb16
    if curve not in ("pq", "hlg"):
        return F.transform(rgb16, lambda v: to_16(srgb_encoded(to_linear(v / TOP, curve))))
    linear = F.transform(rgb16, lambda v: to_linear(v / TOP, curve) * (100.0 if curve == "pq" else 1.0))
    if primaries not in (1, 2):
        matrix = primaries_matrix(primaries, 1)
        linear = let(linear, lambda c: _times(matrix, c))
    return F.transform(in_gamut(linear), lambda v: to_16(srgb_encoded(shoulder(v))))


def gain_applied(base16: Column, map16: Column, channels: list[dict[str, float]], weight: float, base_primaries: int = 1, map_primaries: int = 1, use_base_space: bool = True) -> Column:
    """array(r, g, b) of 16-bit values of a base image with its gain map; both arrays have three values.

    channels: min, max, gamma, base_offset and alternate_offset of one channel or of three. Alternate primaries that differ
    are gone through unless the map says that it is in the base's space.
    """
    if weight == 0.0:
        return base16
    if len(channels) not in (1, 3):
        raise ValueError("unsupported number of channels")
    if any(c["gamma"] <= 0 for c in channels):
        raise ValueError("gamma must be positive")
    each = channels * (3 // len(channels))
    base_primaries, map_primaries = shared_primaries(base_primaries, map_primaries)
    there = not use_base_space and base_primaries != map_primaries

    def gained(linear: Column) -> Column:
        out = []
        for i, c in enumerate(each):
            log2 = c["min"] + (c["max"] - c["min"]) * F.pow(F.get(map16, F.lit(i)) / TOP, F.lit(1 / c["gamma"]))
            out.append((F.get(linear, F.lit(i)) + c["base_offset"]) * F.pow(F.lit(2.0), log2 * weight) - c["alternate_offset"])
        return F.array(*out)

    linear = F.transform(base16, lambda v: srgb_linear(v / TOP))
    if there:
        go, back = primaries_matrix(base_primaries, map_primaries), primaries_matrix(map_primaries, base_primaries)
        toned = let(let(linear, lambda c: let(_times(go, c), gained)), lambda c: _times(back, c))
    else:
        toned = let(linear, gained)
    return F.transform(toned, lambda v: to_16(srgb_encoded(F.greatest(v, F.lit(0.0)))))


def scaled_16(v: Column, depth: int) -> Column:
    """A sample as 16 bits, as it is: 8-bit samples are replicated, others scaled and rounded."""
    top = (1 << depth) - 1
    return v * 257 if depth == 8 else F.call_function("div", v * 65535 + top // 2, F.lit(top).cast("long"))


def alpha_8(v: Column, depth: int) -> Column:
    """An alpha sample as 8 bits."""
    top = (1 << depth) - 1
    return F.call_function("div", v * 255 + top // 2, F.lit(top).cast("long"))


def rgba_16(luma: Column, u: Column, v: Column, alpha: Column, depth: int, matrix: int | None, full: bool, transfer: int | None = None, primaries: int = 1) -> Column:
    """array(r, g, b, a) of 16-bit values: monochrome (u is null) and identity (matrix 0 or 3, planes G, B, R) samples as they are, others by
    their matrix, then the transfer; alpha is opaque where it is null."""
    code = matrix_code(matrix, full)
    grey = F.array(*[scaled_16(luma, depth)] * 3)
    coloured = F.array(*(scaled_16(c, depth) for c in (v, luma, u))) if code in (0, 3) else decoded(luma, u, v, code, depth, full, primaries)
    shown = displayed(F.when(u.isNull(), grey).otherwise(coloured), transfer, primaries)
    return F.concat(shown, F.array(F.coalesce(scaled_16(alpha, depth), F.lit(65535).cast("long"))))


def rgba_8(rgba16: Column) -> Column:
    return F.transform(rgba16, lambda c: F.call_function("div", c * 255 + 32767, F.lit(65535).cast("long")))
