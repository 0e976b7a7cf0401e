"""ICC profiles against plain loops over single pixels."""

import struct
from math import floor

import numpy as np
import pytest

from tessera.functions import icc

D50 = (0.9642, 1.0, 0.8249)


def fixed(*values):
    return struct.pack(f">{len(values)}i", *(round(v * 65536) for v in values))


def xyz(*values):
    return b"XYZ \0\0\0\0" + fixed(*values)


def curv(*values):
    return b"curv\0\0\0\0" + struct.pack(f">I{len(values)}H", len(values), *values)


def para(function, *values):
    return b"para\0\0\0\0" + struct.pack(">HH", function, 0) + fixed(*values)


def exact(values):
    return [round(v * 65536) / 65536 for v in values]


def shown(linear):
    out = []
    for row in icc.D50_TO_SRGB:
        v = min(max(sum(a * b for a, b in zip(row, linear, strict=True)), 0), 1)
        out.append(floor((v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) * 65535 + 0.5))
    return out


PIXELS = np.array([[0, 0, 0], [65535, 65535, 65535], [1000, 30000, 60000], [65535, 0, 12345], [40000, 40001, 39999]], float)
SRGB = {b"rXYZ": (0.4361, 0.2225, 0.0139), b"gXYZ": (0.3851, 0.7169, 0.0971), b"bXYZ": (0.1431, 0.0606, 0.7141)}


def matrix_profile(curves, **more):
    tags = {b"wtpt": xyz(*D50), **{k: xyz(*v) for k, v in SRGB.items()}, **dict(zip((b"rTRC", b"gTRC", b"bTRC"), curves, strict=True)), **more}
    return icc.profile_bytes(tags)


def test_matrix_and_curves():
    curves = [curv(), curv(round(2.2 * 256)), curv(0, 10000, 65535)]
    columns = [exact(v) for v in SRGB.values()]
    got = icc.parse(matrix_profile(curves)).apply(PIXELS)
    for pixel, out in zip(PIXELS, got.tolist(), strict=True):
        r, g, b = pixel / 65535
        at = b * 2
        i = min(int(at), 1)
        table = (0, 10000, 65535)
        linear = (r, g ** (round(2.2 * 256) / 256), (table[i] + (table[i + 1] - table[i]) * (at - i)) / 65535)
        want = shown([sum(columns[c][k] * linear[c] for c in range(3)) for k in range(3)])
        assert np.abs(np.array(out) - want).max() <= 1


@pytest.mark.parametrize(
    ("function", "p", "f"),
    [
        (0, (2.0,), lambda x: x**2), (1, (2.0, 2.0, -0.5), lambda x: (2 * x - 0.5) ** 2 if x >= 0.25 else 0), (2, (2.0, 1.0, -0.25, 0.125), lambda x: (x - 0.25) ** 2 + 0.125 if x >= 0.25 else 0.125),
        (3, (2.5, 0.75, 0.25, 0.125, 0.25), lambda x: (0.75 * x + 0.25) ** 2.5 if x >= 0.25 else 0.125 * x), (4, (2.0, 0.5, 0.25, 0.5, 0.5, 0.125, 0.0625), lambda x: (0.5 * x + 0.25) ** 2 + 0.125 if x >= 0.5 else 0.5 * x + 0.0625),
    ],
)
def test_parametric_curves(function, p, f):
    data = para(function, *p)
    x = np.linspace(0, 1, 41)
    assert icc._curve(icc.Reader(data), 0, len(data))(x) == pytest.approx([min(max(f(v), 0), 1) for v in x], abs=1e-9)


def naive_table(values, points, x):
    """Trilinear interpolation by its definition, red fastest."""
    out = [0.0] * 3
    at = [min(max(v, 0), 1) * (n - 1) for v, n in zip(x, points, strict=True)]
    for r in range(points[0]):
        for g in range(points[1]):
            for b in range(points[2]):
                weight = 1.0
                for v, k in zip(at, (r, g, b), strict=True):
                    weight *= max(0.0, 1 - abs(v - k))
                for c in range(3):
                    out[c] += weight * values[((b * points[1] + g) * points[0] + r) * 3 + c] / 65535
    return out


@pytest.mark.parametrize("wide", [1, 2])
def test_tables(wide):
    rng = np.random.default_rng(wide)
    top = 255 if wide == 1 else 65535
    scale = 257 if wide == 1 else 1
    n_in = 256 if wide == 1 else 5
    pack = lambda v: np.asarray(v, np.uint8 if wide == 1 else ">u2").tobytes()
    first = [np.sort(rng.integers(0, top + 1, n_in)) for _ in range(3)]
    grid = rng.integers(0, top + 1, 27 * 3)
    last = [np.sort(rng.integers(0, top + 1, n_in)) for _ in range(3)]
    head = (b"mft1" if wide == 1 else b"mft2") + bytes(4) + bytes([3, 3, 3, 0]) + fixed(1, 0, 0, 0, 1, 0, 0, 0, 1) + (b"" if wide == 1 else struct.pack(">HH", n_in, n_in))
    tag = head + b"".join(map(pack, first)) + pack(grid) + b"".join(map(pack, last))
    got = icc.parse(icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B1": tag})).apply(PIXELS)
    look = lambda t, v: float(np.interp(min(max(v, 0), 1) * (n_in - 1), np.arange(n_in), t * scale)) / 65535
    for pixel, out in zip(PIXELS, got.tolist(), strict=True):
        x = [look(first[c], pixel[c] / 65535) for c in range(3)]
        y = naive_table(grid * scale, (3, 3, 3), x)
        assert np.abs(np.array(out) - shown([look(last[c], y[c]) for c in range(3)])).max() <= 1


def chain_tag(kind, elements):
    """A mAB or mBA tag of the elements b, matrix, m, clut and a."""
    body, starts = b"", {}
    for name, data in elements.items():
        starts[name] = 32 + len(body)
        body += data + bytes(-len(data) % 4)
    return kind + bytes(4) + bytes([3, 3, 0, 0]) + b"".join(struct.pack(">I", starts.get(n, 0)) for n in ("b", "matrix", "m", "clut", "a")) + body


def padded(*curves):
    return b"".join(c + bytes(-len(c) % 4) for c in curves)


ELEMENTS = {
    "b": padded(curv(), para(0, 2.0), curv(512)), "matrix": fixed(0.5, 0.25, 0.0, 0.0, 0.5, 0.25, 0.25, 0.0, 0.5, 0.0625, 0.0, 0.125), "m": padded(curv(256), curv(), curv()),
    "clut": bytes([2, 3, 2]) + bytes(13) + bytes([2, 0, 0, 0]) + np.random.default_rng(5).integers(0, 65536, 36).astype(">u2").tobytes(), "a": padded(curv(0, 65535), curv(0, 30000, 65535), curv()),
}
CLUT = np.frombuffer(ELEMENTS["clut"][20:], ">u2").astype(float)


def stages():
    m = np.array([[0.5, 0.25, 0.0], [0.0, 0.5, 0.25], [0.25, 0.0, 0.5]])
    return {
        "a": lambda x: [x[0], float(np.interp(min(max(x[1], 0), 1) * 2, [0, 1, 2], [0, 30000, 65535])) / 65535, x[2]], "clut": lambda x: naive_table(CLUT, (2, 3, 2), x), "m": lambda x: x,
        "matrix": lambda x: np.clip(m @ np.array(x) + [0.0625, 0, 0.125], 0, 1).tolist(), "b": lambda x: [x[0], min(max(x[1], 0), 1) ** 2, x[2] ** 2],
    }


@pytest.mark.parametrize("names", [("b",), ("b", "matrix", "m"), ("b", "clut", "a"), tuple(ELEMENTS)])
@pytest.mark.parametrize("pcs", [b"XYZ ", b"Lab "])
def test_chains(names, pcs):
    data = icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B0": chain_tag(b"mAB ", {k: ELEMENTS[k] for k in names})}, pcs=pcs)
    white = exact(D50)
    for pixel, out in zip(PIXELS, icc.parse(data).apply(PIXELS).tolist(), strict=True):
        x = (pixel / 65535).tolist()
        for k in ("a", "clut", "m", "matrix", "b"):
            x = stages()[k](x) if k in names else x
        if pcs == b"Lab ":
            l, a, b = (min(max(v, 0), 1) * s - o for v, s, o in zip(x, (100, 255, 255), (0, 128, 128), strict=True))
            fy = (l + 16) / 116
            x = [w * (f**3 if f**3 > 216 / 24389 else (116 * f - 16) * 27 / 24389) for w, f in zip(white, (fy + a / 500, fy, fy - b / 200), strict=True)]
        assert np.abs(np.array(out) - shown(x)).max() <= 1


def test_backward_chain_gives_device_values():
    data = icc.profile_bytes({b"wtpt": xyz(*D50), b"B2A0": chain_tag(b"mBA ", ELEMENTS)}, pcs=b"Lab ")
    for pixel, out in zip(PIXELS, icc.parse(data).apply(PIXELS).tolist(), strict=True):
        x = (pixel / 65535).tolist()
        for k in ("b", "matrix", "m", "clut", "a"):
            x = stages()[k](x)
        assert out == [floor(min(max(v, 0), 1) * 65535 + 0.5) for v in x]
    with pytest.raises(ValueError):
        icc.parse(data).linear_matrix()


def test_gray_profiles():
    data = icc.profile_bytes({b"wtpt": xyz(*D50), b"kTRC": curv(512)}, space=b"GRAY")
    for pixel, out in zip(PIXELS, icc.parse(data).apply(PIXELS).tolist(), strict=True):
        assert np.abs(np.array(out) - shown([w * (pixel[0] / 65535) ** 2 for w in exact(D50)])).max() <= 1


def test_linear_matrices():
    m = icc.parse(matrix_profile([curv(512)] * 3)).linear_matrix()
    assert m == pytest.approx(np.array(icc.D50_TO_SRGB) @ np.array([exact(v) for v in SRGB.values()]).T)
    grid = np.array([[r, g, b] for b in (0, 1) for g in (0, 1) for r in (0, 1)], float)
    half = np.array([[0.5, 0.1, 0], [0, 0.4, 0.2], [0.1, 0, 0.6]])
    clut = bytes([2, 2, 2]) + bytes(13) + bytes([2, 0, 0, 0]) + np.rint(grid @ half.T * 65535).astype(">u2").tobytes()
    linear = icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B0": chain_tag(b"mAB ", {"b": padded(curv(), curv(), curv()), "clut": clut})})
    assert icc.parse(linear).linear_matrix() == pytest.approx(np.array(icc.D50_TO_SRGB) @ half, abs=1e-3)
    for bad in (chain_tag(b"mAB ", ELEMENTS), chain_tag(b"mAB ", {"b": padded(curv(), curv(512), curv())})):
        with pytest.raises(ValueError):
            icc.parse(icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B0": bad})).linear_matrix()


def test_refused_profiles():
    good = matrix_profile([curv()] * 3)
    for bad in (b"", good[:100], good[:-40], icc.profile_bytes({b"wtpt": xyz(*D50)}), matrix_profile([curv(), curv(), b"text" + bytes(20)]), icc.profile_bytes({b"wtpt": xyz(0.5, 1, 0.5), b"A2B0": chain_tag(b"mAB ", ELEMENTS)}),
                icc.profile_bytes({b"A2B0": chain_tag(b"mAB ", ELEMENTS)}), icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B0": b"text" + bytes(40)}), icc.profile_bytes({b"wtpt": xyz(*D50), b"B2A0": chain_tag(b"mAB ", ELEMENTS)}),
                icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B0": chain_tag(b"mAB ", {"b": ELEMENTS["b"], "a": ELEMENTS["a"]})}), icc.profile_bytes({b"wtpt": xyz(*D50), b"A2B0": chain_tag(b"mAB ", {"m": ELEMENTS["m"]})})):
        with pytest.raises(ValueError):
            icc.parse(bad)
    with pytest.raises(ValueError):
        icc._curve(icc.Reader(para(1, 1.0, 0.0, 0.0)), 0, 24)
