"""Frame headers written bit by bit and read back, with the slots they leave."""

import random

import pytest

from tessera.sources.bodies import Bits, Fault
from tessera.sources.frame_header import IDENTITY, INTER, KEY, LF_REF_DELTAS, Decoder, distance, near_reference
from tessera.sources.payloads import sequence_header


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, *fields):
        for value, n in fields:
            self.bits += f"{value & ((1 << n) - 1):0{n}b}" if n else ""
        return self

    def data(self):
        text = self.bits + "1"
        text = text.ljust(-(-len(text) // 8) * 8, "0")
        return int(text, 2).to_bytes(len(text) // 8, "big")


def sequence(reduced=False, order_bits=0, grain=0, restoration=0, ids=False, large=0, superres=0):
    w = Writer().put((0, 3), (int(reduced), 1), (int(reduced), 1))
    if reduced:
        w.put((4, 5))
    else:
        w.put((0, 1), (0, 1), (0, 5), (0, 12), (4, 5))
    w.put((8, 4), (8, 4), (199, 9), (99, 9))
    if not reduced:
        w.put((int(ids), 1), *([(2, 4), (3, 3)] if ids else []))  # ids of 8 bits, deltas of 4
    w.put((large, 1), (1, 1), (1, 1))
    if not reduced:
        w.put((1, 1), (1, 1), (1, 1), (1, 1), (int(order_bits > 0), 1), *([(1, 1), (1, 1)] if order_bits else []), (1, 1), (1, 1), *([(order_bits - 1, 3)] if order_bits else []))
    w.put((superres, 1), (1, 1), (restoration, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 2), (0, 1), (grain, 1))
    return sequence_header(w.data())


PLAIN = [(1, 1), (0, 1), (0, 1), (100, 8), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1)]  # one uniform tile, quantizer 100, no deltas, matrices, segments, block deltas
FILTER = [(10, 6), (20, 6), (3, 6), (4, 6), (2, 3), (0, 1)]
CDEF = [(1, 2), (1, 2), (5, 4), (3, 2), (6, 4), (0, 2), (7, 4), (1, 2), (8, 4), (2, 2)]


def key_frame(s, order=0, show=1, refresh=255):
    w = Writer()
    if not s["reduced"]:
        w.put((0, 1), (KEY, 2), (show, 1), *([] if show else [(1, 1), (0, 1)]))
    w.put((0, 1), (0, 1))
    if s["more"]["id_bits"]:
        w.put((5, 8))
    if not s["reduced"]:
        w.put((0, 1))
    w.put((order, s["order_bits"]), *([] if show else [(refresh, 8)]))
    w.put((0, 1))
    if not s["reduced"]:
        w.put((0, 1))
    return w.put(*PLAIN, *FILTER, *CDEF)


def test_reduced_still_header():
    s = sequence(reduced=True)
    w = key_frame(s).put((1, 1), (0, 1))
    got = Decoder(s).read(w.data())
    assert got["bits"] == len(w.bits) and (got["width"], got["height"], got["render"]) == (200, 100, (200, 100))
    assert got["kind"] == KEY and got["refresh"] == 255 and got["quantizer"] == {"base": 100, "deltas": [0, 0, 0, 0, 0], "matrix": None}
    assert got["filter_levels"] == [10, 20, 3, 4] and got["sharpness"] == 2 and got["tx_select"] and not got["lossless"]
    assert got["cdef"] == {"damping": 4, "strengths": [((5, 4), (6, 0)), ((7, 1), (8, 2))]} and got["restoration"] is None and got["grain"] is None


def inter(s, order, refs, body, refresh=0, resilient=0, primary=0, override=0):
    w = Writer().put((0, 1), (INTER, 2), (1, 1), (resilient, 1), (0, 1), (0, 1))
    if s["more"]["id_bits"]:
        w.put((6, 8))
    w.put((override, 1), (order, s["order_bits"]), *([] if resilient else [(primary, 3)]), (refresh, 8), (0, 1))
    for i in refs:
        w.put((i, 3), *([(1, 4)] if s["more"]["id_bits"] else []))
    return w.put(*body)


@pytest.mark.parametrize("ids", [False, True])
def test_inter_frames_and_slots(ids):
    s = sequence(order_bits=5, ids=ids)
    d = Decoder(s)
    key = key_frame(s, 4).put((1, 1), (0, 1))
    assert d.read(key.data())["bits"] == len(key.bits)
    assert all(slot.order == 4 and slot.deltas == (LF_REF_DELTAS, (0, 0)) for slot in d.slots)
    # size as the sequence's, then a translation of the first reference, deltas of the loop filter, and slots 1 and 3
    head = [(0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1)]
    filters = [(10, 6), (0, 6), (3, 6), (4, 6), (2, 3), (1, 1), (1, 1), (1, 1), (-5, 7), *[(0, 1)] * 7, (0, 1), (1, 1), (9, 7)]
    motion = [(1, 1), (0, 1), (1, 1), (0, 1), (3, 3), (0, 1), (2, 3), *[(0, 1)] * 6]
    w = inter(s, 6, range(7), [*head, *PLAIN, *filters, *CDEF, (1, 1), (0, 1), (1, 1), (1, 1), *motion], refresh=0b1010)
    got = d.read(w.data())
    assert got["bits"] == len(w.bits) and got["refs"] == list(range(7)) and got["high_precision"] and got["filter"] == "switchable" and got["warped"] and got["reduced_tx"]
    # -2 and 1 in units of 2^13 (3 digits after the point)
    assert got["motion"][0] == [-2 << 13, 1 << 13, *IDENTITY[2:]] and got["motion"][1] == list(IDENTITY)
    assert [slot.order for slot in d.slots] == [4, 6, 4, 6, 4, 4, 4, 4] and d.slots[1].deltas == ((-5, *LF_REF_DELTAS[1:]), (0, 9)) and d.slots[3].motion[0][0] == -2 << 13
    # primary reference 1 is slot 1: deltas and motion are taken from there
    again = inter(s, 8, range(7), [*head, *PLAIN, *FILTER[:-1], (1, 1), (0, 1), *CDEF, (1, 1), (0, 1), (0, 1), (0, 1), *[(0, 1)] * 7], refresh=1, primary=1)
    assert d.read(again.data())["bits"] == len(again.bits) and d.slots[0].deltas == d.slots[1].deltas and d.slots[0].motion[0] == IDENTITY
    shown = Writer().put((1, 1), (3, 3), *([(6, 8)] if ids else []))
    got = d.read(shown.data())
    assert got["show_existing"] and got["order"] == 6 and got["refresh"] == 0 and got["bits"] == len(shown.bits)


def test_faults_leave_the_slots_as_they_were():
    s = sequence(order_bits=5)
    d = Decoder(s)
    with pytest.raises(Fault):
        d.read(Writer().put((1, 1), (3, 3)).data())  # an empty slot
    d.read(key_frame(s, 4).put((1, 1), (0, 1)).data())
    before = list(d.slots)
    broken = inter(s, 6, range(7), [(0, 1), (1, 1)], refresh=255)
    with pytest.raises(Fault):
        d.read(broken.data()[:-1])
    assert d.slots == before


def test_hidden_key_frame_is_shown():
    s = sequence(order_bits=5)
    d = Decoder(s)
    hidden = key_frame(s, 7, show=0, refresh=4).put((1, 1), (0, 1))
    got = d.read(hidden.data())
    assert got["bits"] == len(hidden.bits) and got["refresh"] == 4 and [x and x.order for x in d.slots] == [None, None, 7] + [None] * 5
    for _ in range(2):
        assert d.read(Writer().put((1, 1), (2, 3)).data())["order"] == 7
    with pytest.raises(Fault) as e:
        d.read(Writer().put((1, 1), (3, 3)).data())
    assert e.value.kind == "unsupported" and [x and x.order for x in d.slots] == [None, None, 7] + [None] * 5


def test_sizes_of_references_and_superres():
    s = sequence(order_bits=5, superres=1)
    d = Decoder(s)
    w = Writer().put((0, 1), (KEY, 2), (1, 1), (0, 1), (0, 1), (1, 1), (3, 5), (149, 9), (79, 9), (1, 1), (2, 3), (1, 1), (299, 16), (159, 16), (0, 1), *PLAIN, *FILTER, *CDEF, (1, 1), (0, 1))
    got = d.read(w.data())
    assert got["bits"] == len(w.bits) and (got["upscaled"], got["width"], got["height"], got["render"]) == (150, (150 * 8 + 5) // 11, 80, (300, 160))
    body = [(0, 1), (1, 1), (0, 1), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1), *PLAIN, *FILTER, *CDEF, (1, 1), (0, 1), (0, 1), (0, 1), *[(0, 1)] * 7]
    got = d.read(inter(s, 5, range(7), body, override=1).data())  # the second reference's size, at full width
    assert (got["upscaled"], got["width"], got["height"], got["render"]) == (150, 150, 80, (300, 160)) and got["filter"] == "switchable"


def test_short_reference_lists():
    s = sequence(order_bits=5)
    d = Decoder(s)
    d.read(key_frame(s, 0).put((1, 1), (0, 1)).data())
    from dataclasses import replace

    orders = [2, 4, 6, 8, 12, 14, 16, 1]
    d.slots = [replace(d.slots[0], order=o) for o in orders]
    refs = d._short_refs(3, 0, 10)  # last: 8, golden: 2
    assert [orders[i] for i in refs] == [8, 6, 4, 2, 12, 14, 16]  # then the latest before, and after: nearest, next and farthest
    with pytest.raises(Fault):
        d._short_refs(4, 0, 10)
    d.slots = [replace(x, order=o) for x, o in zip(d.slots, [5, 5, 5, 5, 5, 4, 3, 2], strict=True)]
    assert d._short_refs(0, 1, 6) == [0, 4, 3, 1, 2, 5, 6]  # the latest first, of equals the last


def test_segments_restoration_and_grain():
    s = sequence(order_bits=5, grain=1, restoration=1)
    segments = [(1, 1)]
    for i in range(8):
        segments += [(1, 1), (-20 - i, 9), *[(0, 1)] * 4, (1, 1), (5, 3), (0, 1), (1, 1)] if i < 2 else [(0, 1)] * 8
    grain = [(1, 1), (777, 16), (2, 4), (0, 8), (20, 8), (255, 8), (40, 8), (0, 1), (1, 4), (128, 8), (30, 8), (0, 4), (3, 2), (1, 2), *[(128 + k, 8) for k in range(4)], *[(100 + k, 8) for k in range(5)], (1, 2), (2, 2), (1, 8), (2, 8), (300, 9), (1, 1), (0, 1)]
    w = Writer().put((0, 1), (KEY, 2), (1, 1), (0, 1), (0, 1), (0, 1), (3, 5), (0, 1), (0, 1), (1, 1), (0, 1), (0, 1), (100, 8), (1, 1), (-3, 7), (0, 1), (0, 1), (1, 1), (4, 4), (5, 4), *segments, (1, 1), (2, 2), (1, 1), (1, 2), (1, 1), *FILTER, *CDEF, (2, 2), (0, 2), (3, 2), (1, 1), (1, 1), (1, 1), (0, 1), (1, 1), *grain)
    got = Decoder(s).read(w.data())
    assert got["bits"] == len(w.bits) and got["quantizer"] == {"base": 100, "deltas": [-3, 0, 0, 0, 0], "matrix": (4, 5, 5)}
    assert got["segments"][0] == {0: -20, 5: 5, 7: 0} and got["segments"][1][0] == -21 and got["segments"][2:] == ({},) * 6
    assert got["delta_q"] == 2 and got["delta_lf"] == (1, True) and got["restoration"] == {"kinds": ["wiener", "none", "self_guided"], "shift": 2, "chroma_shift": 1}
    g = got["grain"]
    assert g["seed"] == 777 and g["y"] == [(0, 20), (255, 40)] and g["cb"] == [(128, 30)] and g["cr"] == [] and g["ar_y"] == [0, 1, 2, 3] and g["ar_cb"] == [-28, -27, -26, -25, -24] and g["cb_mix"] == (1, 2, 300) and g["overlap"] and not g["clip"]


def write_near(n, reference, value):
    """Bits that near_reference() reads as the value."""
    r, v = (reference, value) if 2 * reference <= n else (n - 1 - reference, n - 1 - value)
    code = v if v > 2 * r else 2 * (r - v) - 1 if v < r else 2 * (v - r)
    w, base, i = Writer(), 0, 0
    while True:
        bits = 3 + max(0, i - 1)
        if n <= base + 3 * (1 << bits):
            rest, x = n - base, code - base
            width = rest.bit_length()
            short = (1 << width) - rest
            return w.put((x, width - 1)) if x < short else w.put((x + short >> 1, width - 1), (x + short & 1, 1))
        if code < base + (1 << bits):
            return w.put((0, 1), (code - base, bits))
        w.put((1, 1))
        base, i = base + (1 << bits), i + 1


def test_values_near_a_reference():
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 9000)
        reference, value = rng.randrange(n), rng.randrange(n)
        w = write_near(n, reference, value)
        b = Bits(w.data())
        assert near_reference(b, n, reference) == value and b.at == len(w.bits), (n, reference, value)


def test_order_hint_distances():
    assert [distance(a, b, 4) for a, b in ((1, 15), (15, 1), (0, 8), (7, 0))] == [2, -2, -8, 7] and distance(3, 1, 0) == 0
