"""Frame headers of a coded sequence, bit by bit, with the eight reference slots that they depend on.

Decoder keeps the slots from frame to frame: a header is read against a copy of the state and the state changes only if all of it
could be read. Showing a slot changes none, whatever it holds. Sequences are read in order, one track a group (operators and streams see streaming.playback for how that is dealt).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sources.bodies import Bits, Fault
from tessera.sources.payloads import sequence_header, tile_layout

KEY, INTER, INTRA_ONLY, SWITCH = range(4)
NONE, ALL, REFS = 7, 255, 7
#: Loop-filter deltas at the start, bits, signs and limits of segment features, and restoration kinds by code.
LF_REF_DELTAS = (1, 0, 0, 0, -1, 0, -1, -1)
SEGMENT = ((8, True, 255), (6, True, 63), (6, True, 63), (6, True, 63), (6, True, 63), (3, False, 7), (0, False, 0), (0, False, 0))
RESTORATION = ("none", "switchable", "wiener", "self_guided")
IDENTITY = (0, 0, 1 << 16, 0, 0, 1 << 16)


def signed(b: Bits, n: int) -> int:
    value = b.read(n)
    return value - (1 << n) if value >> (n - 1) else value


def distance(a: int, b: int, bits: int) -> int:
    """Signed distance of order hints; 0 where there are none."""
    if not bits:
        return 0
    half = 1 << (bits - 1)
    return ((a - b) & (half - 1)) - ((a - b) & half)


@dataclass(frozen=True)
class Slot:
    """What later headers need of a frame."""

    kind: int
    order: int
    upscaled: int
    width: int
    height: int
    render: tuple[int, int]
    motion: tuple = (IDENTITY,) * REFS
    deltas: tuple = (LF_REF_DELTAS, (0, 0))
    segments: tuple = ()
    grain: dict | None = None


@dataclass
class Decoder:
    """Header state of one sequence. sequence: what sequence_header() gives, its `more` included."""

    sequence: dict
    slots: list[Slot | None] = field(default_factory=lambda: [None] * 8)

    def read(self, data: bytes, temporal: int = 0, spatial: int = 0) -> dict:
        """The fields of the header that data begins with, and `bits`, how many it has; the slots are refreshed as it says."""
        b = Bits(data)
        found, slot = self._header(b, temporal, spatial)
        for i in range(8):
            if found["refresh"] >> i & 1:
                self.slots[i] = slot
        return found | {"bits": b.at}

    def _slot(self, i: int) -> Slot:
        if self.slots[i] is None:
            raise Fault("bitstream", f"reference slot {i} is empty")
        return self.slots[i]

    def _header(self, b: Bits, temporal: int, spatial: int) -> tuple[dict, Slot | None]:
        s, more = self.sequence, self.sequence["more"]
        f: dict = {"show_existing": False}
        if s["reduced"]:
            f |= {"kind": KEY, "show": True, "showable": False, "resilient": True}
        else:
            if b.flag():
                return self._existing(b)
            f["kind"] = b.read(2)
            f["show"] = b.flag()
            if f["show"] and more["model"] and not more["equal_interval"]:
                b.read(more["presentation_bits"])
            f["showable"] = f["kind"] != KEY if f["show"] else b.flag()
            f["resilient"] = f["kind"] == SWITCH or (f["kind"] == KEY and f["show"]) or b.flag()
        kind, intra = f["kind"], f["kind"] in (KEY, INTRA_ONLY)
        fresh = kind == KEY and f["show"]
        slots = [None] * 8 if fresh else self.slots
        f["no_cdf_update"] = b.flag()
        f["screen"] = b.flag() if more["screen"] == 2 else bool(more["screen"])
        f["integer_mv"] = f["screen"] and (b.flag() if more["integer_mv"] == 2 else bool(more["integer_mv"]))
        if more["id_bits"]:
            f["frame_id"] = b.read(more["id_bits"])
        override = kind == SWITCH or (not s["reduced"] and b.flag())
        f["order"] = b.read(s["order_bits"])
        f["primary"] = NONE if intra or f["resilient"] else b.read(3)
        if more["model"]:
            self._removal_times(b, temporal, spatial)
        f["refresh"] = ALL if kind == SWITCH or fresh else b.read(8)
        if (not intra or f["refresh"] != ALL) and f["resilient"] and s["order_bits"]:
            for _ in range(8):
                b.read(s["order_bits"])
        f |= {"intrabc": False, "refs": [], "high_precision": False, "filter": None, "ref_mvs": False}
        if intra:
            if kind == INTRA_ONLY and f["refresh"] == ALL:
                raise Fault("bitstream", "an intra-only frame must leave a slot")
            self._size(b, f, override)
            self._render(b, f)
            f["intrabc"] = f["screen"] and f["upscaled"] == f["width"] and b.flag()
        else:
            self._inter(b, f, override)
        f["no_end_update"] = s["reduced"] or f["no_cdf_update"] or b.flag()
        past = self._slot(f["refs"][f["primary"]]) if f["primary"] != NONE else None
        f["tiles"] = tile_layout(b, f["width"], f["height"], s["large_blocks"], s["reduced"])
        planes = 1 if s["mono"] else 3
        f["quantizer"] = self._quantizer(b, planes)
        f["segments"] = self._segments(b, f, past)
        self._deltas(b, f)
        q = f["quantizer"]
        level = lambda seg: max(0, min(255, q["base"] + seg.get(0, 0)))
        f["lossless"] = not any(q["deltas"]) and all(level(seg) == 0 for seg in (f["segments"] or ({},)))
        f["filter_levels"], deltas = self._loop_filter(b, f, planes, past)
        f["cdef"] = self._cdef(b, planes) if s["cdef"] and not f["lossless"] and not f["intrabc"] else None
        f["restoration"] = self._restoration(b, planes) if s["restoration"] and not f["intrabc"] and not (f["lossless"] and f["width"] == f["upscaled"]) else None
        f["tx_select"] = not f["lossless"] and b.flag()
        f["compound"] = not intra and b.flag()
        f["skip_mode"] = self._skip_mode_allowed(f) and b.flag()
        f["warped"] = not intra and not f["resilient"] and more["warped"] and b.flag()
        f["reduced_tx"] = b.flag()
        f["motion"] = [list(IDENTITY) for _ in range(REFS)] if intra else self._motion(b, f, past)
        f["grain"] = self._grain(b, f, slots)
        render = f["render"]
        slot = Slot(kind, f["order"], f["upscaled"], f["width"], f["height"], render, tuple(map(tuple, f["motion"])), deltas, f["segments"], f["grain"])
        return f, slot

    def _existing(self, b: Bits) -> tuple[dict, Slot]:
        more, i = self.sequence["more"], b.read(3)
        if more["model"] and not more["equal_interval"]:
            b.read(more["presentation_bits"])
        if more["id_bits"]:
            b.read(more["id_bits"])
        slot = self.slots[i]
        if slot is None:
            raise Fault("unsupported", f"slot {i} holds nothing to show")
        return {"show_existing": True, "slot": i, "kind": slot.kind, "show": True, "order": slot.order, "refresh": 0, "width": slot.width, "height": slot.height, "upscaled": slot.upscaled, "render": slot.render, "grain": slot.grain}, slot

    def _removal_times(self, b: Bits, temporal: int, spatial: int) -> None:
        more = self.sequence["more"]
        if b.flag():
            for idc, modelled in more["points"]:
                if modelled and (idc == 0 or (idc >> temporal & 1 and idc >> (spatial + 8) & 1)):
                    b.read(more["removal_bits"])

    # --- sizes and references

    def _size(self, b: Bits, f: dict, override: bool) -> None:
        s = self.sequence
        f["upscaled"], f["height"] = (b.read(s["more"]["wide"]) + 1, b.read(s["more"]["high"]) + 1) if override else (s["width"], s["height"])
        self._scaled(b, f)

    def _scaled(self, b: Bits, f: dict) -> None:
        part = b.read(3) + 9 if self.sequence["superres"] and b.flag() else 8
        f["width"] = (f["upscaled"] * 8 + part // 2) // part

    def _render(self, b: Bits, f: dict) -> None:
        f["render"] = (b.read(16) + 1, b.read(16) + 1) if b.flag() else (f["upscaled"], f["height"])

    def _inter(self, b: Bits, f: dict, override: bool) -> None:
        s, more = self.sequence, self.sequence["more"]
        short = s["order_bits"] > 0 and b.flag()
        f["refs"] = self._short_refs(b.read(3), b.read(3), f["order"]) if short else []
        for i in range(REFS):
            if not short:
                f["refs"].append(b.read(3))
            if more["id_bits"]:
                b.read(more["delta_id_bits"])
        if override and not f["resilient"]:
            for i in f["refs"]:
                if b.flag():
                    slot = self._slot(i)
                    f["upscaled"], f["height"], f["render"] = slot.upscaled, slot.height, slot.render
                    self._scaled(b, f)
                    break
            else:
                self._size(b, f, True)
                self._render(b, f)
        else:
            self._size(b, f, override)
            self._render(b, f)
        f["high_precision"] = not f["integer_mv"] and b.flag()
        f["filter"] = "switchable" if b.flag() else b.read(2)
        f["motion_switchable"] = b.flag()
        f["ref_mvs"] = not f["resilient"] and more["ref_mvs"] and b.flag()

    def _short_refs(self, last: int, golden: int, order: int) -> list[int]:
        """All references from the slots of the last and the golden frame, by order hints."""
        bits = self.sequence["order_bits"]
        now = 1 << (bits - 1)
        hints = [now + distance(self._slot(i).order, order, bits) for i in range(8)]
        if hints[last] >= now or hints[golden] >= now:
            raise Fault("bitstream", "last or golden frame is not before this one")
        refs, used = {0: last, 3: golden}, {last, golden}

        def take(place: int, candidates: list[int], best) -> None:
            if candidates:
                refs[place] = best(candidates)
                used.add(refs[place])

        later = lambda: [i for i in range(8) if i not in used and hints[i] >= now]
        # the latest of equal hints wins where the largest is wanted, the first where the least is
        largest = lambda c: max(c, key=lambda i: (hints[i], i))
        least = lambda c: min(c, key=lambda i: (hints[i], i))
        take(6, later(), largest)
        take(4, later(), least)
        take(5, later(), least)
        for place in (1, 2, 4, 5, 6):
            if place not in refs:
                take(place, [i for i in range(8) if i not in used and hints[i] < now], largest)
        first = least(list(range(8)))
        return [refs.get(i, first) for i in range(REFS)]

    # --- parts

    def _quantizer(self, b: Bits, planes: int) -> dict:
        delta = lambda: signed(b, 7) if b.flag() else 0
        base, deltas = b.read(8), [delta()]
        if planes > 1:
            apart = self.sequence["more"]["separate_uv"] and b.flag()
            deltas += [delta(), delta()]
            deltas += [delta(), delta()] if apart else deltas[1:3]
        matrix = None
        if b.flag():
            y, u = b.read(4), b.read(4)
            matrix = (y, u, b.read(4) if self.sequence["more"]["separate_uv"] else u)
        return {"base": base, "deltas": deltas, "matrix": matrix}

    def _segments(self, b: Bits, f: dict, past: Slot | None) -> tuple:
        """Features by number of each segment, () if there are none."""
        if not b.flag():
            return ()
        update = True
        if f["primary"] != NONE:
            if b.flag():
                b.flag()
            update = b.flag()
        if not update:
            return past.segments if past else ()
        out = []
        for _ in range(8):
            own = {}
            for j, (bits, sign, most) in enumerate(SEGMENT):
                if b.flag():
                    value = signed(b, bits + 1) if sign else b.read(bits)
                    own[j] = max(-most if sign else 0, min(most, value))
            out.append(own)
        return tuple(out)

    def _deltas(self, b: Bits, f: dict) -> None:
        f["delta_q"] = b.read(2) if f["quantizer"]["base"] > 0 and b.flag() else None
        f["delta_lf"] = (b.read(2), b.flag()) if f["delta_q"] is not None and not f["intrabc"] and b.flag() else None

    def _loop_filter(self, b: Bits, f: dict, planes: int, past: Slot | None) -> tuple[list[int] | None, tuple]:
        refs, modes = past.deltas if past else (LF_REF_DELTAS, (0, 0))
        if f["lossless"] or f["intrabc"]:
            return None, (LF_REF_DELTAS, (0, 0))
        levels = [b.read(6), b.read(6)]
        if planes > 1 and any(levels):
            levels += [b.read(6), b.read(6)]
        f["sharpness"] = b.read(3)
        if b.flag() and b.flag():
            refs = tuple(signed(b, 7) if b.flag() else old for old in refs)
            modes = tuple(signed(b, 7) if b.flag() else old for old in modes)
        return levels, (refs, modes)

    @staticmethod
    def _cdef(b: Bits, planes: int) -> dict:
        damping, n = b.read(2) + 3, 1 << b.read(2)
        strength = lambda: (b.read(4), (0, 1, 2, 4)[b.read(2)])
        return {"damping": damping, "strengths": [(strength(), strength() if planes > 1 else None) for _ in range(n)]}

    def _restoration(self, b: Bits, planes: int) -> dict | None:
        kinds = [RESTORATION[b.read(2)] for _ in range(planes)]
        if not any(k != "none" for k in kinds):
            return None
        shift = b.read(1)
        if self.sequence["large_blocks"]:
            shift += 1
        elif shift:
            shift += b.read(1)
        chroma = self.sequence["sub_x"] and self.sequence["sub_y"] and any(k != "none" for k in kinds[1:])
        return {"kinds": kinds, "shift": shift, "chroma_shift": b.read(1) if chroma else 0}

    def _skip_mode_allowed(self, f: dict) -> bool:
        bits = self.sequence["order_bits"]
        if not f["compound"] or not bits:
            return False
        hints = [self._slot(i).order for i in f["refs"]]
        apart = [distance(h, f["order"], bits) for h in hints]
        if any(d > 0 for d in apart) and any(d < 0 for d in apart):
            return True
        before = sorted({d for d in apart if d < 0})
        return len(before) > 1 and not any(d > 0 for d in apart)

    def _motion(self, b: Bits, f: dict, past: Slot | None) -> list[list[int]]:
        before = past.motion if past else (IDENTITY,) * REFS
        out = []
        for old in before:
            p = list(IDENTITY)
            if b.flag():
                kind = 2 if b.flag() else 1 if b.flag() else 3  # 1 translation, 2 rotation and zoom, 3 affine
                param = lambda i, kind=kind, old=old: self._param(b, kind, i, old[i], f["high_precision"])
                if kind >= 2:
                    p[2], p[3] = param(2), param(3)
                    p[4], p[5] = (param(4), param(5)) if kind == 3 else (-p[3], p[2])
                p[0], p[1] = param(0), param(1)
            out.append(p)
        return out

    @staticmethod
    def _param(b: Bits, kind: int, i: int, old: int, precise: bool) -> int:
        size, digits = 12, 15
        if i < 2:
            size, digits = (9 - (not precise), 3 - (not precise)) if kind == 1 else (12, 6)
        shift, one = 16 - digits, i % 3 == 2
        most = 1 << size
        reference = (old >> shift) - (one << digits)
        return ((near_reference(b, 2 * most + 1, reference + most) - most) << shift) + (one << 16)

    def _grain(self, b: Bits, f: dict, slots: list[Slot | None]) -> dict | None:
        s = self.sequence
        if not s["grain"] or not (f["show"] or f["showable"]) or not b.flag():
            return None
        seed = b.read(16)
        if f["kind"] == INTER and not b.flag():
            i = b.read(3)
            if i not in f["refs"]:
                raise Fault("bitstream", "film grain of a slot that is no reference")
            return (self._slot(i).grain or {}) | {"seed": seed}
        points = lambda: [(b.read(8), b.read(8)) for _ in range(b.read(4))]
        g: dict = {"seed": seed, "y": points()}
        g["from_luma"] = not s["mono"] and b.flag()
        bare = s["mono"] or g["from_luma"] or (s["sub_x"] and s["sub_y"] and not g["y"])
        g["cb"], g["cr"] = ([], []) if bare else (points(), points())
        g["scaling"], lag = b.read(2) + 8, b.read(2)
        n = 2 * lag * (lag + 1)
        coefficients = lambda count: [b.read(8) - 128 for _ in range(count)]
        g["ar_y"] = coefficients(n) if g["y"] else []
        n += bool(g["y"])
        g["ar_cb"] = coefficients(n) if g["from_luma"] or g["cb"] else []
        g["ar_cr"] = coefficients(n) if g["from_luma"] or g["cr"] else []
        g["ar_shift"], g["scale_shift"] = b.read(2) + 6, b.read(2)
        mixing = lambda: (b.read(8), b.read(8), b.read(9))
        g["cb_mix"] = mixing() if g["cb"] else None
        g["cr_mix"] = mixing() if g["cr"] else None
        g["overlap"], g["clip"] = b.flag(), b.flag()
        return g


def near_reference(b: Bits, n: int, reference: int) -> int:
    """A value in 0..n-1 coded by how far it is from a reference: short codes nearby."""
    def centred(r: int, v: int) -> int:
        return v if v > 2 * r else r - (v + 1 >> 1) if v & 1 else r + (v >> 1)

    base, i = 0, 0
    while True:
        bits = 3 + max(0, i - 1)
        if n <= base + 3 * (1 << bits):
            value = base + b.below(n - base)
            break
        if not b.flag():
            value = base + b.read(bits)
            break
        base, i = base + (1 << bits), i + 1
    return centred(reference, value) if 2 * reference <= n else n - 1 - centred(n - 1 - reference, value)


HEADERS_OUT = "kind int, show boolean, show_existing boolean, refresh int, order_hint int, width long, height long, base_q int, fault string"


def track_headers(frames: DataFrame, track: str, order: str, payload: str, sequence: str) -> DataFrame:
    """track, order and HEADERS_OUT of every frame header of every track: payload begins with the header, sequence is the track's sequence
    header (binary, the first that isn't null). A track is a group, since each header depends on all before it; a header with a fault
    leaves the state as it was."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        known = rows[sequence].drop_null()
        decoder = Decoder(sequence_header(known[0].as_py())) if len(known) else None
        out = []
        for data in rows[payload].to_pylist():
            try:
                if decoder is None:
                    raise Fault("bitstream", "no sequence header")
                f = decoder.read(data or b"")
                out.append((f["kind"], f["show"], f["show_existing"], f["refresh"], f["order"], f["width"], f["height"], f.get("quantizer", {}).get("base"), None))
            except Fault as e:
                out.append((*[None] * 8, e.kind))
        found = [pa.array(values, kind) for values, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)]
        return pa.Table.from_arrays([rows[track], rows[order], *found], names=[track, order, *(name for name, _ in fields)])

    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [(name, arrow[kind]) for name, kind in map(str.split, HEADERS_OUT.split(", "))]
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    return frames.select(track, order, payload, sequence).groupBy(track).applyInArrow(run, f"`{track}` {kinds[track]}, `{order}` {kinds[order]}, {HEADERS_OUT}")
