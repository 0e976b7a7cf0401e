"""Bodies of image-container boxes as tables: one narrow pass gives a row per file whose nested arrays are its items, extents,
references, groups, properties, associations and tracks; table() turns one of them into plain rows for joins.

A file that breaks a rule of the format has no tables but a fault: `short` (data end too early), `bitstream` (contradicts the format)
or `unsupported` (a version or a tool that isn't handled), and a message. Null content is short. A later box of a kind replaces an
earlier one of its file, but property containers and association boxes add up.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fault(Exception):
    """kind: short, bitstream or unsupported."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Cursor:
    """Big-endian fields of a stretch of bytes, in order."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n > self.end - self.at:
            raise Fault("short", f"{n} bytes wanted, {self.end - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def kind(self) -> str:
        return self.take(4).decode("latin-1")

    def need(self, n: int, what: str) -> None:
        if self.end - self.at < n:
            raise Fault("short", f"{what} is too short")

    def full(self, what: str, newest: int, least: int) -> tuple[int, int]:
        """Version and flags of a full box of at least so many bytes."""
        self.need(least, what)
        version, flags = self.number(1), self.number(3)
        if version > newest:
            raise Fault("unsupported", f"{what} version {version}")
        return version, flags

    def count(self, n: int, each: int, what: str) -> int:
        """A declared number of entries, refused if they can't fit."""
        if n * each > self.end - self.at:
            raise Fault("short", f"{n} entries of {what} don't fit")
        return n

    def text(self) -> str:
        """Up to a zero byte or the end."""
        stop = self.data.find(b"\0", self.at, self.end)
        raw = self.data[self.at : self.end if stop < 0 else stop]
        self.at = self.end if stop < 0 else stop + 1
        try:
            return raw.decode()
        except UnicodeDecodeError:
            raise Fault("bitstream", "text is not UTF-8") from None

    def children(self) -> Iterator[tuple[str, Cursor]]:
        """Type and body of each box from here on."""
        while self.at < self.end:
            start = self.at
            size, kind = self.number(4), self.kind()
            if size == 1:
                size = self.number(8)
            elif size == 0:
                size = self.end - start
            if size < self.at - start:
                raise Fault("bitstream", f"{kind} is smaller than its header")
            if size > self.end - start:
                raise Fault("short", f"{kind} ends outside its parent")
            yield kind, Cursor(self.data, self.at, start + size)
            self.at = start + size

    def child(self, kind: str) -> Cursor | None:
        """The first child of the kind; all are walked."""
        found = [body for k, body in Cursor(self.data, self.at, self.end).children() if k == kind]
        return found[0] if found else None

    def rest(self) -> bytes:
        return self.data[self.at : self.end]


class Bits:
    """Bits of a stretch of bytes, highest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise Fault("short", f"{n} bits wanted")
        first, last = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def flag(self) -> bool:
        if self.at >= 8 * len(self.data):
            raise Fault("short", "1 bits wanted")
        found = bool(self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1)
        self.at += 1
        return found

    def uvlc(self) -> int:
        """A count of leading zeros, then so many bits; 32 zeros or more give 2^32 - 1."""
        zeros = 0
        while not self.flag():
            zeros += 1
            if zeros >= 32:
                return 0xFFFFFFFF
        return self.read(zeros) + (1 << zeros) - 1

    def below(self, n: int) -> int:
        """A value in 0..n-1, one bit shorter for the first ones where n is no power of two."""
        if n < 1:
            raise Fault("bitstream", "no values to choose from")
        width = n.bit_length()
        short = (1 << width) - n
        value = self.read(width - 1)
        return value if value < short else (value << 1) - short + self.read(1)

    def align(self) -> None:
        """To the next byte; the bits left over must be 0."""
        left = -self.at % 8
        if self.read(left):
            raise Fault("bitstream", "padding bits are not zero")


# --- properties: numbers, text


def _pixi(c: Cursor) -> tuple[list[int], str | None]:
    c.need(5, "pixi")
    version, flags, n = c.number(1), c.number(3), c.number(1)
    if version:
        raise Fault("unsupported", f"pixi version {version}")
    depths = list(c.take(n))
    if flags & ~1:
        raise Fault("unsupported", f"pixi flags {flags:06x}")
    if not flags:
        return depths, None
    bits, layout = Bits(c.rest()), []
    for _ in range(n):
        channel, reserved, form, subsampled, labelled = bits.read(3), bits.read(1), bits.read(2), bits.flag(), bits.flag()
        if reserved:
            raise Fault("bitstream", "pixi reserved bit is set")
        if channel or form:
            raise Fault("unsupported", "pixi channel or component format")
        if subsampled:
            kind, location = bits.read(4), bits.read(4)
            if kind >= 5 or location > 4:
                raise Fault("bitstream", "pixi subsampling is reserved")
            layout.append(f"{kind}:{location}")
        else:
            layout.append("-")
        if labelled:
            stop = bits.data.find(b"\0", bits.at // 8)
            if stop < 0:
                raise Fault("short", "pixi label has no end")
            bits.at = 8 * (stop + 1)
    return depths, ",".join(layout)


def _colr(c: Cursor) -> tuple[list[int], str | None]:
    kind = c.kind()
    if kind != "nclx" or c.end - c.at < 7:
        return [], kind
    return [c.number(2), c.number(2), c.number(2), c.number(1) >> 7], kind


def _a1lx(c: Cursor) -> tuple[list[int], str | None]:
    c.need(1, "a1lx")
    large = c.number(1)
    if large > 1:
        raise Fault("bitstream", "a1lx reserved bits are set")
    if c.end - c.at != 3 * (2 + 2 * large):
        raise Fault("bitstream", "a1lx has another length than its sizes")
    return [c.number(2 + 2 * large) for _ in range(3)], None


def _exactly(n: int) -> Callable[[Cursor], tuple[list[int], str | None]]:
    def parse(c: Cursor) -> tuple[list[int], str | None]:
        if c.end - c.at != n:
            raise Fault("bitstream", f"payload must have {n} bytes")
        return [c.number(n)], None

    return parse


def _after_flags(parse: Callable[[Cursor], tuple[list[int], str | None]], least: int) -> Callable[[Cursor], tuple[list[int], str | None]]:
    def run(c: Cursor) -> tuple[list[int], str | None]:
        c.need(least, "property")
        c.take(4)
        return parse(c)

    return run


#: What each recognised property holds, as numbers and a text.
PROPERTIES: dict[str, Callable[[Cursor], tuple[list[int], str | None]]] = {
    "auxC": _after_flags(lambda c: ([], c.text()), 4),
    "clap": lambda c: ([c.number(4) for _ in range(8)], None),
    "irot": lambda c: ([c.number(1) & 3], None),
    "imir": lambda c: ([c.number(1) & 1], None),
    "ispe": _after_flags(lambda c: ([c.number(4), c.number(4)], None), 12),
    "pixi": _pixi,
    "av1C": lambda c: ([], None),
    "colr": _colr,
    "prem": lambda c: ([], None),
    "a1op": _exactly(1),
    "lsel": _exactly(2),
    "a1lx": _a1lx,
}


# --- the meta box


def _pitm(c: Cursor, out: dict) -> None:
    version, _ = c.full("pitm", 1, 6)
    out["primary_item"] = c.number(4 if version else 2)


def _iinf(c: Cursor, out: dict) -> None:
    version, _ = c.full("iinf", 1, 6)
    n = c.number(4 if version else 2)
    c.count(n, 8, "iinf")
    found, entries = [], c.children()
    for _ in range(n):
        kind, body = next(entries, (None, None))
        if kind is None:
            raise Fault("short", "iinf has fewer entries than it says")
        if kind != "infe":
            continue
        version, _ = body.full("infe", 3, 12)
        if version < 2:
            raise Fault("unsupported", f"infe version {version}")
        item = body.number(2 if version == 2 else 4)
        body.take(2)
        found.append({"item": item, "type": body.kind(), "name": body.text()})
    out["items"] = found


def _iloc(c: Cursor, out: dict) -> None:
    version, _ = c.full("iloc", 2, 8)
    sizes, more = c.number(1), c.number(1)
    offset, length, base, index = sizes >> 4, sizes & 15, more >> 4, (more & 15 if version else 0)
    for size in (offset, length, base, index):
        if size not in (0, 4, 8):
            raise Fault("unsupported", f"iloc field of {size} bytes")
    wide = 4 if version == 2 else 2
    n = c.number(wide)
    c.count(n, wide + 2 * (version > 0) + 4 + base, "iloc")
    located, extents = [], []
    for _ in range(n):
        item = c.number(wide)
        method = c.number(2) & 15 if version else 0
        if method > 2:
            raise Fault("unsupported", f"iloc construction method {method}")
        if c.number(2):
            raise Fault("unsupported", "iloc data in another file")
        start, many = c.number(base), c.number(2)
        c.count(many, index + offset + length, "iloc extents")
        located.append({"item": item, "method": method, "base": start})
        for no in range(many):
            at = c.number(index) if index else 1
            if method == 2 and index and not at:
                raise Fault("bitstream", "iloc extent index is zero")
            extents.append({"item": item, "method": method, "base": start, "no": no, "index": at, "offset": c.number(offset), "length": c.number(length)})
    out["locations"], out["extents"] = located, extents


def _iref(c: Cursor, out: dict) -> None:
    version, _ = c.full("iref", 1, 4)
    wide, found = 4 if version else 2, []
    for no, (kind, body) in enumerate(c.children()):
        start, n = body.number(wide), body.number(2)
        found += [{"ref_no": no, "kind": kind, "from_item": start, "pos": pos, "to_item": body.number(wide)} for pos in range(n)]
    out["refs"] = found


def _grpl(c: Cursor, out: dict) -> None:
    found = []
    for no, body in enumerate(body for kind, body in c.children() if kind == "altr"):
        body.full("altr", 0, 12)
        body.take(4)
        n = body.number(4)
        body.count(n, 4, "altr")
        found += [{"group_no": no, "pos": pos, "entity": body.number(4)} for pos in range(n)]
        if body.at != body.end:
            raise Fault("bitstream", "altr has bytes left over")
    out["groups"] = found


def _ipma(c: Cursor, out: dict) -> None:
    version, flags = c.full("ipma", 1, 8)
    n = c.number(4)
    c.count(n, (4 if version else 2) + 1, "ipma")
    width = 2 if flags & 1 else 1
    lists = out.setdefault("own", {})
    for _ in range(n):
        item, many = c.number(4 if version else 2), c.number(1)
        c.count(many, width, "ipma associations")
        again = item in lists  # a first list may repeat an index, what is added to it may not
        own = lists.setdefault(item, [])
        for _ in range(many):
            value = c.number(width)
            index = value & (0x7FFF if width == 2 else 0x7F)
            if again and any(i == index for i, _ in own):
                raise Fault("bitstream", f"item {item} has property {index} twice")
            own.append((index, bool(value >> (8 * width - 1))))
    out["assoc"] = [{"item": item, "pos": pos, "index": i, "essential": e} for item, own in lists.items() for pos, (i, e) in enumerate(own)]


def _iprp(c: Cursor, out: dict) -> None:
    for kind, body in c.children():
        if kind == "ipco":
            props = out.setdefault("props", [])
            for name, payload in body.children():
                raw = payload.rest()
                numbers, text = PROPERTIES[name](payload) if name in PROPERTIES else ([], None)
                props.append({"place": len(props) + 1, "kind": name if name in PROPERTIES else "other", "numbers": numbers, "text": text, "payload": raw})
        elif kind == "ipma":
            _ipma(body, out)


META: dict[str, Callable[[Cursor, dict], None]] = {"pitm": _pitm, "iinf": _iinf, "iloc": _iloc, "iref": _iref, "grpl": _grpl, "iprp": _iprp}


def _meta(c: Cursor, out: dict) -> None:
    c.need(4, "meta")
    c.take(4)
    for kind, body in c.children():
        if kind == "idat":
            out["idat"] = body.rest()
        elif kind in META:
            META[kind](body, out)


def _ftyp(c: Cursor, out: dict) -> None:
    c.need(8, "ftyp")
    out["major"] = c.kind()
    c.take(4)
    out["brands"] = [c.kind() for _ in range((c.end - c.at) // 4)]


# --- tracks


def _entries(c: Cursor, what: str, widths: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Rows of a counted table after version and flags."""
    c.need(8, what)
    c.take(4)
    n = c.number(4)
    c.count(n, sum(widths), what)
    return [tuple(c.number(w) for w in widths) for _ in range(n)]


def _aux_type(description: bytes) -> str | None:
    at = description.find(b"auxi")
    if at < 0 or at + 8 > len(description):
        return None
    try:
        return description[at + 8 :].split(b"\0", 1)[0].decode()
    except UnicodeDecodeError:
        return None


def _edits(edts: Cursor) -> list[dict]:
    edts.need(8, "edts")
    elst = edts.child("elst")
    if elst is None:
        raise Fault("bitstream", "edts has no elst")
    elst.need(8, "elst")
    version = elst.number(1)
    if version > 1:
        raise Fault("bitstream", f"elst version {version}")
    elst.take(3)
    n, wide = elst.number(4), 8 if version else 4
    elst.count(n, 2 * wide + 4, "elst")
    out = []
    for _ in range(n):
        duration, time = elst.number(wide), elst.number(wide)
        elst.take(4)
        out.append({"duration": duration, "media_time": time - (1 << 8 * wide) if time >> (8 * wide - 1) else time})
    return out


def _track(trak: Cursor, number: int) -> dict | None:
    """One track's raw tables, or None for a track that is no AV1 picture or incomplete."""
    mdia = trak.child("mdia")
    if mdia is None:
        return None
    tref, auxl = trak.child("tref"), []
    if tref is not None and (body := tref.child("auxl")) is not None:
        if body.end == body.at or (body.end - body.at) % 4:
            raise Fault("short", "auxl track reference")
        auxl = [body.number(4) for _ in range((body.end - body.at) // 4)]
    hdlr = mdia.child("hdlr")
    if hdlr is None or hdlr.end - hdlr.at < 12 or hdlr.rest()[8:12] not in (b"vide", b"pict", b"auxv"):
        return None
    minf = mdia.child("minf")
    stbl = minf.child("stbl") if minf is not None else None
    stsd = stbl.child("stsd") if stbl is not None else None
    if stsd is None:
        return None
    stsd.need(8, "stsd")
    stsd.take(4)
    n, entries, descriptions = stsd.number(4), stsd.children(), []
    for _ in range(n):
        kind, body = next(entries, (None, None))
        if kind is None:
            raise Fault("short", "stsd has fewer entries than it says")
        descriptions.append(body.rest() if kind == "av01" else None)
    known = [d for d in descriptions if d is not None]
    tables = {k: stbl.child(k) for k in ("stsc", "stsz", "stco", "co64", "stts")}
    chunks = tables["stco"] or tables["co64"]
    if not known or tables["stsc"] is None or tables["stsz"] is None or chunks is None:
        return None
    offsets = [o for (o,) in _entries(chunks, "chunk offsets", (4 if chunks is tables["stco"] else 8,))]
    stsz = tables["stsz"]
    stsz.need(12, "stsz")
    stsz.take(4)
    fixed, many = stsz.number(4), stsz.number(4)
    sizes = [fixed] * many if fixed else [stsz.number(4) for _ in range(stsz.count(many, 4, "stsz"))]
    scale = 1
    if (mdhd := mdia.child("mdhd")) is not None:
        mdhd.need(16, "mdhd")
        mdhd.take(19 if mdhd.number(1) == 1 else 11)
        scale = mdhd.number(4)
        if not scale:
            raise Fault("bitstream", "timescale is zero")
    aux = next((t for t in map(_aux_type, known) if t is not None), None)
    edts = trak.child("edts")
    return {
        "track_no": number, "auxl": auxl, "aux_type": aux, "timescale": scale, "sizes": sizes, "chunks": offsets,
        "per_chunk": [{"first_chunk": a, "samples": b, "description": d} for a, b, d in _entries(tables["stsc"], "stsc", (4, 4, 4))],
        "durations": None if tables["stts"] is None else [{"count": a, "duration": b} for a, b in _entries(tables["stts"], "stts", (4, 4))],
        "descriptions": descriptions, "edits": None if edts is None else _edits(edts),
    }


def _moov(c: Cursor, out: dict) -> None:
    tracks = out.setdefault("tracks", [])
    for kind, body in c.children():
        if kind == "trak" and (track := _track(body, len(tracks))) is not None:
            tracks.append(track)


FIELDS = {
    "path": "string", "fault": "string", "message": "string", "major": "string", "brands": "array<string>", "primary_item": "bigint",
    "items": "array<struct<item: bigint, type: string, name: string>>",
    "locations": "array<struct<item: bigint, method: int, base: bigint>>",
    "extents": "array<struct<item: bigint, method: int, base: bigint, no: int, index: bigint, offset: bigint, length: bigint>>",
    "refs": "array<struct<ref_no: int, kind: string, from_item: bigint, pos: int, to_item: bigint>>",
    "groups": "array<struct<group_no: int, pos: int, entity: bigint>>",
    "props": "array<struct<place: int, kind: string, numbers: array<bigint>, text: string, payload: binary>>",
    "assoc": "array<struct<item: bigint, pos: int, index: int, essential: boolean>>",
    "idat": "binary",
    "tracks": "array<struct<track_no: int, auxl: array<bigint>, aux_type: string, timescale: bigint, sizes: array<bigint>, chunks: array<bigint>, per_chunk: array<struct<first_chunk: bigint, samples: bigint, description: bigint>>, durations: array<struct<count: bigint, duration: bigint>>, descriptions: array<binary>, edits: array<struct<duration: bigint, media_time: bigint>>>>",
}
LISTS = ("brands", "items", "locations", "extents", "refs", "groups", "props", "assoc", "tracks")


def parse(data: bytes | None) -> dict:
    """The tables of one file, by FIELDS."""
    out: dict = {}
    try:
        whole = Cursor(data or b"")
        for no, (kind, body) in enumerate(whole.children()):
            if no == 0 and kind != "ftyp":
                raise Fault("bitstream", "the first box is not ftyp")
            if no == 0:
                _ftyp(body, out)
            elif kind == "meta":
                _meta(body, out)
            elif kind == "moov":
                _moov(body, out)
        if "major" not in out:
            raise Fault("short", "no box")
    except Fault as e:
        return {"fault": e.kind, "message": str(e)}
    return {k: v for k, v in out.items() if k in FIELDS} | {k: out.get(k, []) for k in LISTS}


def file_tables(files: DataFrame) -> DataFrame:
    """One row per file with its nested tables (FIELDS). files: path and content, as binaryFile gives them. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in FIELDS.items())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [{"path": path} | parse(content.as_py()) for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in FIELDS.items()))


def table(parsed: DataFrame, name: str) -> DataFrame:
    """path and the columns of one nested table, a row per entry."""
    return parsed.select("path", F.inline(name))


def is_avif(content_brands: DataFrame) -> DataFrame:
    """The rows with avif: whether the major brand or a compatible one is one of the format's."""
    wanted = ("avif", "avis", "avio")  # fixed values
    return content_brands.withColumn("avif", F.col("major").isin(*wanted) | F.exists("brands", lambda b: b.isin(*wanted)))


# --- writing: boxes of files that queries and tests are made of


def box(kind: str, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind.encode("latin-1") + body


def full_box(kind: str, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3, "big") + body)
