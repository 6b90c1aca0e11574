"""The binary trace format: a stream of Cap'n Proto messages, decoded and encoded in plain Python.

Layouts follow from the field lists by the format's rule: in order of declaration, numbers take the first free place of their
size in the data section and texts and lists take the next pointer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: The message types of the trace schema, with fields in declared order.
STRUCTS: dict[str, list[tuple[str, str]]] = {
    "methodenter": [("name", "text"), ("calleeclass", "text"), ("calleetag", "i64"), ("signature", "text"), ("threadName", "text"), ("callsitefile", "text"), ("callsiteline", "i64")],
    "lateinit": [("calleetag", "i64"), ("calleeclass", "text"), ("fields", "tuples")],
    "fieldstore": [("holderclass", "text"), ("holdertag", "i64"), ("newval", "i64"), ("oldval", "i64"), ("fname", "text"), ("type", "text"), ("callermethod", "text"), ("callerclass", "text"), ("callertag", "i64"), ("threadName", "text")],
    "fieldload": [("holderclass", "text"), ("holdertag", "i64"), ("val", "i64"), ("fname", "text"), ("type", "text"), ("callermethod", "text"), ("callerclass", "text"), ("callertag", "i64"), ("threadName", "text")],
    "varstore": [("callermethod", "text"), ("callerclass", "text"), ("callertag", "i64"), ("newval", "i64"), ("oldval", "i64"), ("var", "i8"), ("threadName", "text")],
    "varload": [("callermethod", "text"), ("callerclass", "text"), ("callertag", "i64"), ("val", "i64"), ("var", "i8"), ("threadName", "text")],
    "readmodify": [("isModify", "bool"), ("calleeclass", "text"), ("calleetag", "i64"), ("fname", "text"), ("callerclass", "text"), ("callertag", "i64"), ("threadName", "text")],
    "methodexit": [("name", "text"), ("cname", "text"), ("threadName", "text")],
}
#: The union's cases in order of their tags.
KINDS = tuple(STRUCTS)
TUPLE = [("name", "text"), ("val", "i64")]
BITS = {"i64": 64, "i8": 8, "bool": 1}


def layout(fields: list[tuple[str, str]]) -> tuple[list[tuple[str, str, int]], int, int]:
    """((name, type, bit offset or pointer number) in order, data words, pointers)."""
    out, taken, pointers, words = [], [], 0, 0
    for name, kind in fields:
        if kind not in BITS:
            out.append((name, kind, pointers))
            pointers += 1
            continue
        size, at = BITS[kind], 0
        while any(at < b and a < at + size for a, b in taken):
            at += size
        taken.append((at, at + size))
        words = max(words, -(-(at + size) // 64))
        out.append((name, kind, at))
    return out, words, pointers


LAYOUTS = {k: layout(f) for k, f in STRUCTS.items()}
TUPLE_LAYOUT = layout(TUPLE)


class Message:
    def __init__(self, segments: list[bytes]):
        self.segments = segments

    def word(self, seg: int, at: int) -> int:
        return struct.unpack_from("<Q", self.segments[seg], 8 * at)[0]

    def follow(self, seg: int, at: int) -> tuple[int, int, int]:
        """(segment, pointer word, first word of the target); resolves far pointers."""
        p = self.word(seg, at)
        if p & 3 == 2:
            pad_seg, pad = p >> 32, (p >> 3) & 0x1FFFFFFF
            if p & 4:
                far, tag = self.word(pad_seg, pad), self.word(pad_seg, pad + 1)
                return far >> 32, tag, (far >> 3) & 0x1FFFFFFF
            seg, at, p = pad_seg, pad, self.word(pad_seg, pad)
        offset = (p & 0xFFFFFFFF) >> 2
        offset -= (offset & 0x20000000) << 1
        return seg, p, at + 1 + offset

    def read(self, spec, seg: int, data: int, words: int, pointers: int) -> dict:
        fields, _, _ = spec
        out = {}
        for name, kind, at in fields:
            if kind in BITS:
                known = at // 64 < words
                w = self.word(seg, data + at // 64) >> (at % 64) if known else 0
                if kind == "bool":
                    out[name] = bool(w & 1)
                else:
                    n = BITS[kind]
                    w &= (1 << n) - 1
                    out[name] = w - (1 << n) if w >> (n - 1) else w
            elif at >= pointers or self.word(seg, data + words + at) == 0:
                out[name] = "" if kind == "text" else []
            else:
                where, p, start = self.follow(seg, data + words + at)
                size = p >> 35
                if kind == "text":
                    out[name] = self.segments[where][8 * start : 8 * start + size - 1].decode("utf-8", "replace")
                else:
                    tag = self.word(where, start)
                    n, w, k = (tag & 0xFFFFFFFF) >> 2, (tag >> 32) & 0xFFFF, tag >> 48
                    out[name] = [self.read(TUPLE_LAYOUT, where, start + 1 + i * (w + k), w, k) for i in range(n)]
        return out

    def event(self) -> tuple[str, dict]:
        seg, p, at = self.follow(0, 0)
        words, pointers = (p >> 32) & 0xFFFF, p >> 48
        which = self.word(seg, at) & 0xFFFF if words else 0
        kind = KINDS[which]
        if not pointers or self.word(seg, at + words) == 0:
            return kind, self.read(LAYOUTS[kind], seg, at, 0, 0)
        seg, p, start = self.follow(seg, at + words)
        return kind, self.read(LAYOUTS[kind], seg, start, (p >> 32) & 0xFFFF, p >> 48)


def messages(stream) -> Iterator[Message]:
    """Messages of a binary stream. A stream that breaks off inside a message ends there."""
    while len(head := stream.read(4)) == 4:
        n = struct.unpack("<I", head)[0] + 1
        table = stream.read(4 * (n + (n + 1) % 2))
        if len(table) < 4 * n:
            return
        sizes = struct.unpack_from(f"<{n}I", table)
        segments = [stream.read(8 * s) for s in sizes]
        if any(len(b) < 8 * s for b, s in zip(segments, sizes)):
            return
        yield Message(segments)


def events(stream, first: int = 1) -> Iterator[tuple[int, str, dict]]:
    """(idx, kind, fields), counted from ``first``."""
    for idx, m in enumerate(messages(stream), first):
        kind, fields = m.event()
        yield idx, kind, fields


# ---- writing, one segment a message


def _struct(spec, values: dict, at: int) -> tuple[bytearray, bytearray]:
    """(own words, words that follow); ``at``: the word where what follows begins, counted from the own first word."""
    fields, words, pointers = spec
    own, more = bytearray(8 * (words + pointers)), bytearray()
    for name, kind, place in fields:
        v = values.get(name)
        if kind in BITS:
            w = int(v or 0) & ((1 << BITS[kind]) - 1)
            old = struct.unpack_from("<Q", own, 8 * (place // 64))[0]
            struct.pack_into("<Q", own, 8 * (place // 64), old | w << (place % 64))
        elif v:
            here, target = words + place, at + len(more) // 8
            offset = (target - here - 1) << 2
            if kind == "text":
                raw = v.encode() + b"\0"
                struct.pack_into("<Q", own, 8 * here, offset | 1 | 2 << 32 | len(raw) << 35)
                more += raw + bytes(-len(raw) % 8)
            else:
                _, w, k = TUPLE_LAYOUT
                struct.pack_into("<Q", own, 8 * here, offset | 1 | 7 << 32 | len(v) * (w + k) << 35)
                bodies, tail, size = bytearray(), bytearray(), len(v) * (w + k)
                for i, item in enumerate(v):
                    body, rest = _struct(TUPLE_LAYOUT, item, size - i * (w + k) + len(tail) // 8)
                    bodies += body
                    tail += rest
                more += struct.pack("<Q", len(v) << 2 | w << 32 | k << 48) + bodies + tail
    return own, more


def encode(kind: str, values: dict) -> bytes:
    spec = LAYOUTS[kind]
    own, more = _struct(spec, values, spec[1] + spec[2])
    root = struct.pack("<Q", 1 << 32 | 1 << 48) + struct.pack("<Q", KINDS.index(kind)) + struct.pack("<Q", spec[1] << 32 | spec[2] << 48)
    body = root + own + more
    return struct.pack("<II", 0, len(body) // 8) + body
