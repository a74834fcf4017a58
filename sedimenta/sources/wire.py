"""Results in the protocol-buffer wire format, written and read without a compiled schema."""

from __future__ import annotations

import struct

#: Fields of each message: name -> (number, kind). Kinds: int, float, double, str, bytes, a message's name; a list of a kind is
#: repeated; a pair of kinds is a map.
MESSAGES: dict[str, dict[str, tuple[int, object]]] = {
    "Header": {"version": (1, "int"), "hash": (2, "str"), "repository": (3, "str"), "begin": (4, "int"), "end": (5, "int"), "commits": (6, "int"), "run_time": (7, "int"), "run_time_per_item": (8, ("str", "double"))},
    "Row": {"columns": (1, ["int"])},
    "Matrix": {"name": (1, "str"), "rows_count": (2, "int"), "columns_count": (3, "int"), "rows": (4, ["Row"])},
    "Owners": {"value": (1, ("int", "int"))},
    "Sparse": {"rows_count": (1, "int"), "columns_count": (2, "int"), "data": (3, ["int"]), "indices": (4, ["int"]), "indptr": (5, ["int"])},
    "Burndown": {"granularity": (1, "int"), "sampling": (2, "int"), "project": (3, "Matrix"), "files": (4, ["Matrix"]), "people": (5, ["Matrix"]), "interaction": (6, "Sparse"), "ownership": (7, ["Owners"]), "tick_size": (8, "int")},
    "Pairs": {"index": (1, ["str"]), "matrix": (2, "Sparse")},
    "Touched": {"files": (1, ["int"])},
    "Couples": {"files": (6, "Pairs"), "people": (7, "Pairs"), "people_files": (8, ["Touched"]), "files_lines": (9, ["int"])},
    "Lines": {"added": (1, "int"), "removed": (2, "int"), "changed": (3, "int")},
    "DevTick": {"commits": (1, "int"), "stats": (2, "Lines"), "languages": (3, ("str", "Lines"))},
    "TickDevs": {"devs": (1, ("int", "DevTick"))},
    "Devs": {"ticks": (1, ("int", "TickDevs")), "people": (2, ["str"]), "tick_size": (8, "int")},
    "Results": {"header": (1, "Header"), "contents": (2, ("str", "bytes"))},
}
_WIDTH = {"double": (1, "<d"), "float": (5, "<f")}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _one(number: int, kind: str, value: object) -> bytes:
    if kind == "int":
        return _varint(number << 3) + _varint(int(value))
    if kind in _WIDTH:
        code, form = _WIDTH[kind]
        return _varint(number << 3 | code) + struct.pack(form, value)
    raw = value.encode() if kind == "str" else value if kind == "bytes" else encode(kind, value)
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def encode(message: str, value: dict) -> bytes:
    """value, a dictionary by field, as bytes; numbers of a repeated field are packed, what is absent or null is left out."""
    out = []
    for name, (number, kind) in MESSAGES[message].items():
        v = value.get(name)
        if v is None:
            continue
        if isinstance(kind, list) and kind[0] == "int":
            raw = b"".join(map(_varint, v))
            out.append(_varint(number << 3 | 2) + _varint(len(raw)) + raw if raw else b"")
        elif isinstance(kind, list):
            out += [_one(number, kind[0], x) for x in v]
        elif isinstance(kind, tuple):
            for k, x in sorted(v.items()):
                entry = _one(1, kind[0], k) + _one(2, kind[1], x)
                out.append(_varint(number << 3 | 2) + _varint(len(entry)) + entry)
        elif v or isinstance(v, dict):
            out.append(_one(number, kind, v))
    return b"".join(out)


def _take(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(raw):
            raise ValueError("the message ends within a number")
        n |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return n - (1 << 64) if n >> 63 else n, at
        shift += 7


def _fields(raw: bytes):
    at = 0
    while at < len(raw):
        tag, at = _take(raw, at)
        number, code = tag >> 3, tag & 7
        if code == 0:
            v, at = _take(raw, at)
        else:
            size, at = _take(raw, at) if code == 2 else ({1: 8, 5: 4}.get(code, -1), at)
            if size < 0 or at + size > len(raw):
                raise ValueError("the message is cut off or of another format")
            v, at = raw[at : at + size], at + size
        yield number, code, v


def _value(kind: str, v: object) -> object:
    if kind in _WIDTH:
        return struct.unpack(_WIDTH[kind][1], v)[0]
    return v if kind in ("int", "bytes") else v.decode() if kind == "str" else decode(kind, v)


def _empty(kind: object) -> object:
    return [] if isinstance(kind, list) else {} if isinstance(kind, tuple) else {"int": 0, "str": "", "bytes": b""}.get(kind, 0.0 if kind in _WIDTH else None)


def decode(message: str, raw: bytes) -> dict:
    """The dictionary by field that encode() took, with defaults for what is absent; unknown fields are passed over."""
    known = {number: (name, kind) for name, (number, kind) in MESSAGES[message].items()}
    out = {name: _empty(kind) for name, (_, kind) in MESSAGES[message].items()}
    for number, code, v in _fields(raw):
        if number not in known:
            continue
        name, kind = known[number]
        if isinstance(kind, list):
            if kind[0] == "int" and code == 2:
                at = 0
                while at < len(v):
                    n, at = _take(v, at)
                    out[name].append(n)
            else:
                out[name].append(_value(kind[0], v))
        elif isinstance(kind, tuple):
            key, x = _empty(kind[0]), _empty(kind[1])
            for n, _, part in _fields(v):
                key, x = (_value(kind[0], part), x) if n == 1 else (key, _value(kind[1], part))
            out[name][key] = x if x is not None else decode(kind[1], b"")
        else:
            out[name] = _value(kind, v)
    return out
