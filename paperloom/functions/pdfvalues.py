"""PDF values as JSON text, and back: the per-value helper of the PDF source and writer.

In JSON a name is ``"/Name"``, a string ``{"s": hex}``, a reference ``{"r": [number, generation]}``;
numbers, booleans, null, arrays and dictionaries are themselves. Dictionary keys have no slash.
"""

from __future__ import annotations

import json
import re

_SPACE = b" \t\r\n\x0c\x00"
_TOKEN = re.compile(rb"[\s\x00]*(?:%[^\r\n]*[\s\x00]*)*(<<|>>|[\[\]{}]|/[^\s\x00()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\s\x00()<>\[\]{}/%]+)")
_REF = re.compile(rb"[\s\x00]+(\d+)[\s\x00]+R(?![A-Za-z0-9])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_HEXED, _UNSAFE = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")
_WORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def name_text(raw: bytes) -> str:
    return (_HEXED.sub(lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw).decode("latin-1")


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses whose first byte is at ``at``; (value, place after it)."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            elif e == b"\r":
                at += 2 if data[at + 1 : at + 2] == b"\n" else 1
            else:
                out += b"" if e == b"\n" else _ESCAPES.get(e, e)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if depth == 0:
            break
        out += c
    return bytes(out), at


def hex_string(raw: bytes) -> bytes:
    digits = b"".join(raw.split())
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """The value at a place, and the place after it. A bare word is returned as bytes."""
    m = _TOKEN.match(data, at)
    if not m:
        raise ValueError(f"no value at {at}")
    token, at = m[1], m.end()
    if token == b"<<":
        out = {}
        while True:
            key, at = parse(data, at)
            if key == b">>":
                return out, at
            if not isinstance(key, str):
                continue
            value, at = parse(data, at)
            if value == b">>":
                return out, at
            out[key[1:]] = value
    if token == b"[":
        items = []
        while True:
            value, at = parse(data, at)
            if value == b"]":
                return items, at
            items.append(value)
    if token == b"(":
        value, at = literal(data, at)
        return {"s": value.hex()}, at
    if token[:1] == b"<" and token != b"<<":
        return {"s": hex_string(token[1:-1]).hex()}, at
    if token[:1] == b"/":
        return "/" + name_text(token[1:]), at
    if _NUMBER.match(token):
        if token.isdigit():
            ref = _REF.match(data, at)
            if ref:
                return {"r": [int(token), int(ref[1])]}, ref.end()
            return int(token), at
        value = float(token)
        return int(value) if value.is_integer() and b"." not in token else value, at
    return _WORDS.get(token, token), at


def references(value: object, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], int, int]]:
    """(key path, number, generation) of every reference inside; array places are part of the path."""
    if isinstance(value, dict):
        if set(value) == {"r"}:
            return [(path, *value["r"])]
        return [x for k, v in value.items() for x in references(v, (*path, k))]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in references(v, (*path, str(k)))]
    return []


def relinked(value: object, moves: dict[tuple[int, int], tuple[int, int]]) -> object:
    if isinstance(value, dict):
        if set(value) == {"r"}:
            return {"r": list(moves.get(tuple(value["r"]), tuple(value["r"])))}
        return {k: relinked(v, moves) for k, v in value.items()}
    return [relinked(v, moves) for v in value] if isinstance(value, list) else value


def to_json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), default=lambda b: "/" + b.decode("latin-1"))


def to_pdf(value: object) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, (int, float)):
        return (f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)).encode()
    if isinstance(value, str):
        return b"/" + _UNSAFE.sub(lambda m: b"#%02X" % m[0][0], value[1:].encode("latin-1"))
    if isinstance(value, list):
        return b"[" + b" ".join(map(to_pdf, value)) + b"]"
    if set(value) == {"r"}:
        return b"%d %d R" % tuple(value["r"])
    if set(value) == {"s"}:
        return b"<" + value["s"].encode() + b">"
    return b"<<" + b" ".join(to_pdf("/" + k) + b" " + to_pdf(v) for k, v in value.items()) + b">>"
