"""Bytes, printable forms, and Unicode units of tokens."""

from __future__ import annotations

from functools import cache

BYTE_UNIT = 0x110000  #: a raw byte b is the unit BYTE_UNIT + b, after all code points


@cache
def byte_to_printable() -> dict[int, str]:
    """Each byte as one printable character: itself where Latin-1 prints it, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + k) for k, b in enumerate(hidden)}


@cache
def printable_to_byte() -> dict[str, int]:
    return {c: b for b, c in byte_to_printable().items()}


def printable(token: bytes) -> str:
    table = byte_to_printable()
    return "".join(table[b] for b in token)


def from_printable(text: str) -> bytes:
    table = printable_to_byte()
    try:
        return bytes(table[c] for c in text)
    except KeyError as e:
        raise ValueError(f"{e.args[0]!r} is not in the printable alphabet") from None


def byte_order(alphabet: str) -> list[int]:
    """The bytes in the order of their ids."""
    if alphabet in ("raw", None):
        return list(range(256))
    if alphabet == "byte_level":
        table = byte_to_printable()
        return sorted(range(256), key=lambda b: table[b])
    raise ValueError(f"Unknown initial alphabet: {alphabet}")


def units(token: bytes) -> tuple[int, ...]:
    """Code points where the bytes are well-formed, and raw bytes (BYTE_UNIT + b) where not.

    A lead byte and the continuation bytes behind it are one run: all of it is a
    code point or all of it stays bytes. ASCII is always a code point.
    """
    out: list[int] = []
    k = 0
    while k < len(token):
        b = token[k]
        if b < 0x80:
            out.append(b)
            k += 1
            continue
        z = k + 1
        if b >= 0xC0:
            while z < len(token) and 0x80 <= token[z] < 0xC0:
                z += 1
        try:
            out += map(ord, token[k:z].decode())
        except UnicodeDecodeError:
            out += [BYTE_UNIT + x for x in token[k:z]]
        k = z
    return tuple(out)


def units_to_bytes(seq: tuple[int, ...]) -> bytes:
    return b"".join(bytes([u - BYTE_UNIT]) if u >= BYTE_UNIT else chr(u).encode() for u in seq)


def is_canonical(token: bytes) -> bool:
    """A token of a Unicode model: code points only, or raw bytes only (one ASCII byte counts as either)."""
    u = units(token)
    raw = sum(x >= BYTE_UNIT for x in u)
    return raw in (0, len(u))


def is_legal_merge(left: bytes, right: bytes) -> bool:
    """Unicode + Unicode, or raw + raw that stays raw or becomes exactly one code point."""
    a, b, c = units(left), units(right), units(left + right)
    raw = [all(x >= BYTE_UNIT for x in u) for u in (a, b, c)]
    if not any(x >= BYTE_UNIT for x in a + b):
        return True
    return raw[0] and raw[1] and (raw[2] or len(c) == 1)


def _hidden(c: str) -> bool:
    return c < "!" or c == "\x7f" or c.isspace() or c == "␣"


def escaped(token: bytes) -> str:
    """Readable text: a blank is ``␣``, control and white-space characters ``{uXXXX}``, raw bytes ``{xHH}``."""
    out = []
    for u in units(token):
        if u >= BYTE_UNIT:
            out.append(f"{{x{u - BYTE_UNIT:02x}}}")
        elif u == 0x20:
            out.append("␣")
        elif _hidden(chr(u)) or chr(u) == "{":
            out.append(f"{{u{u:04x}}}")
        else:
            out.append(chr(u))
    return "".join(out)


def from_escaped(text: str) -> bytes:
    out, k = b"", 0
    while k < len(text):
        c = text[k]
        z = text.find("}", k) if c == "{" and text[k + 1 : k + 2] in ("x", "u") else -1
        if z > 0:
            try:
                n = int(text[k + 2 : z], 16)
            except ValueError:
                raise ValueError(f"bad escape {text[k : z + 1]}") from None
            out += bytes([n]) if text[k + 1] == "x" else chr(n).encode()
            k = z + 1
        else:
            out += b" " if c == "␣" else c.encode()
            k += 1
    return out


def lossy(token: bytes) -> str:
    return token.decode("utf-8", "replace")
