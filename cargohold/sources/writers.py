"""Small writers of containers, for round trips: rows become a container's bytes."""

from __future__ import annotations

import struct

from cargohold.functions.codecs import xor_constant, xor_index


def vp_bytes(files: list[tuple[str, bytes, int]]) -> bytes:
    """(path, content, time) rows as one VP file; each path opens and closes its directories."""
    data, entries, at = [], [], 16
    for path, content, time in files:
        *dirs, name = path.split("\\")
        entries += [struct.pack("<ii32si", -1, 0, d.encode(), 0) for d in dirs]
        entries.append(struct.pack("<ii32si", at, len(content), name.encode(), time))
        entries += [struct.pack("<ii32si", -1, 0, b"..", 0) for _ in dirs]
        data.append(content)
        at += len(content)
    return struct.pack("<4siii", b"VPVP", 2, at, len(entries)) + b"".join(data) + b"".join(entries)


def pak_bytes(files: list[tuple[str, bytes, int]]) -> bytes:
    entries, at = [], 12
    for path, content, _ in files:
        entries.append(struct.pack("<56sII", path.replace("\\", "/").encode(), at, len(content)))
        at += len(content)
    return struct.pack("<4sII", b"PACK", at, 64 * len(entries)) + b"".join(c for _, c, _ in files) + b"".join(entries)


def xcat_bytes(files: list[tuple[str, bytes, int]], data_name: str) -> tuple[bytes, bytes]:
    """(index, data)."""
    index = data_name.encode() + b"\n" + b"".join(f"{p} {len(c)}\n".encode() for p, c, _ in files)
    index += b"\0" * (-len(index) % 5)
    return xor_index(index), xor_constant(b"".join(c for _, c, _ in files), 0x33)


def bat_bytes(messages: list[tuple[bytes, int, bool]]) -> bytes:
    """(message, received, deleted) rows."""
    out = [b"\x20\x06\x79\x19", struct.pack("<H", 6)]
    for raw, received, deleted in messages:
        out += [struct.pack("<4sIIIHHB7xIII8x", b"\x21\x09\x70\x19", 48, 0, received, 0, 0, int(deleted), 0, 0, len(raw)), raw]
    return b"".join(out)
