"""Byte-level functions of container entries (I rows of the survey), as small helpers behind one Arrow-batched UDF."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inflated(data: bytes, bits: int) -> bytes:
    """Raw (-15), zlib (15) or gzip (31) deflate; what follows the stream is ignored."""
    return zlib.decompressobj(bits).decompress(data)


def framed_inflated(data: bytes) -> bytes:
    """Blocks of raw deflate, each behind its length in 16 bits; the windows are separate."""
    out, at = [], 0
    while at + 2 <= len(data):
        n = int.from_bytes(data[at : at + 2], "little")
        out.append(inflated(data[at + 2 : at + 2 + n], -15))
        at += 2 + n
    return b"".join(out)


def lzma_raw(data: bytes) -> bytes:
    """I4: five bytes of properties, eight of size, and the stream."""
    return lzma.decompress(data, lzma.FORMAT_ALONE)


def xor_index(data: bytes) -> bytes:
    """Five keys from 0xDB in turn, each five larger after use."""
    i = np.arange(len(data))
    return (np.frombuffer(data, np.uint8) ^ ((0xDB + i % 5 + 5 * (i // 5)) & 0xFF).astype(np.uint8)).tobytes()


def xor_constant(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.uint8(key)).tobytes()


def unscrambled(data: bytes) -> bytes:
    """Rotate (byte ^ 0xD5) right by two, less the position modulo 0x47."""
    x = np.frombuffer(data, np.uint8) ^ np.uint8(0xD5)
    return ((x >> 2 | x << 6) - (np.arange(len(x)) % 0x47).astype(np.uint8)).astype(np.uint8).tobytes()


def weak_crc32(data: bytes) -> int:
    """CRC-32 without inverting before and after."""
    return zlib.crc32(data, 0xFFFFFFFF) ^ 0xFFFFFFFF


CODECS: dict[str, Callable[[bytes], bytes]] = {
    "none": lambda x: x,
    "deflate": lambda x: inflated(x, -15),
    "zlib": lambda x: inflated(x, 15),
    "gzip": lambda x: inflated(x, 31),
    "framed": framed_inflated,
    "bzip2": bz2.decompress,
    "lzma": lzma_raw,
    "xor_index": xor_index,
    "xor33": lambda x: xor_constant(x, 0x33),
    "unscramble": unscrambled,
}


def decoded_bytes(data: bytes | None, codec: str | None) -> tuple[bytes | None, str]:
    """(content, status); hostile input gives a status, never an exception."""
    if data is None:
        return None, "missing"
    try:
        return CODECS[codec or "none"](data), "ok"
    except KeyError:
        return None, f"unknown codec {codec}"
    except (zlib.error, lzma.LZMAError, OSError, ValueError, EOFError) as e:
        return None, f"bad data: {e}"


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())]))
def decoded(data: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """A struct of the decoded bytes and a status."""
    return pd.DataFrame([decoded_bytes(d, c) for d, c in zip(data, codec, strict=True)], columns=["content", "status"])
