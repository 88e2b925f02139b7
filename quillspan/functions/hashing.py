"""Hash functions; digests are BYTES, fingerprints INT64."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def md5(x: Column) -> Column:
    return F.unhex(F.md5(x))


def sha1(x: Column) -> Column:
    return F.unhex(F.sha1(x))


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def sha512(x: Column) -> Column:
    return F.unhex(F.sha2(x, 512))


# The multipliers and the seed of the published FarmHash Fingerprint64.
_K0, _K1, _K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
_SEED = 81
_MASK = (1 << 64) - 1


def _turn(v: int, by: int) -> int:
    """Rotates a 64-bit value to the right."""
    v &= _MASK
    return (v >> by | v << (64 - by)) & _MASK


def _fold(v: int) -> int:
    v &= _MASK
    return v ^ v >> 47


def _pair(u: int, v: int, times: int) -> int:
    """Mixes two words into one."""
    a = _fold((u ^ v) * times)
    return _fold((v ^ a) * times) * times & _MASK


def _at(data: bytes, place: int) -> int:
    return int.from_bytes(data[place : place + 8], "little")


def _upto_16(data: bytes) -> int:
    n = len(data)
    times = _K2 + 2 * n
    if n >= 8:
        a, b = _at(data, 0) + _K2, _at(data, n - 8)
        return _pair(_turn(b, 37) * times + a, (_turn(a, 25) + b) * times, times)
    if n >= 4:
        first, last = (int.from_bytes(data[i : i + 4], "little") for i in (0, n - 4))
        return _pair(n + (first << 3), last, times)
    if n:
        y, z = data[0] + (data[n >> 1] << 8), n + (data[-1] << 2)
        return _fold(y * _K2 ^ z * _K0) * _K2 & _MASK
    return _K2


def _upto_64(data: bytes) -> int:
    n = len(data)
    times = _K2 + 2 * n
    a, b = _at(data, 0) * (_K1 if n <= 32 else _K2), _at(data, 8)
    c, d = _at(data, n - 8) * times, _at(data, n - 16) * _K2
    y = _turn(a + b, 43) + _turn(c, 30) + d
    z = _pair(y, a + _turn(b + _K2, 18) + c, times)
    if n <= 32:
        return z
    e, f = _at(data, 16) * times, _at(data, 24)
    g, h = (y + _at(data, n - 32)) * times, (z + _at(data, n - 24)) * times
    return _pair(_turn(e + f, 43) + _turn(g, 30) + h, e + _turn(f + a, 18) + g, times)


def _block(words: tuple, i: int, a: int, b: int) -> tuple[int, int]:
    """Mixes four words of a block, from the i-th on, with two seeds."""
    a += words[i]
    b = _turn(b + a + words[i + 3], 21)
    inner = a + words[i + 1] + words[i + 2]
    return (inner + words[i + 3]) & _MASK, (b + _turn(inner, 44) + a) & _MASK


def _round(words: tuple, x: int, y: int, z: int, v: tuple, w: tuple, times: int, weight: int) -> tuple:
    """One block of 64 bytes; the last block has another factor and weight."""
    x = _turn(x + y + v[0] + words[1], 37) * times & _MASK
    y = _turn(y + v[1] + words[6], 42) * times
    x ^= w[1] * weight & _MASK
    y += v[0] * weight + words[5]
    z = _turn(z + w[0], 33) * times
    v = _block(words, 0, v[1] * times, x + w[0])
    w = _block(words, 4, z + w[1], y + words[2])
    return z & _MASK, y & _MASK, x, v, w


def _over_64(data: bytes) -> int:
    n = len(data)
    y = _SEED * _K1 + 113 & _MASK
    x, z = _SEED * _K2 + _at(data, 0) & _MASK, _fold(y * _K2 + 113) * _K2 & _MASK
    v, w = (0, 0), (0, 0)
    for start in range(0, (n - 1) // 64 * 64, 64):
        x, y, z, v, w = _round(struct.unpack_from("<8Q", data, start), x, y, z, v, w, _K1, 1)
    times = _K1 + ((z & 0xFF) << 1)
    w = (w[0] + (n - 1 & 63), w[1])
    v = (v[0] + w[0], v[1])
    w = (w[0] + v[0], w[1])
    x, y, z, v, w = _round(struct.unpack_from("<8Q", data, n - 64), x, y, z, v, w, times, 9)
    return _pair(_pair(v[0], w[0], times) + _fold(y) * _K0 + z, _pair(v[1], w[1], times) + x, times)


def fingerprint64(data: bytes) -> int:
    """FarmHash Fingerprint64 of the bytes, as a signed 64-bit number."""
    found = (_upto_16 if len(data) <= 16 else _upto_64 if len(data) <= 64 else _over_64)(data)
    return found - (1 << 64) if found >> 63 else found


@F.pandas_udf(LongType())
def _fingerprints(data: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else fingerprint64(b) for b in data], dtype="Int64")


def farm_fingerprint(x: Column) -> Column:
    """FARM_FINGERPRINT of STRING (its UTF-8) or BYTES; NULL gives NULL."""
    return _fingerprints(x.cast("binary"))
