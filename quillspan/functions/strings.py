"""String and bytes functions, native columns wherever Spark has the parts."""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the dialect's default word delimiters of INITCAP.
INITCAP_DELIMITERS = "[](){}/|<>!?@\"^#$&~_,.:;*%+- \t\n\r\v\f"


def chr_(code: Column) -> Column:
    """Code point to text; 0 is empty text."""
    return F.when(code == 0, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


@F.pandas_udf(T.StringType())
def code_points_to_string(codes: pd.Series) -> pd.Series:
    """Any NULL code gives NULL; 0 adds nothing."""

    def one(codes):
        if codes is None or pd.isna(codes).any():
            return None
        codes = np.asarray(codes)
        if len(codes) and not 0 <= codes.min() <= codes.max() <= 0x10FFFF:
            raise ValueError("no code point")
        return codes.astype("<u4").tobytes().decode("utf-32-le").replace("\0", "")

    return codes.map(one)


def code_points_to_bytes(codes: Column) -> Column:
    return F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


@F.pandas_udf(T.ArrayType(T.LongType()))
def to_code_points(text: pd.Series) -> pd.Series:
    # as many bytes a code as the library's own form has, since a batch of texts is held in it
    return text.map(lambda t: None if t is None else np.frombuffer(t.encode("utf-32-le"), "<u4"))


def from_hex(text: Column) -> Column:
    """Odd lengths get a leading zero."""
    return F.unhex(F.when(F.length(text) % 2 == 1, F.concat(F.lit("0"), text)).otherwise(text))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def to_base64(data: Column) -> Column:
    """One line: the line breaks that Spark puts behind every 76 characters are taken out."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


_BASE32 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Ten bits as two characters, and back; what is no pair of base-32 digits has more than ten bits.
_PAIRS = np.frombuffer(bytes(c for high in _BASE32 for low in _BASE32 for c in (high, low)), "<u2")
_BITS = np.full(1 << 16, 1 << 10, np.uint16)
_BITS[_PAIRS] = np.arange(1 << 10)


def b32encode(data: bytes) -> str:
    """As the library's, of which it leaves the last block."""
    whole = len(data) // 5 * 5
    b = np.frombuffer(data, np.uint8, whole).reshape(-1, 5).T.astype(np.uint16)
    bits = np.stack([b[0] << 2 | b[1] >> 6, (b[1] & 63) << 4 | b[2] >> 4, (b[2] & 15) << 6 | b[3] >> 2, (b[3] & 3) << 8 | b[4]], axis=1)
    return (_PAIRS[bits].tobytes() + base64.b32encode(data[whole:])).decode()


def b32decode(text: str) -> bytes:
    """As the library's, which reads the last block and refuses what is wrong."""
    if len(text) % 8 or not text.isascii():
        return base64.b32decode(text)
    v = _BITS[np.frombuffer(text.encode(), "<u2", max(0, len(text) - 8) // 2)].reshape(-1, 4).T
    if v.max(initial=0) >> 10:
        return base64.b32decode(text)
    data = np.stack([v[0] >> 2, (v[0] & 3) << 6 | v[1] >> 4, (v[1] & 15) << 4 | v[2] >> 6, (v[2] & 63) << 2 | v[3] >> 8, v[3] & 255], axis=1)
    return data.astype(np.uint8).tobytes() + base64.b32decode(text[-8:])


@F.pandas_udf(T.StringType())
def to_base32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else b32encode(b))


@F.pandas_udf(T.BinaryType())
def from_base32(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else b32decode(t))


def contains_substr(text: Column, part: str) -> Column:
    """Case-insensitive containment."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def initcap(text: Column, delimiters: str = INITCAP_DELIMITERS) -> Column:
    """First character of each word upper-case, the others lower-case; any delimiter parts words."""
    classed = "[" + re.escape(delimiters).replace("\\\n", "\\n") + "]"
    words = F.regexp_extract_all(text, F.lit(f"({classed}|[^{classed[1:]}+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def _pieces(text: Column, part: str) -> Column:
    return F.split(text, re.escape(part), -1)


def instr(text: Column, part: str, position: int = 1, occurrence: int = 1) -> Column:
    """1-based place of the n-th occurrence at or after ``position`` (backwards from a negative one); 0 if none."""
    if position < 0:
        length, found = F.length(text), instr(F.reverse(text), part[::-1], -position, occurrence)
        return F.when(found == 0, F.lit(0)).otherwise(length - found - len(part) + 2)
    place = F.locate(part, text, position)
    for _ in range(occurrence - 1):
        place = F.when(place == 0, F.lit(0)).otherwise(F.call_function("locate", F.lit(part), text, place + 1))
    return place


def strpos(text: Column, part: str) -> Column:
    return F.instr(text, part)


def left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def right(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def regexp_contains(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def regexp_extract(text: Column, pattern: str, position: int = 1, occurrence: int = 1) -> Column:
    """The n-th match at or after ``position`` (its group, if the pattern has one); NULL if none."""
    group, rest = min(1, _groups(pattern)), text if position == 1 else F.substring(text, position, 1 << 30)
    if occurrence == 1:  # both stop at the first match
        return F.when(rest.rlike(pattern), F.regexp_extract(rest, pattern, group))
    return F.get(F.regexp_extract_all(rest, F.lit(pattern), group), F.lit(occurrence - 1))


def regexp_extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), min(1, _groups(pattern)))


def regexp_instr(text: Column, pattern: str, position: int = 1, occurrence: int = 1, after: bool = False) -> Column:
    """Place of the n-th match (or behind it), 0 if there is none: the text up to the match is cut off piece by piece."""
    start, rest = F.lit(position), text if position == 1 else F.substring(text, position, 1 << 30)
    place = None
    for k in range(occurrence):
        at = F.regexp_instr(rest, F.lit(pattern))
        match = F.regexp_substr(rest, F.lit(pattern))
        place = F.when(at > 0, start + at - 1 + (F.length(match) if after else 0)).otherwise(F.lit(0))
        if k + 1 < occurrence:
            shift = at + F.greatest(F.length(match), F.lit(1)) - 1
            start, rest = F.when(at > 0, start + shift).otherwise(start), F.when(at > 0, F.substr(rest, shift + 1)).otherwise(F.lit(""))
    return place


def regexp_replace(text: Column, pattern: str, replacement: str) -> Column:
    r"""Back-references are written ``\1``."""
    return F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$")))


def replace(text: Column, old: str, new: str) -> Column:
    """An empty search text changes nothing."""
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def reverse_bytes(data: Column) -> Column:
    # a character a byte
    return F.encode(F.reverse(F.decode(data, "ISO-8859-1")), "ISO-8859-1")


def length_bytes(data: Column) -> Column:
    return F.octet_length(data)


def lpad_bytes(data: Column, length: int, pad: bytes = b" ") -> Column:
    """Longer values are cut to ``length`` bytes."""
    return F.lpad(data, length, pad)


def rpad_bytes(data: Column, length: int, pad: bytes = b" ") -> Column:
    return F.rpad(data, length, pad)


def trim_bytes(data: Column, members: bytes) -> Column:
    """Without the bytes at both ends that are in ``members``."""
    return F.encode(F.btrim(F.decode(data, "ISO-8859-1"), F.lit(members.decode("ISO-8859-1"))), "ISO-8859-1")


def collate(text: Column, collation: str = "und:ci") -> Column:
    """``und:ci`` compares without regard to case, ``binary`` by bytes; the text stays as it is."""
    names = {"und:ci": "UTF8_LCASE", "binary": "UTF8_BINARY", "": "UTF8_BINARY"}
    if collation not in names:
        raise ValueError(f"no collation {collation}")
    return F.collate(text, names[collation])


def safe_convert_bytes_to_string(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def soundex(text: Column) -> Column:
    """Non-letters are skipped; text without letters is empty."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


def split(text: Column, delimiter: str = ",") -> Column:
    """Empty delimiter: one element a character."""
    if delimiter == "":
        return F.filter(F.split(text, ""), lambda c: c != "")
    return _pieces(text, delimiter)


def translate(text: Column, source: str, target: str) -> Column:
    """Simultaneous; characters of ``source`` beyond ``target`` are deleted."""
    if len(set(source)) < len(source):
        raise ValueError("a source character occurs twice")
    return F.translate(text, source, target)


def unicode_(text: Column) -> Column:
    return F.ascii(text)


def trim(text: Column, characters: str | None = None) -> Column:
    return F.trim(text) if characters is None else F.btrim(text, F.lit(characters))


@F.pandas_udf(T.StringType())
def _normal(text: pd.Series, mode: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(m, t) for t, m in zip(text, mode, strict=True)])


def normalize(text: Column, mode: str = "NFC") -> Column:
    return _normal(text, F.lit(mode))


@F.pandas_udf(T.StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.casefold()))


def normalize_and_casefold(text: Column) -> Column:
    return _casefold(text)


def _literal(value: Column) -> Column:
    """A value as the dialect writes it in a query: numbers and booleans bare, text quoted, dates with their type."""
    text = value.cast("string")
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    kind = F.typeof(value)
    return (
        F.when(kind == "string", quoted(escaped))
        .when(kind == "date", F.concat(F.lit("DATE "), quoted(text)))
        .when(kind == "timestamp", F.concat(F.lit("TIMESTAMP "), quoted(F.concat(text, F.lit("+00")))))
        .when(kind == "timestamp_ntz", F.concat(F.lit("DATETIME "), quoted(text)))
        .otherwise(text)
    )


def format_(pattern: str, *values: Column) -> Column:
    """printf-style FORMAT with a constant pattern; %t is the plain text of a value, %T its literal."""
    parts, at, used = [], 0, 0
    for found in re.finditer(r"%(%|([-+ #0']*)(\d*)(?:\.(\d+))?([diouxXeEfFgGsStT]))", pattern):
        parts.append(F.lit(pattern[at : found.start()]))
        at = found.end()
        if found[1] == "%":
            parts.append(F.lit("%"))
            continue
        flags, width, digits, verb = found[2], found[3], found[4], found[5]
        value = values[used]
        used += 1
        if verb in "sStT":
            text = _literal(value) if verb == "T" else value.cast("string")
            if digits:
                text = F.substring(text, 1, int(digits))
            parts.append(F.format_string(f"%{flags.replace('0', '')}{width}s", text))
        elif verb in "diu":
            parts.append(F.format_string(f"%{flags.replace(chr(39), ',')}{width}d", value.cast("long")))
        else:
            point = f".{digits}" if digits else ".6"
            java = verb if verb in "oxX" else f"{point}{verb.lower() if verb == 'F' else verb}"
            parts.append(F.format_string(f"%{flags.replace(chr(39), ',')}{width}{java}", value))
    parts.append(F.lit(pattern[at:]))
    return F.concat(*parts)
