"""Network functions; addresses are BYTES in network order."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Public suffixes of more than one label that this library knows; others count their last label.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")


def host(url: Column) -> Column:
    """Host of a URL with or without a scheme, without user and port, lower-case; NULL if there is none."""
    rest = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":\d*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def public_suffix(url: Column) -> Column:
    name = host(url)
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.nullif(F.regexp_extract(name, r"([^.]+)$", 1), F.lit("")))


def reg_domain(url: Column) -> Column:
    """Public suffix with one more label; NULL for a bare suffix."""
    name, suffix = host(url), public_suffix(url)
    before = F.substr(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    label = F.regexp_extract(before, r"([^.]+)$", 1)
    return F.when(F.length(name) > F.length(suffix), F.concat(label, F.lit("."), suffix))


def ipv4_from_int64(n: Column) -> Column:
    """The low 32 bits, for negative and larger numbers too."""
    return F.unhex(F.lpad(F.hex(n.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))


def ipv4_to_int64(address: Column) -> Column:
    return F.conv(F.hex(address), 16, 10).cast("long")


def ip_from_string(text: Column, safe: bool = False) -> Column:
    """NET.IP_FROM_STRING, or NET.SAFE_IP_FROM_STRING."""

    @F.pandas_udf(T.BinaryType())
    def parse(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                return None if value is None else ipaddress.ip_address(value).packed
            except ValueError:
                if safe:
                    return None
                raise

        return values.map(one)

    return parse(text)


@F.pandas_udf(T.StringType())
def ip_to_string(address: pd.Series) -> pd.Series:
    return address.map(lambda b: None if b is None else str(ipaddress.ip_address(bytes(b))))


def ip_net_mask(size: int, prefix: int) -> Column:
    """Mask of ``size`` bytes with ``prefix`` leading ones; both are constants."""
    bits = size * 8
    return F.lit(((1 << bits) - (1 << (bits - prefix))).to_bytes(size, "big"))


def ip_trunc(address: Column, prefix: int) -> Column:
    @F.pandas_udf(T.BinaryType())
    def cut(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            bits = len(value) * 8
            kept = int.from_bytes(value, "big") >> (bits - prefix) << (bits - prefix)
            return kept.to_bytes(len(value), "big")

        return values.map(one)

    return cut(address)
