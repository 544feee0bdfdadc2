"""Keyed functions as native expressions: HMAC-SHA256 labels, hash features, splits and partitions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and the outer pad of HMAC-SHA256 for `key`."""
    key = hashlib.sha256(key).digest() if len(key) > BLOCK_BYTES else key
    key = key.ljust(BLOCK_BYTES, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def _binary(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def hmac_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a BINARY column as 64 hex digits."""
    inner, outer = pads(key)
    return F.sha2(F.concat(_binary(outer), F.unhex(F.sha2(F.concat(_binary(inner), message), 256))), 256)


def keyed_term(term: Column, key: bytes) -> Column:
    """The first 32 hex digits of the term's HMAC."""
    return F.substring(hmac_hex(F.encode(term, "UTF-8"), key), 1, 32)


def big_endian(number: Column, width: int) -> Column:
    """An integer column as `width` bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 2 * width, "0"))


def cell_label(cell: Column, key: bytes, tag: bytes) -> Column:
    """A cell's 16-byte label as hex: HMAC of the tag and the cell's four bytes."""
    return F.substring(hmac_hex(F.concat(_binary(tag), big_endian(cell, 4)), key), 1, 32)


def unsigned64(digits: Column) -> Column:
    """Sixteen hex digits as DECIMAL(20,0)."""
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def hash_coordinate(label: Column, key: bytes, dimensions: int) -> Column:
    """The coordinate a label falls on: its HMAC's first 64 bits modulo `dimensions`."""
    digest = hmac_hex(F.encode(label, "UTF-8"), key)
    return F.pmod(unsigned64(F.substring(digest, 1, 16)), F.lit(dimensions).cast("decimal(20,0)")).cast("int")


def hash_sign(label: Column, key: bytes) -> Column:
    """+1 where the HMAC's ninth byte is odd, else -1."""
    digest = hmac_hex(F.encode(label, "UTF-8"), key)
    return F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)


def blake_partition(number: Column, key: bytes, parts: int) -> Column:
    """A document's partition from the keyed BLAKE2b of its number's eight bytes, bit for bit as in stores built with that.

    Spark has no such function, so rows go through Python in Arrow batches; `keyed_partition` needs none.
    """

    @F.pandas_udf("int")
    def placed(numbers: pd.Series) -> pd.Series:
        of = lambda n: int.from_bytes(hashlib.blake2b(int(n).to_bytes(8, "big"), key=key, digest_size=8).digest(), "big") % parts
        return pd.Series([of(n) for n in numbers], dtype="int32")

    return F.when(number >= 0, placed(F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)).cast("bigint")))


def in_half(name: Column, salt: str | None) -> Column:
    """True for the half of names whose SHA-256 starts with an odd byte; a salt makes another split."""
    text = name if salt is None else F.concat(F.lit(f"{salt}:"), name)
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int") % 2 == 1


def keyed_partition(number: Column, key: bytes, parts: int) -> Column:
    """A record's keyed partition: the HMAC of its eight bytes, first 64 bits, modulo `parts`."""
    digest = hmac_hex(big_endian(number, 8), key)
    return F.pmod(unsigned64(F.substring(digest, 1, 16)), F.lit(parts).cast("decimal(20,0)")).cast("int")


def hash_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the parts' SHA-256; the same in every run and engine."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def hash_normal(*parts: Column) -> Column:
    """A standard normal number from two hash uniforms (Box-Muller)."""
    u, v = hash_uniform(*parts, F.lit("u")), hash_uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.lit(3.141592653589793) * v)


def hmac_sql(message: str, key: bytes) -> str:
    """The twin of `hmac_hex` for DuckDB; `message` is a BLOB expression."""
    inner, outer = pads(key)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || {message})))"
