"""Addresses are 20-byte BINARY inside the package and ``0x…`` text in results.

Half the width of the text form, which is what the ledger shuffle and every join key pay for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO = "0x" + "0" * 40


def address(text: str) -> Column:
    """Literal address from its hex text."""
    return F.lit(bytes.fromhex(text.removeprefix("0x")))


def from_text(col: Column, strict: bool = True) -> Column:
    """``0x…`` text of any case to bytes; other text raises, or gives NULL if not ``strict``."""
    digits, kind = F.substring(col, 3, 2**31 - 1), F.lit("hex")
    return F.to_binary(digits, kind) if strict else F.try_to_binary(digits, kind)


def literal(token: Column | str | bytes) -> Column:
    """An address given as bytes, as ``0x…`` text of any case, or as a binary column."""
    if isinstance(token, Column):
        return token
    return F.lit(bytes(token)) if isinstance(token, (bytes, bytearray)) else address(token)


def to_text(col: Column | str) -> Column:
    """Bytes to lower-case ``0x…`` text."""
    return F.concat(F.lit("0x"), F.lower(F.hex(col)))


def with_text(df: DataFrame) -> DataFrame:
    """All binary columns of ``df`` as text."""
    return df.select(
        *[
            to_text(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else f.name
            for f in df.schema.fields
        ]
    )


def short_addr(text: Column | str) -> Column:
    """First and last four characters of an address text."""
    return F.concat(F.substring(text, 1, 4), F.lit("..."), F.substring(text, -4, 4))
