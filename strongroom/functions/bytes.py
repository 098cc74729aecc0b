"""Big-endian numbers, codes and boxes as column expressions over BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strongroom.functions.binding import let


def column(value) -> Column:
    """A column as it is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def slice_(data: Column, at, size) -> Column:
    """``size`` bytes from the zero-based position ``at``."""
    return F.substring(data, (column(at) + 1).cast("int"), column(size).cast("int"))


def unsigned(data: Column, at, width: int) -> Column:
    """An unsigned number of up to four bytes, NULL when the data ends first."""
    number = F.conv(F.hex(slice_(data, at, width)), 16, 10).cast("bigint")
    return F.when(F.length(data) >= column(at) + width, number)


def u8(data: Column, at) -> Column:
    return unsigned(data, at, 1)


def u16(data: Column, at) -> Column:
    return unsigned(data, at, 2)


def u32(data: Column, at) -> Column:
    return unsigned(data, at, 4)


def u64(data: Column, at) -> Column:
    """A full-range unsigned number of eight bytes, as DECIMAL(20,0)."""
    number = F.conv(F.hex(slice_(data, at, 8)), 16, 10).cast("decimal(20,0)")
    return F.when(F.length(data) >= column(at) + 8, number)


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= (1 << (bits - 1)), value - F.lit(1 << bits)).otherwise(value)


def i16(data: Column, at) -> Column:
    return _signed(u16(data, at), 16)


def i32(data: Column, at) -> Column:
    return _signed(u32(data, at), 32)


def i64(data: Column, at) -> Column:
    value = u64(data, at)
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(value >= half, value - span).otherwise(value).cast("bigint")


def versioned(data: Column, version: Column, narrow_at: int, wide_at: int) -> Column:
    """A field that is four bytes in version 0 and eight in version 1."""
    return F.when(version == 0, u32(data, narrow_at).cast("decimal(20,0)")).when(version == 1, u64(data, wide_at))


def code(text: str) -> Column:
    """A four-character code as bytes."""
    return F.lit(text.encode("latin-1"))


def one_of(kind: Column, codes) -> Column:
    """Whether a code is one of several."""
    return kind.isin(*[bytearray(c.encode("latin-1")) for c in codes])


def printable(kind: Column) -> Column:
    """Whether every byte of a code is printable ASCII."""
    return F.decode(kind, "ISO-8859-1").rlike(r"^[\x20-\x7e]*\z")


def shown(kind: Column) -> Column:
    """A code as text, bytes that are not printable ASCII as ``\\xNN``."""

    def byte(at: Column) -> Column:
        return let(
            F.lower(F.hex(slice_(kind, at, 1))),
            lambda h: F.when(h.between("20", "7e"), F.decode(F.unhex(h), "ISO-8859-1")).otherwise(
                F.concat(F.lit("\\x"), h)
            ),
        )

    escaped = F.array_join(F.transform(F.sequence(F.lit(0), F.length(kind) - 1), byte), "")
    return F.when(printable(kind), F.decode(kind, "ISO-8859-1")).otherwise(escaped)


def big_endian(value, width: int) -> Column:
    """A number as ``width`` bytes, two's complement when negative."""
    digits = F.lpad(F.hex(column(value).cast("bigint")), 16, "0")
    return F.unhex(F.substring(digits, 17 - 2 * width, 2 * width))


def raw(text: str) -> Column:
    """Bytes written as hex digits."""
    return F.lit(bytes.fromhex(text))


def ascii_(text) -> Column:
    return F.encode(column(text), "ISO-8859-1")


def numbers(values: Column, width: int) -> Column:
    """An array of numbers as consecutive big-endian fields."""
    field = lambda v: F.substring(F.lpad(F.hex(v.cast("bigint")), 16, "0"), 17 - 2 * width, 2 * width)
    return F.unhex(F.array_join(F.transform(values, field), ""))
