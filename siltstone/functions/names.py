"""Archive headers, member names, name hashes and natural order as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512


def pad_to_block(size: Column, block: int = BLOCK) -> Column:
    return (F.ceil(size / block) * block).cast("long")


def octal_size(header: Column) -> Column:
    """The size field of a tar header: 11 octal digits at byte 124."""
    digits = F.decode(F.substring(header, 125, 11), "ISO-8859-1")
    return F.coalesce(F.conv(F.regexp_replace(digits, r"[^0-7]", ""), 8, 10), F.lit("0")).cast("long")


def type_flag(header: Column) -> Column:
    """What a header's type byte (156) means: file, old, long, link, dir, other."""
    flag = F.hex(F.substring(header, 157, 1))
    return (
        F.when(flag == "30", "file").when(flag == "00", "old").when(flag.isin("78", "4C", "67"), "long")
        .when(flag.isin("31", "32"), "link").when(flag == "35", "dir").otherwise("other")
    )


def member_name(header: Column) -> Column:
    """The name field up to its first NUL."""
    return F.decode(F.unhex(F.regexp_extract(F.hex(F.substring(header, 1, 100)), r"^((?:..)*?)(?:00|$)", 1)), "UTF-8")


def without_first(name: Column) -> Column:
    """A name without its first path component (the version's folder); names without a slash stay."""
    return F.regexp_replace(name, r"^[^/]*/", "")


def directory_key(path: Column) -> Column:
    """From the first slash: with one slash before the last, up to the last; with more than two, up to the last but one."""
    parts = F.split(F.regexp_extract(path, r"(?s)(/.*)$", 1), "/")
    slashes = F.size(parts) - 1
    cut = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    return F.when(slashes - 1 > 2, cut(slashes - 1)).when(slashes > 0, cut(slashes)).otherwise("")


# Fixed value: the multiplier of the name hash, 2**40 + 0x1B3.
_LOW = 0x1B3


def _codes(name: Column, limit: int) -> Column:
    pairs = F.regexp_replace(F.hex(F.substring(F.encode(name, "UTF-8"), 1, limit)), "(..)", "$1 ")
    return F.transform(F.filter(F.split(pairs, " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))


def name_hash_16(name: Column, limit: int = 101) -> Column:
    """``h = h * 31 + c`` mod 2**16."""
    return F.aggregate(_codes(name, limit), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 65536)


#: Bytes that count of a name in a header, and of a long name.
NAME_LIMIT, LONG_NAME_LIMIT = 101, 8197


def name_hash(name: Column, limit: int = 101) -> Column:
    """``h = h * (2**40 + 0x1B3) + c`` mod 2**64 over the first bytes, as 16 hex digits.

    The two halves are kept apart, so nothing overflows a signed long.
    """
    codes = _codes(name, limit)
    word = 0xFFFFFFFF

    def step(h: Column, c: Column) -> Column:
        low = h["low"] * _LOW + c
        high = h["high"] * _LOW + F.shiftright(low, 32) + F.shiftleft(h["low"], 8)
        return F.struct(high.bitwiseAND(F.lit(word)).alias("high"), low.bitwiseAND(F.lit(word)).alias("low"))

    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    pair = F.aggregate(codes, zero, step)
    return F.lower(F.concat(F.lpad(F.hex(pair["high"]), 8, "0"), F.lpad(F.hex(pair["low"]), 8, "0")))


def long_name(record: Column) -> Column:
    """The name in a long-name record's payload, up to its first NUL, without its first component."""
    text = F.regexp_extract(F.hex(record), r"^((?:..)*?)(?:00|$)", 1)
    return without_first(F.decode(F.unhex(text), "UTF-8"))


def long_name_hashes(name: Column) -> tuple[Column, Column]:
    """Hashes of a member with a long name: of the record that carries the name, one less, and of the member itself."""
    own = name_hash(name, LONG_NAME_LIMIT)
    # One less modulo 2**64, on the two halves of the sixteen digits.
    high, low = (F.conv(F.substring(own, at, 8), 16, 10).cast("long") for at in (1, 9))
    word = F.lit(0xFFFFFFFF)
    down = F.when(low == 0, high - 1).otherwise(high).bitwiseAND(word)
    record = F.lower(F.concat(F.lpad(F.hex(down), 8, "0"), F.lpad(F.hex((low - 1).bitwiseAND(word)), 8, "0")))
    return record, own


def natural_key(name: Column) -> Column:
    """Digit runs by value, letters without case: a string that sorts that way.

    A run of digits is written without leading zeros behind its number of digits, four of them.
    """
    parts = F.regexp_extract_all(F.upper(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, key), "")
