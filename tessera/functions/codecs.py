"""Column codecs: how values of one type are kept as values of another, as plain column expressions.

A codec is a pair of functions from column to column.  Codecs do not chain: the stored type of a codec may not itself be
a type that a codec converts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFunction = Callable[[Column], Column]

#: Digits of the base-62 form, in order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Codec:
    """encode runs on write and decode on read; stored_as names the stored type."""

    name: str
    encode: ColumnFunction
    decode: ColumnFunction
    stored_as: str


class CodecRegistry:
    """Codecs by the name of the type that they convert."""

    def __init__(self) -> None:
        self._codecs: dict[str, Codec] = {}

    def register(self, codec: Codec) -> Codec:
        if codec.stored_as in self._codecs or any(c.stored_as == codec.name for c in self._codecs.values()):
            raise ValueError(f"codecs do not chain: {codec.name} is stored as {codec.stored_as}")
        self._codecs[codec.name] = codec
        return codec

    def get(self, name: str | None) -> Codec | None:
        return self._codecs.get(name) if name else None

    def __contains__(self, name: str) -> bool:
        return name in self._codecs


def base62_encode(value: Column, width: int = 11) -> Column:
    """Non-negative integers as base-62 text of ``width`` digits, the highest first; eleven hold every 64-bit integer."""
    if not 1 <= width <= 11:
        raise ValueError("a 64-bit integer has one to eleven base-62 digits")
    digit = lambda k: F.substr(F.lit(BASE62), F.pmod(F.call_function("div", value, F.lit(62**k)), F.lit(62)).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(k) for k in reversed(range(width))])


def base62_decode(text: Column) -> Column:
    """The integer that a base-62 text stands for."""
    value = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda total, c: total * 62 + (F.position(c, F.lit(BASE62)) - 1).cast("long"))
    return F.when(F.length(text) > 0, value)


def union_encode(value: Column, first_when: Column, first: Column, second: Column) -> Column:
    """A value of one of two types as struct(mask, t1, t2): mask 0 holds t1, 255 holds t2, and a null stays null."""
    mask = F.when(first_when, F.lit(0)).otherwise(F.lit(255)).cast("int")
    return F.when(value.isNotNull(), F.struct(mask.alias("mask"), F.when(first_when, first).alias("t1"), F.when(~first_when, second).alias("t2")))


def union_decode(union: Column, to: str) -> Column:
    """The value of a two-type union, both types cast to ``to``."""
    return F.when(union["mask"] == 0, union["t1"].cast(to)).when(union["mask"] == 255, union["t2"].cast(to))


def missing_encode(value: Column) -> Column:
    """A value or nothing as struct(mask, value): mask 255 where there is none."""
    return F.struct(F.when(value.isNull(), 255).otherwise(0).cast("int").alias("mask"), value.alias("value"))


def missing_decode(stored: Column) -> Column:
    return F.when(stored["mask"] == 0, stored["value"])


def is_defined(stored: Column) -> Column:
    """Whether an element of a value-or-missing column holds a value."""
    return stored["mask"] == 0


def dict_to_pairs(value: Column) -> Column:
    """A map as an array of (key, value) pairs, the stored form of dictionaries."""
    return F.map_entries(value)


def pairs_to_dict(pairs: Column) -> Column:
    """Pairs as a map; of equal keys the last wins, at its own place, and null keys are left out, which a map could not hold.

    Pairs are sorted by key and compared with their neighbours, so long dictionaries cost n log n.
    """
    order = lambda *fields: lambda a, b: _compared(a, b, fields)
    placed = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))), lambda p: p["key"].isNotNull())
    by_key = F.array_sort(placed, order("key", "at"))
    last = F.filter(F.zip_with(by_key, F.slice(by_key, F.lit(2), F.greatest(F.size(by_key), F.lit(0))), lambda a, b: F.when(b.isNull() | (a["key"] != b["key"]), a)), lambda p: p.isNotNull())
    return F.map_from_entries(F.transform(F.array_sort(last, order("at")), lambda p: F.struct(p["key"], p["value"])))


def _compared(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    found = F.lit(0)
    for f in reversed(fields):
        found = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(found)
    return found


def big_integer(value: Column) -> Column:
    """Integers beyond 64 bits as text, the form in which they are stored."""
    return value.cast("string")


def complex_struct(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def tuple_struct(*values: Column) -> Column:
    """A tuple as a struct with the fields _1, _2, ..."""
    return F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values, 1)])


def strip_padding(text: Column) -> Column:
    """Fixed-length foreign strings: cut at the first NUL, then spaces on the right."""
    return F.rtrim(F.substring_index(text, "\0", 1))
