"""The stored type names and the Spark types that hold them."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import types as T

#: Names of scalar types in the catalog, and the Spark type of each.  Unsigned types take the next wider signed one;
#: integers of 128 bits and big numbers are text, as no Spark type holds all of them.
SPARK_TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "int128": T.StringType(),
    "uint128": T.StringType(),
    "bigint": T.StringType(),
    "bigfloat": T.StringType(),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
    "symbol": T.StringType(),
    "char": T.StringType(),
    "opaque": T.BinaryType(),
    "function": T.StringType(),
    "module": T.StringType(),
    "reference": T.LongType(),
    "complex": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "type": T.StructType([T.StructField("name", T.StringType()), T.StructField("params", T.ArrayType(T.StringType()))]),
    "nothing": T.NullType(),
    "missing": T.NullType(),
}

#: Plain types: what a file in plain mode may hold.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType)


class Missing:
    """The value that stands for missing data, as distinct from nothing."""

    def __repr__(self) -> str:
        return "missing"


missing = Missing()


def type_of(value: Any) -> str:
    """The stored type name of a Python value."""
    if value is None:
        return "nothing"
    if value is missing:
        return "missing"
    if isinstance(value, (bool, np.bool_)):
        return "bool"
    if isinstance(value, np.generic):
        return "complex" if value.dtype.kind == "c" else "string" if value.dtype.kind == "U" else value.dtype.name
    if isinstance(value, int):
        return "int64" if -(1 << 63) <= value < 1 << 63 else "int128" if -(1 << 127) <= value < 1 << 127 else "bigint"
    if isinstance(value, float):
        return "float64"
    if isinstance(value, complex):
        return "complex"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "opaque"
    raise TypeError(f"no stored type for {type(value).__name__}")


def stored_value(value: Any, name: str) -> Any:
    """The value as its Spark type takes it."""
    if name in ("nothing", "missing"):
        return None
    if name in ("int128", "uint128", "bigint", "bigfloat"):
        return str(value)
    if name == "complex":
        return (float(value.real), float(value.imag))
    if name == "uint64":
        from decimal import Decimal

        return Decimal(int(value))
    if name.startswith(("int", "uint")):
        return int(value)
    if name.startswith("float"):
        return float(value)
    if name == "bool":
        return bool(value)
    if name == "opaque":
        return bytes(value)
    return str(value)


def loaded_value(value: Any, name: str) -> Any:
    """The Python value that a stored one stands for."""
    if name == "missing":
        return missing
    if value is None or name == "nothing":
        return None
    if name in ("int128", "uint128", "bigint", "uint64"):
        return int(value)
    if name == "complex":
        return complex(value[0], value[1])
    if name == "opaque":
        return bytes(value)
    return value


def is_plain(schema: T.DataType) -> bool:
    """Whether a type needs no committed type: numbers, text, and arrays of them."""
    if isinstance(schema, T.ArrayType):
        return is_plain(schema.elementType)
    return isinstance(schema, PLAIN)


def signature(schema: T.DataType, fields: bool = True) -> str:
    """A type as text, without its values."""
    if isinstance(schema, T.StructType):
        inner = ", ".join(f"{f.name}: {signature(f.dataType, fields)}" for f in schema.fields)
        return f"struct<{inner}>" if fields else f"struct of {len(schema.fields)} fields"
    if isinstance(schema, T.ArrayType):
        return f"array<{signature(schema.elementType, fields)}>"
    if isinstance(schema, T.MapType):
        return f"map<{signature(schema.keyType, fields)}, {signature(schema.valueType, fields)}>"
    return schema.simpleString()


def without_empty_structs(schema: T.StructType) -> tuple[T.StructType, list[str]]:
    """The schema without fields that hold nothing (Parquet refuses empty structs), and their names."""
    kept, dropped = [], []
    for f in schema.fields:
        empty = isinstance(f.dataType, T.StructType) and not f.dataType.fields
        (dropped if empty else kept).append(f)
    return T.StructType(kept), [f.name for f in dropped]
