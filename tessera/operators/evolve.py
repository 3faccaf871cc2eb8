"""Schema evolution at read time: fields by name, conversions that lose nothing, type maps and upgrades."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Conversions that keep every value: from the first type to any of the others.
_WIDER: dict[str, tuple[str, ...]] = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "bigint": ("double",),
    "float": ("double",),
    "boolean": ("tinyint", "smallint", "int", "bigint"),
}


class EvolutionError(ValueError):
    """Stored fields cannot become the wanted type."""


@dataclass(frozen=True)
class Upgrade:
    """Turns stored records, read as they are, into the new type: ``apply`` maps the frame of the old fields."""

    apply: Callable[[DataFrame], DataFrame]


#: What a type name may be mapped to: a schema, an upgrade, another type name, or None for the record as stored.
Target = T.StructType | Upgrade | str | None
TypeMap = Mapping[str, Target] | Callable[[str, str, list[str]], Target]


def resolve(typemap: TypeMap | None, name: str | None, path: str, params: list[str] | None = None) -> tuple[bool, Target]:
    """(whether the map speaks about this type, its target).  A callable gets name, path and parameters."""
    if typemap is None or name is None:
        return False, None
    if callable(typemap):
        return True, typemap(name, path, params or [])
    return name in typemap, typemap.get(name)


def converted(value: Column, have: T.DataType, want: T.DataType, where: str) -> Column:
    """value as another type; raises where stored values could be lost."""
    if have == want:
        return value
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        names = {f.name: f for f in have.fields}
        if gone := [f.name for f in want.fields if f.name not in names]:
            raise EvolutionError(f"{where}: stored records have no field {', '.join(gone)}")
        made = F.struct(*[converted(value[f.name], names[f.name].dataType, f.dataType, f"{where}.{f.name}").alias(f.name) for f in want.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: converted(x, have.elementType, want.elementType, f"{where}[]"))
    if isinstance(have, T.NullType) or want.simpleString() in _WIDER.get(have.simpleString(), ()):
        return value.cast(want)
    raise EvolutionError(f"{where}: {have.simpleString()} does not convert to {want.simpleString()} without loss")


def match_fields(df: DataFrame, want: T.StructType, where: str = "record") -> DataFrame:
    """df's fields by name as the wanted type; stored fields that it lacks are dropped with a warning."""
    have = {f.name: f for f in df.schema.fields}
    if gone := [f.name for f in want.fields if f.name not in have]:
        raise EvolutionError(f"{where}: stored records have no field {', '.join(gone)}")
    if extra := [n for n in have if n not in want.names]:
        warnings.warn(f"{where}: fields {', '.join(extra)} are stored but not wanted", stacklevel=2)
    return df.select(*[converted(F.col(f"`{f.name}`"), have[f.name].dataType, f.dataType, f"{where}.{f.name}").alias(f.name) for f in want.fields])


def evolve(df: DataFrame, target: Target, known: Mapping[str, T.StructType], where: str = "record") -> tuple[DataFrame, bool]:
    """(df as the target, whether it was reconstructed): what does not fit is left as stored, with a warning."""
    if target is None:
        return df, True
    if isinstance(target, Upgrade):
        return target.apply(df), False
    if isinstance(target, str):
        if target not in known:
            warnings.warn(f"{where}: no type {target}, the record is left as stored", stacklevel=2)
            return df, True
        target = known[target]
    try:
        return match_fields(df, target, where), False
    except EvolutionError as error:
        warnings.warn(f"{error}; the record is left as stored", stacklevel=2)
        return df, True


def upgrade_column(value: Column, function: Callable[[Column], Column], container: T.DataType) -> Column:
    """Applies an upgrade to records inside arrays, element by element."""
    if isinstance(container, T.ArrayType):
        return F.transform(value, lambda x: upgrade_column(x, function, container.elementType))
    return function(value)
