"""References, identity and ragged data: surrogate keys, joins back, edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup(df: DataFrame, content: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(objects, references): each distinct content once, under the smallest key that holds it, and key -> ref of every row.

    Contents are told apart by SHA-256 of their JSON form.  They travel once, after rows of one content are summed up; the
    references are found by digests alone, in a join whose hot side Spark can split.
    """
    hashed = df.select("*", F.sha2(F.to_json(F.struct(*content)), 256).alias("__digest"))
    objects = hashed.groupBy("__digest").agg(F.min(key).alias("ref"), *[F.first(c).alias(c) for c in content])
    named = hashed.groupBy("__digest").agg(F.min(key).alias("ref"))
    return objects.select("ref", *content), hashed.select(key, "__digest").join(named, "__digest").select(key, "ref")


def resolve(df: DataFrame, ref: str, objects: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    """df with the struct ``name`` of the fields of the object that ref points to; null where it points to nothing."""
    target = objects.select(F.col(key).alias("__ref"), F.struct(*fields).alias(name))
    return df.join(target, df[ref] == target["__ref"], "left").drop("__ref")


def edges(df: DataFrame, key: str, references: Sequence[str]) -> DataFrame:
    """(src, field, dst): the graph of references, cycles included; null references make no edge."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("field"), F.col(r).cast("long").alias("dst")) for r in references]))
    return df.select(F.col(key).cast("long").alias("src"), pairs.alias("e")).select("src", "e.field", "e.dst").where("dst IS NOT NULL")


def ragged_pack(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): the values of each key as an array, in a stated order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x["__v"]).alias(name))


def ragged_unpack(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, idx, name): a row per element."""
    return df.select(*keys, F.posexplode(value).alias("idx", name))


def append(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of several datasets by field name; a field that one lacks is null there."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
