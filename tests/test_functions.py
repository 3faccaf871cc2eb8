import bz2
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import codecs
from tessera.functions.filters import Bzip2, Deflate, Filter, FilterPipeline, Lz4, Shuffle, Zstd, compress_column, decompress_column, filter_by_id, lookup3, normalize_filters, shuffle_hex
from tessera.functions.types import signature, type_of
from tessera.operators import arrays, evolve, refs


def test_lookup3_known_answers():
    assert lookup3(b"") == 0xDEADBEEF
    assert lookup3(b"Four score and seven years ago") == 0x17770551
    assert lookup3(b"Four score and seven years ago", 1) == 0xCD628161


PIPELINES = [True, "zstd", Lz4(), Bzip2(1), [Shuffle(4), Deflate(3)], [Shuffle(8), Zstd(-2)], [Shuffle(3)], FilterPipeline([Shuffle(2), Bzip2(), Deflate(9)]), False]


@pytest.mark.parametrize("option", PIPELINES)
@given(raw=st.binary(max_size=300))
@settings(max_examples=25, deadline=None)
def test_pipelines_restore(option, raw):
    pipeline = normalize_filters(option)
    assert pipeline.decompress(pipeline.compress(raw)) == raw


def test_filter_options():
    for bad in (42, 3.14, ["zstd"], "nope"):
        with pytest.raises(ValueError):
            normalize_filters(bad)
    for bad in (lambda: Deflate(10), lambda: Bzip2(0), lambda: Zstd(23), lambda: filter_by_id(99)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        FilterPipeline([Deflate(), Zstd()]).parquet()
    assert normalize_filters([Shuffle(), Zstd(7)]).with_element_size(8).filters[0].element_size == 8
    assert normalize_filters(Zstd(7)).parquet()[1] == {"parquet.compression.codec.zstd.level": "7"}
    assert len(normalize_filters(True).compress(bytes(range(256)) * 40)) < 10_240
    assert filter_by_id(307, blocksize100k=2).forward(b"x") == bz2.compress(b"x", 2)


def test_filters_on_columns(spark):
    class Xor(Filter):
        id, name = 40000, "xor"

        def forward(self, raw):
            return bytes(b ^ 0x5A for b in raw)

        backward = forward

    rows = [(bytes(random.Random(k).randbytes(k)),) for k in range(20)] + [(None,)]
    df = spark.createDataFrame(rows, "b binary")
    for option in ([Shuffle(4), Zstd()], Xor(), True):
        back = df.select("b", decompress_column(compress_column(F.col("b"), option), option).alias("c"))
        assert back.where(~F.col("b").eqNullSafe(F.col("c"))).count() == 0
    moved = df.select("b", shuffle_hex(F.col("b"), 3).alias("s"))
    for row in moved.collect():
        assert row["s"] == (None if row["b"] is None else Shuffle(3).forward(bytes(row["b"])))
    assert moved.where(~F.col("b").eqNullSafe(shuffle_hex(F.col("s"), 3, backward=True))).count() == 0


def test_base62(spark):
    values = [0, 1, 61, 62, 3843, 3844, 10**9, 62**10 - 1, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", codecs.base62_encode(F.col("v")).alias("t")).withColumn("b", codecs.base62_decode(F.col("t"))).collect()
    for r in rows:
        value, text = r["v"], ""
        for _ in range(11):
            text = codecs.BASE62[value % 62] + text
            value //= 62
        assert (r["t"], r["b"]) == (text, r["v"])


def test_unions_dicts_and_padding(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.5), (3, None)], "id int, v double")
    whole = F.col("v") == F.floor("v")
    u = df.select("id", codecs.union_encode(F.col("v"), whole, F.col("v").cast("long"), F.col("v")).alias("u"))
    assert [(r["u"]["mask"], r["u"]["t1"], r["u"]["t2"]) if r["u"] else None for r in u.orderBy("id").collect()] == [(0, 3, None), (255, None, 3.5), None]
    assert [r[0] for r in u.orderBy("id").select(codecs.union_decode(F.col("u"), "double")).collect()] == [3.0, 3.5, None]
    m = df.select("id", codecs.missing_decode(codecs.missing_encode(F.col("v"))).alias("v"))
    assert m.exceptAll(df).count() == 0
    pairs = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3), (None, 4)],)], "p array<struct<key:string,value:int>>")
    assert pairs.select(codecs.pairs_to_dict(F.col("p"))).first()[0] == {"a": 3, "b": 2}
    text = spark.createDataFrame([("ab  \0xx",), ("c d ",)], "t string")
    assert [r[0] for r in text.select(codecs.strip_padding(F.col("t"))).collect()] == ["ab", "c d"]
    assert df.select(codecs.tuple_struct(F.col("id"), F.col("v")).alias("t")).select("t.*").columns == ["_1", "_2"]
    assert df.select(codecs.complex_struct(F.lit(1), F.lit(2)).alias("c")).first()["c"].asDict() == {"re": 1.0, "im": 2.0}


def test_types():
    assert type_of(1 << 90) == "int128" and type_of(1 << 190) == "bigint" and type_of(1j) == "complex"
    with pytest.raises(TypeError):
        type_of(object())
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("b", T.LongType())])))])
    assert signature(kind) == "struct<a: array<struct<b: bigint>>>" and signature(kind, False) == "struct of 1 fields"


def test_nested_evolution(spark):
    df = spark.createDataFrame([([(1, 2)], {"k": 1})], "a array<struct<x:int,y:int>>, m map<string,int>")
    want = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("y", T.DoubleType()), T.StructField("x", T.LongType())])))])
    with pytest.warns(UserWarning):
        got = evolve.match_fields(df, want)
    assert got.schema["a"].dataType == want["a"].dataType and got.first()["a"][0].asDict() == {"y": 2.0, "x": 1}
    with pytest.raises(evolve.EvolutionError):
        evolve.match_fields(df, T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("q", T.LongType())])))]))
    doubled = evolve.upgrade_column(F.col("a"), lambda s: s["x"] * 2, df.schema["a"].dataType)
    assert df.select(doubled.alias("d")).first()["d"] == [2]


def test_references(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "b", None), (3, "a", 9), (4, None, 1), (5, None, 4)], "id long, t string, next long")
    objects, references = refs.dedup(df, ["t"], "id")
    assert objects.count() == 3
    assert {r["id"]: r["ref"] for r in references.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    found = refs.resolve(df.select("id", "next"), "next", df.select(F.col("id").alias("k"), "t"), "k", ["t"], "target")
    assert {r["id"]: (r["target"]["t"] if r["target"] else None) for r in found.collect()} == {1: "b", 2: None, 3: None, 4: "a", 5: None}
    assert refs.edges(df, "id", ["next"]).count() == 4
    packed = refs.ragged_pack(df, ["t"], ["id"], "next", "all")
    assert {r["t"]: r["all"] for r in packed.collect()} == {"a": [2, 9], "b": [None], None: [1, 4]}
    assert refs.ragged_unpack(packed, ["t"], "all", "next").count() == 5
    assert refs.append(df.select("id"), df.select("t")).columns == ["id", "t"]


@given(dims=st.lists(st.integers(1, 6), min_size=1, max_size=3), data=st.data())
@settings(max_examples=8, deadline=None)
def test_slices_match_numpy(spark, dims, data):
    import numpy as np

    array = np.arange(int(np.prod(dims))).reshape(dims)
    grid = arrays.Grid.of(dims, [data.draw(st.integers(1, d + 1)) for d in dims])
    index = []
    for d in dims:
        a = data.draw(st.integers(0, d - 1))
        index.append(slice(a, data.draw(st.integers(a, d)), data.draw(st.integers(1, 3))))
    got = arrays.to_numpy(arrays.slice_chunks(arrays.to_chunks(spark, array, grid), grid, index), array[tuple(index)].shape)
    np.testing.assert_array_equal(got, array[tuple(index)])
