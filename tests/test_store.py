from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.codecs import Codec
from tessera.functions.types import missing
from tessera.operators.evolve import Upgrade
from tessera.plans.store import Store, StoreError, load, load_object, save, save_object


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


VALUES = {
    "float": 3.7,
    "true": True,
    "text": "Hello",
    "nul": "a\0b",
    "emoji": "👍 é",
    "empty_text": "",
    "int": 42,
    "big": 1 << 100,
    "bigger": -(1 << 200),
    "complex": 1.5 - 2j,
    "bytes": b"\x00\xff",
    "nothing": None,
    "missing": missing,
    "ints": [1, 2, 3],
    "texts": ["a", "", "ü"],
    "holes": [1, None, 3],
    "ragged": [[1], [], [2, 3]],
    "mixed": [1, 2.0, "x", True],
    "empty_list": [],
    "dict": {"a": 1, "b": 2},
    "empty_dict": {},
}


def test_round_trip_matrix(spark, root):
    with Store.open(spark, root, "w") as f:
        for name, value in VALUES.items():
            f[f"v/{name}"] = value
    with Store.open(spark, root, "r") as f:
        for name, value in VALUES.items():
            got = f.value(f"v/{name}")
            assert got == value or got is value, name
            assert type(got) is type(value), name


@pytest.mark.parametrize("array", [np.arange(15).reshape(3, 5), np.arange(30.0).reshape(3, 5, 2), np.array([[True, False]]), np.zeros((0, 2)), np.zeros((2, 0)), np.arange(7, dtype=np.int32), np.array([[np.nan, np.inf], [-np.inf, 0.5]])])
def test_arrays_round_trip(spark, root, array):
    with Store.open(spark, root, "w") as f:
        f.write("a", array, chunk=[2] * array.ndim)
        got = f.value("a")
    np.testing.assert_array_equal(got, array)
    assert got.dtype == array.dtype and got.shape == array.shape


def test_zero_dimensional_array(spark, root):
    with Store.open(spark, root, "w") as f:
        f["a"] = np.array(5.0)
        assert f.value("a").shape == () and f.value("a") == 5.0


@pytest.mark.parametrize("compress", [False, True, "gzip", "zstd", "lz4_raw", "none"])
def test_codecs_conform(spark, root, compress):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    with Store.open(spark, root, "w") as f:
        f.write("t", df, compress=compress)
        assert f["t"].agg(F.sum("x")).first()[0] == df.agg(F.sum("x")).first()[0]
        assert f["t"].schema.simpleString() == df.schema.simpleString()


def test_modes(spark, root):
    with pytest.raises(FileNotFoundError):
        Store.open(spark, root, "r")
    with pytest.raises(FileNotFoundError):
        Store.open(spark, root, "r+")
    with pytest.raises(StoreError):
        Store.open(spark, root, "x")
    with Store.open(spark, root, "a") as f:
        f["x"] = 1
    with Store.open(spark, root, "a+") as f:
        f["y"] = 2
        assert Store.open(spark, root, "r+") is f
        f.close()
        with pytest.raises(StoreError):
            Store.open(spark, root, "r")
        with pytest.raises(StoreError):
            Store.open(spark, root, "w")
        with pytest.raises(StoreError):
            Store.open(spark, root, "r", parallel_read=True)
        with pytest.raises(StoreError):
            Store.open(spark, root, "r+", parallel_read=True)
    with Store.open(spark, root, "r") as f:
        assert f.keys() == ["x", "y"]
        with pytest.raises(StoreError):
            f["z"] = 3
        other = Store.open(spark, root, "r", parallel_read=True)
        assert other is not f and other.value("x") == 1
        other.close()
    with Store.open(spark, root, "w") as f:
        assert f.keys() == [] and f.is_empty()


def test_paths_and_groups(spark, root):
    with Store.open(spark, root, "w") as f:
        f["/g1/x1"] = 1
        f["g1/x2"] = 2
        f["/g2//x1"] = 3
        g = f.create_group("g3")
        g["x"] = 4
        g["/abs"] = 5
        g["inner/x"] = 6
        f.create_group("empty/deep")
        assert f.keys() == ["g1", "g2", "g3", "abs", "empty"]
        assert f.value("g3/inner/x") == 6 and f.value("abs") == 5 and len(f["g1"]) == 2
        assert "g1/x1" in f and "g1/x9" not in f and f.is_group("g1") and not f.is_group("abs")
        for bad in (lambda: f.write("g1/x1", 0), lambda: f.create_group("g1"), lambda: f.write("abs/x", 0), lambda: f.group("abs"), lambda: f.write("", 1)):
            with pytest.raises(StoreError):
                bad()
        with pytest.raises(KeyError):
            f["nope"]
        assert f.get("nope", 7) == 7 and f.get("nope", lambda: 8) == 8
        f.setdefault("made", 9)
        f.setdefault("made", 10)
        assert f.value("made") == 9
        f.delete("g1")
        assert "g1/x1" not in f and "g1" not in f
        f["g1/x1"] = 11
        f.attach("copy", f["g3"])
        assert f.value("copy/inner/x") == 6
    with Store.open(spark, root, "r+") as f:
        assert f.value("g1/x1") == 11 and f.keys()[-2:] == ["g1", "copy"]
        assert f.vacuum() == 2
        toc = f.toc()
        assert "├─ g2/" in toc and "x1" in toc
        assert f.toc(3).endswith("more entries)")


def test_load_and_save(spark, tmp_path):
    path = str(tmp_path / "s")
    save(spark, path, {"a": 1, "b/c": spark.range(3)})
    assert set(load(spark, path)) == {"a", "b/c"}
    nested = load(spark, path, nested=True)
    assert nested["b"]["c"].count() == 3
    assert load(spark, path, "b")["c"].count() == 3
    assert [df.count() for df in load(spark, path, "a", "b/c")] == [1, 3]
    save(spark, path, "x", 1, "y", 2, z=3)
    assert set(load(spark, path)) == {"x", "y", "z"}
    for bad in ((), ({},), ("x",)):
        with pytest.raises(StoreError):
            save(spark, path, *bad)
    with pytest.raises(TypeError):
        save(spark, path, {1: 2})
    with pytest.raises(StoreError):
        load_object(spark, str(tmp_path / "s2")) if save(spark, str(tmp_path / "s2"), a=1, b=2) is None else None
    save_object(spark, path, {"k": 5})
    assert load_object(spark, path) == {"k": 5}


def test_dataset_handles_and_attributes(spark, root):
    with Store.open(spark, root, "w") as f:
        d = f.create_dataset("d", compress=True)
        d.add_attribute("unit", "m")
        with pytest.raises(StoreError):
            d.add_attribute("unit", "s")
        assert not d.is_written()
        with pytest.raises(StoreError):
            d.read()
        d.write(np.arange(6).reshape(2, 3))
        with pytest.raises(StoreError):
            d.write(1)
        d.add_attribute("later", [1, 2])
        assert d.attributes() == {"unit": "m", "later": [1, 2]} and d.is_array()
        assert "attribute unit" in d.show() and "int64" in d.show() and d.headers()
        f.create_group("g")
        f.add_attribute("g", "note", "x")
        assert f.attributes("g") == {"note": "x"} and f.attributes("g", str)
        with pytest.raises(TypeError):
            f.attributes("g", int)
        with pytest.raises(ValueError):
            f.create_dataset("e", compress=42)
        with pytest.raises(ValueError):
            f.write("e", spark.range(1), compress="bzip2")


def test_slices_and_updates(spark, root):
    b = np.array([[42, 43, 44], [45, 46, 47]])
    with Store.open(spark, root, "w") as f:
        f.write("b", b, chunk=[1, 2])
        d = f.dataset("b")
        np.testing.assert_array_equal(d[0:2, 0:2], b[0:2, 0:2])
        np.testing.assert_array_equal(d[0, 0:3:2], b[0, 0:3:2])
        assert d[1, 2] == 47 and d[-1, -1] == 47 and d[4] == 46 and d.shape == (2, 3)
        for bad in (7, (2, 0), (0, 4), (slice(0, 5), 0), (0, slice(0, 3, -1)), (0, 0, 0)):
            with pytest.raises(IndexError):
                d[bad]
        d[0, 0] = 1
        d[:, 2] = np.array([5, 47])
        d[1, 0] = -1
        np.testing.assert_array_equal(d[:, :], [[1, 43, 5], [-1, 46, 47]])
        assert d.entry.version == 4
        d[0:2, 0:2] = lambda old, i, j: old * 10
        np.testing.assert_array_equal(f.value("b"), [[10, 430, 5], [-10, 460, 47]])
        plan = d.elements((slice(0, 1), slice(0, 2)))._jdf.queryExecution().toString()
        assert "PushedFilters" in plan and "EqualTo(c0,0)" in plan


def test_preallocated_arrays_read_as_fill(spark, root):
    with Store.open(spark, root, "w") as f:
        d = f.create_dataset("p", dims=(20, 20), chunk=(8, 8)).allocate()
        assert d[:, :].sum() == 0
        d[3, 4] = 2.5
        assert d[3, 4] == 2.5 and d[:, :].sum() == 2.5
        with pytest.raises(StoreError):
            f.create_dataset("q", dims=(2,), compress=True).allocate()
        with pytest.raises(StoreError):
            f.create_dataset("q").allocate()


def test_evolution_of_stored_records(spark, root):
    old = spark.createDataFrame([(1, 2.0)], "x int, y double")
    with Store.open(spark, root, "w") as f:
        f.write("r", old, type_name="Old")
        assert f.committed_types() == {"Old": old.schema} and "Old" in f.signature("r")
    upgrade = Upgrade(lambda df: df.select(F.col("x").cast("double").alias("x"), "y").withColumn("z", F.col("x") * F.col("y")))
    with Store.open(spark, root, "r", typemap={"Old": upgrade}) as f:
        assert f["r"].first().asDict() == {"x": 1.0, "y": 2.0, "z": 2.0}
        assert not f.reconstructed("r")
    wide = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    with Store.open(spark, root, "r", typemap=lambda name, path, params: wide) as f:
        assert f["r"].schema == wide
    with Store.open(spark, root, "r", typemap={"Old": T.StructType([T.StructField("x", T.LongType())])}) as f, pytest.warns(UserWarning, match="not wanted"):
        assert f["r"].columns == ["x"]
    for bad in (T.StructType([T.StructField("q", T.LongType())]), T.StructType([T.StructField("y", T.LongType())]), "Nope"):
        with Store.open(spark, root, "r", typemap={"Old": bad}) as f, pytest.warns(UserWarning, match="left as stored"):
            assert f["r"].schema == old.schema
    with Store.open(spark, root, "r", typemap={"Old": bad}, plain=True) as f:
        assert f["r"].schema == old.schema


def test_custom_codecs(spark, root):
    codec = Codec("Celsius", lambda c: c + 273.15, lambda c: c - 273.15, "Kelvin")
    df = spark.createDataFrame([(20.0,)], "t double")
    with Store.open(spark, root, "w") as f:
        f.codecs.register(codec)
        with pytest.raises(ValueError):
            f.codecs.register(Codec("Kelvin", lambda c: c, lambda c: c, "Rankine"))
        f.write("t", df, type_name="Celsius")
        assert abs(f["t"].first()[0] - 20.0) < 1e-9
    with Store.open(spark, root, "r") as f:
        assert abs(f["t"].first()[0] - 293.15) < 1e-9


def test_plain_types_only(spark, root):
    with Store.open(spark, root, "w") as f:
        f.disable_commit()
        f["n"] = 1
        f["a"] = [1, 2]
        for bad in (lambda: f.write("c", 1j), lambda: f.write("t", spark.range(1), type_name="T")):
            with pytest.raises(StoreError):
                bad()


def test_wide_records_and_empty_structs(spark, root):
    wide = spark.range(2).select(*[F.col("id").alias(f"f{k}") for k in range(256)])
    with Store.open(spark, root, "w") as f:
        f["wide"] = wide
        assert len(f["wide"].columns) == 256
        ghost = spark.createDataFrame([(1, ())], T.StructType([T.StructField("x", T.LongType()), T.StructField("g", T.StructType([]))]))
        f["ghost"] = ghost
        assert f["ghost"].columns == ["x"] and f.attributes("ghost") == {"empty_fields": ["g"]}


def test_many_names_and_reopening(spark, root):
    from tessera.plans.catalog import Entry

    with Store.open(spark, root, "w") as f:
        for k in range(5000):
            f.catalog.changed[f"k{k:05d}"] = Entry(f"k{k:05d}", "group", ordinal=k + 1)
    with Store.open(spark, root, "r") as f:
        assert len(f) == 5000 and f.keys()[17] == "k00017"
    import tessera.plans.catalog as catalog

    held, catalog.HELD_ROWS = catalog.HELD_ROWS, 10
    try:
        with Store.open(spark, root, "r+") as f:
            assert "k00400" in f and "k0" not in f and len(f.keys()) == 5000
            f.create_group("new")
        with Store.open(spark, root, "r") as f:
            assert f.keys()[-1] == "new"
    finally:
        catalog.HELD_ROWS = held


def test_fill_values_survive_every_way_of_loading(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", "w") as store:
        made = store.create_dataset("g/a", (4, 3), chunk=(2, 2)).allocate(fill=7.0)
        assert store.value("g/a").tolist() == [[7.0] * 3] * 4 and len(made.read().collect()) == 4
        assert store.load_all(nested=True)["g"]["a"].count() == store.load("g")["a"].count() == store.load_all()["g/a"].count() == 4
        made[1, 0:2] = [1.0, 2.0]
        made.put_elements(spark.createDataFrame([(3, 2, 9.0), (3, 1, None)], "i0 int, i1 int, value double"))
        want = np.full((4, 3), 7.0)
        want[1, 0:2], want[3, 2], want[3, 1] = [1.0, 2.0], 9.0, np.nan
        assert np.array_equal(store.value("g/a"), want, equal_nan=True)
        with pytest.raises(Exception, match="outside the array"):
            made.put_elements(spark.createDataFrame([(4, 0, 1.0)], "i0 int, i1 int, value double"))


def test_links_name_data_elsewhere(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/elsewhere")
    with Store.open(spark, f"{tmp_path}/s", "w") as store:
        store.link("a/b", f"{tmp_path}/elsewhere")
        with pytest.raises(StoreError):
            store.link("a/b", f"{tmp_path}/elsewhere")
        assert store["a/b"].count() == 5
    with Store.open(spark, f"{tmp_path}/s", "r+") as store:
        store.delete("a")
        store.vacuum()
    assert spark.read.parquet(f"{tmp_path}/elsewhere").count() == 5


def test_codecs_are_checked_and_slices_bounded(spark, tmp_path, monkeypatch):
    with Store.open(spark, f"{tmp_path}/s", "w", compress="zstd") as store:
        store.write("x", spark.range(10))
        store.dataset("x").check_codec()
        entry = store.entry("x")
        store.catalog.put(replace(entry, codec="gzip"))
        with pytest.raises(StoreError, match="ZSTD"):
            store.dataset("x").check_codec()
        store.write("m", np.zeros((10, 10)))
        monkeypatch.setattr("tessera.plans.store.MOST_CELLS", 50)
        assert store.dataset("m")[0:5, 0:10].shape == (5, 10)
        with pytest.raises(StoreError, match="elements"):
            store.dataset("m")[0:6, 0:10]
