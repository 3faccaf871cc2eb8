"""The dataset store: open modes, groups, datasets, attributes, loading and saving.

A store is a folder.  Every dataset is a Parquet folder of its own, read as a lazy DataFrame; the catalog keeps names, shapes,
types and attributes.  Data is written first and the catalog last, so an interrupted write leaves no trace but files that
``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.codecs import CodecRegistry
from tessera.functions.filters import normalize_filters
from tessera.functions.types import is_plain, loaded_value, signature, stored_value, type_of, without_empty_structs
from tessera.operators import arrays
from tessera.operators.evolve import TypeMap, evolve, resolve
from tessera.sources.files import Files

from .catalog import Catalog, Entry, normalize

#: Fixed value: the name under which a single object is kept.
SINGLE_OBJECT = "single_stored_object"
TYPES = "_types"
#: Cells that a slice may bring to the driver.
MOST_CELLS = 1 << 26
MODES = {"r": (False, False, False), "r+": (True, False, False), "a": (True, True, False), "a+": (True, True, False), "w": (True, True, True), "w+": (True, True, True)}

_OPEN: dict[tuple[str, str], Store] = {}


class StoreError(ValueError):
    pass


class Store:
    """An open store; also the root group.  Use ``Store.open``, best as a context manager."""

    def __init__(self, spark: SparkSession, files: Files, mode: str, plain: bool, compress: Any, typemap: TypeMap | None):
        self.spark, self.files, self.mode = spark, files, mode
        self.writable = MODES[mode][0]
        self.plain, self.compress, self.typemap = plain, normalize_filters(compress), typemap
        self.catalog = Catalog(spark, files)
        self.codecs = CodecRegistry()
        self.commit_types = True
        self.users = 1
        self.root = Group(self, "")

    # opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, mode: str = "r", *, compress: Any = None, plain: bool = False, typemap: TypeMap | None = None, parallel_read: bool = False) -> Store:
        """Opens a store.  r: read; r+: read and write; a, a+: as r+, made if missing; w, w+: emptied first.

        One session opens a store once: opening it again in the same mode gives the same handle, in another mode it
        raises.  parallel_read gives a read-only handle of its own.
        """
        if mode not in MODES:
            raise StoreError(f"mode {mode!r} is none of {', '.join(MODES)}")
        files = Files(spark, path)
        key, (write, create, truncate) = (spark.sparkContext.applicationId, files.root), MODES[mode]
        held = _OPEN.get(key)
        if parallel_read:
            if write:
                raise StoreError("a parallel handle is read-only")
            if held and held.writable:
                raise StoreError(f"{files.root} is open for writing")
        elif held:
            if truncate or held.writable != write:
                raise StoreError(f"{files.root} is already open in mode {held.mode}")
            held.users += 1
            return held
        if files.is_file(files.root):
            raise StoreError(f"{files.root} is a file, not a store")
        if truncate:
            files.delete(files.root)
        if not files.exists(f"{files.root}/_catalog"):
            if not create:
                raise FileNotFoundError(f"no store at {files.root}")
            files.mkdirs(f"{files.root}/_catalog")
        store = cls(spark, files, mode, plain, compress, typemap)
        if not parallel_read:
            _OPEN[key] = store
        return store

    def close(self) -> None:
        """Commits; the last user of a handle closes it."""
        if self.writable:
            self.catalog.commit()
        self.users -= 1
        if self.users <= 0:
            _OPEN.pop((self.spark.sparkContext.applicationId, self.files.root), None)

    def flush(self) -> None:
        if self.writable:
            self.catalog.commit()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def guard(self) -> None:
        if not self.writable:
            raise StoreError(f"{self.files.root} is open for reading only")

    def disable_commit(self) -> None:
        """From now on plain types alone may be written: numbers, text, and arrays of them."""
        self.commit_types = False

    # the root group's operations

    def __getattr__(self, name: str) -> Any:
        if name in _FORWARDED:
            return getattr(self.root, name)
        raise AttributeError(name)

    def __getitem__(self, name: str) -> DataFrame | Group:
        return self.root[name]

    def __setitem__(self, name: str, value: Any) -> None:
        self.root[name] = value

    def __delitem__(self, name: str) -> None:
        self.root.delete(name)

    def __contains__(self, name: str) -> bool:
        return name in self.root

    def __len__(self) -> int:
        return len(self.root)

    def __iter__(self) -> Iterator[str]:
        return iter(self.root)

    # writing

    def write_entry(self, path: str, value: Any, *, compress: Any = None, type_name: str | None = None, chunk: Sequence[int] | None = None, attributes: dict[str, Any] | None = None) -> Entry:
        self.guard()
        if not path:
            raise StoreError("a dataset needs a name")
        if self.catalog.get(path):
            raise StoreError(f"{path} exists already")
        pipeline = self.compress if compress is None else normalize_filters(compress)
        frame, entry = self._frame_of(value, path, chunk)
        if compress is not None and pipeline and entry.space in ("scalar", "null"):
            warnings.warn(f"{path}: compression has no use for a single value", stacklevel=3)
        name, codec = type_name or entry.type_name, self.codecs.get(type_name)
        if codec:
            column = frame.columns[-1]
            frame = frame.withColumn(column, codec.encode(F.col(column)))
        schema, dropped = without_empty_structs(frame.schema)
        frame = frame.select(*[F.col(f"`{f.name}`") for f in schema.fields])
        if not self.commit_types and (type_name or not all(is_plain(f.dataType) for f in schema.fields)):
            raise StoreError(f"{path}: this store takes plain types only")
        self._make_groups(path)
        parquet, options = pipeline.parquet()
        data_dir = f"data/{uuid.uuid4().hex}"
        frame.write.mode("errorifexists").option("compression", parquet).options(**options).parquet(f"{self.files.root}/{data_dir}")
        attrs = {k: json.dumps(v) for k, v in (attributes or {}).items()}
        if dropped:
            attrs["empty_fields"] = json.dumps(dropped)
        entry = replace(entry, type_name=name, written_as=codec.stored_as if codec else None, schema_json=schema.json(), codec=parquet, attrs=attrs, data_dir=data_dir)
        if type_name:
            self._commit_type(type_name, schema, entry.written_as)
        return self.catalog.put(entry)

    def _frame_of(self, value: Any, path: str, chunk: Sequence[int] | None) -> tuple[DataFrame, Entry]:
        spark = self.spark
        if isinstance(value, DataFrame):
            return value, Entry(path, "dataset", space="frame")
        if isinstance(value, np.ndarray):
            if value.ndim == 0:
                name = type_of(value[()])
                return self._one(value[()], name), Entry(path, "dataset", space="simple", dims=[], type_name=name)
            if value.dtype.kind in "OUSc":
                flat = value.ravel().tolist()
                return self._many(flat), Entry(path, "dataset", space="list", dims=list(value.shape), type_name=_element_type(flat))
            grid = arrays.Grid.of(value.shape, chunk)
            frame = arrays.to_chunks(spark, value, grid)
            return frame, Entry(path, "dataset", space="simple", dims=list(value.shape), chunk=list(grid.chunk), type_name=value.dtype.name)
        if isinstance(value, dict):
            pairs = [(k, v) for k, v in value.items()]
            if not pairs:
                return spark.createDataFrame([], "key string, value string"), Entry(path, "dataset", space="dict", dims=[0], type_name="dict")
            keys, values = _element_type([k for k, _ in pairs]), _element_type([v for _, v in pairs])
            from tessera.functions.types import SPARK_TYPES

            schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("key", SPARK_TYPES[keys]), T.StructField("value", SPARK_TYPES[values])])
            rows = [(i, stored_value(k, keys), stored_value(v, values)) for i, (k, v) in enumerate(pairs)]
            return spark.createDataFrame(rows, schema), Entry(path, "dataset", space="dict", dims=[len(pairs)], type_name=f"dict<{keys},{values}>")
        if isinstance(value, (list, tuple)):
            return self._many(list(value)), Entry(path, "dataset", space="list", dims=[len(value)], type_name=_element_type(list(value)))
        name = type_of(value)
        if name in ("nothing", "missing"):
            return spark.createDataFrame([(name,)], "value string"), Entry(path, "dataset", space="null", type_name=name)
        return self._one(value, name), Entry(path, "dataset", space="scalar", type_name=name)

    def _one(self, value: Any, name: str) -> DataFrame:
        from tessera.functions.types import SPARK_TYPES

        return self.spark.createDataFrame([(stored_value(value, name),)], T.StructType([T.StructField("value", SPARK_TYPES[name])]))

    def _many(self, values: list) -> DataFrame:
        from tessera.functions.types import SPARK_TYPES

        name = _element_type(values)
        if name == "ragged":
            inner = _element_type([x for v in values if v is not None for x in v])
            kind: T.DataType = T.ArrayType(SPARK_TYPES[inner])
            rows = [(i, None if v is None else [stored_value(x, inner) for x in v]) for i, v in enumerate(values)]
        elif name == "union":
            kind = T.StringType()
            rows = [(i, json.dumps({"type": type_of(v), "value": v if isinstance(v, (int, float, str, bool)) else None if v is None else repr(v)})) for i, v in enumerate(values)]
        else:
            kind = SPARK_TYPES[name] if name not in ("nothing", "missing") else T.StringType()
            rows = [(i, stored_value(v, name) if v is not None and type_of(v) != "missing" else None) for i, v in enumerate(values)]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField("idx", T.LongType()), T.StructField("value", kind)]))

    def _make_groups(self, path: str) -> None:
        parts = path.split("/")[:-1]
        for k in range(1, len(parts) + 1):
            parent = "/".join(parts[:k])
            found = self.catalog.get(parent)
            if found is None:
                self.catalog.put(Entry(parent, "group"))
            elif found.kind != "group":
                raise StoreError(f"{parent} is no group")

    def _commit_type(self, name: str, schema: T.StructType, written_as: str | None) -> None:
        path = f"{TYPES}/{name}"
        if self.catalog.get(TYPES) is None:
            self.catalog.put(Entry(TYPES, "group"))
        if self.catalog.get(path) is None:
            self.catalog.put(Entry(path, "type", type_name=name, written_as=written_as, schema_json=schema.json()))

    def committed_types(self) -> dict[str, T.StructType]:
        """Schemas of the types committed to this store, by name."""
        return {e.name: e.schema for e in self.catalog.children(TYPES)}

    def signature(self, path: str, fields: bool = True) -> str:
        """A dataset's type as text; its data is not read."""
        entry = self.root.entry(path)
        return f"{entry.type_name}: {signature(entry.schema, fields)}" if entry.type_name else signature(entry.schema, fields)

    # reading

    def data_path(self, entry: Entry) -> str:
        """Where a dataset's files are: in the store, or where a link points."""
        return entry.data_dir if entry.data_dir.startswith("/") or ":/" in entry.data_dir else f"{self.files.root}/{entry.data_dir}"

    def frame(self, entry: Entry, *, plain: bool | None = None, typemap: TypeMap | None = None) -> DataFrame:
        df = self.spark.read.schema(entry.schema).parquet(self.data_path(entry))
        if self.plain if plain is None else plain:
            return df
        if codec := self.codecs.get(entry.type_name):
            column = df.columns[-1]
            df = df.withColumn(column, codec.decode(F.col(column)))
        spoken, target = resolve(typemap or self.typemap, entry.type_name, entry.path)
        if spoken:
            df, _ = evolve(df, target, self.committed_types(), entry.path)
        return df

    def reconstructed(self, path: str, typemap: TypeMap | None = None) -> bool:
        """Whether reading this dataset leaves its records as stored since their type could not be made."""
        entry = self.root.entry(path)
        spoken, target = resolve(typemap or self.typemap, entry.type_name, entry.path)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return bool(spoken and evolve(self.frame(entry, plain=True), target, self.committed_types(), entry.path)[1])

    def value(self, path: str) -> Any:
        """The Python value of a small dataset; cells of an array that were never written hold its fill value."""
        entry = self.root.entry(path)
        df = self.root.dataset(path).read()
        if entry.space == "null":
            return loaded_value(None, entry.type_name)
        if entry.space == "scalar":
            return loaded_value(df.first()["value"], entry.type_name)
        if entry.space == "dict":
            kinds = entry.type_name[5:-1].split(",") if "<" in entry.type_name else ("string", "string")
            return {loaded_value(r["key"], kinds[0]): loaded_value(r["value"], kinds[1]) for r in (df.orderBy("idx") if "idx" in df.columns else df).collect()}
        if entry.space == "list":
            rows = [r["value"] for r in df.orderBy("idx").collect()]
            if entry.type_name == "union":
                return [loaded_value(x["value"], x["type"]) for x in map(json.loads, rows)]
            return [list(v) if isinstance(v, list) else loaded_value(v, entry.type_name) for v in rows]
        if entry.space == "simple":
            if not entry.dims:
                return np.array(df.first()["value"])
            grid = arrays.Grid.of(entry.dims, entry.chunk)
            return arrays.to_numpy(arrays.explode_chunks(df, grid), entry.dims).astype(entry.type_name)
        return df

    # maintenance

    def vacuum(self) -> int:
        """Removes data that no committed entry uses; returns how many folders went."""
        self.guard()
        self.catalog.commit()
        used = {r["data_dir"] for r in self.catalog.committed().where("data_dir IS NOT NULL").select("data_dir").collect()}
        gone = [n for n in self.files.names(f"{self.files.root}/data") if f"data/{n}" not in used]
        for n in gone:
            self.files.delete(f"{self.files.root}/data/{n}")
        return len(gone)


def _element_type(values: list) -> str:
    kinds = {"ragged" if isinstance(v, (list, tuple, np.ndarray)) else type_of(v) for v in values if v is not None} - {"missing"}
    if not kinds:
        return "nothing"
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {"int64", "float64"}:
        return "union"
    return "union"


class Dataset:
    """A handle on a dataset, written or not: its data is read only when asked for."""

    def __init__(self, group: Group, path: str, dims: Sequence[int] | None = None, chunk: Sequence[int] | None = None, dtype: str = "float64", compress: Any = None):
        self.group, self.store, self.path = group, group.store, path
        self._spec = (dims, chunk, dtype, compress)
        self._attributes: dict[str, Any] = {}

    @property
    def entry(self) -> Entry | None:
        return self.store.catalog.get(self.path)

    def is_written(self) -> bool:
        return self.entry is not None

    def is_array(self) -> bool:
        entry = self.entry
        return (entry.space == "simple") if entry else self._spec[0] is not None

    def write(self, value: Any) -> Dataset:
        """Writes the data, once."""
        if self.is_written():
            raise StoreError(f"{self.path} is written already")
        self.store.write_entry(self.path, value, compress=self._spec[3], chunk=self._spec[1], attributes=self._attributes)
        return self

    def allocate(self, dtype: str | None = None, fill: Any = 0) -> Dataset:
        """Makes the array without data: cells that are never written read as the fill value."""
        dims, chunk, kind, compress = self._spec
        if dims is None:
            raise StoreError("an array to allocate needs dimensions")
        if compress:
            raise StoreError("arrays that are filled later are not compressed")
        grid = arrays.Grid.of(dims, chunk)
        kind = dtype or kind
        spark_type = {"f": "double", "i": "long", "u": "long", "b": "boolean"}[np.dtype(kind).kind]
        schema = "".join(f"{n} int, " for n in grid.names) + f"shape array<int>, values array<{spark_type}>"
        entry = self.store.write_entry(self.path, self.store.spark.createDataFrame([], schema), attributes=self._attributes | {"fill": fill})
        self.store.catalog.put(replace(entry, space="simple", dims=list(grid.dims), chunk=list(grid.chunk), type_name=kind))
        return self

    def read(self) -> DataFrame:
        entry = self.entry
        if entry is None:
            raise StoreError(f"{self.path} is not written")
        df = self.store.frame(entry)
        if "fill" in entry.attrs:
            df = arrays.filled(df, self.grid, json.loads(entry.attrs["fill"]))
        return df

    @property
    def grid(self) -> arrays.Grid:
        entry = self.entry
        if entry is None or entry.space != "simple" or not entry.dims:
            raise StoreError(f"{self.path} is no array")
        return arrays.Grid.of(entry.dims, entry.chunk)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.grid.dims

    def _index(self, index: Any) -> tuple:
        index = index if isinstance(index, tuple) else (index,)
        if len(index) == 1 and len(self.shape) > 1 and isinstance(index[0], int):  # a linear index, row-major
            if not 0 <= index[0] < int(np.prod(self.shape)):
                raise IndexError(f"index {index[0]} is outside the array")
            index = tuple(int(i) for i in np.unravel_index(index[0], self.shape))
        return index

    def elements(self, index: Any) -> DataFrame:
        """(i0, ..., value) of a slice as a lazy frame."""
        return arrays.slice_chunks(self.read(), self.grid, self._index(index))

    def __getitem__(self, index: Any) -> Any:
        index = self._index(index)
        ranges = arrays.bounds(self.grid, index)
        shape = [-(-(stop - first) // step) for first, stop, step in ranges]
        if np.prod(shape, dtype=object) > MOST_CELLS:
            raise StoreError(f"{self.path}: a slice of {tuple(shape)} is more than the driver takes; use elements()")
        found = arrays.to_numpy(self.elements(index), shape).astype(self.entry.type_name)
        kept = tuple(slice(None) if isinstance(i, slice) else 0 for i in index)
        return found[kept]

    def __setitem__(self, index: Any, value: Any) -> None:
        """Sets a slice to one value, to an array, or to what a function of the old value and the indices gives, as columns.

        The chunks go to a new version of the dataset.
        """
        self.store.guard()
        index = self._index(index)
        ranges = arrays.bounds(self.grid, index)
        shape = tuple(-(-(stop - first) // step) for first, stop, step in ranges)
        if isinstance(value, (np.ndarray, list)):
            new = np.broadcast_to(np.asarray(value), [n for n, i in zip(shape, index, strict=True) if isinstance(i, slice)]).reshape(shape)
            steps = {f"i{k}": first + at.ravel() * step for k, (at, (first, _, step)) in enumerate(zip(np.indices(shape), ranges, strict=True))}
            self.put_elements(self.store.spark.createDataFrame(pd.DataFrame(steps | {"value": new.ravel()})))
            return
        change = value if callable(value) else lambda *_: F.lit(value)
        self._replace(arrays.update_chunks(self.read(), self.grid, index, change))

    def put_elements(self, elements: DataFrame) -> None:
        """Sets the cells that a frame (i0, i1, ..., value) lists, of any number; of several values of a cell the largest counts.

        Only chunks that a listed cell falls into are taken apart; the others are copied as they are.
        """
        self.store.guard()
        self._replace(arrays.put_elements(self.read(), self.grid, elements))

    def _replace(self, frame: DataFrame) -> None:
        entry, data_dir = self.entry, f"data/{uuid.uuid4().hex}"
        frame.write.option("compression", entry.codec or "none").parquet(f"{self.store.files.root}/{data_dir}")
        attrs = {k: v for k, v in entry.attrs.items() if k != "fill"}
        self.store.catalog.put(replace(entry, data_dir=data_dir, version=entry.version + 1, attrs=attrs))

    def add_attribute(self, name: str, value: Any) -> None:
        if self.is_written():
            self.group.add_attribute(self.path.rpartition("/")[2] if self.group.path else self.path, name, value)
        elif name in self._attributes:
            raise StoreError(f"{self.path} has an attribute {name} already")
        else:
            self._attributes[name] = value

    def attributes(self) -> dict[str, Any]:
        return {k: json.loads(v) for k, v in self.entry.attrs.items()} if self.entry else dict(self._attributes)

    def show(self) -> str:
        """The dataset's description as text."""
        entry = self.entry
        if entry is None:
            return f"dataset {self.path}: not written"
        lines = [f"dataset {self.path}", f"  type: {entry.type_name or '-'} {signature(entry.schema)}", f"  space: {entry.space}{' ' + str(tuple(entry.dims)) if entry.dims is not None else ''}", f"  layout: parquet, {entry.codec}{', chunks ' + str(tuple(entry.chunk)) if entry.chunk else ''}"]
        return "\n".join([*lines, *(f"  attribute {k}: {v}" for k, v in entry.attrs.items())])

    def check_codec(self) -> None:
        """Raises where a file of the dataset has another codec than the catalog says."""
        import pyarrow.parquet as pq

        want = (self.entry.codec or "none").upper().replace("NONE", "UNCOMPRESSED").replace("LZ4_RAW", "LZ4")
        for store, path in self._files():
            meta = pq.ParquetFile(path, filesystem=store).metadata
            found = {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)}
            if found - {want}:
                raise StoreError(f"{path} is compressed with {', '.join(sorted(found))}, not {want}")

    def headers(self) -> list[str]:
        """Parquet footers of the dataset's files as text."""
        import pyarrow.parquet as pq

        return [str(pq.ParquetFile(path, filesystem=store).metadata) for store, path in self._files()]

    def _files(self) -> list[tuple[Any, str]]:
        from pyarrow import fs

        place = self.store.data_path(self.entry)
        store, path = fs.FileSystem.from_uri(place if "://" in place else place.replace("file:/", "file:///", 1))
        return [(store, f.path) for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]


class Group:
    """A folder of names; keys keep the order of their creation."""

    def __init__(self, store: Store, path: str):
        self.store, self.path = store, path

    def _full(self, name: str) -> str:
        return normalize(name, self.path)

    def entry(self, name: str) -> Entry:
        path = self._full(name)
        found = self.store.catalog.get(path)
        if found is None:
            raise KeyError(path)
        return found

    def __contains__(self, name: str) -> bool:
        path = self._full(name)
        return path == "" or self.store.catalog.get(path) is not None

    def is_group(self, name: str) -> bool:
        return self.entry(name).kind == "group"

    def keys(self) -> list[str]:
        return [e.name for e in self.store.catalog.children(self.path) if e.path != TYPES]

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def is_empty(self) -> bool:
        return not self.keys()

    def group(self, name: str) -> Group:
        """An existing group."""
        if not self.is_group(name):
            raise StoreError(f"{name} is no group")
        return Group(self.store, self._full(name))

    def create_group(self, name: str) -> Group:
        self.store.guard()
        path = self._full(name)
        if path in self.store.root:
            raise StoreError(f"{path} exists already")
        self.store._make_groups(path)
        self.store.catalog.put(Entry(path, "group"))
        return Group(self.store, path)

    def __getitem__(self, name: str) -> DataFrame | Group:
        entry = self.entry(name)
        return Group(self.store, entry.path) if entry.kind == "group" else self.dataset(name).read()

    def __setitem__(self, name: str, value: Any) -> None:
        self.write(name, value)

    def write(self, name: str, value: Any, **options: Any) -> Entry:
        """Writes a value under a new name; options as of Store.write_entry.  A dict of frames makes a group."""
        path = self._full(name)
        if isinstance(value, Group):
            self.attach(name, value)
            return self.entry(name)
        if isinstance(value, dict) and value and any(isinstance(v, (DataFrame, dict)) for v in value.values()):
            made = self.create_group(name)
            for key, item in value.items():
                made.write(key, item, **options)
            return self.entry(name)
        return self.store.write_entry(path, value, **options)

    def link(self, name: str, location: str) -> Entry:
        """Names Parquet data that lies elsewhere, without copying it; deleting the name leaves the data alone."""
        self.store.guard()
        path = self._full(name)
        if self.store.catalog.get(path):
            raise StoreError(f"{path} exists already")
        location = Files(self.store.spark, location).root
        schema = self.store.spark.read.parquet(location).schema
        self.store._make_groups(path)
        return self.store.catalog.put(Entry(path, "dataset", space="frame", schema_json=schema.json(), data_dir=location))

    def attach(self, name: str, child: Group) -> None:
        """Gives a group's entries another name as well; data is shared, not copied."""
        made = self.create_group(name)
        for e in list(self.store.catalog.below(child.path)):
            self.store.catalog.put(replace(e, path=f"{made.path}{e.path[len(child.path):]}", ordinal=0))

    def value(self, name: str) -> Any:
        return self.store.value(self._full(name))

    def get(self, name: str, default: Any = None) -> Any:
        """The dataset, or the default; a callable default is called."""
        if name in self:
            return self[name]
        return default() if callable(default) else default

    def setdefault(self, name: str, default: Any) -> Any:
        if name not in self:
            self.write(name, default() if callable(default) and not isinstance(default, DataFrame) else default)
        return self[name]

    def delete(self, name: str) -> None:
        """Drops a name and what is below it; space is given back by ``vacuum``."""
        self.store.guard()
        self.store.catalog.drop(self.entry(name).path)

    def dataset(self, name: str) -> Dataset:
        entry = self.entry(name)
        if entry.kind == "group":
            raise StoreError(f"{entry.path} is a group")
        return Dataset(Group(self.store, ""), entry.path)

    def create_dataset(self, name: str, dims: Sequence[int] | None = None, chunk: Sequence[int] | None = None, dtype: str = "float64", compress: Any = None) -> Dataset:
        """A description of a dataset that is written later."""
        self.store.guard()
        normalize_filters(compress)
        if name in self:
            raise StoreError(f"{name} exists already")
        return Dataset(Group(self.store, ""), self._full(name), dims, chunk, dtype, compress)

    def add_attribute(self, name: str, key: str, value: Any) -> None:
        """Adds an attribute to a dataset or group; its name must be new."""
        self.store.guard()
        entry = self.entry(name) if self._full(name) else self.store.catalog.get("") or Entry("", "group")
        if key in entry.attrs:
            raise StoreError(f"{entry.path} has an attribute {key} already")
        self.store.catalog.put(replace(entry, attrs={**entry.attrs, key: json.dumps(value)}))

    def attributes(self, name: str = "", expected: type | None = None) -> dict[str, Any]:
        entry = self.store.catalog.get(self._full(name))
        found = {k: json.loads(v) for k, v in entry.attrs.items()} if entry else {}
        if expected and (wrong := [k for k, v in found.items() if not isinstance(v, expected)]):
            raise TypeError(f"attributes {', '.join(wrong)} are no {expected.__name__}")
        return found

    def load_all(self, nested: bool = False) -> dict[str, Any]:
        """All datasets as lazy frames: flat ``a/b/c`` keys, or nested dictionaries."""
        if nested:
            return {e.name: Group(self.store, e.path).load_all(True) if e.kind == "group" else self.store.root.dataset(e.path).read() for e in self.store.catalog.children(self.path) if e.path != TYPES}
        skip = len(self.path) + 1 if self.path else 0
        return {e.path[skip:]: self.store.root.dataset(e.path).read() for e in self.store.catalog.below(self.path) if e.kind == "dataset"}

    def load(self, *names: str) -> Any:
        """One dataset (a group as nested dictionaries), or a tuple of several."""
        found = tuple(v.load_all(True) if isinstance(v := self[n], Group) else v for n in names)
        return found[0] if len(found) == 1 else found

    def save(self, **values: Any) -> None:
        for name, value in values.items():
            self.write(name, value)

    def toc(self, lines: int | None = None) -> str:
        """The tree of names below this group, cut after some lines."""
        out: list[str] = [self.path or "/"]

        def walk(path: str, indent: str) -> None:
            children = [e for e in self.store.catalog.children(path) if e.path != TYPES]
            for k, e in enumerate(children):
                last = k == len(children) - 1
                mark = "" if e.kind == "group" else f"  {signature(e.schema, False)}" if e.schema else ""
                out.append(f"{indent}{'└─ ' if last else '├─ '}{e.name}{'/' if e.kind == 'group' else mark}")
                if e.kind == "group":
                    walk(e.path, indent + ("   " if last else "│  "))

        walk(self.path, "")
        if lines is not None and len(out) > lines:
            out = [*out[:lines], f"... ({len(out) - lines} more entries)"]
        return "\n".join(out)


_FORWARDED = {"keys", "is_empty", "group", "create_group", "write", "link", "attach", "get", "setdefault", "delete", "dataset", "create_dataset", "add_attribute", "attributes", "load_all", "load", "save", "toc", "is_group", "entry"}


def save(spark: SparkSession, path: str, *pairs: Any, compress: Any = None, **values: Any) -> None:
    """Saves to a new store: a dictionary, name-value pairs, or keywords."""
    if len(pairs) == 1 and isinstance(pairs[0], dict):
        given = dict(pairs[0])
    elif len(pairs) % 2 == 0:
        given = dict(zip(pairs[::2], pairs[1::2], strict=True))
    else:
        raise StoreError("values need names")
    given |= values
    if not given:
        raise StoreError("there is nothing to save")
    if bad := [k for k in given if not isinstance(k, str)]:
        raise TypeError(f"names are text, not {type(bad[0]).__name__}")
    with Store.open(spark, path, "w", compress=compress) as store:
        for name, value in given.items():
            store.root.write(name, value)


def load(spark: SparkSession, path: str, *names: str, nested: bool = False, typemap: TypeMap | None = None) -> Any:
    """All datasets of a store, or the named ones, as lazy frames."""
    with Store.open(spark, path, "r", typemap=typemap, parallel_read=True) as store:
        return store.root.load(*names) if names else store.root.load_all(nested)


def save_object(spark: SparkSession, path: str, value: Any) -> None:
    save(spark, path, **{SINGLE_OBJECT: value})


def load_object(spark: SparkSession, path: str) -> Any:
    """The only object of a store; none or several raise."""
    with Store.open(spark, path, "r", parallel_read=True) as store:
        found = store.keys()
        if len(found) != 1:
            raise StoreError(f"{path} holds {len(found)} objects, not one")
        entry = store.entry(found[0])
        return store[found[0]] if entry.space == "frame" else store.value(found[0])


def over_tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Read access to a folder of NAME.parquet files as if each were a dataset; nothing is read before it is asked for."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
