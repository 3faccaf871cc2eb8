"""The catalog of a store: a row per group, dataset and committed type, kept as versioned Parquet snapshots.

A commit writes a whole new snapshot under another name and renames it into place; the highest version with a success
mark is the catalog.  Readers therefore see the catalog before or after a commit, never between.  Small catalogs (up to
``HELD_ROWS`` rows, checked by a count) are held by the driver; larger ones are asked by filters that reach the scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.files import Files

FORMAT_VERSION = 1
HELD_ROWS = 500_000

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("space", T.StringType()),
        T.StructField("dims", T.ArrayType(T.LongType())),
        T.StructField("chunk", T.ArrayType(T.LongType())),
        T.StructField("type_name", T.StringType()),
        T.StructField("written_as", T.StringType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data_dir", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("format_version", T.IntegerType()),
    ]
)


@dataclass
class Entry:
    """One catalog row.  attrs holds JSON texts; dims and chunk are of arrays only."""

    path: str
    kind: str
    ordinal: int = 0
    space: str | None = None
    dims: list[int] | None = None
    chunk: list[int] | None = None
    type_name: str | None = None
    written_as: str | None = None
    schema_json: str | None = None
    codec: str | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    data_dir: str | None = None
    version: int = 1
    format_version: int = FORMAT_VERSION

    @property
    def parent(self) -> str:
        return self.path.rpartition("/")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]

    @property
    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(self.schema_json)) if self.schema_json else None

    def row(self) -> tuple:
        values = asdict(self) | {"parent": self.parent, "name": self.name}
        return tuple(values[f.name] for f in SCHEMA.fields)

    @classmethod
    def of(cls, row: T.Row) -> Entry:
        values = row.asDict()
        values.pop("parent")
        values.pop("name")
        values["attrs"] = dict(values["attrs"] or {})
        return cls(**values)


def normalize(path: str, base: str = "") -> str:
    """A path from the root without a leading slash; a leading slash counts from the root, repeated ones count once."""
    if not isinstance(path, str):
        raise TypeError(f"names are text, not {type(path).__name__}")
    parts = [p for p in (path if path.startswith("/") else f"{base}/{path}").split("/") if p]
    return "/".join(parts)


class Catalog:
    def __init__(self, spark: SparkSession, files: Files):
        self.spark, self.files = spark, files
        self.folder = f"{files.root}/_catalog"
        self.changed: dict[str, Entry | None] = {}
        self._version = self._latest()
        self._held: dict[str, Entry] | None = None
        self._top: int | None = None
        if self._version is None:
            self._held = {}

    def _latest(self) -> int | None:
        found = [int(n[1:]) for n in self.files.names(self.folder) if n.startswith("v") and n[1:].isdigit() and self.files.exists(f"{self.folder}/{n}/_SUCCESS")]
        return max(found, default=None)

    def committed(self) -> DataFrame:
        """The committed snapshot."""
        if self._version is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{self._version:09d}")

    def _hold(self) -> dict[str, Entry] | None:
        if self._held is None and self._top is None:
            frame = self.committed()
            count, top = frame.agg(F.count(F.lit(1)), F.max("ordinal")).first()
            self._top = top or 0
            bad = frame.where(F.col("format_version") > FORMAT_VERSION).limit(1).collect()
            if bad:
                raise ValueError(f"the store has format {bad[0]['format_version']}; this code reads up to {FORMAT_VERSION}")
            if count <= HELD_ROWS:
                self._held = {r["path"]: Entry.of(r) for r in frame.collect()}
        return self._held

    def get(self, path: str) -> Entry | None:
        if path in self.changed:
            return self.changed[path]
        held = self._hold()
        if held is not None:
            return held.get(path)
        rows = self.committed().where(F.col("path") == path).limit(1).collect()
        return Entry.of(rows[0]) if rows else None

    def frame(self) -> DataFrame:
        """All live rows, changes of this session included."""
        base = self.committed()
        if not self.changed:
            return base
        gone = self.spark.createDataFrame([(p,) for p in self.changed], "path string")
        new = self.spark.createDataFrame([e.row() for e in self.changed.values() if e], SCHEMA)
        return base.join(F.broadcast(gone), "path", "left_anti").select(*SCHEMA.names).unionByName(new)

    def children(self, path: str) -> list[Entry]:
        """Entries right below a group, in the order of their creation."""
        held = self._hold()
        if held is not None:
            found = [e for p, e in held.items() if e.parent == path and p not in self.changed]
        else:
            found = [Entry.of(r) for r in self.committed().where(F.col("parent") == path).collect() if r["path"] not in self.changed]
        found += [e for e in self.changed.values() if e and e.parent == path and e.path]
        return sorted((e for e in found if e.path), key=lambda e: (e.ordinal, e.path))

    def below(self, path: str) -> Iterator[Entry]:
        for e in self.children(path):
            yield e
            if e.kind == "group":
                yield from self.below(e.path)

    def put(self, entry: Entry) -> Entry:
        old = self.get(entry.path)
        if old is None:
            self._hold()
            top = max([self._top or 0, *(e.ordinal for e in (self._held or {}).values()), *(e.ordinal for e in self.changed.values() if e)], default=0) if self._top is None or not self.changed else max(self._top, *(e.ordinal for e in self.changed.values() if e), 0)
            entry = replace(entry, ordinal=top + 1)
        self.changed[entry.path] = entry
        return entry

    def drop(self, path: str) -> None:
        for e in list(self.below(path)):
            self.changed[e.path] = None
        self.changed[path] = None

    def commit(self) -> None:
        """Writes the next snapshot; nothing to do where nothing changed."""
        if not self.changed and self._version is not None:
            return
        version = (self._version or 0) + 1
        if (self._latest() or 0) >= version:
            raise RuntimeError("another session has committed to this store meanwhile")
        partial = f"{self.folder}/_next-{version:09d}"
        self.files.delete(partial)
        self.frame().coalesce(1).write.parquet(partial)
        if not self.files.rename(partial, f"{self.folder}/v{version:09d}"):
            raise RuntimeError("the catalog could not be committed")
        self._version, self.changed, self._held, self._top = version, {}, None, None
