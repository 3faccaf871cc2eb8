"""Registered queries of the store's own operators, over whole tables, and their SQL twins for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import codecs
from tessera.functions.filters import normalize_filters
from tessera.operators import arrays, evolve, refs

from .store import Store, load, load_object, over_tables, save, save_object

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where a local session leaves that unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"


def linked(spark: SparkSession, sf_dir: str) -> str:
    """A store that names every table, without copying any."""
    path = scratch(spark, "links")
    with Store.open(spark, path, "w") as store:
        for t in TABLES:
            store.link(t, f"{sf_dir}/{t}.parquet")
    return path


def world(spark: SparkSession, sf_dir: str) -> str:
    """A store with a group for each region, with attributes, and in it the region's nations."""
    read, path = over_tables(spark, sf_dir), scratch(spark, "world")
    with Store.open(spark, path, "w") as store:
        top = store.create_group("world")
        for r in read("region").orderBy("r_regionkey").collect():  # a row per group to make
            region = top.create_group(r["r_name"])
            region.write("nations", read("nation").where(F.col("n_regionkey") == r["r_regionkey"]))
            top.add_attribute(r["r_name"], "regionkey", r["r_regionkey"])
            top.add_attribute(r["r_name"], "label", r["r_name"].lower())
    return path


@_query("load_named", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def load_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset of a store by name, three of its fields; the other datasets are not read."""
    return load(spark, linked(spark, sf_dir), "lineitem").select("l_orderkey", "l_partkey", "l_quantity")


@_query("toc_counts", " UNION ALL ".join(f"SELECT '{t}' AS path, count(*) AS n_rows FROM {t}" for t in TABLES))
def toc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All datasets of a store with the length of each; counts come from Parquet footers."""
    found = load(spark, linked(spark, sf_dir))
    return refs.append(*(df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(path).alias("path"), "n_rows") for path, df in found.items()))


@_query("toc_lines", "SELECT * FROM (VALUES (0, '/'), " + ", ".join(f"({k + 1}, '{'└─' if k == len(TABLES) - 1 else '├─'} {t}')" for k, t in enumerate(TABLES)) + ") AS t(idx, line)")
def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of contents as lines of text, names alone."""
    with Store.open(spark, linked(spark, sf_dir), "r", parallel_read=True) as store:
        lines = store.toc().splitlines()
    return spark.createDataFrame([(k, line.split("  ")[0]) for k, line in enumerate(lines)], "idx int, line string")


@_query("path_tree", "SELECT concat('world/', r_name, '/nations') AS path, count(n_nationkey) AS n_rows FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets under nested group paths."""
    found = load(spark, world(spark, sf_dir))
    return refs.append(*(df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(path).alias("path"), "n_rows") for path, df in found.items()))


@_query("load_nested", "SELECT r_name AS region, n_nationkey, n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def load_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group loaded as nested dictionaries of frames."""
    found = load(spark, world(spark, sf_dir), "world")
    return refs.append(*(group["nations"].select(F.lit(name).alias("region"), "n_nationkey", "n_name", "n_regionkey") for name, group in found.items()))


@_query("attach_group", "SELECT p AS path, n_name FROM (VALUES ('world'), ('earth')) AS t(p) CROSS JOIN nation")
def attach_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group under a second name: both names give the same rows."""
    with Store.open(spark, world(spark, sf_dir), "r+") as store:
        store.attach("earth", store.group("world"))
        found = store.load_all()
    return refs.append(*(df.select(F.lit(path.split("/")[0]).alias("path"), "n_name") for path, df in found.items()))


@_query(
    "group_names",
    """SELECT 'keys' AS what, r_name AS name, 0 AS n FROM region UNION ALL SELECT 'member', r_name, 1 FROM region UNION ALL SELECT 'member', 'nowhere', 0
       UNION ALL SELECT 'length', 'world', count(*) FROM region UNION ALL SELECT 'default', 'nowhere', 7 UNION ALL SELECT 'inserted', 'size', count(*) FROM nation UNION ALL SELECT 'after', 'world', count(*) + 1 FROM region""",
)
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, membership, length, get with a default and get-or-insert of a group."""
    nations = over_tables(spark, sf_dir)("nation")
    with Store.open(spark, world(spark, sf_dir), "r+") as store:
        top = store.group("world")
        rows = [("keys", k, 0) for k in top.keys()] + [("member", k, int(k in top)) for k in [*top.keys(), "nowhere"]]
        rows += [("length", "world", len(top)), ("default", "nowhere", top.get("nowhere", lambda: 7))]
        made = top.setdefault("size", lambda: nations.count())
        rows += [("inserted", "size", made.first()["value"]), ("after", "world", len(top))]
    return spark.createDataFrame(rows, "what string, name string, n long")


@_query("save_forms", "SELECT 'pairs' AS form, r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'keyword', n_nationkey, n_name FROM nation UNION ALL SELECT 'object', s_suppkey, s_name FROM supplier UNION ALL SELECT 'dictionary', c_custkey, c_name FROM customer")
def save_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saving by pairs, keywords, a dictionary and as a single object, and loading each again."""
    read, path, one, many = over_tables(spark, sf_dir), scratch(spark, "saved"), scratch(spark, "object"), scratch(spark, "dictionary")
    save(spark, path, "places/region", read("region"), nation=read("nation"), compress="zstd")
    save_object(spark, one, read("supplier"))
    save(spark, many, {"people": {"customer": read("customer")}})
    region, nation = load(spark, path, "places/region", "nation")
    found = [("pairs", region, "r_regionkey", "r_name"), ("keyword", nation, "n_nationkey", "n_name"), ("object", load_object(spark, one), "s_suppkey", "s_name"), ("dictionary", load(spark, many, nested=True)["people"]["customer"], "c_custkey", "c_name")]
    return refs.append(*(df.select(F.lit(form).alias("form"), F.col(key).alias("id"), F.col(name).alias("name")) for form, df, key, name in found))


@_query("slice_nd", "SELECT vec_id, embedding[2:4] AS part FROM embeddings")
def slice_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each array."""
    return over_tables(spark, sf_dir)("embeddings").select("vec_id", arrays.slice_column(F.col("embedding"), 1, 4).alias("part"))


@_query("slice_stride", "SELECT vec_id, [embedding[i] FOR i IN range(1, len(embedding) + 1, 2)] AS part FROM embeddings")
def slice_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second element of each array."""
    table = over_tables(spark, sf_dir)("embeddings")
    longest = table.agg(F.max(F.size("embedding"))).first()[0] or 0
    return table.select("vec_id", arrays.slice_column(F.col("embedding"), 0, longest, 2).alias("part"))


@_query(
    "chunk_grid",
    """SELECT vec_id, CAST(i // 7 AS INTEGER) AS chunk, CAST(least(7, len(embedding) - (i // 7) * 7) AS INTEGER) AS size, CAST(i AS INTEGER) AS idx, embedding[i + 1] AS value
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays cut into chunks of seven, the last one clipped, and read back element by element."""
    chunks = arrays.chunk_rows(over_tables(spark, sf_dir)("embeddings"), ["vec_id"], "embedding", 7)
    return chunks.select("vec_id", "chunk", "size", F.posexplode("values").alias("k", "value")).select("vec_id", "chunk", "size", (F.col("chunk") * 7 + F.col("k")).cast("int").alias("idx"), "value")


@_query(
    "update_slice",
    """SELECT vec_id, CAST(i AS INTEGER) AS idx, CASE WHEN i BETWEEN 2 AND 4 THEN CAST(-1 AS FLOAT) ELSE embedding[i + 1] END AS value
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def update_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements 2 to 4 of every array set anew."""
    changed = over_tables(spark, sf_dir)("embeddings").select("vec_id", arrays.update_column(F.col("embedding"), 2, 5, F.lit(-1.0).cast("float")).alias("embedding"))
    return changed.select("vec_id", F.posexplode("embedding").alias("idx", "value"))


def matrix(spark: SparkSession, sf_dir: str) -> tuple[str, int, int]:
    """A store with the embeddings as one matrix in chunks of 128 x 16, and the matrix's size."""
    table, path = over_tables(spark, sf_dir)("embeddings"), scratch(spark, "matrix")
    rows, columns = table.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    with Store.open(spark, path, "w") as store:
        made = store.create_dataset("matrix", (rows, columns), chunk=(128, 16)).allocate()
        made.put_elements(table.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value")))
    return path, rows, columns


@_query(
    "slice_matrix",
    """SELECT CAST(vec_id - 10 AS INTEGER) AS i0, CAST((i - 5) // 3 AS INTEGER) AS i1, CAST(embedding[i + 1] AS DOUBLE) AS value
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings) WHERE vec_id >= 10 AND i >= 5 AND (i - 5) % 3 = 0""",
)
def slice_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strided block of a stored matrix, from row 10 and column 5 to the ends."""
    path, rows, columns = matrix(spark, sf_dir)
    with Store.open(spark, path, "r", parallel_read=True) as store:
        return store.dataset("matrix").elements((slice(10, rows), slice(5, columns, 3)))


@_query(
    "update_matrix",
    """SELECT CAST(vec_id AS INTEGER) AS i0, CAST(i AS INTEGER) AS i1,
              CASE WHEN i >= 8 AND i % 2 = 0 THEN 2 * CAST(embedding[i + 1] AS DOUBLE) + vec_id WHEN i = 3 THEN -1.0 WHEN vec_id = 5 AND i < 3 THEN i * 1.5 ELSE CAST(embedding[i + 1] AS DOUBLE) END AS value
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def update_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored matrix with a strided block changed by a function of value and place, a column set to one value, and three cells to an array."""
    path, rows, columns = matrix(spark, sf_dir)
    with Store.open(spark, path, "r+") as store:
        found = store.dataset("matrix")
        found[0:rows, 8:columns:2] = lambda old, i, j: old * 2 + i
        found[0:rows, 3] = -1.0
        found[5, 0:3] = [0.0, 1.5, 3.0]
        return found.elements((slice(0, rows), slice(0, columns)))


@_query("prealloc_fill", "SELECT CAST(r.idx AS INTEGER) AS i0, coalesce(e.value, -1.0) AS value FROM (SELECT unnest(range(2 * max(event_id) + 2)) AS idx FROM events) r LEFT JOIN events e ON 2 * e.event_id + e.user_id % 2 = r.idx")
def prealloc_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array made first, with two cells per event, then filled by events; cells without one hold the fill value."""
    events, path = over_tables(spark, sf_dir)("events"), scratch(spark, "prealloc")
    cells = 2 * events.agg(F.max("event_id")).first()[0] + 2
    with Store.open(spark, path, "w") as store:
        made = store.create_dataset("a", (cells,), chunk=(512,)).allocate(fill=-1.0)
        made.put_elements(events.select((F.col("event_id") * 2 + F.col("user_id") % 2).alias("i0"), "value"))
    with Store.open(spark, path, "r", parallel_read=True) as store:
        return store.dataset("a").elements(slice(0, cells))


@_query("fill_values", "SELECT way, CAST(i AS INTEGER) AS i0, CAST(CASE WHEN i BETWEEN 2 AND 3 THEN 1 ELSE 7 END AS DOUBLE) AS value FROM (SELECT unnest(['flat', 'nested', 'group', 'value']) AS way), (SELECT unnest(range(6)) AS i)")
def fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preallocated array's cells, set or not, by every way of loading it."""
    path = scratch(spark, "fill")
    with Store.open(spark, path, "w") as store:
        made = store.create_dataset("g/a", (6,), chunk=(2,)).allocate(fill=7.0)
        grid = made.grid
        untouched = store.value("g/a")
        made.put_elements(spark.createDataFrame([(2, 1.0), (3, 1.0)], "i0 int, value double"))
        found = {"flat": store.load_all()["g/a"], "nested": store.load_all(nested=True)["g"]["a"], "group": store.load("g")["a"]}
        value = store.value("g/a")
    if untouched.tolist() != [7.0] * 6:
        raise RuntimeError("cells that were never written do not hold the fill value")
    rows = spark.createDataFrame([("value", i, float(v)) for i, v in enumerate(value)], "way string, i0 int, value double")
    return refs.append(*(arrays.explode_chunks(df, grid).select(F.lit(way).alias("way"), "i0", "value") for way, df in found.items()), rows)


@_query(
    "inline_union",
    """SELECT event_id, CAST(CASE WHEN value < 50 THEN 0 ELSE 255 END AS INTEGER) AS mask, CAST(CASE WHEN value < 50 THEN floor(value) ELSE value END AS DOUBLE) AS value FROM events""",
)
def inline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as integers or floats in one union, written as (mask, t1, t2) and read back."""
    small = F.col("value") < 50
    union = codecs.union_encode(F.col("value"), small, F.floor("value").cast("long"), F.col("value"))
    return over_tables(spark, sf_dir)("events").select("event_id", union.alias("u")).select("event_id", F.col("u.mask").alias("mask"), codecs.union_decode(F.col("u"), "double").alias("value"))


@_query("nullable_union", "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events")
def nullable_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values or missing, places kept."""
    stored = codecs.missing_encode(F.when(F.col("event_type") == "click", None).otherwise(F.col("value")))
    return over_tables(spark, sf_dir)("events").select("event_id", stored.alias("s")).select("event_id", codecs.missing_decode(F.col("s")).alias("value"))


@_query(
    "dict_pairs",
    """SELECT o_orderkey, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""",
)
def dict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary per order, stored as pairs, read back as a map, listed as rows."""
    made = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    stored = over_tables(spark, sf_dir)("orders").select("o_orderkey", codecs.dict_to_pairs(made).alias("pairs"))
    return stored.select("o_orderkey", codecs.pairs_to_dict(F.col("pairs")).alias("m")).select("o_orderkey", F.explode("m").alias("key", "value"))


@_query("ragged_pack", "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey")
def ragged_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each order as one array of any length."""
    return refs.ragged_pack(over_tables(spark, sf_dir)("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_quantity", "quantities")


@_query(
    "ragged_unpack",
    """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS idx, l_quantity AS quantity FROM lineitem""",
)
def ragged_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed arrays as rows again."""
    return refs.ragged_unpack(ragged_pack(spark, sf_dir), ["l_orderkey"], "quantities", "quantity")


@_query("ref_resolve", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name AS part_name, p.p_size AS part_size FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey")
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to parts resolved to their fields."""
    read = over_tables(spark, sf_dir)
    found = refs.resolve(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", read("part"), "p_partkey", ["p_name", "p_size"], "part")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.col("part.p_name").alias("part_name"), F.col("part.p_size").alias("part_size"))


@_query("ref_dedup", "SELECT d.doc_id, o.ref, length(d.text) AS n FROM documents d JOIN (SELECT text, min(doc_id) AS ref FROM documents GROUP BY text) o ON d.text = o.text")
def ref_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts stored once: every document refers to the smallest id that holds its text."""
    docs = over_tables(spark, sf_dir)("documents").select("doc_id", "text")
    objects, references = refs.dedup(docs, ["text"], "doc_id")
    lengths = objects.select(F.col("ref").alias("key"), F.length("text").cast("long").alias("n"))
    return references.join(lengths, references["ref"] == lengths["key"]).select("doc_id", "ref", "n")


@_query("ref_edges", "SELECT l_orderkey AS src, 'l_partkey' AS field, l_partkey AS dst FROM lineitem UNION ALL SELECT l_orderkey, 'l_suppkey', l_suppkey FROM lineitem")
def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of references as rows."""
    return refs.edges(over_tables(spark, sf_dir)("lineitem"), "l_orderkey", ["l_partkey", "l_suppkey"])


def _upgraded(lines: DataFrame) -> DataFrame:
    """Stored (x int, y double) as the new (x double, y double, z = x * y)."""
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("x").cast("double").alias("x"), "y").withColumn("z", F.col("x") * F.col("y"))


@_query("upgrade_struct", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y, l_linenumber * l_quantity AS z FROM lineitem")
def upgrade_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records upgraded at read time."""
    stored = over_tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"))
    return evolve.evolve(stored, evolve.Upgrade(_upgraded), {})[0]


@_query("convert_field", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def convert_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer field read as a double, by name."""
    want = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.DoubleType())])
    return evolve.match_fields(over_tables(spark, sf_dir)("part").select("p_partkey", "p_size"), want, "part")


@_query(
    "typemap_rename",
    "SELECT c_custkey AS id, c_acctbal AS balance FROM customer",
)
def typemap_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type map, given as a function, that sends stored customers to a new type."""
    target = evolve.Upgrade(lambda df: df.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))
    _, found = evolve.resolve(lambda name, path, params: target if name == "Customer" else None, "Customer", "customer")
    return evolve.evolve(over_tables(spark, sf_dir)("customer"), found, {}, "customer")[0]


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@_query(
    "codec_base62",
    "SELECT o_orderkey, concat(" + ", ".join(f"substr('{_DIGITS}', CAST((o_orderkey * 1000003 // {62**k}) % 62 AS INTEGER) + 1, 1)" for k in range(10, -1, -1)) + ") AS code, o_orderkey * 1000003 AS back FROM orders",
)
def codec_base62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large integers as base-62 text of eleven digits and back, by column expressions."""
    coded = over_tables(spark, sf_dir)("orders").select("o_orderkey", codecs.base62_encode(F.col("o_orderkey") * 1_000_003).alias("code"))
    return coded.withColumn("back", codecs.base62_decode(F.col("code")))


@_query("append_union", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def append_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets appended by field name."""
    read = over_tables(spark, sf_dir)
    customers = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = read("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return refs.append(customers, suppliers)


@_query("delete_keys", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A committed group deleted with all below it; the store opened again no longer names it."""
    path = world(spark, sf_dir)
    with Store.open(spark, path, "r+") as store:
        store.group("world").delete("ASIA")
    with Store.open(spark, path, "r+") as store:
        store.vacuum()
        return refs.append(*(df.select("n_nationkey", "n_name") for df in store.load_all().values()))


@_query("attrs_rows", "SELECT r_name AS name, 'regionkey' AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT r_name, 'label', lower(r_name) FROM region")
def attrs_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of groups, listed and read back."""
    with Store.open(spark, world(spark, sf_dir), "r", parallel_read=True) as store:
        top = store.group("world")
        rows = [(name, key, str(value)) for name in top for key, value in top.attributes(name).items()]
    return spark.createDataFrame(rows, "name string, key string, value string")


def _roundtrip(option: object) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The events, all columns, written to a store through a filter and read back; the files must name its codec."""
        path = scratch(spark, "codec")
        with Store.open(spark, path, "w") as store:
            store.write("events", over_tables(spark, sf_dir)("events"), compress=option)
            store.dataset("events").check_codec()
        return load(spark, path, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))

    return query


for _name in ("none", "gzip", "zstd", "lz4_raw"):
    _query(f"compress_roundtrip_{_name}", "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events")(_roundtrip(_name))


@_query(
    "shuffle_bytes",
    """SELECT p_partkey, concat(array_to_string([h[4 * k + 1:4 * k + 2] FOR k IN range(n // 2)], ''), array_to_string([h[4 * k + 3:4 * k + 4] FOR k IN range(n // 2)], ''), h[4 * (n // 2) + 1:]) AS shuffled, h AS back
       FROM (SELECT p_partkey, hex(p_name) AS h, strlen(p_name) AS n FROM part)""",
)
def shuffle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte shuffle of whole names for elements of two bytes and its inverse, by built-in functions."""
    from tessera.functions.filters import shuffle_hex

    moved = over_tables(spark, sf_dir)("part").select("p_partkey", shuffle_hex(F.encode("p_name", "utf-8"), 2).alias("s"))
    return moved.select("p_partkey", F.hex("s").alias("shuffled"), F.hex(shuffle_hex(F.col("s"), 2, backward=True)).alias("back"))


@_query("linear_element", "SELECT vec_id, embedding[10] AS value FROM embeddings")
def linear_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element of every array by its place."""
    return over_tables(spark, sf_dir)("embeddings").select("vec_id", arrays.element_column(F.col("embedding"), 9).alias("value"))


@_query("tuple_fields", "SELECT s_suppkey AS _1, s_name AS _2, s_acctbal AS _3 FROM supplier")
def tuple_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples stored as structs with numbered fields, and their fields."""
    stored = over_tables(spark, sf_dir)("supplier").select(codecs.tuple_struct(F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal")).alias("t"))
    return stored.select("t.*")


@_query("defined_elements", "SELECT event_id, value FROM events WHERE CASE WHEN event_type = 'click' THEN NULL ELSE value END IS NOT NULL")
def defined_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that are defined; undefined ones are skipped."""
    stored = over_tables(spark, sf_dir)("events").select("event_id", codecs.missing_encode(F.when(F.col("event_type") != "click", F.col("value"))).alias("s"))
    return stored.where(codecs.is_defined(F.col("s"))).select("event_id", codecs.missing_decode(F.col("s")).alias("value"))


@_query(
    "open_modes",
    """SELECT * FROM (VALUES ('r', 'missing', 'FileNotFoundError'), ('r+', 'missing', 'FileNotFoundError'), ('a', 'missing', '0'), ('w', 'missing', '0'), ('r', 'there', '1'), ('r+', 'there', '1'), ('a+', 'there', '1'), ('w+', 'there', '0'),
       ('r', 'write', 'StoreError'), ('r+', 'twice', 'same'), ('w', 'twice', 'StoreError'), ('r', 'parallel', 'own'), ('x', 'there', 'StoreError')) AS t(mode, state, found)""",
)
def open_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode does to a store that is missing, there, or open already: the number of names, or the error."""
    region = over_tables(spark, sf_dir)("region")

    def attempt(mode: str, there: bool) -> str:
        path = scratch(spark, "modes")
        if there:
            save(spark, path, region=region)
        try:
            with Store.open(spark, path, mode) as store:
                return str(len(store))
        except (FileNotFoundError, ValueError) as error:
            return type(error).__name__

    def raised(action: Callable[[], object]) -> str:
        try:
            action()
        except ValueError as error:
            return type(error).__name__
        return "none"

    rows = [(m, "missing", attempt(m, False)) for m in ("r", "r+", "a", "w")] + [(m, "there", attempt(m, True)) for m in ("r", "r+", "a+", "w+", "x")]
    path = scratch(spark, "modes")
    save(spark, path, region=region)
    with Store.open(spark, path, "r") as store:
        rows.append(("r", "write", raised(lambda: store.write("more", region))))
        with Store.open(spark, path, "r", parallel_read=True) as other:
            rows.append(("r", "parallel", "own" if other is not store else "same"))
    with Store.open(spark, path, "r+") as store:
        with Store.open(spark, path, "r+") as again:
            rows.append(("r+", "twice", "same" if again is store else "own"))
        rows.append(("w", "twice", raised(lambda: Store.open(spark, path, "w"))))
    return spark.createDataFrame(rows, "mode string, state string, found string")


@_query(
    "stored_types",
    "SELECT 'Line' AS type, 'l_orderkey' AS field, 'bigint' AS kind UNION ALL SELECT 'Line', 'l_quantity', 'double' UNION ALL SELECT 'reconstructed', 'lines', 'true' UNION ALL SELECT 'plain', 'lines', 'double'",
)
def stored_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type committed with a dataset, and a map that names a type which cannot be made of the stored records."""
    path = scratch(spark, "types")
    with Store.open(spark, path, "w") as store:
        store.write("lines", over_tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_quantity"), type_name="Line")
    target = T.StructType([T.StructField("nothing", T.LongType())])
    with Store.open(spark, path, "r", typemap={"Line": target}, parallel_read=True) as store:
        rows = [("Line", f.name, f.dataType.simpleString()) for f in store.committed_types()["Line"].fields]
        rows.append(("reconstructed", "lines", str(store.reconstructed("lines")).lower()))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            rows.append(("plain", "lines", store["lines"].schema["l_quantity"].dataType.simpleString()))
    return spark.createDataFrame(rows, "type string, field string, kind string")


@_query(
    "store_roundtrip",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables saved to a store in nested groups, loaded from it, and joined by their reference."""
    read, path = over_tables(spark, sf_dir), scratch(spark, "store")
    with Store.open(spark, path, "w", compress="zstd") as store:
        store.write("people/customer", read("customer"), type_name="Customer")
        store.write("places/nation", read("nation"))
    with Store.open(spark, path, "r", parallel_read=True) as store:
        customers, nations = store.load("people/customer", "places/nation")
    return refs.resolve(customers, "c_nationkey", nations, "n_nationkey", ["n_name"], "nation").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", F.col("nation.n_name").alias("n_name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lines upgraded at read time, with the part that each refers to."""
    read = over_tables(spark, sf_dir)
    return refs.resolve(upgrade_struct(spark, sf_dir), "l_partkey", read("part"), "p_partkey", ["p_name", "p_brand", "p_size"], "part")
