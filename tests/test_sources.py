import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.filters import Shuffle, lookup3
from tessera.plans.store import load
from tessera.sources.hdf5 import FormatError, H5File, load_h5, read_h5, scan_h5
from tessera.streaming.ingest import append_rows, read_rows, write_stream


def message(kind, body, flags=0):
    return struct.pack("<BHB", kind, len(body), flags) + body


def header(*messages):
    body = b"".join(messages)
    return b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + bytes(4)


def space(*dims):
    return message(1, bytes([2, len(dims), 0, 1 if dims else 0]) + b"".join(struct.pack("<Q", d) for d in dims))


INT = bytes([0x10, 8, 0, 0]) + struct.pack("<IHH", 8, 0, 64)
DOUBLE = bytes([0x11, 0x20, 63, 0]) + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023)
TEXT = bytes([0x19, 1, 0, 0]) + struct.pack("<I", 16) + bytes([0x10, 0, 0, 0]) + struct.pack("<IHH", 1, 0, 8)
FIXED = bytes([0x13, 2, 0, 0]) + struct.pack("<I", 4)
REFERENCE = bytes([0x17, 0, 0, 0]) + struct.pack("<I", 8)
PAIR = bytes([0x36, 2, 0, 0]) + struct.pack("<I", 16) + b"x\0" + bytes([0]) + INT + b"y\0" + bytes([8]) + DOUBLE


def link(name, address):
    return message(6, bytes([1, 0, len(name)]) + name.encode() + struct.pack("<Q", address))


class Builder:
    """Writes small files by hand, as no HDF5 library is here."""

    def __init__(self, offset=0):
        self.offset, self.out, self.links = offset, bytearray(48), []

    def add(self, raw):
        at = len(self.out)
        self.out += raw
        return at

    def dataset(self, name, kind, dims, data, *more, compact=False):
        where = bytes([3, 0]) + struct.pack("<H", len(data)) + data if compact else bytes([3, 1]) + struct.pack("<QQ", self.add(data), len(data))
        at = self.add(header(space(*dims), message(3, kind), message(8, where), *more))
        self.links.append(link(name, at))
        return at

    def done(self):
        root = self.add(header(*self.links))
        top = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", self.offset, (1 << 64) - 1, len(self.out), root)
        self.out[:48] = top + struct.pack("<I", lookup3(top))
        return bytes(self.offset) + bytes(self.out)


def sample(offset=0):
    b = Builder(offset)
    ints = b.dataset("ints", INT, (2, 3), np.arange(6, dtype="<i8").tobytes(), message(0x0C, bytes([3, 0]) + struct.pack("<HHHB", 5, len(INT), 4, 0) + b"unit\0" + INT + bytes([2, 0, 0, 0]) + struct.pack("<q", 7)))
    b.dataset("one", DOUBLE, (), struct.pack("<d", 2.5), compact=True)
    b.dataset("pairs", PAIR, (2,), struct.pack("<qdqd", 1, 0.5, 2, 1.5))
    b.dataset("fixed", FIXED, (2,), b"ab  cd e")
    words = [b"hello", "é".encode()]
    heap = b"".join(struct.pack("<HHIQ", k + 1, 1, 0, len(w)) + w + bytes(-len(w) % 8) for k, w in enumerate(words)) + bytes(16)
    at = b.add(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", 16 + len(heap)) + heap)
    b.dataset("words", TEXT, (3,), b"".join(struct.pack("<IQI", len(w), at, k + 1) for k, w in enumerate(words)) + bytes(16))
    b.dataset("refs", REFERENCE, (2,), struct.pack("<QQ", ints, 0))
    raw = np.arange(10, dtype="<i8")
    chunks = [zlib.compress(Shuffle(8).forward(np.pad(raw[k : k + 4], (0, 4 - len(raw[k : k + 4]))).tobytes())) for k in (0, 4, 8)]
    keys = [(struct.pack("<IIQQ", len(c), 0, 4 * k, 0), b.add(c)) for k, c in enumerate(chunks)]
    tree = b.add(b"TREE" + bytes([1, 0]) + struct.pack("<HQQ", 3, *[(1 << 64) - 1] * 2) + b"".join(k + struct.pack("<Q", a) for k, a in keys) + bytes(24))
    pipeline = message(0x0B, bytes([2, 2]) + struct.pack("<HHHI", 2, 0, 1, 8) + struct.pack("<HHHI", 1, 0, 1, 5))
    at = b.add(header(space(10), message(3, INT), pipeline, message(8, bytes([3, 2, 2]) + struct.pack("<QII", tree, 4, 8))))
    b.links.append(link("chunked", at))
    inner = b.add(header(link("again", ints)))
    b.links.append(link("group", inner))
    at = b.add(header(space(3), message(3, INT), message(8, bytes([3, 1]) + struct.pack("<QQ", (1 << 64) - 1, 24))))
    b.links.append(link("blank", at))
    return b.done()


@pytest.mark.parametrize("offset", [0, 512, 2048])
def test_h5_values(offset):
    h = H5File(sample(offset))
    assert h.read("ints").tolist() == [[0, 1, 2], [3, 4, 5]] and h.find("ints").attributes == {"unit": 7}
    assert h.read("one") == 2.5 and h.read("pairs") == [{"x": 1, "y": 0.5}, {"x": 2, "y": 1.5}]
    assert h.read("fixed") == ["ab", "cd e"] and h.read("words") == ["hello", "é", ""]
    assert h.read("chunked").tolist() == list(range(10)) and h.read("blank").tolist() == [0, 0, 0]
    first, second = h.resolve(h.read("refs"))
    assert first.tolist() == h.read("ints").tolist() and second is None
    assert h.read("group/again").tolist() == h.read("ints").tolist()
    with pytest.raises(KeyError):
        h.read("nope")


def dense_group(b, links):
    """A dense group: a heap of 64-byte blocks, two a row, direct up to 128 bytes; its index has nodes of 128 bytes."""
    blank, heap_at = (1 << 64) - 1, 0
    free, ids = list(links), []

    def direct(begin, size):
        body = bytearray(b"FHDB" + bytes(13))
        while free and len(body) + len(free[0]) <= size:
            ids.append(struct.pack("<IH", begin + len(body), len(free[0])))
            body += free.pop(0)
        return b.add(bytes(body) + bytes(size - len(body)))

    def indirect(begin, rows):
        at, addresses = begin, []
        for row in range(rows):
            size = 64 if row < 2 else 64 << (row - 1)
            for _ in range(2):
                addresses.append(blank if not free else direct(at, size) if size <= 128 else indirect(at, {256: 2, 512: 3, 1024: 4}[size]))
                at += size
        return b.add(b"FHIB" + bytes(1) + struct.pack("<QI", heap_at, begin) + b"".join(struct.pack("<Q", a) for a in addresses) + bytes(4))

    root = indirect(0, 6)
    assert not free
    heap = b.add(b"FRHP" + bytes(106) + struct.pack("<HQQHHQH", 2, 64, 128, 32, 1, root, 6) + bytes(4))
    records = [bytes(4) + b"\0" + i for i in ids]

    def node(own, level):
        """(address, records in the node, records below and in it)"""
        if not level:
            return b.add(b"BTLF" + bytes([0, 5]) + b"".join(own) + bytes(4)), len(own), len(own)
        children, kept, share = [], [], -(-len(own) // 4)
        for at in range(0, len(own), share):
            last = at + share >= len(own)
            children.append(node(own[at : at + share - (not last)], level - 1))
            kept += [] if last else [own[at + share - 1]]
        pointers = b"".join(struct.pack("<QB", a, n) + (total.to_bytes(1, "little") if level > 1 else b"") for a, n, total in children)
        return b.add(b"BTIN" + bytes([0, 5]) + b"".join(kept) + pointers + bytes(4)), len(kept), len(own)

    top, count, total = node(records, 2)
    index = b.add(b"BTHD" + bytes([0, 5]) + struct.pack("<IHHBBQHQ", 128, 11, 2, 100, 40, top, count, total) + bytes(4))
    return b.add(header(message(2, bytes([0, 0]) + struct.pack("<QQ", heap, index))))


@pytest.mark.parametrize("offset", [0, 512])
def test_h5_dense_groups_deeper_than_their_direct_blocks(offset):
    b = Builder(offset)
    one = b.dataset("one", INT, (), struct.pack("<q", 5))
    names = [f"n{k:03d}" for k in range(140)]
    b.links.append(link("dense", dense_group(b, [bytes([1, 0, len(n)]) + n.encode() + struct.pack("<Q", one) for n in names])))
    h = H5File(b.done())
    assert sorted(n for n, _ in h.names() if n.startswith("dense/")) == [f"dense/{n}" for n in names]
    assert h.read("dense/n000") == 5 and h.read("dense/n139") == 5


def old_header(*messages):
    body = b"".join(struct.pack("<HHB3x", kind, len(raw), 0) + raw for kind, raw in messages)
    return struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body


@pytest.mark.parametrize("version", [0, 1])
def test_h5_old_superblocks_and_symbol_tables(version):
    blank, names = (1 << 64) - 1, [f"d{k}" for k in range(6)]
    out = bytearray(24 + 4 * version + 32 + 40)
    out += bytes(-len(out) % 8)

    def add(raw):
        at = len(out)
        out.extend(raw + bytes(-len(raw) % 8))
        return at

    old_space = lambda *dims: struct.pack("<BBB5x", 1, len(dims), 0) + b"".join(struct.pack("<Q", d) for d in dims)
    targets = [add(old_header((1, old_space(2)), (3, INT + bytes(4)), (8, bytes([3, 1]) + struct.pack("<QQ", add(struct.pack("<qq", k, -k)), 16) + bytes(6)))) for k in range(6)]
    text = b"\0" * 8 + b"".join(n.encode().ljust(8, b"\0") for n in names)
    heap = add(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(text), blank, add(text)))
    entry = lambda k: struct.pack("<QQII16x", 8 + 8 * k, targets[k], 0, 0)
    leaves = [add(b"SNOD" + struct.pack("<BBH", 1, 0, 2) + entry(k) + entry(k + 1)) for k in (0, 2, 4)]
    node = lambda level, children: add(b"TREE" + struct.pack("<BBHQQ", 0, level, len(children), blank, blank) + bytes(8) + b"".join(struct.pack("<QQ", c, 0) for c in children))
    tree = node(1, [node(0, leaves[:2]), node(0, leaves[2:])])
    root = add(old_header((0x11, struct.pack("<QQ", tree, heap))))
    top = b"\x89HDF\r\n\x1a\n" + bytes([version, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + (struct.pack("<HH", 32, 0) if version else b"")
    top += struct.pack("<QQQQ", 0, blank, len(out), blank) + struct.pack("<QQII16x", 0, root, 0, 0)
    out[: len(top)] = top
    h = H5File(bytes(out))
    assert [n for n, _ in h.names()] == names
    assert all(h.read(n).tolist() == [k, -k] for k, n in enumerate(names))


def test_h5_damage():
    raw = sample()
    with pytest.raises(EOFError):
        H5File(b"")
    for bad in (b"no such file", raw[:30] + bytes([raw[30] ^ 1]) + raw[31:], raw[:8] + b"\x09" + raw[9:], raw[:9] + b"\x04" + raw[10:]):
        with pytest.raises(FormatError):
            H5File(bad)
    with pytest.raises(FormatError):
        H5File(raw[:200]).read("ints")


def test_h5_frames(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.h5").write_bytes(sample())
    found = {(r["path"], r["kind"]): r for r in scan_h5(spark, f"{tmp_path}/*.h5").where(F.col("file").endswith("0.h5")).collect()}
    assert found[("ints", "dataset")]["dims"] == [2, 3] and found[("ints", "dataset")]["attrs"] == '{"unit": 7}'
    assert ("group", "group") in found and found[("pairs", "dataset")]["type"] == "compound{x: int64, y: float64}"
    loaded = load_h5(spark, f"{tmp_path}/*.h5", "pairs")
    assert loaded.count() == 4 and loaded.select(F.get_json_object("value", "$.y").cast("double").alias("y")).agg(F.sum("y")).first()[0] == 4.0


def test_h5_typed_frames(spark, tmp_path):
    (tmp_path / "0.h5").write_bytes(sample())
    (tmp_path / "1.h5").write_bytes(sample(512))
    read = lambda name: read_h5(spark, f"{tmp_path}/*.h5", name)
    values = lambda name: [r["value"] for r in read(name).where(F.col("file").endswith("1.h5")).orderBy("idx").collect()]
    assert read("pairs").schema["value"].dataType.simpleString() == "struct<x:bigint,y:double>" and read("pairs").agg(F.sum("value.y")).first()[0] == 4.0
    assert values("ints") == list(range(6)) and values("chunked") == list(range(10)) and values("one") == [2.5]
    assert values("words") == ["hello", "é", ""] and values("fixed") == ["ab", "cd e"] and values("pairs")[1] == (2, 1.5)
    first, second = values("refs")
    assert first > 0 and second is None
    b = Builder()
    b.dataset("ints", DOUBLE, (1,), struct.pack("<d", 1))
    unsigned = bytes([0x10, 0, 0, 0]) + struct.pack("<IHH", 8, 0, 64)
    b.dataset("big", unsigned, (2,), struct.pack("<QQ", 0, (1 << 64) - 1))
    b.dataset("none", INT, (0,), b"", compact=True)
    (tmp_path / "2.other").write_bytes(b.done())
    assert [int(r["value"]) for r in read_h5(spark, f"{tmp_path}/*.other", "big").orderBy("idx").collect()] == [0, (1 << 64) - 1]
    assert read_h5(spark, f"{tmp_path}/*.other", "none").count() == 0
    with pytest.raises(Exception, match="another type"):
        read_h5(spark, f"{tmp_path}/*", "ints").collect()


def test_streams(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.range(10).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source).withColumn("twice", F.col("id") * 2)
    write_stream(stream(), store, "events", str(tmp_path / "ck")).awaitTermination()
    spark.range(10, 15).write.mode("append").parquet(source)
    write_stream(stream(), store, "events", str(tmp_path / "ck")).awaitTermination()
    append_rows(spark, store, "events", spark.range(1), 0)  # replayed: already there
    rows = read_rows(spark, store, "events")
    assert rows.count() == 15 and rows.agg(F.sum("twice")).first()[0] == 210
    assert set(load(spark, store)) == {"events/batch-000000000", "events/batch-000000001"}
