"""Read-only scans of foreign HDF5 files: groups, datasets and attributes as frames.

The decoder follows the public HDF5 file format specification: superblocks 0, 2 and 3 at any of the usual offsets, both kinds
of object headers with continuation blocks, link messages, old symbol tables, dense groups, compact, contiguous and
chunked layouts (version-1 B-trees and single chunks), filters, committed datatypes, global heaps and references.
Files come through Spark's ``binaryFile`` source, so they may lie in any store, and one file is decoded by one task.
Names of types in a file are never evaluated.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.filters import KNOWN, Shuffle, lookup3

MAGIC = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
ROWS = 1 << 16
OFFSETS = (0, 512, 1024, 2048, 4096)


class FormatError(ValueError):
    pass


@dataclass
class Kind:
    """A datatype: class number, size in bytes, and what the class needs besides."""

    cls: int
    size: int
    dtype: np.dtype | None = None
    fields: list[tuple[str, int, Kind]] = field(default_factory=list)
    base: Kind | None = None
    dims: tuple[int, ...] = ()
    names: dict[str, int] = field(default_factory=dict)
    text: bool = False
    padding: int = 0

    def describe(self) -> str:
        if self.cls == 6:
            return "compound{" + ", ".join(f"{n}: {k.describe()}" for n, _, k in self.fields) + "}"
        if self.cls == 9:
            return "string" if self.text else f"vlen<{self.base.describe()}>"
        if self.cls == 10:
            return f"{self.base.describe()}{list(self.dims)}"
        if self.cls == 8:
            return f"enum<{self.base.describe()}>"
        if self.cls == 3:
            return f"string[{self.size}]"
        if self.cls == 7:
            return "reference"
        return str(self.dtype) if self.dtype is not None else f"opaque[{self.size}]"


@dataclass
class Node:
    """What an object header says."""

    address: int
    dims: tuple[int, ...] | None = None
    null: bool = False
    kind: Kind | None = None
    layout: tuple | None = None
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    attributes: dict[str, Any] = field(default_factory=dict)
    links: dict[str, int] = field(default_factory=dict)
    is_group: bool = False


class H5File:
    """A file held in memory; ``names`` lists its objects, ``read`` decodes one."""

    def __init__(self, data: bytes):
        self.data = data
        self._nodes: dict[int, Node] = {}
        self._heaps: dict[int, dict[int, bytes]] = {}
        if not data:
            raise EOFError("the file is empty")
        for at in OFFSETS:
            if data[at : at + 8] == MAGIC:
                break
        else:
            raise FormatError("no HDF5 superblock")
        version = data[at + 8]
        if version in (0, 1):
            if data[at + 13] != 8 or data[at + 14] != 8:
                raise FormatError("only 8-byte offsets and lengths are known")
            base = at + 24 + (4 if version == 1 else 0)
            self.base = self._u(base, 8)
            self.root = self._u(base + 40, 8)
        elif version in (2, 3):
            if data[at + 9] != 8 or data[at + 10] != 8:
                raise FormatError("only 8-byte offsets and lengths are known")
            self.base, self.root = self._u(at + 12, 8), self._u(at + 36, 8)
            if lookup3(data[at : at + 44]) != self._u(at + 44, 4):
                raise FormatError("the superblock's checksum is wrong")
        else:
            raise FormatError(f"superblock version {version} is not known")

    def _u(self, at: int, n: int) -> int:
        if at + n > len(self.data):
            raise FormatError("the file is cut off")
        return int.from_bytes(self.data[at : at + n], "little")

    # object headers

    def node(self, address: int) -> Node:
        if address not in self._nodes:
            found = Node(address)
            self._nodes[address] = found
            for kind, flags, body in self._messages(address + self.base):
                self._message(found, kind, flags, body)
        return self._nodes[address]

    def _messages(self, at: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
        d = self.data
        if at + 16 > len(d):
            raise FormatError("the file is cut off")
        if d[at : at + 4] == b"OHDR":
            flags, p = d[at + 5], at + 6
            p += 16 if flags & 0x20 else 0
            p += 4 if flags & 0x10 else 0
            width = 1 << (flags & 3)
            size = self._u(p, width)
            blocks = [(p + width, size)]
            order = 2 if flags & 4 else 0
            while blocks:
                p, size = blocks.pop(0)
                end = p + size
                while p + 4 + order <= end:
                    kind, length, message_flags = d[p], self._u(p + 1, 2), d[p + 3]
                    p += 4 + order
                    if kind == 0x10:
                        blocks.append((self._u(p, 8) + self.base + 4, self._u(p + 8, 8) - 8))
                    else:
                        yield kind, message_flags, (p, length)
                    p += length
            return
        if d[at] != 1:
            raise FormatError(f"object header version {d[at]} is not known")
        left, blocks = self._u(at + 2, 2), [(at + 16, self._u(at + 8, 4))]
        while blocks and left:
            p, size = blocks.pop(0)
            end = p + size
            while p + 8 <= end and left:
                kind, length, message_flags = self._u(p, 2), self._u(p + 2, 2), d[p + 4]
                p += 8
                left -= 1
                if kind == 0x10:
                    blocks.append((self._u(p, 8) + self.base, self._u(p + 8, 8)))
                else:
                    yield kind, message_flags, (p, length)
                p += length

    def _message(self, node: Node, kind: int, flags: int, body: tuple[int, int]) -> None:
        p, n = body
        if kind == 0x01:
            node.dims, node.null = self._space(p)
        elif kind == 0x03:
            node.kind = self._shared_kind(p) if flags & 2 else self._kind(p)[0]
        elif kind == 0x06:
            name, target = self._link(p)
            node.is_group = True
            if target is not None:
                node.links[name] = target
        elif kind == 0x02:
            node.is_group = True
            q = p + 2 + (8 if self.data[p + 1] & 1 else 0)
            heap, index = self._u(q, 8), self._u(q + 8, 8)
            if heap != UNDEFINED:
                for raw in self._dense(heap, index):
                    name, target = self._link_bytes(raw)
                    if target is not None:
                        node.links[name] = target
        elif kind == 0x0A:
            node.is_group = True
        elif kind == 0x11:
            node.is_group = True
            node.links |= self._symbols(self._u(p, 8), self._u(p + 8, 8))
        elif kind == 0x08:
            node.layout = self._layout(p)
        elif kind == 0x0B:
            node.filters = self._filters(p)
        elif kind == 0x0C:
            name, value = self._attribute(p, n)
            node.attributes[name] = value

    # message bodies

    def _space(self, p: int) -> tuple[tuple[int, ...] | None, bool]:
        version, rank = self.data[p], self.data[p + 1]
        if version == 2:
            kind, q = self.data[p + 3], p + 4
        else:
            kind, q = 1 if rank else 0, p + 8
        if kind == 2:
            return None, True
        return tuple(self._u(q + 8 * k, 8) for k in range(rank)), False

    def _shared_kind(self, p: int) -> Kind:
        version = self.data[p]
        target = self._u(p + (2 if version >= 2 else 8), 8)
        found = self.node(target).kind
        if found is None:
            raise FormatError("a committed datatype is missing")
        return found

    def _kind(self, p: int) -> tuple[Kind, int]:
        d = self.data
        version, cls, bits, size = d[p] >> 4, d[p] & 15, d[p + 1 : p + 4], self._u(p + 4, 4)
        q = p + 8
        order = ">" if bits[0] & 1 else "<"
        if cls == 0:
            known = size in (1, 2, 4, 8)
            return Kind(cls, size, np.dtype(f"{order}{'i' if bits[0] & 8 else 'u'}{size}") if known else None), q + 4
        if cls == 1:
            return Kind(cls, size, np.dtype(f"{order}f{size}")), q + 12
        if cls == 2:
            raise FormatError("time datatypes are not supported")
        if cls == 3:
            return Kind(cls, size, text=True, padding=bits[0] & 15), q
        if cls == 4:
            return Kind(cls, size, np.dtype(f"{order}u{size}") if size in (1, 2, 4, 8) else None), q + 4
        if cls == 5:
            tag = bits[0]
            return Kind(cls, size), q + (tag + 7) // 8 * 8
        if cls == 6:
            members = []
            for _ in range(bits[0] | bits[1] << 8):
                end = d.index(b"\0", q)
                name = d[q:end].decode()
                q = end + 1 if version == 3 else q + (end - q + 8) // 8 * 8
                if version == 3:
                    width = max(1, (size.bit_length() + 7) // 8)
                    offset, q = self._u(q, width), q + width
                else:
                    offset, q = self._u(q, 4), q + 4
                dims: tuple[int, ...] = ()
                if version == 1:
                    dims = tuple(self._u(q + 12 + 4 * k, 4) for k in range(d[q]))
                    q += 28
                member, q = self._kind(q)
                if dims:
                    member = Kind(10, member.size * int(np.prod(dims)), base=member, dims=dims)
                members.append((name, offset, member))
            return Kind(cls, size, fields=members), q
        if cls == 7:
            return Kind(cls, size), q
        if cls == 8:
            base, q = self._kind(q)
            count, names = bits[0] | bits[1] << 8, []
            for _ in range(count):
                end = d.index(b"\0", q)
                names.append(d[q:end].decode())
                q = end + 1 if version == 3 else q + (end - q + 8) // 8 * 8
            values = np.frombuffer(d, base.dtype, count, q).tolist()
            return Kind(cls, size, base.dtype, base=base, names=dict(zip(names, values, strict=True))), q + base.size * count
        if cls == 9:
            base, q = self._kind(q)
            return Kind(cls, size, base=base, text=bool(bits[0] & 15)), q
        if cls == 10:
            rank = d[q]
            q += 1 if version == 3 else 4
            dims = tuple(self._u(q + 4 * k, 4) for k in range(rank))
            q += 4 * rank * (1 if version == 3 else 2)
            base, q = self._kind(q)
            return Kind(cls, size, base=base, dims=dims), q
        raise FormatError(f"datatype class {cls} is not known")

    def _link(self, p: int) -> tuple[str, int | None]:
        return self._link_bytes(self.data[p:])

    def _link_bytes(self, raw: bytes) -> tuple[str, int | None]:
        """(name, address); soft and external links have no address."""
        flags, p = raw[1], 2
        kind = 0
        if flags & 8:
            kind, p = raw[p], p + 1
        p += 8 if flags & 4 else 0
        p += 1 if flags & 16 else 0
        width = 1 << (flags & 3)
        length = int.from_bytes(raw[p : p + width], "little")
        p += width
        name = raw[p : p + length].decode()
        return name, int.from_bytes(raw[p + length : p + length + 8], "little") if kind == 0 else None

    def _symbols(self, tree: int, heap: int) -> dict[str, int]:
        names = self._u(heap + self.base + 24, 8) + self.base
        out: dict[str, int] = {}
        for leaf in self._tree_children(tree, 8):
            p = leaf + self.base
            for k in range(self._u(p + 6, 2)):
                entry = p + 8 + 40 * k
                at = names + self._u(entry, 8)
                out[self.data[at : self.data.index(b"\0", at)].decode()] = self._u(entry + 8, 8)
        return out

    def _tree_children(self, address: int, key: int) -> Iterator[int]:
        """Leaves of a version-1 B-tree of groups."""
        p = address + self.base
        level, used = self.data[p + 5], self._u(p + 6, 2)
        for k in range(used):
            child = self._u(p + 24 + key + k * (key + 8), 8)
            if level:
                yield from self._tree_children(child, key)
            else:
                yield child

    def _dense(self, heap: int, index: int) -> Iterator[bytes]:
        """Link messages of a dense group: version-2 B-tree records that point into a fractal heap."""
        p, h = index + self.base, heap + self.base
        if self.data[p : p + 4] != b"BTHD" or self.data[h : h + 4] != b"FRHP":
            raise FormatError("a dense group is damaged")
        node_size, record, depth = self._u(p + 6, 4), self._u(p + 10, 2), self._u(p + 12, 2)
        root, in_root = self._u(p + 16, 8), self._u(p + 24, 2)
        offset_bytes = (self._u(h + 128, 2) + 7) // 8
        id_start = {5: 4, 6: 8}[self.data[p + 5]]
        most, totals = [(node_size - 10) // record], [0]  # records of a node and bytes of a subtree's record count, by level
        width, below = max(1, (most[0].bit_length() + 7) // 8), most[0]
        for _ in range(depth):
            most.append((node_size - 10 - 8 - width - totals[-1]) // (record + 8 + width + totals[-1]))
            below = (most[-1] + 1) * below + most[-1]
            totals.append((below.bit_length() + 7) // 8)

        def walk(address: int, count: int, level: int) -> Iterator[bytes]:
            q = address + self.base + 6
            for k in range(count):
                at = q + k * record + id_start
                yield self.data[at : at + record - id_start]
            if level:
                child, total_width = q + count * record, totals[level - 1]
                for k in range(count + 1):
                    at = child + k * (8 + width + total_width)
                    yield from walk(self._u(at, 8), self._u(at + 8, width), level - 1)

        if root != UNDEFINED and in_root:
            for heap_id in walk(root, in_root, depth):
                if heap_id[0] & 0x30:
                    raise FormatError("only managed heap objects are known")
                offset = int.from_bytes(heap_id[1 : 1 + offset_bytes], "little")
                length = int.from_bytes(heap_id[1 + offset_bytes :], "little")
                yield self._heap_object(h, offset, length)

    def _heap_object(self, h: int, offset: int, length: int) -> bytes:
        width, start, largest = self._u(h + 110, 2), self._u(h + 112, 8), self._u(h + 120, 8)
        root, rows = self._u(h + 132, 8), self._u(h + 140, 2)
        if not rows:
            at = root + self.base + offset
            return self.data[at : at + length]
        offset_bytes = (self._u(h + 128, 2) + 7) // 8
        block, begin = root, 0
        while block != UNDEFINED:  # down the indirect blocks
            p = block + self.base
            if self.data[p : p + 4] != b"FHIB":
                raise FormatError("a dense group is damaged")
            p += 5 + 8 + offset_bytes
            for row in range(rows):
                size = start * (1 if row < 2 else 1 << (row - 1))
                if offset < begin + width * size:
                    break
                begin, p = begin + width * size, p + 8 * width
            else:
                break
            k = (offset - begin) // size
            block, begin, rows = self._u(p + 8 * k, 8), begin + k * size, (size // (start * width)).bit_length()
            if size <= largest and block != UNDEFINED:
                at = block + self.base + offset - begin
                return self.data[at : at + length]
        raise FormatError("a heap object is missing")

    def _layout(self, p: int) -> tuple:
        d, version, cls = self.data, self.data[p], self.data[p + 1]
        if version not in (3, 4):
            raise FormatError(f"data layout version {version} is not known")
        if cls == 0:
            return ("compact", p + 4, self._u(p + 2, 2))
        if cls == 1:
            return ("contiguous", self._u(p + 2, 8), self._u(p + 10, 8))
        if cls == 2 and version == 3:
            rank = d[p + 2]
            return ("tree", self._u(p + 3, 8), tuple(self._u(p + 11 + 4 * k, 4) for k in range(rank - 1)))
        if cls == 2:
            flags, rank, width = d[p + 2], d[p + 3], d[p + 4]
            dims = tuple(self._u(p + 5 + width * k, width) for k in range(rank - 1))
            q = p + 5 + width * rank
            if d[q] != 1:
                raise FormatError("of version-4 chunk indices only the single chunk is known")
            if flags & 2:
                return ("single", self._u(q + 13, 8), dims, self._u(q + 1, 8), self._u(q + 9, 4))
            return ("single", self._u(q + 1, 8), dims, None, 0)
        raise FormatError(f"layout class {cls} is not known")

    def _filters(self, p: int) -> list[tuple[int, tuple[int, ...]]]:
        version, count = self.data[p], self.data[p + 1]
        q, out = p + (8 if version == 1 else 2), []
        for _ in range(count):
            ident = self._u(q, 2)
            named = version == 1 or ident >= 256
            length = self._u(q + 2, 2) if named else 0
            q += 4 if named else 2
            values = self._u(q + 2, 2)
            q += 4 + ((length + 7) // 8 * 8 if version == 1 else length)
            out.append((ident, tuple(self._u(q + 4 * k, 4) for k in range(values))))
            q += 4 * values + (4 if version == 1 and values % 2 else 0)
        return out

    def _attribute(self, p: int, n: int) -> tuple[str, Any]:
        version, flags = self.data[p], self.data[p + 1]
        name_size, kind_size, space_size = (self._u(p + 2 + 2 * k, 2) for k in range(3))
        q = p + 8 + (version == 3)
        pad = (lambda x: (x + 7) // 8 * 8) if version == 1 else (lambda x: x)
        name = self.data[q : q + name_size].split(b"\0")[0].decode()
        q += pad(name_size)
        kind = self._shared_kind(q) if version > 1 and flags & 1 else self._kind(q)[0]
        q += pad(kind_size)
        dims, null = self._space(q)
        q += pad(space_size)
        if null:
            return name, None
        return name, self._values(self.data[q : p + n], kind, dims or ())

    # data

    def names(self, address: int | None = None, prefix: str = "") -> Iterator[tuple[str, Node]]:
        """(path, node) of all objects, groups before their members; cycles are entered once."""
        seen: set[int] = set()

        def walk(at: int, path: str) -> Iterator[tuple[str, Node]]:
            node = self.node(at)
            for name, target in node.links.items():
                child = self.node(target)
                yield f"{path}{name}", child
                if child.is_group and target not in seen:
                    seen.add(target)
                    yield from walk(target, f"{path}{name}/")

        yield from walk(self.root if address is None else address, prefix)

    def find(self, path: str) -> Node:
        node = self.node(self.root)
        for part in filter(None, path.split("/")):
            if part not in node.links:
                raise KeyError(path)
            node = self.node(node.links[part])
        return node

    def read(self, path: str) -> Any:
        return self.value(self.find(path))

    def value(self, node: Node) -> Any:
        if node.null or node.kind is None:
            return None
        dims = node.dims or ()
        raw = self._raw(node, dims)
        return self._values(raw, node.kind, dims)

    def _raw(self, node: Node, dims: tuple[int, ...]) -> bytes:
        size = node.kind.size * int(np.prod(dims, dtype=np.int64))
        if node.layout is None or not size:
            return bytes(size)
        how, *rest = node.layout
        if how == "compact":
            return self.data[rest[0] : rest[0] + rest[1]]
        if node.filters and how == "contiguous":
            raise FormatError("filters need a chunked layout")
        if rest[0] == UNDEFINED:  # never written: the fill value
            return bytes(size)
        if how == "contiguous":
            at = rest[0] + self.base
            return self.data[at : at + size]
        chunk = rest[1]
        out = np.zeros((*dims, node.kind.size), dtype=np.uint8)
        if how == "single":
            at = rest[0] + self.base
            whole = node.kind.size * int(np.prod(chunk, dtype=np.int64))
            parts = [((0,) * len(dims), self.data[at : at + (rest[2] or whole)], rest[3])]
        else:
            parts = list(self._chunks(rest[0], len(dims)))
        for start, raw, mask in parts:
            for k in reversed(range(len(node.filters))):
                if not mask >> k & 1:
                    raw = self._undo(node.filters[k], raw, node.kind.size)
            block = np.frombuffer(raw, np.uint8, int(np.prod(chunk, dtype=np.int64)) * node.kind.size).reshape((*chunk, node.kind.size))
            to = tuple(slice(a, min(a + c, d)) for a, c, d in zip(start, chunk, dims, strict=True))
            out[to] = block[tuple(slice(0, s.stop - s.start) for s in to)]  # edge chunks are clipped
        return out.tobytes()

    def _chunks(self, address: int, rank: int) -> Iterator[tuple[tuple[int, ...], bytes, int]]:
        p, key = address + self.base, 8 + 8 * (rank + 1)
        if self.data[p : p + 4] != b"TREE":
            raise FormatError("a chunk index is damaged")
        level, used = self.data[p + 5], self._u(p + 6, 2)
        for k in range(used):
            q = p + 24 + k * (key + 8)
            child = self._u(q + key, 8)
            if level:
                yield from self._chunks(child, rank)
            else:
                at = child + self.base
                yield tuple(self._u(q + 8 + 8 * j, 8) for j in range(rank)), self.data[at : at + self._u(q, 4)], self._u(q + 4, 4)

    @staticmethod
    def _undo(step: tuple[int, tuple[int, ...]], raw: bytes, element: int) -> bytes:
        ident, values = step
        if ident == 2:
            return Shuffle(values[0] if values else element).backward(raw)
        if ident == 3:
            return raw[:-4]
        if ident not in KNOWN:
            raise FormatError(f"filter {ident} is not known")
        if ident == 32004:  # blocks: total size, block size, then each block's size and bytes
            total, block, at, out = int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:12], "big"), 12, b""
            if raw[:4] == b"\x04\x22\x4d\x18":
                return KNOWN[ident]().backward(raw)
            while len(out) < total:
                size = int.from_bytes(raw[at : at + 4], "big")
                want = min(block, total - len(out))
                part = raw[at + 4 : at + 4 + size]
                out += part if size == want else pa.Codec("lz4_raw").decompress(part, want, asbytes=True)
                at += 4 + size
            return out
        return KNOWN[ident]().backward(raw)

    def _values(self, raw: bytes, kind: Kind, dims: tuple[int, ...]) -> Any:
        count = int(np.prod(dims, dtype=np.int64)) if dims else 1
        if kind.dtype is not None:
            found = np.frombuffer(raw, kind.dtype, count)
            found = found.astype(kind.dtype.newbyteorder("="))
            return found.reshape(dims) if dims else found[0].item()
        items = [self._item(raw[k * kind.size : (k + 1) * kind.size], kind) for k in range(count)]
        if not dims:
            return items[0]
        return items if len(dims) == 1 else _nested(items, dims)

    def _item(self, raw: bytes, kind: Kind) -> Any:
        if kind.dtype is not None:
            return np.frombuffer(raw, kind.dtype, 1)[0].item()
        if kind.cls == 3:
            raw = raw.split(b"\0")[0] if kind.padding == 0 else raw.rstrip(b"\0") if kind.padding == 1 else raw.rstrip(b" ")
            return raw.decode("utf-8", "replace")
        if kind.cls == 6:
            return {name: self._item(raw[at : at + k.size], k) for name, at, k in kind.fields}
        if kind.cls == 7:
            target = int.from_bytes(raw[:8], "little")
            return None if target in (0, UNDEFINED) else Reference(target)
        if kind.cls == 9:
            length, address, index = struct.unpack("<IQI", raw[:16])
            if address in (0, UNDEFINED):
                return "" if kind.text else []
            data = self._heap(address).get(index, b"")
            if kind.text:
                return data[: length * kind.base.size].decode("utf-8", "replace")
            found = self._values(data, kind.base, (length,)) if length else []
            return found.tolist() if isinstance(found, np.ndarray) else found
        if kind.cls == 10:
            found = self._values(raw, kind.base, kind.dims)
            return found.tolist() if isinstance(found, np.ndarray) else found
        return raw

    def _heap(self, address: int) -> dict[int, bytes]:
        if address not in self._heaps:
            p = address + self.base
            if self.data[p : p + 4] != b"GCOL":
                raise FormatError("a global heap is damaged")
            end, p, out = p + self._u(p + 8, 8), p + 16, {}
            while p + 16 <= end:
                index, size = self._u(p, 2), self._u(p + 8, 8)
                if not index:
                    break
                out[index] = self.data[p + 16 : p + 16 + size]
                p += 16 + (size + 7) // 8 * 8
            self._heaps[address] = out
        return self._heaps[address]

    def resolve(self, value: Any) -> Any:
        """value with references replaced by what they point to; a reference met again on its own path stays one."""
        return self._resolve(value, ())

    def _resolve(self, value: Any, path: tuple[int, ...]) -> Any:
        if isinstance(value, Reference):
            if value.address in path:
                return value
            return self._resolve(self.value(self.node(value.address)), (*path, value.address))
        if isinstance(value, dict):
            return {k: self._resolve(v, path) for k, v in value.items()}
        if isinstance(value, list):
            return [self._resolve(v, path) for v in value]
        return value


@dataclass(frozen=True)
class Reference:
    address: int


def _nested(items: list, dims: tuple[int, ...]) -> list:
    for d in reversed(dims[1:]):
        items = [items[k : k + d] for k in range(0, len(items), d)]
    return items


def _plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, Reference):
        return {"ref": value.address}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def scan_h5(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, kind, dims, type, attrs): the objects of all files under path; data is not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, name, "group" if n.is_group else "dataset" if n.layout is not None or n.null else "type", list(n.dims) if n.dims is not None else None, n.kind.describe() if n.kind else None, json.dumps(_plain(n.attributes), default=str)) for name, n in H5File(content).names()]
                yield pd.DataFrame(rows, columns=["file", "path", "kind", "dims", "type", "attrs"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, path string, kind string, dims array<long>, type string, attrs string")


def load_h5(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, idx, value): the elements of one dataset of each file, in storage order; values are JSON text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                h5 = H5File(content)
                node = h5.find(name)
                value = h5.value(node)
                flat = value.ravel().tolist() if isinstance(value, np.ndarray) else value if isinstance(value, list) and node.dims else [value]
                yield pd.DataFrame({"file": file, "idx": range(len(flat)), "value": [json.dumps(_plain(h5.resolve(v)), default=str) for v in flat]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, idx long, value string")


_NUMBERS = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType()}


def spark_type(kind: Kind) -> T.DataType:
    """The column type of a datatype: the next wider one for unsigned numbers, addresses for references, bytes for what is opaque."""
    if kind.dtype is not None:
        return _NUMBERS.get(kind.dtype.str[1:], T.BinaryType())
    if kind.cls == 3 or kind.cls == 9 and kind.text:
        return T.StringType()
    if kind.cls == 6:
        return T.StructType([T.StructField(name, spark_type(k)) for name, _, k in kind.fields])
    if kind.cls == 7:
        return T.LongType()
    if kind.cls == 9:
        return T.ArrayType(spark_type(kind.base))
    if kind.cls == 10:
        found = spark_type(kind.base)
        for _ in kind.dims:
            found = T.ArrayType(found)
        return found
    return T.BinaryType()


def _typed(value: Any, kind: T.DataType) -> Any:
    if isinstance(value, Reference):
        return value.address
    if isinstance(value, dict):
        return {f.name: _typed(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(value, list):
        return [_typed(v, kind.elementType) for v in value]
    return Decimal(value) if isinstance(kind, T.DecimalType) and value is not None else value


def read_h5(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, idx, value): the elements of one dataset of each file in storage order, value with the dataset's own type.

    The type is that of one file; a file where it differs raises, as does one without the dataset.  References are addresses
    in their file, null elements are null, a dataset without elements makes no rows.  Rows leave in batches of ``ROWS``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                node = H5File(content.as_py()).find(name)
                if node.kind is None:
                    raise FormatError(f"{name} is no dataset")
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(spark_type(node.kind).jsonValue())])], ["type"])

    first = files.limit(1).select("content").mapInArrow(typed, "type string").first()
    if first is None:
        raise FileNotFoundError(path)
    kind = T.StructType.fromJson({"type": "struct", "fields": [{"name": "value", "type": json.loads(first["type"]), "nullable": True, "metadata": {}}]})["value"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                h5 = H5File(content.as_py())
                node = h5.find(name)
                if node.kind is None or spark_type(node.kind) != kind:
                    raise FormatError(f"{name} has another type in {file}")
                value = h5.value(node)
                if isinstance(value, np.ndarray):
                    flat = value.ravel()
                elif value is None:
                    flat = []
                else:
                    flat = _flat(value, len(node.dims)) if node.dims else [value]
                for at in range(0, len(flat), ROWS):
                    part = flat[at : at + ROWS]
                    if isinstance(part, np.ndarray) and not isinstance(kind, T.DecimalType):
                        found = pa.array(part).cast(arrow)
                    else:
                        found = pa.array([_typed(v, kind) for v in (part.tolist() if isinstance(part, np.ndarray) else part)], arrow)
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(part)), pa.array(np.arange(at, at + len(part))), found], ["file", "idx", "value"])

    return files.mapInArrow(run, T.StructType([T.StructField("file", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("value", kind)]))


def _flat(items: list, rank: int) -> list:
    for _ in range(rank - 1):
        items = [x for inner in items for x in inner]
    return items
