"""Block files of the binary map format as a Spark data source, for batches and streams.

Blocks are framed by a length, a header and a blob, each raw or zlib. A walk over the frames unpacks no blob; neighbouring blocks
make a partition of their own range of bytes. Blocks are unpacked by columns: packed integers in bulk, deltas as running sums, Arrow
batches out. read() reads one kind of element, and pushes comparisons of id, version, changeset, uid, visible, timestamp, lat and lon down:

* build_index() writes a table of the blocks once: kinds, and ranges of ids, times and places. A scan that finds it opens only
  blocks whose ranges fit the filters; an index made of another size of the file is passed over.
* inside a block, elements that a filter refuses are dropped before their tags, members and places are made.
* columns that aren't asked for aren't unpacked (option columns).

Filters that were pushed are applied by Spark again, so that they only ever save work.

Options: type (node, way, relation); columns (names with commas); startOffset (a frame's first byte, to resume there); offset
(true: a column block_offset, the frame to resume at); index (folder of build_index(), by default the path with .blocks behind);
taskBytes (bytes of blobs in a partition); pushdown (true, with spark.sql.python.filterPushdown.enabled). A stream's offset is the end of each
file's last whole frame: a file that grows is taken up where the last batch ended, and a frame that is still being
written waits. Files are opened through Arrow's file systems: local paths and file:, hdfs:, s3: and gs: addresses, which all executors must
reach; decode() takes contents that Spark has read instead, from any Hadoop path."""

from __future__ import annotations

import functools
import os
import struct
import zlib
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, datasource
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema

MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024
FEATURES = ("OsmSchema-V0.6", "DenseNodes", "LocationsOnWays")  # fixed values: what a reader must support
GROUP_FIELD = {"node": 2, "way": 3, "relation": 4}  # fixed values: fields of a group; 1 has plain nodes
MEMBER_TYPES = ("node", "way", "relation")  # fixed values: by number
#: Columns that filters are pushed on.
SCALARS = ("id", "lat", "lon", "uid", "visible", "version", "changeset", "timestamp")


class FormatError(ValueError):
    pass


def varints(b: bytes) -> np.ndarray:
    """All variable-length integers of a packed field."""
    a = np.frombuffer(b, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    if a.max() < 128:  # a byte each
        return a.astype(np.uint64)
    last = np.flatnonzero(a < 128)
    first = np.append(0, last[:-1] + 1)
    length = last - first + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(length.max())):
        ok = length > k
        out[ok] |= (a[first[ok] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out


def zigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).astype(np.int64) ^ -((u & np.uint64(1)).astype(np.int64))


def deltas(b: bytes) -> np.ndarray:
    return np.cumsum(zigzag(varints(b)))


def fields(b: bytes):
    """(number, value) of a message: integers, or bytes."""
    i, n = 0, len(b)

    def varint():
        nonlocal i
        x = s = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << s
            if c < 128:
                return x
            s += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, b[i : i + size]
            i += size
        elif kind == 1:
            yield tag >> 3, b[i : i + 8]
            i += 8
        elif kind == 5:
            yield tag >> 3, b[i : i + 4]
            i += 4
        else:
            raise FormatError(f"wire type {kind}")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):  # file:/a, as Hadoop writes it, too
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str):
    fs, at = system(path)
    return fs.open_input_file(at)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the .pbf files of a folder, by name."""
    fs, at = system(path)
    top = fs.get_file_info(at)
    if top.type == pafs.FileType.File:
        return [(path, top.size)]
    inside = fs.get_file_info(pafs.FileSelector(at))
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in inside if x.type == pafs.FileType.File and x.base_name.endswith(".pbf"))


def _frames(f, start: int, end: int | None = None):
    """As frames(), of an open file; with end, without a frame that isn't whole by then."""
    f.seek(start)
    at = start
    while True:
        first = f.read(4)
        if not first or end is not None and at + 4 > end:
            return
        (size,) = struct.unpack(">I", first)
        if size >= MAX_HEADER:
            raise FormatError("block header too large")
        if end is not None and at + 4 + size > end:
            return
        kind, data = "", 0
        for k, v in fields(f.read(size)):
            if k == 1:
                kind = v.decode()
            elif k == 3:
                data = v
        if data >= MAX_BLOB:
            raise FormatError("blob too large")
        blob = at + 4 + size
        if end is not None and blob + data > end:
            return
        yield kind, blob, data, at
        at = blob + data
        f.seek(at)


def frames(path: str, start: int = 0, end: int | None = None):
    """(kind, offset of the blob, its size, offset of the frame) of every block from a frame's start on."""
    with opened(path) as f:
        yield from _frames(f, start, end)


def payload(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        out = zlib.decompress(f[3])
        if 2 in f and len(out) != f[2]:
            raise FormatError("raw blob size differs from what the block says")
        return out
    raise FormatError("unknown blob data")


def header(path: str) -> dict:
    """The header block: bounds, features, program, source and replication state."""
    with opened(path) as f:
        kind, at, size, _ = next(_frames(f, 0), ("", 0, 0, 0))
        if kind != "OSMHeader":
            raise FormatError("file has no header")
        f.seek(at)
        return parsed_header(payload(f.read(size)))


def parsed_header(b: bytes) -> dict:
    out = {"bounds": None, "required_features": [], "optional_features": [], "writing_program": None, "source": None, "replication_timestamp": None, "replication_seq_num": None, "replication_base_url": None}
    for k, v in fields(b):
        if k == 1:
            box = {n: int(zigzag(np.array([x], np.uint64))[0]) for n, x in fields(v)}
            out["bounds"] = {"minlat": 1e-9 * box.get(4, 0), "maxlat": 1e-9 * box.get(3, 0), "minlon": 1e-9 * box.get(1, 0), "maxlon": 1e-9 * box.get(2, 0)}
        elif k in (4, 5):
            out["required_features" if k == 4 else "optional_features"].append(v.decode())
        elif k in (16, 17, 34):
            out[{16: "writing_program", 17: "source", 34: "replication_base_url"}[k]] = v.decode()
        elif k == 32:
            out["replication_timestamp"] = datetime.fromtimestamp(signed(v), timezone.utc)
        elif k == 33:
            out["replication_seq_num"] = signed(v)
    if bad := [x for x in out["required_features"] if x not in FEATURES]:
        raise FormatError(f"parser does not have {bad[0]} capability")
    return out


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: its path, and what its header says."""
    names = spark.createDataFrame(files_of(path), "path string, size long")

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([{"path": p, **header(p)} for p in b["path"]], columns=["path", *_HEADER_COLUMNS])

    return names.mapInPandas(run, "path string, " + ", ".join(f"{k} {t}" for k, t in _HEADER_COLUMNS.items()))


_HEADER_COLUMNS = {
    "bounds": schema.BOUNDS, "required_features": "array<string>", "optional_features": "array<string>", "writing_program": "string", "source": "string",
    "replication_timestamp": "timestamp", "replication_seq_num": "bigint", "replication_base_url": "string",
}


class Numbers:
    """A column of numbers, some of which may be missing."""

    def __init__(self, values, there=None):
        self.values = values
        self.there = np.ones(len(values), bool) if there is None else there

    @classmethod
    def of(cls, values: list, kind=np.int64) -> Numbers:
        there = np.array([x is not None for x in values], bool)
        return cls(np.array([0 if x is None else x for x in values], kind), there)

    @classmethod
    def none(cls, n: int) -> Numbers:
        return cls(np.zeros(n, np.int64), np.zeros(n, bool))

    def __getitem__(self, rows) -> Numbers:
        return Numbers(self.values[rows], self.there[rows])

    def array(self, kind) -> pa.Array:
        values = pa.array(self.values, mask=~self.there)
        return values.cast(pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else values.cast(kind)


class Lists:
    """Elements' lists laid end to end: counts, and columns of their items."""

    def __init__(self, counts, **columns):
        self.counts, self.columns = np.asarray(counts, np.int64), columns

    def __getitem__(self, rows) -> Lists:
        wanted = np.zeros(len(self.counts), bool)
        wanted[rows] = True
        items = np.repeat(wanted, self.counts)
        return Lists(self.counts[wanted], **{k: v[items] for k, v in self.columns.items()})

    def array(self, kind, made) -> pa.Array:
        """made: name and type of an item's field to its values, of these columns."""
        n = int(self.counts.sum())
        inner = kind.value_type
        columns = [made(f.name, f.type, self.columns, n) for f in inner]
        items = pa.StructArray.from_arrays(columns, fields=list(inner))
        ends = np.append(0, np.cumsum(self.counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), items, type=kind)


class Block:
    """One block of elements; batches(kind) gives its nodes, ways or relations by columns, in order."""

    def __init__(self, b: bytes):
        self._strings, self.groups, self.granularity, self.dates, self.lat0, self.lon0 = b"", [], 100, 1000, 0, 0
        for k, v in fields(b):
            if k == 1:
                self._strings = v
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.granularity = v
            elif k == 18:
                self.dates = v
            elif k == 19:
                self.lat0 = signed(v)
            elif k == 20:
                self.lon0 = signed(v)

    @functools.cached_property
    def strings(self) -> pa.Array:
        return pa.array([x.decode("utf-8", "replace") for n, x in fields(self._strings) if n == 1], pa.string())

    def place(self, raw, offset):
        return 1e-9 * (offset + self.granularity * raw)

    def kinds(self) -> set[str]:
        """Kinds of elements in here, without unpacking them."""
        found = {k for g in self.groups for k, _ in fields(g)}
        return {name for name, k in GROUP_FIELD.items() if k in found}

    def batches(self, kind: str, shape: pa.Schema, test=None):
        """Record batches of shape. test: from scalar columns (Numbers by name) to the rows to unpack further."""
        want = GROUP_FIELD[kind]
        for g in self.groups:
            loose = []
            for k, v in fields(g):
                if k == 1 and kind == "node":
                    raise FormatError("plain nodes are not supported")
                if k == want and kind == "node":
                    yield from self._batch(*self._dense(v), kind, shape, test)
                elif k == want:
                    loose.append(dict(fields(v)))
            if loose:
                yield from self._batch(*self._loose(loose, kind, shape), kind, shape, test)

    def rows(self, kind: str):
        for b in self.batches(kind, arrow_shape(StructType.fromDDL(schema.TABLES[kind]))):
            yield from b.to_pylist()

    def _batch(self, scalars: dict, user: Numbers, lists: dict, kind: str, shape: pa.Schema, test):
        if test is not None:
            keep = test(scalars)
            if not keep.any():
                return
            if not keep.all():
                scalars, user = {k: v[keep] for k, v in scalars.items()}, user[keep]
                lists = {k: (lambda make=make: make()[keep]) for k, make in lists.items()}
        n = len(user.values)
        columns = []
        for f in shape:
            if f.name in scalars:
                columns.append(scalars[f.name].array(f.type))
            elif f.name == "user":
                columns.append(self.strings.take(user.array(pa.int64())))
            elif f.name in lists:
                columns.append(lists[f.name]().array(f.type, self._item))
            elif f.name == "updates" and kind != "node":
                columns.append(pa.array([[]] * n, f.type))
            else:
                columns.append(pa.nulls(n, f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=shape)

    def _item(self, name, kind, columns, n):
        if name not in columns:
            return pa.nulls(n, kind)
        v = columns[name]
        if pa.types.is_string(kind):  # a number in the table of strings, or of member types
            return (pa.array(MEMBER_TYPES) if name == "type" else self.strings).take(pa.array(v))
        return v.array(kind) if isinstance(v, Numbers) else pa.array(v).cast(kind)

    def _stamps(self, raw: Numbers) -> Numbers:
        return Numbers(raw.values * self.dates * 1000, raw.there)

    def _dense(self, b: bytes):
        f = dict(fields(b))
        ids = deltas(f.get(1, b""))
        n = len(ids)
        info = dict(fields(f[5])) if 5 in f else {}
        of = lambda k, how: Numbers(how(info[k])) if k in info else Numbers.none(n)
        scalars = {
            "id": Numbers(ids), "lat": Numbers(self.place(deltas(f.get(8, b"")), self.lat0)), "lon": Numbers(self.place(deltas(f.get(9, b"")), self.lon0)),
            "version": of(1, lambda x: varints(x).astype(np.int64)), "timestamp": self._stamps(of(2, deltas)), "changeset": of(3, deltas), "uid": of(4, deltas),
            "visible": Numbers(varints(info[6]).astype(bool) if 6 in info else np.ones(n, bool)),
        }
        return scalars, of(5, deltas), {"tags": lambda: self._dense_tags(varints(f.get(10, b"")).astype(np.int64), n)}

    def _dense_tags(self, kv: np.ndarray, n: int) -> Lists:
        """Keys and values in turn, a zero behind each element; nothing at all if no element has tags."""
        ends = np.flatnonzero(kv == 0)
        sizes = np.diff(np.append(-1, ends)) - 1
        if len(ends) != n or (sizes % 2).any():  # no tags, or an empty string as a value: step by step
            counts, at, rows = [], 0, []
            for _ in range(n):
                began = len(rows)
                while at < len(kv) and kv[at]:
                    rows.append((kv[at], kv[at + 1]))
                    at += 2
                at += 1
                counts.append(len(rows) - began)
            pairs = np.array(rows, np.int64).reshape(-1, 2)
            return Lists(counts, k=pairs[:, 0], v=pairs[:, 1])
        flat = kv[kv != 0]
        return Lists(sizes // 2, k=flat[::2], v=flat[1::2])

    def _loose(self, found: list[dict], kind: str, shape: pa.Schema):
        info = [dict(fields(f[4])) if 4 in f else {} for f in found]
        of = lambda k, how=int: Numbers.of([None if x.get(k) is None else how(x[k]) for x in info])
        scalars = {
            "id": Numbers(np.array([signed(f.get(1, 0)) for f in found], np.int64)), "version": of(1), "timestamp": self._stamps(of(2, signed)), "changeset": of(3), "uid": of(4),
            "visible": Numbers(np.array([bool(x.get(6, 1)) for x in info], bool)),
        }
        end = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])

        def tags():
            k, v = ([varints(f.get(i, b"")).astype(np.int64) for f in found] for i in (2, 3))
            return Lists([len(x) for x in k], k=end(k), v=end(v))

        def nodes():
            refs = [deltas(f.get(8, b"")) for f in found]
            sizes = [len(x) for x in refs]
            there = np.repeat(np.array([9 in f for f in found], bool), sizes)
            at = lambda k, zero: Numbers(np.concatenate([np.zeros(0), *(self.place(deltas(f[k]), zero) if k in f else np.zeros(m) for f, m in zip(found, sizes))]), there)
            return Lists(sizes, ref=end(refs), lat=at(9, self.lat0), lon=at(10, self.lon0))

        def members():
            roles, refs, kinds = ([how(f.get(i, b"")).astype(np.int64) for f in found] for i, how in ((8, varints), (9, deltas), (10, varints)))
            return Lists([len(x) for x in refs], role=end(roles), ref=end(refs), type=end(kinds))

        return scalars, of(5), {"tags": tags, **({"nodes": nodes} if kind == "way" else {"members": members})}


def top_level(ddl: str) -> dict[str, str]:
    """Names and types of the columns of a schema's text, without a session to parse it."""
    depth, parts = 0, [""]
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return dict(x.strip().split(" ", 1) for x in parts)


def arrow_shape(s: StructType) -> pa.Schema:
    return to_arrow_schema(s)


def _number(x):
    if isinstance(x, datetime):
        d = x - datetime(1970, 1, 1, tzinfo=timezone.utc if x.tzinfo else None)
        return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds
    return x


_COMPARE = {
    datasource.EqualTo: lambda a, x: a == x, datasource.GreaterThan: lambda a, x: a > x, datasource.GreaterThanOrEqual: lambda a, x: a >= x,
    datasource.LessThan: lambda a, x: a < x, datasource.LessThanOrEqual: lambda a, x: a <= x, datasource.In: lambda a, x: np.isin(a, list(x)),
}


class Test:
    """Comparisons that all have to hold: of rows, and of ranges."""

    def __init__(self, filters):
        self.parts = []
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in SCALARS and f.value is not None:
                value = tuple(_number(x) for x in f.value if x is not None) if isinstance(f, datasource.In) else _number(f.value)
                self.parts.append((f.attribute[0], type(f), value))

    def __call__(self, scalars: dict) -> np.ndarray:
        keep = np.ones(len(scalars["id"].values), bool)
        for name, op, value in self.parts:
            if name in scalars:
                keep &= scalars[name].there & _COMPARE[op](scalars[name].values, value)
        return keep

    def ranges(self) -> pads.Expression:
        """What the ranges of a block must be for it to have such an element."""
        all_ = pads.scalar(True)
        for name, op, value in self.parts:
            if name not in RANGES:
                continue
            low, high = pads.field(f"min_{name}"), pads.field(f"max_{name}")
            if op is datasource.EqualTo:
                all_ &= (low <= value) & (high >= value)
            elif op is datasource.In:
                near = pads.scalar(False)
                for x in value:
                    near |= (low <= x) & (high >= x)
                all_ &= near
            elif op in (datasource.GreaterThan, datasource.GreaterThanOrEqual):
                all_ &= _COMPARE[op](high, value)
            else:
                all_ &= _COMPARE[op](low, value)
        return all_


#: Columns whose ranges the index has; times in microseconds.
RANGES = {"id": "bigint", "version": "bigint", "changeset": "bigint", "timestamp": "bigint", "lat": "double", "lon": "double"}
_WALKED = "path string, file_size bigint, offset bigint, at bigint, size bigint"
_INDEX = f"{_WALKED}, kind string, count bigint, " + ", ".join(f"min_{k} {t}, max_{k} {t}" for k, t in RANGES.items())


def build_index(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Write the table of blocks: a row for each block and kind of element in it. Files are walked in one task each, blocks unpacked
    in tasks of their own."""
    import pandas as pd

    def walk(batches):
        for b in batches:
            for p, size in zip(b["path"], b["size"]):
                rows = [(p, size, at, blob, data) for kind, blob, data, at in frames(p) if kind == "OSMData"]
                yield pd.DataFrame(rows, columns=["path", "file_size", "offset", "at", "size"])

    def ranges(batches):
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                with opened(x.path) as f:
                    f.seek(x.at)
                    block = Block(payload(f.read(x.size)))
                for kind in sorted(block.kinds()):
                    out.append({**x._asdict(), "kind": kind, **_ranges(block, kind)})
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in _INDEX.split(", ")]).astype({f"{e}_{k}": "Int64" for k, t in RANGES.items() if t == "bigint" for e in ("min", "max")})

    names = spark.createDataFrame(files_of(path), "path string, size long")
    names = names.repartition(max(1, min(names.count(), 10_000)))
    blocks = names.mapInPandas(walk, _WALKED).repartition("path", "offset")
    index = index or f"{path.rstrip('/')}.blocks"
    blocks.mapInPandas(ranges, _INDEX).repartitionByRange("kind", "min_id").sortWithinPartitions("kind", "min_id").write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


def _ranges(block: Block, kind: str) -> dict:
    out = {"count": 0}

    def see(scalars):
        out["count"] += len(scalars["id"].values)
        for name in RANGES:
            if name in scalars and scalars[name].there.any():
                v = scalars[name].values[scalars[name].there]
                low, high = v.min().item(), v.max().item()
                out[f"min_{name}"] = min(low, out.get(f"min_{name}", low))
                out[f"max_{name}"] = max(high, out.get(f"max_{name}", high))
        return np.zeros(len(scalars["id"].values), bool)

    for _ in block.batches(kind, pa.schema([]), see):
        pass
    return out


class _Blocks(InputPartition):
    """Blocks (offset of the frame, of the blob, size) of one file that are read by one task."""

    def __init__(self, path, blocks):
        self.path, self.blocks = path, blocks


class _Reading:
    """What batches and streams have in common."""

    def __init__(self, options, shape: StructType):
        self.path, self.kind = options["path"], options.get("type", "node")
        self.start, self.task_bytes = int(options.get("startOffset", 0)), int(options.get("taskBytes", 16 << 20))
        self.index = options.get("index") or f"{self.path.rstrip('/')}.blocks"
        self.shape, self.test = arrow_shape(shape), None

    def grouped(self, found) -> list[_Blocks]:
        """Neighbouring blocks (path, frame, blob, size), as many as a task shall have."""
        out, held = [], 0
        for path, at, blob, size in found:
            if not out or out[-1].path != path or held + size > self.task_bytes:
                out.append(_Blocks(path, []))
                held = 0
            out[-1].blocks.append((at, blob, size))
            held += size
        return out

    def read(self, partition):
        if partition.path is None:
            return
        plain = pa.schema([f for f in self.shape if f.name != "block_offset"])
        with opened(partition.path) as f:
            for at, blob, size in partition.blocks:
                f.seek(blob)
                for b in Block(payload(f.read(size))).batches(self.kind, plain, self.test):
                    if len(plain) < len(self.shape):
                        columns = dict(zip(plain.names, b.columns)) | {"block_offset": pa.array(np.full(len(b), at, np.int64))}
                        b = pa.RecordBatch.from_arrays([columns[n] for n in self.shape.names], schema=self.shape)
                    yield b


class _Reader(_Reading, DataSourceReader):
    def partitions(self):
        known, sizes = {}, dict(files_of(self.path))
        if self.start == 0:
            for p in sizes:
                header(p)
        fs, at = system(self.index)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            table = pads.dataset(at, filesystem=fs, format="parquet")
            whole = table.to_table(columns=["path", "file_size"], filter=pads.field("path").isin(pa.array(list(sizes), pa.string()))).group_by("path").aggregate([("file_size", "min"), ("file_size", "max")])
            good = {x["path"] for x in whole.to_pylist() if x["file_size_min"] == x["file_size_max"] == sizes[x["path"]]}
            wanted = pads.field("path").isin(pa.array(sorted(good), pa.string())) & (pads.field("kind") == self.kind) & (pads.field("offset") >= self.start)
            wanted &= self.test.ranges() if self.test else pads.scalar(True)
            known = {p: [] for p in good}
            for x in table.to_table(columns=["path", "offset", "at", "size"], filter=wanted).sort_by([("path", "ascending"), ("offset", "ascending")]).to_pylist():
                known[x["path"]].append((x["path"], x["offset"], x["at"], x["size"]))
        found = []
        for p in sizes:
            found += known[p] if p in known else [(p, at, blob, size) for kind, blob, size, at in frames(p, self.start) if kind == "OSMData"]
        return self.grouped(found) or [_Blocks(None, [])]


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        test = Test(filters)
        self.test = test if test.parts else None
        return filters  # Spark applies them again


class _StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path, size in files_of(self.path):
            end = self.ends.get(path, self.start)
            for _, blob, data, _ in frames(path, end, size):
                end = blob + data
            out[path] = self.ends[path] = end
        return out

    @functools.cached_property
    def ends(self) -> dict:
        return {}

    def partitions(self, start, end):
        found = []
        for path, to in sorted(end.items()):
            found += [(path, at, blob, size) for kind, blob, size, at in frames(path, start.get(path, self.start), to) if kind == "OSMData"]
        return self.grouped(found)

    def commit(self, end):
        pass

    def stop(self):
        pass


class PbfSource(DataSource):
    """Options as the module says."""

    @classmethod
    def name(cls):
        return "pbf"

    def schema(self):
        full = top_level(schema.TABLES[self.options.get("type", "node")])
        names = [x.strip() for x in self.options["columns"].split(",")] if self.options.get("columns") else list(full)
        if unknown := [x for x in names if x not in full]:
            raise ValueError(f"no column {unknown[0]}")
        return ", ".join([*(f"{x} {full[x]}" for x in names), *(["block_offset bigint"] if self.options.get("offset") == "true" else [])])

    def reader(self, schema):
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options, schema)

    def streamReader(self, schema):
        return _StreamReader(self.options, schema)


def read(spark: SparkSession, path: str, kind: str = "node", columns: list[str] | None = None, **options) -> DataFrame:
    """Elements of one kind; filters on them are pushed down. For this, spark.sql.python.filterPushdown.enabled is set."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)
    given = {"type": kind, "pushdown": "true"} | ({"columns": ",".join(columns)} if columns else {}) | {k: str(v) for k, v in options.items()}
    return spark.read.format("pbf").options(**given).load(path)


def decode(files: DataFrame, kind: str = "node") -> DataFrame:
    """Elements of files that Spark has read whole (columns path and content, as of its binaryFile source)."""
    import io

    shape = schema.TABLES[kind]
    plain = arrow_shape(StructType.fromDDL(shape))

    def run(batches):
        for b in batches:
            for content in b.column(0):
                f = io.BytesIO(content.as_py())
                for at, (name, blob, size, _) in enumerate(list(_frames(f, 0))):
                    f.seek(blob)
                    if name == "OSMHeader":
                        parsed_header(payload(f.read(size)))
                    elif at == 0:
                        raise FormatError("file has no header")
                    elif name == "OSMData":
                        yield from Block(payload(f.read(size))).batches(kind, plain)

    return files.select("content").mapInArrow(run, shape)
