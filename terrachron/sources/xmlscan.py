"""Map XML of any kind in one parse: documents, change files and diffs, with elements of all kinds as rows of one table.

A file is cut into ranges of bytes; a range's task parses the units (elements; in diffs, actions) that start in its range, and
goes on beyond its end as far as the last one needs. A range that starts inside a file looks for its first unit; which
block (create, modify, delete) is open there is told by the last edge of one in each range before, found in a pass of its own. Element names count in any
case. Compressed files are one range each. The parts of one document (`parts`), which no element crosses, are read like ranges of it.

A row has path, position (the byte where its unit begins), kind, action, side (old or new, in diffs) and, in the column of its kind, the raw
record; tables() and changes() shape them as the other readers do, diffs() puts old and new side by side.

Defined results: elements outside of any block have no action; records of unknown elements are passed over, and so are elements without attributes (diffs
have a note of that kind at their head); a number or time that can't be
read is null; an element that isn't closed is an error; comments and CDATA that hold what looks like the start of an element are
not told from it where a range starts. Files are opened through Arrow's file systems, as block files are."""

from __future__ import annotations

import re
from xml.parsers import expat

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .pbf import arrow_shape, system
from .xml import _RAW, _shaped

KINDS = tuple(_RAW)
BLOCKS = ("create", "modify", "delete")
SPLIT = 64 << 20
_UNIT = re.compile(rb"<(?:" + "|".join(KINDS).encode() + rb")\s", re.I)
_ACTION = re.compile(rb"<action\s", re.I)  # comments of notes have action elements too, without attributes
_EDGE = re.compile(rb"<(/?)(create|modify|delete)[\s>]", re.I)
_NAME = re.compile(rb"<([A-Za-z][\w.:-]*)")
_OVER = 16  # bytes that a name at the border of two pieces may need
_PACKED = (".gz", ".bz2")
_HEAD = 1 << 16


def _struct(kind: str, times_as_text: bool) -> T.StructType:
    """With times_as_text, times as the strings that the parser sees."""

    def changed(t):
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, changed(f.dataType)) for f in t])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(changed(t.elementType))
        return T.StringType() if times_as_text and isinstance(t, T.TimestampType) else t

    return changed(T.StructType.fromDDL(_RAW[kind]))


class Node:
    """An element: its attributes, its children by name (in small letters), its text."""

    __slots__ = ("attrs", "children", "text")

    def __init__(self, attrs):
        self.attrs, self.children, self.text = attrs, {}, []


def _boolean(x):
    return {"true": True, "false": False}[x.strip().lower()]


def _plain(t):
    make = {T.StringType: str, T.BooleanType: _boolean, T.DoubleType: float}.get(type(t), int)

    def get(x):
        try:
            return make(x)
        except (ValueError, KeyError):
            return None

    return get


def maker(t: T.DataType):
    """From an element to a value of the type: fields are attributes or else children."""
    if not isinstance(t, T.StructType):
        make = _plain(t)
        return lambda e: make("".join(e.text))
    parts = []
    for f in t:
        inner = f.dataType
        if isinstance(inner, T.ArrayType):
            parts.append((f.name, None, maker(inner.elementType), True))
        elif isinstance(inner, T.StructType):
            parts.append((f.name, None, maker(inner), False))
        else:
            parts.append((f.name, _plain(inner), maker(inner), False))

    def make_all(e):
        out = {}
        for name, plain, child, many in parts:
            if plain is not None and name in e.attrs:
                out[name] = plain(e.attrs[name])
            elif found := e.children.get(name):
                out[name] = [child(x) for x in found] if many else child(found[0])
        return out

    return make_all


class Parser:
    """Feeds bytes to expat and keeps the units that begin before `end` (a byte of the file)."""

    def __init__(self, at: int, end: int | None, prefix: bytes = b""):
        self.base, self.end, self.done, self.found = at - len(prefix), end, False, []
        self.stack, self.open, self.action, self.side, self.position = [], None, None, None, None
        self.p = expat.ParserCreate()
        self.p.buffer_text = True
        self.p.StartElementHandler, self.p.EndElementHandler, self.p.CharacterDataHandler = self._start, self._end, self._text
        if prefix:
            self.p.Parse(prefix, False)

    def _start(self, name, attrs):
        name = name.rsplit(":", 1)[-1].lower()
        if self.done:
            return
        at = self.base + self.p.CurrentByteIndex
        if self.stack:  # inside a unit
            e = Node(attrs)
            self.stack[-1].children.setdefault(name, []).append(e)
            self.stack.append(e)
        elif name in KINDS and attrs or name == "action":
            if (self.position is None or name == "action") and self.end is not None and at >= self.end:
                self.done = True
            elif name == "action":
                self.action, self.position = attrs.get("type"), at
            else:
                self.open = (name, at if self.position is None else self.position)
                self.stack.append(Node(attrs))
        elif name in BLOCKS:
            self.action = name
        elif name in ("old", "new"):
            self.side = name

    def _end(self, name):
        name = name.rsplit(":", 1)[-1].lower()
        if self.done:
            return
        if self.stack:
            e = self.stack.pop()
            if not self.stack:
                self.found.append((self.open[1], self.open[0], self.action, self.side, e))
        elif name == "action":
            self.action = self.side = self.position = None
        elif name in BLOCKS:
            self.action = None
        elif name in ("old", "new"):
            self.side = None

    def _text(self, data):
        if self.stack and not self.done:
            self.stack[-1].text.append(data)

    def feed(self, data: bytes, last: bool = False):
        self.p.Parse(data, last)
        out, self.found = self.found, []
        return out


def _before(f, at: int, low: int = 0, piece: int = 1 << 20) -> bytes | None:
    """Name of the block that is open at a byte, as it is written; nothing if none is; None if that is decided before `low`."""
    end = at
    while end > low:
        start = max(low, end - piece)
        f.seek(start)
        edges = list(_EDGE.finditer(f.read(min(at, end + _OVER) - start)))
        if edges:
            return b"" if edges[-1][1] else edges[-1][2]
        end = start
    return None


def _open_at_end(path: str, start: int, end: int) -> str | None:
    """The block that is open at the end of a range, by the last edge that begins in it; None: no edge does."""
    fs, at = system(path)
    with fs.open_input_file(at) as f:
        f.seek(end)
        over = f.read(_OVER)  # an edge that begins before the end may reach beyond it
        edges = [m for m in _EDGE.finditer(_tail(f, start, end) + over) if m.start() < min(_OVER, end - start)]
        if edges:
            return "" if edges[-1][1] else edges[-1][2].decode()
        found = _before(f, end, start)
    return None if found is None else found.decode()


def _tail(f, start: int, end: int) -> bytes:
    low = max(start, end - _OVER)
    f.seek(low)
    return f.read(end - low)


def _first(f, pattern, at: int, size: int, piece: int = 1 << 20) -> int | None:
    while at < size:
        f.seek(at)
        if m := pattern.search(f.read(piece + _OVER)):
            return at + m.start()
        at += piece
    return None


def units(path: str, start: int, end: int, size: int, piece: int = 1 << 20, block: str | None = None, part: tuple | None = None):
    """(position, kind, action, side, element) of the units that start in a range. block: what is open where it starts, if that is known.
    part: of a file that is a part of a document, the root's name, whether it is a diff, whether it is the first and the last."""
    fs, at = system(path)
    if part:
        root, diff, is_first, is_last = part
        root = root.encode()
    if path.endswith(_PACKED):
        with fs.open_input_stream(at, compression="detect") as f:
            parser = Parser(0, None)
            while data := f.read(piece):
                yield from parser.feed(data)
            yield from parser.feed(b"", True)
        return
    with fs.open_input_file(at) as f:
        if not part:
            is_first = is_last = True
            root, diff = _root(f.read(_HEAD))
        prefix, place = b"", 0
        if start or not is_first:
            place = _first(f, _ACTION if diff else _UNIT, start, size)
            if place is None or place >= end:
                return
            own = b"" if diff else _before(f, place, 0 if block is None else start)
            own = (block or "").encode() if own is None else own
            prefix = b"<" + root + b">" + (b"<" + own + b">" if own else b"")
        parser = Parser(place, end if end < size else None, prefix)
        f.seek(place)
        while not parser.done and (data := f.read(piece)):
            yield from parser.feed(data)
        if not parser.done and is_last:
            yield from parser.feed(b"", True)
        elif not parser.done and (parser.stack or parser.position is not None):
            raise ValueError(f"an element of {path} is not closed")


def _root(head: bytes) -> tuple[bytes, bool]:
    """Name of the root, and whether the document is a diff."""
    names = _NAME.findall(head)
    return names[0] if names else b"", bool(_ACTION.search(head))


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = system(path)
    top = fs.get_file_info(at)
    if top.type == pafs.FileType.File:
        return [(path, top.size)]
    inside = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    root = path.rstrip("/")
    return sorted((root + x.path[len(at.rstrip("/")) :], x.size) for x in inside if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")) and x.size)


def _start_of(files: list[tuple[str, int]]) -> bytes:
    """The first bytes of a document in parts."""
    head = b""
    for p, _size in files:
        fs, at = system(p)
        with fs.open_input_file(at) as f:
            head += f.read(_HEAD - len(head))
        if len(head) == _HEAD:
            break
    return head


def _blocks(given: DataFrame, parts: bool) -> DataFrame:
    """The ranges with block: what is open where they start."""

    def run(batches):
        for b in batches:
            b["edge"] = [None if p.endswith(_PACKED) else _open_at_end(p, a, e) for p, a, e in zip(b["path"], b["start"], b["end"])]
            yield b

    d = given.mapInPandas(run, T.StructType([*given.schema.fields, T.StructField("edge", T.StringType())]))
    w = Window.partitionBy(F.lit(0) if parts else F.col("path")).orderBy("path", "start")  # a row for each range
    d = d.withColumn("block", F.coalesce(F.last("edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    return d.select(*given.columns, "block")


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT, parts: bool = False) -> DataFrame:
    """Every element of a file, or of the files of a folder, in one parse. parts: the files, in order of their names, are one document, cut
    between its elements, as sinks writes it."""
    ranges, files = [], _files(path)
    for p, size in files:
        step = size if p.endswith(_PACKED) else split_bytes
        ranges += [(p, a, min(size, a + step), size) for a in range(0, size, step)]
    if parts and any(p.endswith(_PACKED) for p, _size in files):
        raise ValueError("parts of a document can't be compressed")
    root, diff = _root(_start_of(files)) if parts else (b"", False)
    root, ends = root.decode(), (files[0][0], files[-1][0]) if files else (None, None)
    shape = T.StructType([T.StructField("path", T.StringType()), T.StructField("position", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("kind", "action", "side"))])
    for kind in KINDS:
        shape = shape.add(kind, _struct(kind, True))
    arrow = arrow_shape(shape)
    shapes = {kind: _struct(kind, True) for kind in KINDS}

    def run(batches):
        make = {kind: maker(s) for kind, s in shapes.items()}
        for b in batches:
            for p, a, e, size, block in zip(*(b.column(i).to_pylist() for i in range(5))):
                rows = []
                part = (root, diff, p == ends[0], p == ends[1]) if parts else None
                for at, kind, action, side, element in units(p, a, e, size, block=block, part=part):
                    rows.append({"path": p, "position": at, "kind": kind, "action": action, "side": side, kind: make[kind](element)})
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    given = spark.createDataFrame(ranges, "path string, start long, end long, size long")
    dealt = lambda d: d.repartition(max(1, len(ranges)), "path", "start")
    several = parts and len(ranges) > 1 and not diff or not parts and len(ranges) > len(files)
    given = _blocks(dealt(given), parts) if several else given.withColumn("block", F.lit(""))
    out = dealt(given).mapInArrow(run, shape)
    # times are read by Spark; those that can't be are null
    return out.select("path", "position", "kind", "action", "side", *(_timed(F.col(k), _struct(k, False)).alias(k) for k in KINDS))


def _timed(c: Column, t: T.DataType) -> Column:
    """The value with its texts of times as times."""
    if isinstance(t, T.TimestampType):
        return F.try_to_timestamp(c)
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_timed(c[f.name], f.dataType).alias(f.name) for f in t)))
    if isinstance(t, T.ArrayType) and "timestamp" in t.simpleString():
        return F.transform(c, lambda x: _timed(x, t.elementType))
    return c


def tables(scanned: DataFrame) -> dict[str, DataFrame]:
    """Tables of each kind, from one scan; users are those with an id."""
    out = {}
    for kind in KINDS:
        d = scanned.where((F.col("kind") == kind) & ((F.lit(kind) != "user") | F.col(f"{kind}.id").isNotNull()))
        out[kind] = d.select(*_shaped(kind, lambda c, kind=kind: F.col(kind)[c]))
    return out


def changes(scanned: DataFrame) -> dict[str, DataFrame]:
    """Per kind the elements of create, modify and delete blocks with their action."""
    out = {}
    for kind in KINDS[:3]:
        d = scanned.where((F.col("kind") == kind) & F.col("action").isin(*BLOCKS) & F.col("side").isNull())
        out[kind] = d.select("action", *_shaped(kind, lambda c, kind=kind: F.col(kind)[c]))
    return out


def diffs(scanned: DataFrame) -> DataFrame:
    """action, type, id, and for each kind the old and new record as structs of its table (old_node, new_node, ...): one row for each action
    element; a bare element is new."""
    side = F.when(F.col("side") == "old", "old").otherwise("new")
    d = scanned.where(F.col("kind").isin(*KINDS[:3])).withColumn("side", side)
    columns = []
    for kind in KINDS[:3]:
        record = F.struct(*_shaped(kind, lambda c, kind=kind: F.col(kind)[c]))
        columns += [F.first(F.when((F.col("kind") == kind) & (F.col("side") == s), record), ignorenulls=True).alias(f"{s}_{kind}") for s in ("old", "new")]
    ids = F.coalesce(*(F.col(f"{k}.id") for k in KINDS[:3]))
    return d.groupBy("path", "position").agg(F.first("action").alias("action"), F.first("kind").alias("type"), F.coalesce(F.max(F.when(F.col("side") == "new", ids)), F.max(ids)).alias("id"), *columns)
