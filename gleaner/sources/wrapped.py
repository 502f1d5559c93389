"""Data source ``wrapped_json``: JSON files that hold their records in one array, decoded record by record.

Spark's own reader takes such a file as one row.  This one reads a file in blocks and holds one record at a time, so a
file may be larger than a task's memory.  A partition is a large file or some small ones.  The conditions of ``where``
are applied to a record before it becomes a row, and those on ``_file`` leave whole files unread.  They are an option
of the relation and not pushed by Spark: Spark 4.1.2 keeps the reader that took one query's filters for other
queries over the same DataFrame, even for the other side of a union.  As a stream, files are taken in the order of their
modification times.

Options: ``path`` (a file or folder of any file system that pyarrow knows), ``key`` (where an object holds its array;
without it the first of ``WRAPPERS`` that holds one, which costs objects a first pass), ``partitionbytes`` (64 MB), ``missing`` (``empty``: an object
without an array under ``key`` gives no rows), ``where`` (a JSON list of ``[column, test, value]``, all of
which must hold; tests are =, <>, <, <=, >, >=, in, prefix, suffix, contains, null with the value true or false; columns are
those of the schema with text, whole number or truth value; a null satisfies only the test for null, as in SQL).

Written with ``mode("append")``, every task's rows become one file of that form, row by row; ``key`` names the array.

A schema must be given.  Besides the records' fields it may name ``_file string`` and ``_record long``, the file and
the place in it, and ``_json string``, the whole record.  A value that does not fit its column is null; a string column takes other values as JSON.  A file
that ends inside a record, or has no array, is an error; an empty array gives no rows; array elements that are not
objects give rows of nulls.
"""

from __future__ import annotations

import codecs
import json
import operator
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from gleaner.session import prepare
from gleaner.sources.corpus import WRAPPERS

FILE, RECORD, RAW = "_file", "_record", "_json"
_BLOCK = 1 << 18
_SPACE = " \t\r\n"


# -- decoding ----------------------------------------------------------------------------------------


class _Text:
    """A JSON text that arrives in blocks; what has been used is let go."""

    def __init__(self, blocks: Iterator[str]):
        self.blocks, self.held, self.at, self.over = blocks, "", 0, False
        self.decoder = json.JSONDecoder(parse_constant=lambda _: None)

    def more(self, size: int = 0) -> None:
        """At least one more block, and as many as ``size`` characters take."""
        parts, got = [self.held[self.at :]], 0
        while not self.over and got <= size:
            block = next(self.blocks, None)
            self.over = block is None
            if block:
                parts.append(block)
                got += len(block)
        self.held, self.at = "".join(parts), 0

    def peek(self) -> str:
        """The next character that is no space, empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.held) or self.over:
                return self.held[self.at : self.at + 1]
            self.more()

    def skip(self, what: str) -> None:
        if self.peek() != what:
            raise ValueError(f"expected {what!r} and found {self.peek()!r}")
        self.at += 1

    def value(self) -> Any:
        """The next value; the text held doubles until it is whole, so a long one is not tried again for each block."""
        self.peek()
        while True:
            try:
                got, end = self.decoder.raw_decode(self.held, self.at)
            except json.JSONDecodeError:
                if self.over:
                    raise
            else:
                if end < len(self.held) or self.over:  # a number that ends the text held may go on
                    self.at = end
                    return got
            self.more(len(self.held) - self.at)

    def elements(self, take: Callable[[], Any]) -> Iterator[Any]:
        """What ``take`` makes of every element of the array that comes next."""
        self.skip("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield take()
            if self.peek() == "]":
                self.at += 1
                return
            self.skip(",")

    def keys(self) -> Iterator[str]:
        """The keys of the object that comes next; whoever asks for them takes the value of each."""
        self.skip("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            key = self.value()
            self.skip(":")
            yield key
            if self.peek() == "}":
                self.at += 1
                return
            self.skip(",")


def _blocks(path: str) -> Iterator[str]:
    system, name = fs.FileSystem.from_uri(path)
    decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
    with system.open_input_stream(name) as stream:
        while block := stream.read(_BLOCK):
            yield decoder.decode(block)
    yield decoder.decode(b"", True)


def _wrapper(text: _Text) -> str | None:
    """The first of the known keys that holds an array, of an object read once."""
    seen = set()
    for key in text.keys():
        if text.peek() == "[":
            seen.add(key)
            if key == WRAPPERS[0]:
                break
            for _ in text.elements(text.value):
                pass
        else:
            text.value()
    return next((w for w in WRAPPERS if w in seen), None)


def records(blocks: Callable[[], Iterator[str]], key: str | None = None, *, missing: str = "error") -> Iterator[Any]:
    """The records of a JSON text, which ``blocks()`` begins anew each time."""
    text = _Text(blocks())
    if text.peek() == "[":
        yield from text.elements(text.value)
        return
    if text.peek() == "{":
        key = key or _wrapper(_Text(blocks()))
        for name in text.keys() if key else ():
            if name == key and text.peek() == "[":
                yield from text.elements(text.value)
                return
            text.value()
        if key and missing == "empty":
            return
    raise ValueError(f"expected a JSON array of records, or an object with one of {', '.join(WRAPPERS)}")


# -- columns -----------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    told = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return told.encode("utf-8", "replace").decode()  # halves of surrogate pairs have no UTF-8


def _number(bits: int) -> Callable[[Any], int | None]:
    def whole(value: Any) -> int | None:
        fits = isinstance(value, int) and not isinstance(value, bool) and -(1 << bits - 1) <= value < 1 << bits - 1
        return value if fits else None

    return whole


def _fraction(value: Any) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        return float(value)
    except OverflowError:
        return None


def caster(kind: T.DataType) -> Callable[[Any], Any]:
    """How a decoded value becomes one of a column; null stays null."""
    if isinstance(kind, T.StringType):
        made: Callable[[Any], Any] = _text
    elif isinstance(kind, (T.LongType, T.IntegerType)):
        made = _number(64 if isinstance(kind, T.LongType) else 32)
    elif isinstance(kind, T.DoubleType):
        made = _fraction
    elif isinstance(kind, T.BooleanType):
        made = lambda v: v if isinstance(v, bool) else None
    elif isinstance(kind, T.ArrayType):
        inner = caster(kind.elementType)
        made = lambda v: [inner(x) for x in v] if isinstance(v, list) else None
    elif isinstance(kind, T.StructType):
        fields = [(f.name, caster(f.dataType)) for f in kind.fields]
        made = lambda v: tuple(cast(v.get(name)) for name, cast in fields) if isinstance(v, dict) else None
    else:
        raise ValueError(f"wrapped_json has no columns of type {kind.simpleString()}")
    return lambda value: None if value is None else made(value)


_TESTS: dict[str, Callable[[Any, Any], bool]] = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda v, x: v in x, "prefix": lambda v, x: v.startswith(x), "suffix": lambda v, x: v.endswith(x), "contains": lambda v, x: x in v,
}


def tests_of(where: str | None, schema: T.StructType) -> list[tuple[str, Callable[[Any], bool]]]:
    """Columns and tests of the conditions in the option ``where``."""
    kinds = {f.name: f.dataType for f in schema.fields}
    made: list[tuple[str, Callable[[Any], bool]]] = []
    for name, test, value in json.loads(where or "[]"):
        if not isinstance(kinds.get(name), (T.StringType, T.LongType, T.IntegerType, T.BooleanType)):
            raise ValueError(f"where: {name!r} is no column of text, whole numbers or truth values")
        if test == "null":
            made.append((name, lambda v, x=value: (v is None) == x))
            continue
        cast, given = caster(kinds[name]), value if test == "in" else [value]
        if test not in _TESTS or any(cast(x) != x or isinstance(x, bool) != isinstance(kinds[name], T.BooleanType) for x in given):
            raise ValueError(f"where: {[name, test, value]} is no test of a column of type {kinds[name].simpleString()}")
        made.append((name, lambda v, x=value, holds=_TESTS[test]: v is not None and holds(v, x)))
    return made


# -- files -------------------------------------------------------------------------------------------


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


def _listed(path: str) -> list[tuple[int, str, int]]:
    """``(modified, address, bytes)`` of the files under ``path``, by time and name; hidden ones are left out."""
    system, base = fs.FileSystem.from_uri(path)
    found = [system.get_file_info(base)]
    if found[0].type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no file at {path}")
    if found[0].type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
    head = path[: len(path) - len(base)] if path.endswith(base) else ""
    own = lambda name: any(part[:1] in "._" for part in name[len(base) :].split("/") if part)
    return sorted((f.mtime_ns or 0, head + f.path, f.size) for f in found if f.type == fs.FileType.File and not own(f.path))


def _packed(files: Sequence[tuple[int, str, int]], size: int) -> list[Files]:
    """Files in partitions of about ``size`` bytes, in the order of their names."""
    made, held, room = [], [], size
    for _, path, n in sorted(files, key=lambda f: f[1]):
        if held and n > room:
            made.append(Files(tuple(held)))
            held, room = [], size
        held.append(path)
        room -= n
    return [*made, Files(tuple(held))] if held else made


class _Rows:
    """What batches and streams share: how a file becomes rows."""

    def __init__(self, schema: T.StructType, options: Any):
        self.schema, self.path, self.key = schema, options.get("path"), options.get("key")
        self.size = int(options.get("partitionbytes", 64 << 20))
        if not self.path:
            raise ValueError("wrapped_json needs a path")
        for f in schema.fields:
            caster(f.dataType)  # an unfit column is told before any task runs
        self.where, self.missing = options.get("where"), options.get("missing", "error")
        self.tests()

    def tests(self) -> list[tuple[str, Callable[[Any], bool]]]:
        return tests_of(self.where, self.schema)

    def listed(self) -> list[tuple[int, str, int]]:
        wanted = [test for name, test in self.tests() if name == FILE]
        return [f for f in _listed(self.path) if all(test(f[1]) for test in wanted)]

    def rows(self, paths: Sequence[str]) -> Iterator[tuple]:
        tests = self.tests()
        casts = {f.name: caster(f.dataType) for f in self.schema.fields}
        first = [(name, test) for name, test in tests if name not in (FILE, RECORD, RAW)]
        later = [(name, test) for name, test in tests if name in (FILE, RECORD, RAW)]
        for path in paths:
            for place, record in enumerate(records(lambda p=path: _blocks(p), self.key, missing=self.missing)):
                got = record if isinstance(record, dict) else {}
                known = {FILE: path, RECORD: place} | ({RAW: _text(record)} if RAW in casts else {})
                if all(test(casts[name](got.get(name))) for name, test in first) and all(test(known[name]) for name, test in later):
                    yield tuple(known[name] if name in known else cast(got.get(name)) for name, cast in casts.items())


class _Reader(_Rows, ds.DataSourceReader):
    def partitions(self) -> list[Files]:
        return _packed(self.listed(), self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition.paths if partition else ())


class _Stream(_Rows, ds.DataSourceStreamReader):
    """An offset is the modification time and name of the last file taken.

    A file must be whole when it appears and not be older than files that were there before, as when it is written
    elsewhere and moved in; files of one time are taken by name.  A micro-batch takes all that is new.
    """

    def __init__(self, schema: T.StructType, options: Any):
        super().__init__(schema, options)
        self.reached: tuple[int, str] = (-1, "")

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        new = [f for f in self.listed() if f[:2] > self.reached]
        if new:
            self.reached = new[-1][:2]
        return {"time": self.reached[0], "file": self.reached[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, last = ((at["time"], at["file"]) for at in (start, end))
        self.reached = max(self.reached, last)  # a restart goes on from its checkpoint
        return _packed([f for f in self.listed() if after < f[:2] <= last], self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition.paths if partition else ())


class _Array(ds.DataSourceWriter):
    """Each task's rows become one object with an array, written as they come; a commit gives the files their names.

    A lost or repeated task leaves hidden files of names of their own, which the commit deletes or does not know.
    """

    def __init__(self, schema: T.StructType, options: Any):
        self.names, self.path, self.key = schema.names, options.get("path"), options.get("key", WRAPPERS[0])

    def write(self, iterator: Iterator[Any]) -> Written:
        system, base = fs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        held, n = f"{base}/.{uuid.uuid4().hex}", 0
        with system.open_output_stream(held) as out:
            out.write(f"{{{json.dumps(self.key)}: [".encode())
            for row in iterator:
                told = {name: value.asDict(True) if hasattr(value, "asDict") else value for name, value in zip(self.names, row)}
                out.write((",\n" if n else "\n").encode() + json.dumps(told, ensure_ascii=False, default=str).encode())
                n += 1
            out.write(b"\n]}\n")
        return Written(held, n)

    def commit(self, messages: list[Any]) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        run = uuid.uuid4().hex[:8]
        for i, each in enumerate(m for m in messages if m is not None):
            if each.n:
                system.move(each.held, f"{base}/part-{i:05d}-{run}.json")
            else:
                system.delete_file(each.held)

    def abort(self, messages: list[Any]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for each in messages:
            if each is not None:
                system.delete_file(each.held)


@dataclass
class Written(ds.WriterCommitMessage):
    held: str
    n: int


class WrappedJson(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "wrapped_json"

    def schema(self) -> T.StructType:
        raise ValueError("wrapped_json needs a schema: spark.read.format('wrapped_json').schema(...)")

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:
        return _Stream(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError("wrapped_json only adds files; use mode('append') with a folder of its own")
        return _Array(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, whose Python workers import it from this package."""
    prepare(spark)
    spark.dataSource.register(WrappedJson)


def write(rows: DataFrame, path: str, *, files: int | None = None, key: str = WRAPPERS[0]) -> None:
    """``rows`` as JSON objects with an array under ``key``, one a task (or ``files`` in all), none of them held whole."""
    register(rows.sparkSession)
    dealt = rows if files is None else rows.repartition(files)
    dealt.write.format("wrapped_json").option("key", key).mode("append").save(path)
