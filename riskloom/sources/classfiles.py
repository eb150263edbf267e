"""Class files, alone or in archives: their constant pool, fields, methods and what the methods' code invokes.

Files come through Spark's binaryFile reader, from whichever store it reads.  `entries` gives each class of an archive a row of
its own, and `classes` parses rows, dealt by entry before, so that a large archive isn't one task's work.
What can't be read is a row with an error and nulls: archives that are damaged, and classes that are cut off or no classes.
The reader has no rows of files without bytes.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = 0xCAFEBABE
#: Fixed: bytes of the entries of a constant pool after their tag; a text (1) has its own length, long (5) and double (6) take two places.
CONSTANTS = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
#: Fixed: instructions that take bytes, by how many; those that aren't named take none.
OPERANDS = {
    1: (0x10, 0x12, *range(0x15, 0x1A), *range(0x36, 0x3B), 0xA9, 0xBC),
    2: (0x11, 0x13, 0x14, 0x84, *range(0x99, 0xA9), *range(0xB2, 0xB9), 0xBB, 0xBD, 0xC0, 0xC1, 0xC6, 0xC7),
    3: (0xC5,),
    4: (0xB9, 0xBA, 0xC8, 0xC9),
}
_LENGTH = {op: n for n, ops in OPERANDS.items() for op in ops}
INVOKES = {0xB6: "virtual", 0xB7: "special", 0xB8: "static", 0xB9: "interface", 0xBA: "dynamic"}
TABLE, LOOKUP, WIDE, WIDE_INCREMENT = 0xAA, 0xAB, 0xC4, 0x84

CALL = pa.struct([("kind", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("descriptor", pa.string())])
METHOD = pa.struct([("name", pa.string()), ("descriptor", pa.string()), ("access", pa.int32()), ("code_bytes", pa.int32()), ("calls", pa.list_(CALL))])
SCHEMA = (
    "path string, entry string, class string, super string, access int, version int, interfaces array<string>, fields array<string>, "
    "methods array<struct<name: string, descriptor: string, access: int, code_bytes: int, calls: array<struct<kind: string, owner: string, name: string, descriptor: string>>>>, error string"
)


class ClassFile:
    """One class, read from its bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        if self.number(4) != MAGIC:
            raise ValueError("not a class file")
        self.number(2)
        self.version = self.number(2)
        self.pool: list[tuple[int, bytes]] = [(0, b"")]
        count = self.number(2)
        while len(self.pool) < count:
            tag = self.number(1)
            if tag != 1 and tag not in CONSTANTS:
                raise ValueError(f"unknown constant {tag}")
            self.pool.append((tag, self.take(self.number(2) if tag == 1 else CONSTANTS[tag])))
            if tag in (5, 6):
                self.pool.append((0, b""))
        self.access, own, above = self.number(2), self.number(2), self.number(2)
        self.name, self.super = self.named(own), self.named(above) if above else None
        self.interfaces = [self.named(self.number(2)) for _ in range(self.number(2))]
        self.fields = [m[0] for m in self.members()]
        self.methods = [{"name": n, "descriptor": d, "access": a, "code_bytes": len(c) if c is not None else None, "calls": self.calls(c or b"")} for n, d, a, c in self.members()]

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("cut off")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def entry(self, i: int, *tags: int) -> bytes:
        if not 0 < i < len(self.pool) or self.pool[i][0] not in tags:
            raise ValueError(f"constant {i} isn't what it should be")
        return self.pool[i][1]

    def text(self, i: int) -> str:
        return self.entry(i, 1).decode("utf-8", "replace")

    def named(self, i: int) -> str:
        return self.text(int.from_bytes(self.entry(i, 7), "big"))

    def members(self) -> Iterator[tuple[str, str, int, bytes | None]]:
        """(name, descriptor, access, code) of the fields or methods that begin here."""
        for _ in range(self.number(2)):
            access, name, descriptor, code = self.number(2), self.text(self.number(2)), self.text(self.number(2)), None
            for _ in range(self.number(2)):
                kind, body = self.text(self.number(2)), self.take(self.number(4))
                if kind == "Code":
                    size = int.from_bytes(body[4:8], "big")
                    code = body[8 : 8 + size]
            yield name, descriptor, access, code

    def calls(self, code: bytes) -> list[dict]:
        """What the instructions of a method invoke, in order."""
        out, i = [], 0
        while i < len(code):
            op = code[i]
            if op in INVOKES:
                out.append(self.call(INVOKES[op], int.from_bytes(code[i + 1 : i + 3], "big")))
            if op in (TABLE, LOOKUP):
                start = i + 4 - i % 4
                _, a, b = struct.unpack_from(">iii", code, start) if op == TABLE else (0, 0, struct.unpack_from(">i", code, start + 4)[0])
                i = start + (12 + 4 * (b - a + 1) if op == TABLE else 8 + 8 * b)
            elif op == WIDE:
                i += 6 if code[i + 1 : i + 2] == bytes([WIDE_INCREMENT]) else 4
            else:
                i += 1 + _LENGTH.get(op, 0)
        return out

    def call(self, kind: str, i: int) -> dict:
        body = self.entry(i, 10, 11, 18)
        owner = None if kind == "dynamic" else self.named(int.from_bytes(body[:2], "big"))
        both = self.entry(int.from_bytes(body[2:4], "big"), 12)
        return {"kind": kind, "owner": owner, "name": self.text(int.from_bytes(both[:2], "big")), "descriptor": self.text(int.from_bytes(both[2:4], "big"))}


def class_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the class files and archives below path."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{class,jar}").option("recursiveFileLookup", "true").load(path)
    return read.select("path", "content")


def entries(files: DataFrame) -> DataFrame:
    """(path, entry, content, error) of files(path, content): each class of an archive, and each file that is one; null content has no entry."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for row in _entries(path or "", data):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([v], k) for v, k in zip(row, (pa.string(), pa.binary(), pa.string()), strict=True))], names=["path", "entry", "content", "error"])

    return files.select("path", "content").where("content is not null").mapInArrow(opened, "path string, entry string, content binary, error string")


def _entries(path: str, data: bytes) -> Iterator[tuple]:
    if not path.endswith(".jar"):
        yield path.rpartition("/")[2], data, None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield None, None, "damaged archive"
        return
    for info in archive.infolist():
        if info.filename.endswith(".class"):
            try:
                yield info.filename, archive.read(info), None
            except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, RuntimeError):
                yield info.filename, None, "damaged entry"


def classes(files: DataFrame, spread: bool = True) -> DataFrame:
    """path, entry, class, super, access, version, interfaces, fields, methods and error of every class in files(path, content).

    spread: whether entries are dealt out before they are parsed, for archives of many classes.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                told = dict.fromkeys(("class", "super", "access", "version", "interfaces", "fields", "methods"))
                error = r["error"]
                if error is None:
                    try:
                        c = ClassFile(r["content"])
                        told = {"class": c.name, "super": c.super, "access": c.access, "version": c.version, "interfaces": c.interfaces, "fields": c.fields, "methods": c.methods}
                    except (ValueError, IndexError, struct.error) as e:
                        error = str(e)
                rows.append({"path": r["path"], "entry": r["entry"], **told, "error": error})
            kinds = [("path", pa.string()), ("entry", pa.string()), ("class", pa.string()), ("super", pa.string()), ("access", pa.int32()), ("version", pa.int32()), ("interfaces", pa.list_(pa.string())), ("fields", pa.list_(pa.string())), ("methods", pa.list_(METHOD)), ("error", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    rows = entries(files)
    return (rows.repartition("path", "entry") if spread else rows).mapInArrow(parsed, SCHEMA)


def invocations(parsed: DataFrame) -> DataFrame:
    """(path, entry, class, method, place, kind, owner, name, descriptor): the calls of every method, in order."""
    m = parsed.where("error is null").select("path", "entry", "class", F.explode("methods").alias("m"))
    return m.select("path", "entry", "class", F.col("m.name").alias("method"), F.posexplode("m.calls").alias("place", "c")).select("path", "entry", "class", "method", "place", "c.*")
