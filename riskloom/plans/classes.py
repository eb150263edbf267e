"""Class files made of the parts, a class for each and an archive for every 64, parsed again; every tenth class is cut off, and one archive in 7 is damaged."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.registry import register
from riskloom.sources import classfiles


def class_bytes(name: str, methods: list[tuple[str, list[tuple[str, str]]]], fields: tuple[str, ...] = (), super_: str = "java/lang/Object") -> bytes:
    """A class whose methods, without arguments, call static methods (owner, name) one after the other, with a switch, a wide increment and padding between."""
    pool: list[bytes] = []

    def constant(body: bytes) -> int:
        if body not in pool:
            pool.append(body)
        return pool.index(body) + 1

    def text(s: str) -> int:
        return constant(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())

    def class_(s: str) -> int:
        return constant(b"\x07" + struct.pack(">H", text(s)))

    def method(owner: str, s: str) -> int:
        both = constant(b"\x0c" + struct.pack(">HH", text(s), text("()V")))
        return constant(b"\x0a" + struct.pack(">HH", class_(owner), both))

    def code(calls: list[tuple[str, str]]) -> bytes:
        out = b"\xc4\x84\x00\x01\xb8\xb8"  # a wide increment, whose bytes look like calls
        for owner, s in calls:
            out += b"\xb8" + struct.pack(">H", method(owner, s))
        out += b"\x03\xab"
        out += b"\x00" * (-len(out) % 4) + struct.pack(">ii", 12, 1) + struct.pack(">ii", 0xB8B8, 12)
        return out + b"\xb1"

    body = struct.pack(">HHH", 0x21, class_(name), class_(super_)) + struct.pack(">H", 0)
    body += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHHH", 2, text(f), text("I"), 0) for f in fields)
    body += struct.pack(">H", len(methods))
    for s, calls in methods:
        inner = code(calls)
        inner = struct.pack(">HHI", 2, 2, len(inner)) + inner + struct.pack(">HH", 0, 0)
        body += struct.pack(">HHHH", 9, text(s), text("()V"), 1) + struct.pack(">HI", text("Code"), len(inner)) + inner
    return struct.pack(">IHHH", classfiles.MAGIC, 0, 61, len(pool) + 1) + b"".join(pool) + body


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): archives of 64 parts' classes each, of which method `size` has as many calls as the part's size has tens."""

    def packed(rows: pa.Table) -> pa.Table:
        out, group = io.BytesIO(), rows.column("group")[0].as_py()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for key, size, brand in zip(rows.column("p_partkey").to_pylist(), rows.column("p_size").to_pylist(), rows.column("p_brand").to_pylist(), strict=True):
                data = class_bytes(f"parts/P{key}", [("size", [(f"brands/{brand}", f"m{i}") for i in range(size // 10)])], fields=("key",))
                archive.writestr(f"parts/P{key}.class", data[:-5] if key % 10 == 0 else data)
                archive.writestr(f"parts/P{key}.txt", "no class")
        data = out.getvalue()
        return pa.table({"path": [f"shop{group}.jar"], "content": pa.array([data[:-30] if group % 7 == 0 else data], pa.binary())})

    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(F.col("p_partkey") / 64).alias("group"), "p_partkey", "p_size", "p_brand")
    return rows.groupBy("group").applyInArrow(packed, "path string, content binary")


_GOOD = "SELECT p_partkey, p_size, p_brand, 'shop' || p_partkey // 64 || '.jar' AS path, 'parts/P' || p_partkey || '.class' AS entry FROM part WHERE p_partkey // 64 % 7 <> 0"


@register("s21_classes", f"""SELECT path, entry, CASE WHEN p_partkey % 10 <> 0 THEN 'parts/P' || p_partkey END AS class, CASE WHEN p_partkey % 10 <> 0 THEN 'java/lang/Object' END AS super, CASE WHEN p_partkey % 10 <> 0 THEN 61 END AS version,
    CASE WHEN p_partkey % 10 <> 0 THEN 'key' END AS fields, CASE WHEN p_partkey % 10 <> 0 THEN 'size' END AS methods, CASE WHEN p_partkey % 10 = 0 THEN 'cut off' END AS error FROM ({_GOOD})
    UNION ALL SELECT DISTINCT 'shop' || p_partkey // 64 || '.jar', NULL, NULL, NULL, NULL::INT, NULL, NULL, 'damaged archive' FROM part WHERE p_partkey // 64 % 7 = 0""")  # fmt: skip
def classes(spark, sf_dir):
    told = classfiles.classes(archives(spark, sf_dir))
    return told.select("path", "entry", "class", "super", "version", F.array_join("fields", ",").alias("fields"), F.array_join("methods.name", ",").alias("methods"), "error")


@register("s21_invocations", f"SELECT path, entry, 'parts/P' || p_partkey AS class, 'size' AS method, i::INT AS place, 'static' AS kind, 'brands/' || p_brand AS owner, 'm' || i AS name, '()V' AS descriptor FROM ({_GOOD}), range(0, 6) r(i) WHERE i < p_size // 10 AND p_partkey % 10 <> 0")
def invocations(spark, sf_dir):
    return classfiles.invocations(classfiles.classes(archives(spark, sf_dir)))
