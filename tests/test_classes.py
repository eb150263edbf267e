"""Class files by hand: written to disk, alone and in archives, whole and damaged."""

from __future__ import annotations

import io
import zipfile

import pytest

from riskloom.plans.classes import class_bytes
from riskloom.sources import classfiles
from riskloom.sources.classfiles import ClassFile


def test_one_class():
    c = ClassFile(class_bytes("a/B", [("f", [("x/Y", "g"), ("x/Y", "h"), ("x/Z", "g")]), ("empty", [])], fields=("one", "zwei"), super_="a/A"))
    assert (c.name, c.super, c.version, c.fields, c.interfaces) == ("a/B", "a/A", 61, ["one", "zwei"], [])
    assert [(m["name"], [(k["kind"], k["owner"], k["name"]) for k in m["calls"]]) for m in c.methods] == [("f", [("static", "x/Y", "g"), ("static", "x/Y", "h"), ("static", "x/Z", "g")]), ("empty", [])]


def test_every_cut_is_an_error_or_whole():
    data = class_bytes("a/B", [("f", [("x/Y", "g")])])
    for n in range(len(data) - 2):  # the last two bytes count the class's attributes, which aren't read
        with pytest.raises((ValueError, IndexError)):
            ClassFile(data[:n])


def test_files_and_archives(spark, tmp_path):
    good = class_bytes("p/Good", [("f", [("q/Q", "g")])])
    (tmp_path / "sub").mkdir()
    (tmp_path / "Good.class").write_bytes(good)
    (tmp_path / "sub" / "Text.class").write_bytes(b"hello")
    (tmp_path / "other.txt").write_bytes(good)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("p/Good.class", good)
        z.writestr("p/Short.class", good[:40])
        z.writestr("README", "text")
    (tmp_path / "two.jar").write_bytes(held.getvalue())
    (tmp_path / "bad.jar").write_bytes(held.getvalue()[:60])
    (tmp_path / "empty.jar").write_bytes(b"")  # files without bytes are no rows of the reader
    rows = classfiles.classes(classfiles.class_files(spark, f"file://{tmp_path}")).collect()
    got = {(r.path.rpartition("/")[2], r.entry): (r["class"], r.error) for r in rows}
    assert got == {
        ("Good.class", "Good.class"): ("p/Good", None), ("Text.class", "Text.class"): (None, "not a class file"), ("two.jar", "p/Good.class"): ("p/Good", None),
        ("two.jar", "p/Short.class"): (None, "cut off"), ("bad.jar", None): (None, "damaged archive"),
    }
    calls = classfiles.invocations(classfiles.classes(classfiles.class_files(spark, f"file://{tmp_path}"), spread=False)).collect()
    assert sorted((r.method, r.place, r.owner, r.name) for r in calls) == [("f", 0, "q/Q", "g")] * 2
    assert classfiles.classes(spark.createDataFrame([("x.class", None)], "path string, content binary")).count() == 0
