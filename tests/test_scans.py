"""Scans that stop and say so, and tables of unequal rows."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers as R
from corpusloom.sources.scans import list_folder, scan_tree, with_contents


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a.txt", "b.tmp", "z/1.txt", "z/2.txt", "z/deep/er/3.txt", "y/4.md", ".git/config", "x/.DS_Store"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    os.symlink(root / "z", root / "link")
    return str(root)


def below(root, df):
    return sorted(r["path"].removeprefix(f"{root}/") for r in df.collect())


def stops(root, scan):
    return {(r["path"].removeprefix(f"{root}/"), r["reason"]) for r in scan.stops.collect()}


def test_a_whole_scan(spark, tree):
    scan = scan_tree(spark, tree)
    assert below(tree, scan.files) == ["a.txt", "y/4.md", "z/1.txt", "z/2.txt", "z/deep/er/3.txt"]
    assert below(tree, scan.folders) == ["x", "y", "z", "z/deep", "z/deep/er"]
    assert not scan.partial
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], bytes(r["content"])) for r in with_contents(scan.files).collect()}
    assert got["3.txt"] == (15, b"z/deep/er/3.txt") and len(got) == 5
    assert scan.files.where("modified IS NULL").isEmpty()


def test_depth_and_number_of_files(spark, tree):
    flat = scan_tree(spark, tree, max_depth=0)
    assert below(tree, flat.files) == ["a.txt"] and stops(tree, flat) == {("x", "maxDepth"), ("y", "maxDepth"), ("z", "maxDepth")}
    few = scan_tree(spark, tree, max_files=2)
    assert below(tree, few.files) == ["a.txt", "y/4.md"] and stops(tree, few) == {(tree, "maxFiles")}
    enough = scan_tree(spark, tree, max_files=5)
    assert not enough.partial


def test_slow_and_unreadable_folders_are_left_out(spark, tree):
    def lister(path):
        if path.endswith("/y"):
            time.sleep(3)
        if path.endswith("/deep"):
            raise PermissionError("no entry")
        return list_folder(path)

    scan = scan_tree(spark, tree, lister=lister, folder_timeout_s=0.5)
    assert below(tree, scan.files) == ["a.txt", "z/1.txt", "z/2.txt"]
    assert stops(tree, scan) == {("y", "timeout"), ("z/deep", "error")}
    assert {r["message"] for r in scan.stops.collect()} == {"no answer in 0.5 s", "no entry"}


def test_a_scan_ends_at_its_deadline(spark, tree):
    assert stops(tree, scan_tree(spark, tree, deadline_s=-1)) == {(tree, "deadline")}

    def lister(path):
        if not path.endswith("root"):
            time.sleep(2)
        return list_folder(path)

    scan = scan_tree(spark, tree, lister=lister, deadline_s=1.0, folder_timeout_s=30)
    assert "a.txt" in below(tree, scan.files) and "deadline" in {r for _, r in stops(tree, scan)}


def test_missing_folder_and_gone_file(spark, tmp_path):
    scan = scan_tree(spark, str(tmp_path / "none"))
    assert {r["reason"] for r in scan.stops.collect()} == {"error"} and scan.files.isEmpty()
    df = spark.createDataFrame([(str(tmp_path / "gone"), 1), (None, 2)], "path string, n int")
    assert [r["content"] for r in with_contents(df).collect()] == [None, None]


def test_rows_of_unequal_width(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿x\ny,z\n\n"a\nb",c,d\n' + ",".join(map(str, range(130))) + "\n", encoding="utf-8")
    lines = R.csv_text(spark, str(tmp_path / "r.csv")).first()["text"].replace("a\nb", "a b").split("\n")
    assert lines[:3] == ["x", "y z", "a b c d"]
    assert lines[3].split() == [str(n) for n in range(100)]


def test_a_workbook_has_its_strings_in_its_cells(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst><si><t>Name</t></si><si><r><t>Ann </t></r><r><t xml:space="preserve">&amp; Bo</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="3"/><c r="C1"><v>7.5</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="C2" t="s"><v>99</v></c></row></sheetData></worksheet>')
    df = R.scan(spark, str(tmp_path), pattern="*.xlsx")
    assert df.select(R.document_text("path", "content").alias("t")).first()["t"] == "Name 7.5\nAnn & Bo in"
    assert R.scan(spark, str(tmp_path), max_files=1).select(F.length("content").alias("n")).first()["n"] > 0
