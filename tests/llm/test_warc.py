import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.llm.warc import audit, copy_files, fixity_drill, fixity_report, leaf_table, ranges_of, read_records, record_column, tree_levels, write_records


def pages(spark, n=700, parts=3):
    return spark.range(n).repartition(parts).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("é<p>"), (F.col("id") % 50).cast("int")).alias("html"))


def test_records_are_valid(spark):
    r = spark.createDataFrame([(1, "a\r\nb", "<p>é")], "page_id long, url string, html string").select(record_column(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first()["r"].encode()
    head, rest = r.split(b"\r\n\r\n", 1)
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    n = int(fields[b"Content-Length"])
    assert rest[n:] == b"\r\n\r\n" and rest[:n].endswith("<p>é".encode()) and fields[b"WARC-Target-URI"] == b"a%0D%0Ab"


def test_files_give_the_pages_back(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, None), (None, None, None), (3, "u\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\n" * 9), (3, "u", "y" * 30_000)], "page_id long, url string, html string")
    both = pages(spark, 90).unionByName(odd)
    write_records(both, str(tmp_path / "w"), file_bytes=8_000)
    files = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("part-*") if p.stat().st_size}
    assert len(files) > 5
    rows = read_records(spark, str(tmp_path / "w")).collect()
    digests = sorted(hashlib.sha256(data[a:b]).hexdigest() for data in files.values() for a, b in ranges_of(data))
    assert sorted(r["digest"] for r in rows) == digests and len(rows) == 94
    for f in {r["file"] for r in rows}:  # ranges lie end to end
        mine = sorted((r["offset"], r["length"]) for r in rows if r["file"] == f)
        assert [a for a, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]
    clean = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    want = sorted((str(r["page_id"]) if r["page_id"] is not None else "", clean(r["url"]), r["html"] or "") for r in both.collect())
    assert sorted((r["page_id"] or "", r["url"], r["html"]) for r in rows) == want


def test_tree_against_brute_force(spark, tmp_path):
    write_records(pages(spark), str(tmp_path / "w"), file_bytes=20_000)
    records = read_records(spark, str(tmp_path / "w"), ("digest",))
    levels = tree_levels(leaf_table(records), 4)
    roots = {r["file"]: r["hash"] for r in levels[-1].collect()}
    files = {}
    for r in sorted(records.collect(), key=lambda r: (r["file"], r["offset"])):
        files.setdefault(r["file"], []).append(r)
    assert len(files) > 3 and len(files) == len(roots)
    for f, rs in files.items():
        level = [(hashlib.sha256(f"{r['offset']}:{r['length']}:{r['digest']}".encode()).hexdigest(), r["offset"], r["offset"] + r["length"]) for r in rs]
        for _ in levels[1:]:
            level = [(hashlib.sha256(("".join(h for h, _, _ in c) + f"{c[0][1]}:{c[-1][2]}").encode()).hexdigest(), c[0][1], c[-1][2]) for c in (level[i : i + 4] for i in range(0, len(level), 4))]
        assert len(level) == 1 and roots[f] == level[0][0]


def test_one_byte_is_found_alone(spark, tmp_path):
    write_records(pages(spark), str(tmp_path / "a"), file_bytes=20_000)
    copy_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    ours = read_records(spark, str(tmp_path / "a"), ("digest", "page_id"))
    theirs = lambda: read_records(spark, str(tmp_path / "b"), ("digest",))
    assert audit(ours, theirs()).count() == 0
    rows = ours.collect()
    hit = next(r for r in rows if r["page_id"] == "333")
    (path,) = (tmp_path / "b" / f"file={hit['file']}").glob("part-*")
    for place in (5, 140, 200, hit["length"] - 1):  # in the mark, a header, the body, the end
        data = bytearray(path.read_bytes())
        data[hit["offset"] + place] ^= 1
        _rewrite(path, data)
        assert [r["page_id"] for r in fixity_report(ours, theirs(), 4).where("state <> 'intact'").collect()] == ["333"], place
        data[hit["offset"] + place] ^= 1
        _rewrite(path, data)
    _rewrite(path, data[:-1])  # a lost byte at the end of a file
    last = max((r for r in rows if r["file"] == hit["file"]), key=lambda r: r["offset"])
    assert [r["page_id"] for r in fixity_report(ours, theirs()).where("state <> 'intact'").collect()] == [last["page_id"]]


def _rewrite(path: Path, data: bytes):
    path.write_bytes(data)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def test_drill_finds_exactly_the_damage(spark, tmp_path):
    report = fixity_drill(pages(spark), str(tmp_path), damaged_ids=r"\d*[05]0", file_bytes=20_000).collect()
    assert len(report) == 700
    assert {r["page_id"] for r in report if r["state"] == "corrupt"} == set(range(50, 700, 50))
    assert {r["state"] for r in report} == {"corrupt", "intact"}


def test_damaged_streams(spark, tmp_path):
    for name in ("a", "b"):
        write_records(pages(spark, 300, 1), str(tmp_path / name), file_bytes=8_000, compression="gzip")
    ours, theirs = (read_records(spark, str(tmp_path / name), ("digest", "page_id")) for name in ("a", "b"))
    assert ours.count() == 300 and audit(ours, theirs).count() == 0
    path = sorted((tmp_path / "b").glob("part-*"))[1]
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 255
    _rewrite(path, data)
    bad = fixity_report(ours, theirs).where("state <> 'intact'").collect()
    assert bad and len({r["file"] for r in bad}) == 1
    mine = sorted(r["offset"] for r in ours.where(F.col("file") == bad[0]["file"]).collect())
    assert max(r["offset"] for r in bad) == mine[-1]


def test_lost_record_and_edges(spark, tmp_path):
    write_records(pages(spark, 40, 1), str(tmp_path / "w"))
    records = read_records(spark, str(tmp_path / "w"), ("digest", "page_id"))
    at7 = next(r["offset"] for r in records.collect() if r["page_id"] == "7")
    assert (at7, "missing") in {(r["offset"], r["state"]) for r in audit(records, records.where("page_id <> '7'"), 4).collect()}
    odd = spark.createDataFrame([(None, None, None, 1), (None, None, None, 2), (3, "u", "x" * 300_000, 3)], "page_id long, url string, html string, digest int")
    got = fixity_drill(odd, str(tmp_path / "odd")).collect()
    assert len(got) == 3 and {r["state"] for r in got} == {"intact"}
    assert fixity_drill(odd.limit(0), str(tmp_path / "none")).count() == 0
    assert list(ranges_of(b"")) == [] and list(ranges_of(b"junk")) == [(0, 4)]
