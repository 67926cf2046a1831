"""WARC files and a Merkle fixity audit of replicas.

Pages become WARC response records, which ``write_records`` stores where they are read: every
task writes files of about ``FILE_BYTES``, and no body is shuffled. ``copy_files`` makes a
replica, and ``read_records`` goes through stored bytes: it gives every record's range of
offsets, the digest of the bytes there, and the page. The audit hashes ranges (offset, length,
digest) into leaves, every ``FANOUT`` leaves in offset order into a node, and so on up to one
root a file. Roots of two replicas are compared first, and only below nodes that differ are
the children compared, down to the records.

Defined results: a null url or body is written as empty, line ends in a url percent-encoded;
an empty table has no records. Rows that repeat become records of their own. A reader that
meets a broken header goes on at the next record's mark, so that damage stays where it is; the
lost stretch is one range, without a page. Files may be gzip streams, in which offsets count
what comes out; behind damage to the stream itself nothing can be read, so what follows it in
that file is missing. A record that one replica lacks, or has in another
place, is reported as missing there. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches
from corpusloom.session import cut_lineage

FANOUT = 16
FILE_BYTES = 32 << 20
MARK, END = b"WARC/1.1\r\n", b"\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n\r\n")


def record_column(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 response record; the date is fixed, so that a record depends on its page alone."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, http, F.lit("\r\n\r\n"))


def write_records(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES, compression: str = "none") -> None:
    """The records as text files of concatenated WARC records; files end after as many as make ``file_bytes`` on average."""
    record = record_column(F.col(id_col), F.col(url_col), F.col(html_col))
    mean = pages.agg(F.avg(F.octet_length(record))).first()[0] or 1
    rows = pages.select(record.alias("record"))
    _write(rows, "record", path, compression, max(1, int(file_bytes / mean)))


def _write(rows: DataFrame, column: str, path: str, compression: str, most: int = 0, by: tuple[str, ...] = ()) -> None:
    """Texts that end in a line end, one after the other."""
    all_but_last_line_end = F.col(column).substr(F.lit(1), F.length(column) - 2)
    rows.select(*by, all_but_last_line_end.alias("value")).write.partitionBy(*by).option("maxRecordsPerFile", most).option("compression", compression).option("lineSep", "\r\n").text(path)


def _file_of(path: Column) -> Column:
    """A file's name in all replicas: its task and number, or what its folder says."""
    named, made = F.regexp_extract(path, r"/file=([^/]+)/", 1), F.regexp_extract(path, r"/part-(\d+)-.*c(\d+)\.txt(?:\.gz)?$", 1)
    number = F.regexp_extract(path, r"/part-(\d+)-.*c(\d+)\.txt(?:\.gz)?$", 2)
    return F.when(named != "", named).otherwise(F.concat_ws("-", made, number))


def copy_files(spark: SparkSession, path: str, to: str, damaged_ids: str | None = None, compression: str = "none") -> None:
    """A replica of stored files, each read and written as a whole.

    For drills: in records whose id matches the pattern ``damaged_ids`` one stored byte becomes another.
    """
    rows = spark.read.text(path, wholetext=True).select(_file_of(F.col("_metadata.file_path")).alias("file"), "value").where("value <> ''")
    if damaged_ids:
        rows = rows.withColumn("value", F.regexp_replace("value", rf"(WARC/1\.1\r\nWARC-Type: )r(?=esponse\r\nWARC-Record-ID: <urn:page:{damaged_ids}>)", "$1R"))
    _write(rows, "value", to, compression, by=("file",))


def ranges_of(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, end) of the records of a file; a stretch that is none, or whose length leads nowhere, goes up to the next mark."""
    at, n = 0, len(data)
    while at < n:
        end = None
        if data.startswith(MARK, at) and (found := _LENGTH.search(data, at, min(n, at + 65_536))):
            end = found.end() + int(found[1]) + len(END)
        if end is None or end > n or not (end == n or data.startswith(MARK, end) or data.startswith(END, end - len(END))):
            end = data.find(END + MARK, at)
            end = n if end < 0 else end + len(END)
        yield at, end
        at = end


def unpacked(content: bytes) -> bytes:
    """The bytes of a file, gzip or plain; a damaged stream gives what comes out before the damage."""
    if content[:2] != b"\x1f\x8b":
        return content
    stream, out = zlib.decompressobj(31), []
    for a in range(0, len(content), 4_096):
        try:
            out.append(stream.decompress(content[a : a + 4_096]))
        except zlib.error:
            break
    return b"".join(out)


def read_records(spark: SparkSession, path: str, fields: tuple[str, ...] = ("digest", "page_id", "url", "html")) -> DataFrame:
    """(file, offset, length, and the asked-for fields) of every range in the bytes of stored files.

    ``digest`` is the SHA-256 of the bytes; page_id, url and html are null in a range that is no
    whole record, and page_id where it is empty. A file is read as a whole.
    """

    def page_of(record: bytes) -> dict[str, str | None]:
        parts = record.split(END, 2)
        head = dict(line.split(b": ", 1) for line in parts[0].split(b"\r\n")[1:] if b": " in line)
        if len(parts) < 3 or head.get(b"WARC-Type") != b"response":
            return {}
        name = head.get(b"WARC-Record-ID", b"").removeprefix(b"<urn:page:").removesuffix(b">")
        text = lambda x: x.decode(errors="replace")
        return {"page_id": text(name) or None, "url": text(head.get(b"WARC-Target-URI", b"")), "html": text(parts[2][: -len(END)]) if "html" in fields else None}

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                rows, content = [], unpacked(content)
                for a, b in ranges_of(content):
                    record = content[a:b]
                    got = {"digest": hashlib.sha256(record).hexdigest()} | (page_of(record) if {*fields} - {"digest"} else {})
                    rows.append((file, a, b - a, *(got.get(name) for name in fields)))
                yield pd.DataFrame(rows, columns=["file", "offset", "length", *fields])

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(_file_of(F.col("path")).alias("file"), "content")
    return files.mapInPandas(parsed, ", ".join(["file string, offset long, length long", *(f"{name} string" for name in fields)]))


def leaf_table(records: DataFrame) -> DataFrame:
    """(file, node, offset, length, hash): leaves in offset order, numbered from 0."""
    node = F.row_number().over(Window.partitionBy("file").orderBy("offset")) - 1
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    return records.select("file", node.cast("long").alias("node"), "offset", "length", leaf.alias("hash"))


def tree_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots: (file, node, offset, length, hash) each.

    A node's hash covers its children's in order, and with them the range of offsets; a node
    gathers ``fanout`` rows at most.
    """
    levels = [cut_lineage(leaves)]
    while True:
        below = levels[-1]
        widest = below.agg(F.max("node")).first()[0]
        if not widest:
            return levels
        child = F.struct("node", "hash", "offset", "length")
        up = below.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        first, last = F.col("c")[0], F.element_at("c", -1)
        hashed = F.sha2(F.concat(F.array_join(F.transform("c", lambda x: x["hash"]), ""), F.concat_ws(":", first["offset"], last["offset"] + last["length"])), 256)
        levels.append(cut_lineage(up.select("file", F.col("parent").alias("node"), first["offset"].alias("offset"), (last["offset"] + last["length"] - first["offset"]).alias("length"), hashed.alias("hash"))))


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, length, state) of ranges that differ between replicas.

    state: 'corrupt' if both have a range at the place, else 'missing' (theirs lacks it) or
    'surplus' (ours does). Only children of nodes that differ are joined at each level.
    """
    a, b = tree_levels(leaf_table(ours), fanout), tree_levels(leaf_table(theirs), fanout)
    top = max(len(a), len(b))
    same_top = lambda levels: levels + [levels[-1]] * (top - len(levels))
    a, b = same_top(a), same_top(b)
    differing = None
    for x, y in zip(reversed(a[1:]), reversed(b[1:]), strict=True):
        if differing is not None:
            below = differing.select("file", F.col("node").alias("above"))
            x, y = (t.join(below, (t["file"] == below["file"]) & (F.floor(t["node"] / fanout) == below["above"]), "left_semi") for t in (x, y))
        both = x.select("file", "node", F.col("hash").alias("h1")).join(y.select("file", "node", F.col("hash").alias("h2")), ["file", "node"], "full")
        differing = cut_lineage(both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", "node"))
    x, y = a[0], b[0]
    if differing is not None:
        below = differing.select("file", F.col("node").alias("above"))
        x, y = (t.join(below, (t["file"] == below["file"]) & (F.floor(t["node"] / fanout) == below["above"]), "left_semi") for t in (x, y))
    both = x.select("file", "offset", "length", F.col("hash").alias("h1")).join(y.select("file", "offset", F.col("length").alias("l2"), F.col("hash").alias("h2")), ["file", "offset"], "full")
    state = F.when(F.col("h1").isNull(), "surplus").when(F.col("h2").isNull(), "missing").otherwise("corrupt")
    return both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", "offset", F.coalesce("length", "l2").alias("length"), state.alias("state"))


def fixity_report(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``ours`` (file, offset, length, digest, ...) with the state of every range: 'intact' where the replicas' bytes agree."""
    found = audit(ours, theirs, fanout).where("state <> 'surplus'").select("file", "offset", "state")
    return ours.join(found, ["file", "offset"], "left").withColumn("state", F.coalesce("state", F.lit("intact")))


def fixity_drill(pages: DataFrame, folder: str, *, damaged_ids: str = r"\d*00", file_bytes: int = FILE_BYTES, fanout: int = FANOUT, compression: str = "gzip") -> DataFrame:
    """Writes the pages' records under ``folder``, copies the files with one byte changed in records whose id
    ends in 00, reads both replicas back and audits their bytes: a report of every record."""
    spark = pages.sparkSession
    write_records(pages, f"{folder}/first", file_bytes=file_bytes, compression=compression)
    copy_files(spark, f"{folder}/first", f"{folder}/second", damaged_ids, compression)
    ours = cut_lineage(read_records(spark, f"{folder}/first", ("digest", "page_id", "url")))
    theirs = cut_lineage(read_records(spark, f"{folder}/second", ("digest",)))
    report = fixity_report(ours, theirs, fanout)
    return report.select(F.col("page_id").cast("long").alias("page_id"), "url", "file", "offset", "length", F.col("digest").alias("record_sha256"), "state")
