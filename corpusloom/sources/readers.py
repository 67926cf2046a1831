"""Readers that turn files of many formats into rows of text, and writers.

Files are read by Spark's own sources; formats without one come as ``binaryFile`` rows
whose bytes a task turns into text.
"""

from __future__ import annotations

import html
import io
import re
import uuid
import zipfile
from collections import Counter
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.sources.scans import with_contents

MAX_TEXT = 500_000
#: Where the texts of zipped formats are, as patterns of member names.
ZIPPED_TEXT = {
    "docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml",
    "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml", "epub": r".*\.x?html?", "kmz": r".*\.kml",
}


def scan(spark: SparkSession, folder: str, pattern: str = "*", ignore: tuple[str, ...] = (), max_files: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(path, length, modified, content) of the files below a folder; ``max_files`` takes the first by path.

    With ``max_files`` only the chosen files are read. For scans with a deadline see ``sources.scans``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"), "content")
    for part in ignore:
        files = files.where(~F.contains("path", F.lit(part)))
    if max_depth is not None:
        below = F.size(F.split(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "/")) - len(folder.rstrip("/").split("/")) - 1
        files = files.where(below <= max_depth)
    return with_contents(files.select("path", "length", "modified").orderBy("path").limit(max_files)) if max_files else files


def shortened(text: Column, most: int = MAX_TEXT) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[Text truncated]"))).otherwise(text)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, cut at the limit with a marker."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.select("path", shortened(F.col("text")).alias("text"))


def csv_text(spark: SparkSession, path: str, max_rows: int = 5_000, max_columns: int = 100) -> DataFrame:
    """(path, text): cells joined by blanks, rows by line feeds; the first rows and columns only, by design."""
    columns = [f"c{n}" for n in range(max_columns)]  # rows may differ in width, so no row says how many there are
    rows = spark.read.csv(path, schema=", ".join(f"{c} string" for c in columns), header=False, mode="PERMISSIVE", multiLine=True, escape='"')  # a quote inside a cell is doubled
    cells = F.concat_ws(" ", *[F.trim(c) for c in columns])
    lines = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), cells.alias("line")).where("line <> ''")
    first = F.row_number().over(Window.partitionBy("path").orderBy("n"))
    lines = lines.withColumn("nth", first).where(F.col("nth") <= max_rows)  # so that a file's rows are few before they are gathered
    kept = F.sort_array(F.collect_list(F.struct("n", "line")))
    return lines.groupBy("path").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))


def markup_text(xml: Column) -> Column:
    """Text of XML without its markup, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[|\]\]>", " "), r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mail_parts(mail: Column) -> Column:
    """Subject, sender, recipient and body of a message, without empty ones, by line feeds."""
    head = [F.nullif(F.trim(F.regexp_extract(mail, rf"(?im)^{name}:[ \t]*([^\r\n]*)$", 1)), F.lit("")) for name in ("Subject", "From", "To")]
    body = F.nullif(F.trim(F.regexp_extract(mail, r"(?s)\r?\n\r?\n(.*)$", 1)), F.lit(""))
    return F.concat_ws("\n", *head, body)


def plain_rtf(rtf: str | None) -> str:
    """Hex escapes decoded, control words and braces dropped, white space collapsed."""
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), rtf or "")
    t = re.sub(r"\\(par|line|tab)\b ?", " ", t)
    t = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", re.sub(r"[{}]", "", t))
    return " ".join(t.split())


def sheet_text(shared: str, sheets: list[str], max_rows: int = 10_000) -> str:
    """A workbook's rows, a line each, cells by blanks: shared strings in their cells, the first rows of each sheet by design."""
    plain = lambda x: " ".join(html.unescape("".join(re.findall(r"<t(?:\s[^>]*)?>(.*?)</t>", x, re.S))).split())
    strings = [plain(x) for x in re.findall(r"<si(?:\s[^>]*)?>(.*?)</si>", shared, re.S)]
    lines = []
    for sheet in sheets:
        for row in re.findall(r"<row(?:\s[^>]*)?>(.*?)</row>", sheet, re.S)[:max_rows]:
            cells = []
            for attributes, cell in re.findall(r"<c(\s[^>]*[^/>])?>(.*?)</c>", row, re.S):
                kind = re.search(r'\bt="(\w+)"', attributes)
                value = re.search(r"<v(?:\s[^>]*)?>(.*?)</v>", cell, re.S)
                if kind and kind[1] == "inlineStr":
                    cells.append(plain(cell))
                elif value and kind and kind[1] == "s":
                    at = int(value[1]) if value[1].strip().isdigit() else len(strings)
                    cells.append(strings[at] if at < len(strings) else "")
                elif value:
                    cells.append(" ".join(html.unescape(value[1]).split()))
            lines.append(" ".join(c for c in cells if c))
    return "\n".join(x for x in lines if x)


def zipped_text(kind: str, content: bytes) -> str:
    """Text of a zipped document's parts in their order; '' if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
            names = sorted((n for n in z.namelist() if re.fullmatch(ZIPPED_TEXT.get(kind, "$^"), n)), key=number)
            raw = [z.read(n).decode("utf-8", "replace") for n in names]
            if kind == "xlsx":
                shared = [x for n, x in zip(names, raw, strict=True) if "sharedStrings" in n]
                return sheet_text("".join(shared), [x for n, x in zip(names, raw, strict=True) if "sharedStrings" not in n])
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
        return ""
    spaced = (re.sub(r"</(w:p|a:p|text:p|text:h|p|h\d|row|si|div)>", "\n", x) for x in raw)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for part in spaced for x in part.split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def document_text(paths: pd.Series, contents: pd.Series) -> pd.Series:
    """Text of a binary file by its extension; formats that need a model or another library give ''."""
    out = []
    for path, content in zip(paths, contents, strict=True):
        kind = PurePosixPath(path).suffix.lower().lstrip(".")
        if kind in ZIPPED_TEXT:
            text = zipped_text(kind, content)
        elif kind == "rtf":
            text = plain_rtf(content.decode("cp1252", "replace"))
        elif kind in ("txt", "md", "csv", "json", "py", "js", "css", "sql", "ini", "yaml", "yml", "log", "eml", "xml", "kml", "html"):
            text = content.decode("utf-8-sig", "replace")
        else:
            text = ""
        out.append(text[:MAX_TEXT])
    return pd.Series(out, dtype=object)


def names_keywords(names: list[str], most: int = 15) -> list[str]:
    """Of an archive's listing: its three most frequent extensions, then distinct parts of names of 3 to 19 letters."""
    exts = Counter(PurePosixPath(n).suffix.lower().lstrip(".") for n in names)
    exts.pop("", None)
    top = [e for e, _ in sorted(exts.items(), key=lambda x: (-x[1], names.index(next(n for n in names if n.lower().endswith("." + x[0])))))[:3]]
    words = (w for n in names for w in re.split(r"[^a-z0-9]+", PurePosixPath(n).stem.lower()) if 3 <= len(w) <= 19)
    return list(dict.fromkeys([*top, *words]))[:most]


@F.pandas_udf(ArrayType(StringType()))
def archive_keywords(contents: pd.Series) -> pd.Series:
    out = []
    for content in contents:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                out.append(names_keywords([n for n in z.namelist() if not n.endswith("/")]))
        except zipfile.BadZipFile:
            out.append([])
    return pd.Series(out, dtype=object)


def save(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One folder of Parquet with LZ4: written beside the old rows and swapped for them by renames.

    A write that fails leaves the old rows as they are. For versions, several tables at once and
    restoring, see ``sources.snapshots``.
    """
    spark, made = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    new, old, at = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{made}-new", f"{made}-old", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    w = df.write.option("compression", "lz4")
    try:
        (w.partitionBy(partition) if partition else w).parquet(f"{made}-new")
    except Exception:
        fs.delete(new, True)
        raise
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{path} cannot be put in place")
    fs.delete(old, True)
