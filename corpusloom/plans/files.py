"""Queries over files that are made of the tables: scans, delimited text, office formats and archives.

Files go to a scratch folder; formats that Spark does not write are made as bytes in tasks.
"""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusloom.operators.history import history
from corpusloom.plans.history import HIST
from corpusloom.plans.registry import query
from corpusloom.session import cut_lineage, scratch, table
from corpusloom.sources import readers as R
from corpusloom.sources.scans import IGNORED, scan_tree, with_contents


@query("csv_text_rows", "SELECT concat_ws(' ', doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '\"' || source || '\", twice' END, n_chars) AS line, count(*) AS n FROM documents GROUP BY 1")
def csv_text_rows(spark, sf):
    """The documents' columns as files of delimited text, of which some rows have a cell with signs and some an empty one."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), "source", F.lit('", twice'))).alias("note"), "n_chars")
    with scratch(spark, "csv") as folder:
        d.write.option("maxRecordsPerFile", 1_000).option("escape", '"').csv(folder)
        text = R.csv_text(spark, folder)
        return cut_lineage(text.select(F.explode(F.split("text", "\n")).alias("line")).select(F.regexp_replace("line", " {2,}", " ").alias("line")).groupBy("line").agg(F.count("*").alias("n")))


@query("tree_scan", "SELECT 'folder' AS kind, '/lang=' || lang || '/source=' || source AS path FROM documents GROUP BY lang, source UNION SELECT 'folder', '/lang=' || lang FROM documents UNION SELECT 'files', '/lang=' || lang || '/source=' || source FROM documents UNION SELECT 'stop: maxDepth', '/lang=' || lang || '/source=' || source FROM documents")
def tree_scan(spark, sf):
    """A folder for every language and source: a whole scan, and one that stops above the files."""
    with scratch(spark, "tree") as folder:
        table(spark, sf, "documents").select("doc_id", "lang", "source").repartition("lang", "source").write.partitionBy("lang", "source").parquet(folder)
        skip = (*IGNORED, "*.crc", "_SUCCESS")
        whole, flat = scan_tree(spark, folder, ignore=skip), scan_tree(spark, folder, ignore=skip, max_depth=1)
        below = lambda c: F.regexp_extract(c, r"(/lang=.*)$", 1)
        parts = [whole.folders.select(F.lit("folder").alias("kind"), below("path").alias("path")), whole.files.select(F.lit("files").alias("kind"), F.regexp_replace(below("path"), "/[^/]*$", "").alias("path"))]
        parts += [flat.stops.select(F.concat(F.lit("stop: "), "reason").alias("kind"), below("path").alias("path")), whole.stops.select(F.concat(F.lit("stop: "), "reason").alias("kind"), "path"), flat.files.select(F.lit("files").alias("kind"), "path")]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return cut_lineage(rows.distinct())


@F.pandas_udf(BinaryType())
def _zipped(kinds: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """A document of two paragraphs (cells, in a workbook) in each format."""
    out = []
    for kind, x, y in zip(kinds, a, b, strict=True):
        x, y = escape(x or ""), escape(y or "")
        parts = {
            "docx": {"word/document.xml": f"<w:document><w:p><w:t>{x}</w:t></w:p><w:p><w:t>{y}</w:t></w:p></w:document>", "word/styles.xml": "<s>no text</s>"},
            "pptx": {"ppt/slides/slide10.xml": f"<a:p>{y}</a:p>", "ppt/slides/slide2.xml": f"<a:p>{x}</a:p>"},
            "xlsx": {"xl/sharedStrings.xml": f"<sst><si><t>{y}</t></si><si><t>{x}</t></si></sst>", "xl/worksheets/sheet1.xml": '<sheetData><row><c t="s"><v>1</v></c></row><row><c t="s"><v>0</v></c></row></sheetData>'},
            "odt": {"content.xml": f"<office:text><text:p>{x}</text:p><text:p>{y}</text:p></office:text>"},
            "epub": {"a/1.xhtml": f"<html><p>{x}</p></html>", "a/2.html": f"<html><p>{y}</p></html>", "a/style.css": "p {}"},
        }.get(kind)
        held = io.BytesIO()
        if parts:
            with zipfile.ZipFile(held, "w") as z:
                for name, text in parts.items():
                    z.writestr(name, text)
        out.append(held.getvalue() if parts else rf"{{\rtf1\ansi {{\b {x}}}\par {y}}}".encode() if kind == "rtf" else b"no document")
    return pd.Series(out, dtype=object)


KINDS = ("docx", "pptx", "xlsx", "odt", "epub", "rtf", "doc")


@query("document_texts", "SELECT doc_id, CASE doc_id % 7 WHEN 6 THEN '' WHEN 5 THEN lang || ' ' || source || ' n' || n_chars ELSE lang || chr(10) || source || ' n' || n_chars END AS text FROM documents")
def document_texts(spark, sf):
    """Documents in six formats that are read, and one that is not."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 7).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", kind.alias("kind"), "lang", F.concat("source", F.lit(" n"), F.col("n_chars").cast("string")).alias("second"))
    made = d.select("doc_id", F.concat(F.lit("/in/x."), F.upper("kind")).alias("path"), _zipped("kind", "lang", "second").alias("content"))
    return made.select("doc_id", R.document_text("path", "content").alias("text"))


@F.pandas_udf(BinaryType())
def _archive(names: pd.Series) -> pd.Series:
    out = []
    for listed in names:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name in listed:
                z.writestr(name, "")
        out.append(held.getvalue())
    return pd.Series(out, dtype=object)


@query("archive_listing", HIST + "SELECT doc_id, list_filter([ext, CASE WHEN ext <> 'txt' THEN 'txt' END, 'doc' || doc_id, lang || 'x', category], lambda w: w IS NOT NULL AND (length(w) > 2)) AS keywords FROM h")
def archive_listing(spark, sf):
    """Archives of three files: kinds by number, then parts of names."""
    h = history(spark, sf)
    names = F.array(F.concat(F.lit("a/"), "file_name"), F.concat(F.lit("b/"), "lang", F.lit("x."), "ext"), F.concat(F.lit("c/"), "category", F.lit(".txt")))
    return h.select("doc_id", R.archive_keywords(_archive(names)).alias("keywords"))


@query("chosen_contents", "SELECT source, count(*) AS files, CAST(sum(strlen(source || chr(10))) AS BIGINT) AS bytes FROM (SELECT DISTINCT source FROM documents) GROUP BY 1")
def chosen_contents(spark, sf):
    """One file of a line for every source; paths are chosen first, and their bytes read in tasks."""
    with scratch(spark, "lines") as folder:
        table(spark, sf, "documents").select("source", F.col("source").alias("line")).distinct().repartition("source").write.partitionBy("source").text(folder)
        files = with_contents(scan_tree(spark, folder, ignore=(*IGNORED, "*.crc", "_SUCCESS")).files)
        source = F.regexp_extract("path", "source=([^/]*)/", 1)
        return cut_lineage(files.groupBy(source.alias("source")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes")))
