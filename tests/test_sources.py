import zipfile

from pyspark.sql import functions as F

from corpusloom.sources import readers as R


def test_scan_and_formats(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.txt").write_text("hello")
    (tmp_path / "a/b/y.rtf").write_bytes(rb"{\rtf1\ansi Caf\'e9 {\b bold}\par next}")
    with zipfile.ZipFile(tmp_path / "a/z.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>Three</w:t></w:p></w:document>")
    (tmp_path / "a/bad.docx").write_bytes(b"no zip")
    files = R.scan(spark, str(tmp_path / "a")).withColumn("text", R.document_text("path", "content"))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.collect()}
    assert got == {"x.txt": "hello", "y.rtf": "Café bold next", "z.docx": "One & two\nThree", "bad.docx": ""}
    assert R.scan(spark, str(tmp_path / "a"), max_files=2).count() == 2
    assert R.scan(spark, str(tmp_path / "a"), pattern="*.txt").count() == 1
    assert R.scan(spark, str(tmp_path / "a"), ignore=("/b/",)).count() == 3


def test_csv_text_mail(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b\n1,"x, y"\n\n3\n')
    assert R.csv_text(spark, str(tmp_path / "s.csv")).first()["text"] == "a b\n1 x, y\n3"
    (tmp_path / "t.txt").write_text("t" * (R.MAX_TEXT + 5))
    assert R.read_texts(spark, str(tmp_path / "t.txt")).first()["text"].endswith("[Text truncated]")
    df = spark.createDataFrame([("Subject: Hi\r\nFrom: me\r\n\r\nBody\r\nhere",)], "m string")
    assert df.select(R.mail_parts(F.col("m"))).first()[0] == "Hi\nme\nBody\r\nhere"
    x = spark.createDataFrame([("<?xml v?><a b='c'>x &lt;y&gt; <![CDATA[z]]></a>",)], "m string")
    assert x.select(R.markup_text(F.col("m"))).first()[0] == "x <y> z"


def test_archive_names():
    assert R.names_keywords(["src/main_file.py", "src/util.py", "doc/read me.md", "x"]) == ["py", "md", "main", "file", "util", "read"]


def test_save(spark, tmp_path):
    R.save(spark.range(3).withColumn("d", F.lit("x")), str(tmp_path / "o"), "d")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
