"""Files, catalog pages, index splicing and the stream."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import catalog, clean
from textloom.sources import text_files
from textloom.streaming import clean_stream


def test_reading_and_changes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes("This sentence has enough words.\r\nNo.\r\n".encode())
    (tmp_path / "a" / "Two.TXT").write_bytes(b"A second sentence with enough words.\n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "note.md").write_text("no")
    found = text_files.read(spark, [str(tmp_path), str(tmp_path / "a")], recursive=True)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in found.collect()}
    assert set(got) == {"one.txt", "bad.txt"} and got["bad.txt"] == (None, "invalid_utf8")  # by case within folders
    named = text_files.read(spark, [str(tmp_path / "a" / "Two.TXT"), str(tmp_path / "note.md"), str(tmp_path / "a")]).orderBy("place", "path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in named] == ["Two.TXT", "one.txt"]
    with pytest.raises(FileNotFoundError):
        text_files.read(spark, [str(tmp_path / "none")])
    assert got["one.txt"][0] == "This sentence has enough words.\nNo.\n"
    good = found.where("error is null").drop("error")
    changed = text_files.changed_only(good, clean.clean_text(good)).collect()
    assert [r.text for r in changed] == ["This sentence has enough words.\n"]


def test_catalog(spark):
    paths = ["sources/b/x.txt", "sources\\b\\a<1>.TXT", "sources/top.txt", "sources/b/c/z.txt", "sources/b/n.md", "other/q.txt"]
    found = catalog.items(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(map(tuple, found.collect())) == [("b", "sources/b/a<1>.TXT", "a<1>"), ("b", "sources/b/x.txt", "x"), ("b/c", "sources/b/c/z.txt", "z"), ("root", "sources/top.txt", "top")]
    page = {r.group_name: r.html for r in catalog.pages(found).collect()}
    assert set(page) == {"b", "b/c"} and page["b"].index("a&lt;1&gt;") < page["b"].index("../sources/b/x.txt") and page["b"].endswith("</html>\n")
    index = catalog.index_list(found).first()
    assert (index.groups, index["items"]) == (3, 4) and "Pages/b.html" in index.list_html and "root" not in index.list_html
    made = spark.createDataFrame([(f"<body>{catalog.MARKER} old </body></html>",), ("nothing",)], "page string")
    new, error = catalog.splice(F.col("page"), F.lit("LIST"))
    assert [tuple(r) for r in made.select(new, error).collect()] == [(f"<body>{catalog.MARKER}\nLIST\n</body></html>", None), (None, "no_marker")]
    gone = catalog.obsolete(spark.createDataFrame([("b",), ("q",)], "stem string"), spark.createDataFrame([("b",)], "name string"))
    assert [r.stem for r in gone.collect()] == ["q"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "This sentence has enough words. No."), (2, "Another sentence with enough words.")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = clean_stream.read(spark, str(tmp_path / "in"), docs.schema)
    clean_stream.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, clean.clean_sentences(docs).collect()))
