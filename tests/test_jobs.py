"""Jobs over files: in place, one bad file beside good ones, conflicts, gaps, the site."""

import pytest
from pyspark.sql import functions as F

from textloom import jobs
from textloom.functions import text as T
from textloom.operators import catalog, clean, pack, regroup
from textloom.sources import text_files


def test_clean_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("This sentence has enough words. No.\r\n".encode())
    (tmp_path / "b.txt").write_text("Another sentence with enough words.\n")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_text("")
    report, status = jobs.clean_files(spark, [str(tmp_path)], f"file://{tmp_path}/work")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in report.collect()}
    assert got == {"a.txt": ("changed", None), "b.txt": ("unchanged", None), "c.txt": ("failed", "invalid_utf8"), "d.txt": ("failed", "empty_input")} and status == 1
    assert tuple(jobs.clean_summary(report).first()) == (4, 1, 1, 2)
    assert (tmp_path / "a.txt").read_bytes() == b"This sentence has enough words.\n" and (tmp_path / "c.txt").read_bytes() == b"\xff\xfe"
    assert not list(tmp_path.glob("*.part"))
    report, status = jobs.clean_files(spark, [str(tmp_path / "a.txt")], f"file://{tmp_path}/work")
    assert [r.status for r in report.collect()] == ["unchanged"] and status == 0
    (tmp_path / "none").mkdir()
    assert jobs.clean_files(spark, [str(tmp_path / "none")], f"file://{tmp_path}/work")[1] == 1


def test_split_and_merge(spark, tmp_path):
    text = "".join(f"This is sentence number {i} of the whole tale.\n" for i in range(7))
    (tmp_path / "tale.txt").write_text(text)
    (tmp_path / "odd.txt").write_text("One line that is short.\n")
    (tmp_path / "oddS004.txt").write_text("left over")
    work = f"file://{tmp_path}/work"
    report, status = jobs.split_files(spark, [str(tmp_path / "tale.txt"), str(tmp_path / "odd.txt")], work, max_lines=3)
    got = {r.source.rsplit("/", 1)[1]: (r.n_parts, r.error) for r in report.collect()}
    assert got == {"tale.txt": (3, None), "odd.txt": (1, "conflict")} and status == 1
    lines = text.splitlines()
    assert [(tmp_path / n).read_text().split("\n") for n in ("tale.txt", "taleS001.txt", "taleS002.txt")] == [lines[:3], lines[3:6], lines[6:]]
    report, status = jobs.merge_files(spark, [str(tmp_path)], work)
    got = {r.source.rsplit("/", 1)[1]: (r.n_parts, r.n_deleted, r.error) for r in report.collect()}
    assert got == {"tale.txt": (3, 2, None), "odd.txt": (0, 0, "gap")} and status == 1
    assert (tmp_path / "tale.txt").read_text() == "\n".join(lines) and not (tmp_path / "taleS001.txt").exists() and (tmp_path / "oddS004.txt").exists()


def test_translate(spark, tmp_path):
    lines = [f"This is sentence number {'abcdefg'[i]} of the whole tale." for i in range(7)]
    (tmp_path / "tale.txt").write_text(" ".join(lines))
    (tmp_path / "prompt.md").write_text("Do so.\n")
    said = []

    def run(request, text):
        path = request.split("---\n")[1].split("\n")[0].rsplit(" ", 1)[1]
        if not request.startswith("# Story Context\n\n") or "Tom, a boy\n\n# Translation Instructions\n\nDo so.\n\n---\n" not in request:
            raise ValueError("a wrong request")
        if path.endswith("S002.txt"):
            raise RuntimeError("boom")
        return text.upper() + "\n\n"

    def translate(context="Tom, a boy", source="tale.txt", template="prompt.md"):
        return jobs.translate_files(spark, str(tmp_path / source), context, str(tmp_path / template), run, f"file://{tmp_path}/work", pause=0.01, limit=20, say=said.append, max_lines=3)

    assert [translate(" "), translate("имя"), translate(source="none.txt"), translate(template="none.md")] == [1] * 4
    assert [s.split(":")[0] for s in said] == ["failed"] * 4 and said[0].endswith("empty_context") and said[1].endswith("non_ascii_context")
    assert (tmp_path / "tale.txt").read_text() == " ".join(lines) and not (tmp_path / "taleS001.txt").exists()
    said.clear()
    assert translate() == 1
    assert said == ["3 parts, 2 pauses, about 2m 41s", "1 - done.", "2 - done.", "3 - fail (attempt 3: boom).", "3 parts, 2 done, 1 failed"]
    got = [(tmp_path / n).read_text() for n in ("tale.txt", "taleS001.txt", "taleS002.txt")]
    assert got == ["\n".join(lines[:3]).upper(), "\n".join(lines[3:6]).upper(), lines[6]]


def test_site(spark, tmp_path):
    (tmp_path / "sources" / "b").mkdir(parents=True)
    (tmp_path / "Pages").mkdir()
    (tmp_path / "sources" / "b" / "x<1>.txt").write_text("x")
    (tmp_path / "sources" / "top.txt").write_text("x")
    (tmp_path / "Pages" / "gone.html").write_text("old")
    said = []
    assert jobs.update_site(spark, str(tmp_path), f"file://{tmp_path}/work", said.append) == 1
    (tmp_path / "index.html").write_text(f"<body>{catalog.MARKER} old </body></html>")
    assert jobs.update_site(spark, str(tmp_path), f"file://{tmp_path}/work", said.append) == 0
    assert [p.name for p in (tmp_path / "Pages").glob("*.html")] == ["b.html"] and "x&lt;1&gt;" in (tmp_path / "Pages" / "b.html").read_text()
    index = (tmp_path / "index.html").read_text()
    assert 'href="Pages/b.html"' in index and "top" not in index and index.startswith(f"<body>{catalog.MARKER}\n    <ul>\n") and said[-1].startswith("2 groups, 2 files, 1 pages")


def test_paths_and_templates(spark, tmp_path):
    assert text_files.resolve("a/b.txt", "/root") == "/root/a/b.txt" and text_files.resolve("/x", "/root") == "/x" and text_files.resolve("hdfs://n/x", "/root") == "hdfs://n/x"
    (tmp_path / "t.md").write_text("  \n")
    for bad, error in (("t.md", ValueError), ("none.md", FileNotFoundError)):
        with pytest.raises(error):
            text_files.load_text(spark, str(tmp_path / bad))
    row = spark.range(1).select(T.user_message(F.lit("p.txt"), F.lit(" Do so. ")).alias("m")).first()
    assert row.m.startswith("Do so.\n\n---\n") and "p.txt\n" in row.m


def test_sentences_are_split_once_and_folds_keep_starts(spark):
    docs = spark.createDataFrame([(1, "This sentence has enough words. " * 5), (2, "nothing ends this sentence here\nand nothing ends another line"), (3, None)], "doc_id int, text string")
    got = pack.parts(docs.select("doc_id", clean.good_sentences(F.col("text")).alias("own")), "own", max_lines=2)
    rows = [(r.doc_id, r.part_no, r.n_lines) for r in got.orderBy("doc_id", "part_no").collect()]
    assert rows == [(1, 1, 2), (1, 2, 2), (1, 3, 1), (2, 1, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    once = docs.select(T.split_sentences(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= once.count("regexp_extract_all") + 2  # the splitter once, and what packing looks at
    own = spark.createDataFrame([(["a b", "c d", "e f", "g h", "i j k l m n o p", "q"],)], "s array<string>")
    assert own.select(regroup.merge_short(F.col("s")).alias("s")).first().s == ["a b c d e f g h", "i j k l m n o p", "q"]
