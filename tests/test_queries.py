"""Every query with SQL against DuckDB over the smallest tables; the others run."""

import os

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def rows(names, found):
    order = [names.index(n) for n in sorted(names)]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_brackets_of_whole_texts(spark, tmp_path):
    sentence = "one, two. three ] four [ five, six. "
    texts = ["", None, "[", "a ] b", sentence * 200, "x [" * 40 + "in" + "]" * 39 + " y" * 600, "p" * 900 + " [ lost", "q" * 500 + ", r. " * 300 + "[[a] b] end", "é, 漢. " * 150]
    docs = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def want(i, t):
        if t is None:
            return None
        made = [t.replace(", ", " [a [b ").replace(". ", " ] c] "), t.replace(", ", " [x] "), t.replace(". ", " ] "), f"{t} [ {t}"][i % 4]
        depth, out = 0, []
        for x in made:
            if x == "[":
                depth += 1
            elif x == "]" and depth:
                depth -= 1
            elif not depth:
                out.append(x)
        return "".join(out)

    got = registry.QUERIES["strip_brackets"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.cleaned for r in got} == {i: want(i, t) for i, t in docs} and len(got) == len(docs)


def test_every_line_and_whole_context(spark, tmp_path):
    texts = ["plain\nsee www.')en here\n", "a" * 70 + " 漢字", "", "x " * 50 + "\nu/me\nR/abc\n\nend", "b" * 70 + " é", None]
    docs = [(9 * i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["drop_rules"](spark, str(tmp_path)).where("line_no >= 0").collect()
    assert len(got) == sum(len(t.removesuffix("\n").split("\n")) for t in texts if t is not None)
    told = {(r.doc_id, r.line_no): {k for k in ("is_empty", "is_community", "has_url", "has_cjk") if r[k]} for r in got}
    assert {k: v for k, v in told.items() if v} == {(0, 1): {"has_url"}, (9, 0): {"has_cjk"}, (18, 0): {"is_empty"}, (27, 1): {"is_community"}, (27, 2): {"is_community"}, (27, 3): {"is_empty"}}
    prompts = {r.doc_id: r for r in registry.QUERIES["prompt_build"](spark, str(tmp_path)).collect()}
    assert [prompts[9 * i].error for i in range(5)] == [None, "non_ascii_context", "empty_context", None, "non_ascii_context"]
    assert texts[0].strip() in prompts[0].prompt and texts[3] in prompts[27].prompt


def test_numbering_of_all_labels(spark, tmp_path):
    ids = [0, 1, 2, 30, 39, 40, 79, 81]
    spark.createDataFrame([(i, 0, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.stem: (r.run_length, r.n_orphans, r.orphans) for r in registry.QUERIES["part_numbering"](spark, str(tmp_path)).collect()}
    assert got == {"d0": (3, 2, "031,040"), "d1": (1, 1, "040"), "d2": (0, 1, "002")}
