"""The catalog: files grouped by folder, a page for each group, an index (SRC3, JN3, SNK5, SNK6, AG6, AG7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The page around a list.
STYLE = (
    "        body { background-color: #0f0f0f; color: #a5a5a5; font-family: system-ui, -apple-system, sans-serif; padding: 40px; margin: 0; }\n"
    "        h1 { color: #ffffff; margin-bottom: 30px; }\n        ul { list-style: none; padding: 0; }\n        li { margin-bottom: 10px; }\n"
    "        a { color: #4a9eff; text-decoration: none; font-size: 16px; }\n        a:hover { color: #6bb3ff; text-decoration: underline; }\n"
)
HEAD, STYLED = '<!DOCTYPE html>\n<html lang="ru">\n<head>\n    <meta charset="utf-8">\n    <title>', "</title>\n    <style>\n" + STYLE + "    </style>\n</head>\n<body>\n    <h1>"
OPEN, CLOSE = "</h1>\n    <ul>\n", "    </ul>\n</body>\n</html>\n"
MARKER, END = "<h1>Список страниц</h1>", "</body>"


def items(paths: DataFrame, path: str = "path", root: str = "sources/") -> DataFrame:
    """SRC3: group_name, href, title of text files; paths are relative to the project."""
    posix = T.posix_path(F.col(path))
    inside = F.substr(posix, F.lit(len(root) + 1))
    folder, name = F.regexp_extract(inside, r"\A(?:(.*)/)?([^/]*)\z", 1), F.regexp_extract(inside, r"\A(?:(.*)/)?([^/]*)\z", 2)
    found = paths.where(F.startswith(posix, F.lit(root)) & F.endswith(F.lower(posix), F.lit(".txt")))
    return found.select(F.when(folder == "", "root").otherwise(folder).alias("group_name"), posix.alias("href"), F.regexp_replace(name, r"(?i)(.)\.txt\z", "$1").alias("title"))


def entry(href: Column, title: Column) -> Column:
    return F.concat(F.lit('        <li><a href="'), T.html_escape(href, True), F.lit('">'), T.html_escape(title, False), F.lit("</a></li>"))


def pages(found: DataFrame) -> DataFrame:
    """SNK5: group_name, page_path, n_items, html, of the groups below the root; entries in order of title, then href."""
    ordered = F.array_sort(F.collect_list(F.struct("title", "href")))
    made = found.where("group_name <> 'root' and group_name <> ''").groupBy("group_name").agg(ordered.alias("_items"))
    link = lambda x: entry(F.when(F.startswith(x["href"], F.lit("/")), x["href"]).otherwise(F.concat(F.lit("../"), x["href"])), x["title"])
    body = F.array_join(F.transform("_items", lambda x: F.concat(link(x), F.lit("\n"))), "")
    html = F.concat(F.lit(HEAD), T.html_escape(F.col("group_name"), True), F.lit(STYLED), T.html_escape(F.col("group_name"), False), F.lit(OPEN), body, F.lit(CLOSE))
    return made.select("group_name", F.concat(F.lit("Pages/"), F.col("group_name"), F.lit(".html")).alias("page_path"), F.size("_items").alias("n_items"), html.alias("html"))


def obsolete(existing: DataFrame, folders: DataFrame) -> DataFrame:
    """JN3: pages (stem) without a folder (name)."""
    return existing.join(folders, existing["stem"] == folders["name"], "left_anti")


def index_list(found: DataFrame) -> DataFrame:
    """SNK6: one row: the index's list of groups (a row for each group meets in one task), groups, items."""
    groups = found.groupBy("group_name").agg(F.count("*").alias("n"))
    named = F.array_sort(F.collect_list(F.when(~F.col("group_name").isin("root", ""), F.col("group_name"))))
    body = F.transform(named, lambda g: entry(F.concat(F.lit("Pages/"), g, F.lit(".html")), g))
    return groups.agg(F.concat(F.lit("    <ul>\n"), F.array_join(F.transform(body, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("    </ul>")).alias("list_html"), F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("items"))


def splice(index: Column, block: Column) -> tuple[Column, Column]:
    """SNK6: the new index (null on error), and the error: no_marker, no_body or null."""
    start, stop = F.instr(index, MARKER), F.instr(index, END)
    error = F.when(start == 0, "no_marker").when(stop == 0, "no_body")
    new = F.concat(F.substr(index, F.lit(1), start + len(MARKER) - 1), F.lit("\n"), block, F.lit("\n"), F.substr(index, stop))
    return F.when(error.isNull(), new), error
