"""Writers: appended bundles and works, replaced embeddings, JSON, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import yaml_list
from lectern.operators.resolve import upsert


def append(df: DataFrame, path: str) -> None:
    """Structs, lists and maps become JSON text with their nulls."""
    as_text = lambda c, t: F.to_json(c, {"ignoreNullFields": "false"}) if t.startswith(("struct", "array", "map")) else F.col(c)
    df.select(*[as_text(c, t).alias(c) for c, t in df.dtypes]).write.mode("append").parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str, to: str) -> None:
    """The table at `path` with the rows of `df` in place of those with the same key, written to `to`."""
    upsert(df.sparkSession.read.parquet(path), df, key).write.mode("overwrite").parquet(to)


def pretty_json(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"})


def markdown_table(rows: DataFrame, order: str, left: str, right: str, titles: tuple[str, str]) -> DataFrame:
    """One row with the table as text. It holds the whole table: for reports, not for corpora."""
    lines = rows.select(order, F.concat(F.lit("| "), F.col(left), F.lit(" | "), F.col(right), F.lit(" |")).alias("l"))
    head = f"| {titles[0]} | {titles[1]} |\n|{'-' * (len(titles[0]) + 2)}|{'-' * (len(titles[1]) + 2)}|"
    body = lines.agg(F.array_sort(F.collect_list(F.struct(order, "l"))).alias("x"))
    return body.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("x", lambda s: s["l"]), "\n")).alias("markdown"))


def note(title: Column, authors: Column, year: Column, venue: Column, tags: Column, abstract: Column, summary: Column) -> Column:
    """A Markdown note with YAML front matter; sections without content are left out."""
    section = lambda name, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"\n## {name}\n\n"), text, F.lit("\n"))).otherwise("")
    block = lambda name, items: F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"{name}:\n"), yaml_list(items), F.lit("\n"))).otherwise(F.lit(f"{name}: []\n"))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), F.coalesce(v.cast("string"), F.lit("")), F.lit("\n"))
    shown = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    return F.concat(F.lit("---\n"), F.lit('title: "'), shown, F.lit('"\n'), block("authors", authors), line("year", year), line("venue", venue), block("tags", tags), F.lit("---\n\n# "), shown, F.lit("\n"), section("Abstract", abstract), section("Summary", summary))


def write_texts(df: DataFrame, name: str, text: str, folder: str) -> DataFrame:
    """(path): every text as a file of its own in a folder that all executors share, written as the rows are read; a name given twice keeps one
    of its texts."""
    from pathlib import Path

    def run(parts):
        import pandas as pd

        for p in parts:
            paths = [str(Path(folder) / n) for n in p["n"]]
            for path, t in zip(paths, p["t"]):
                Path(path).parent.mkdir(parents=True, exist_ok=True)
                Path(path).write_text(t or "", encoding="utf-8")
            yield pd.DataFrame({"path": paths})

    return df.select(F.col(name).alias("n"), F.col(text).alias("t")).where("n <> ''").mapInPandas(run, "path string")


def is_pdf(status: Column, content_type: Column) -> Column:
    """May this answer be kept as a PDF?"""
    return (status == 200) & (F.instr(F.lower(F.coalesce(content_type, F.lit(""))), "application/pdf") > 0)
