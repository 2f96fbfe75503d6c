"""Deeply nested JSON as flat tables that keep their parent-child links.

1. The merged schema is inferred in one distributed pass over all columns: each document's own schema is reduced to the parts that hold
   objects in lists (scalars and lists of scalars are cut out of its text, so objects used as maps add nothing) and parsed into paths.
   A document that mixes kinds, so that its schema says VARIANT, is looked through itself in the same pass.
2. Every list level of that schema becomes a child table. One chain of generators, one for each level, turns a document into
   the rows of all tables in a single scan without a shuffle: row = (key, table, node, parent, ordinal).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.jsons import document
from lectern.plans.runtime import table

Path = tuple[str, ...]
ITEM = "[]"
_NAME = r"(?:`(?:[^`]|``)*`|\w+)"
_SCALAR = r"(?:BIGINT|STRING|DOUBLE|FLOAT|BOOLEAN|VOID|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\s*\d+\))"
_LEAF = rf"{_NAME}: (?:{_SCALAR}|ARRAY<(?!VOID){_SCALAR}>|ARRAY<ARRAY<{_SCALAR}>>)(?:, )?"


def schema_paths(text: str) -> Iterator[tuple[Path, str]]:
    """(path, kind) of each list and each VARIANT in a schema as `schema_of_variant` writes it; kind is list or mixed."""
    at = 0

    def kind(path: Path) -> Iterator[tuple[Path, str]]:
        nonlocal at
        if text.startswith("ARRAY<", at):
            at += 6
            yield path, "list"
            yield from kind((*path, ITEM))
            at += 1
        elif text.startswith("OBJECT<", at):
            at += 7
            while text[at] != ">":
                if text.startswith(", ", at):
                    at += 2
                    continue
                name = re.compile(_NAME).match(text, at)[0]
                at += len(name) + 2
                yield from kind((*path, name[1:-1].replace("``", "`") if name[0] == "`" else name))
            at += 1
        else:
            word = re.compile(r"[A-Z_]+(?:\([^)]*\))?").match(text, at)[0]
            at += len(word)
            if word == "VARIANT":
                yield path, "mixed"

    yield from kind(())


def value_paths(value: object) -> set[Path]:
    """The paths of the lists in a parsed document, those that hold only scalars left out, as they are of schemas."""
    out: set[Path] = set()

    def look(v: object, path: Path) -> bool:
        if isinstance(v, dict):
            for k, x in v.items():
                look(x, (*path, k))
            return True
        if not isinstance(v, list):
            return False
        inner = [look(x, (*path, ITEM)) for x in v]
        if any(inner) or all(x is None for x in v):
            out.add(path)
            return True
        return False

    look(value, ())
    return out


def _paths(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[tuple[int, int]] = set()
    sent: set[tuple[int, Path]] = set()
    for part in parts:
        found: set[tuple[int, Path]] = set()
        for i, s, mixed in zip(part["i"], part["s"], part["mixed"]):
            if mixed is not None:
                found |= {(i, p) for p in value_paths(json.loads(mixed))}
            elif (i, hash(s)) not in seen:
                seen.add((i, hash(s)))
                found |= {(i, p) for p, kind in schema_paths(s) if kind == "list"}
        yield pd.DataFrame([(i, list(p)) for i, p in found - sent], columns=["i", "path"]).astype({"i": "int32"})
        sent |= found


def _quoted(name: str) -> str:
    return '"' + name + '"' if '"' not in name else "'" + name + "'"


def infer_lists(docs: DataFrame, columns: list[str]) -> list[set[Path]]:
    """For each of the VARIANT columns the paths at which some value has a list, however deep, from one pass over all of them.

    A document's own schema tells its lists; only where one mixes kinds, so that its schema says VARIANT, is the document itself looked through.
    Only paths come to the driver, never rows."""

    def said(i: int, c: str) -> Column:
        text = F.regexp_replace(F.schema_of_variant(c), _LEAF, "")
        return F.struct(F.lit(i).alias("i"), text.alias("s"), F.when(F.contains(text, F.lit("VARIANT")), F.to_json(c)).alias("mixed"))

    rows = docs.select(F.explode(F.array(*[F.when(F.col(c).isNotNull(), said(i, c)) for i, c in enumerate(columns)])).alias("x")).where("x is not null").select("x.*")
    found = rows.mapInPandas(_paths, "i int, path array<string>").distinct().collect()
    return [_lifted({tuple(r.path) for r in found if r.i == i}) for i in range(len(columns))]


def _lifted(lists: set[Path]) -> set[Path]:
    """With the paths below lone objects moved to where they are when the object counts as the only item of a list."""

    def lift(path: Path) -> Path:
        out: Path = ()
        for step in path:
            out = (*out, ITEM, step) if out in lists and ITEM not in (step, *out[-1:]) else (*out, step)
        return out

    while (lifted := {lift(p) for p in lists}) != lists:
        lists = lifted
    return lists


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def flatten(df: DataFrame, key: str, columns: list[str], keep_values: bool = False) -> DataFrame:
    """(key, table, node, parent, ordinal[, v]): one row for each JSON object that stands in a list, anywhere in `columns`.

    table is the schema path, node the path with positions (from 0, nulls count), parent the node of the nearest enclosing object
    that stands in a list, else the column's name. A lone object at a place where other values have a list counts as position 0.
    Null, unreadable, empty and scalar texts give no rows, lists that hold no object give none; repeated input rows repeat their
    output; columns not named are ignored; an empty table gives no rows.
    """
    row = "struct<tbl:int,node:string,parent:string,ordinal:int,open:boolean,v:variant>"
    names: list[str] = []
    children: dict[int, list[tuple[int, Path, bool]]] = {}
    roots: list[Column] = []
    docs = df.select(F.col(key).alias("key"), *[document(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    depth, top = 0, []
    inferred = infer_lists(docs, [f"d{i}" for i in range(len(columns))])
    for i, column in enumerate(columns):
        lists = sorted(inferred[i], key=len)
        root = len(names)
        top.append(root)
        names.append(column)
        number = {}
        for p in lists:
            number[p] = len(names)
            names.append(column + "".join(f"[]" if s == ITEM else f".{s}" for s in p))
        for p in lists:
            above = max((q for q in lists if len(q) < len(p) and p[: len(q) + 1] == (*q, ITEM)), key=len, default=None)
            rest = p[len(above) + 1 :] if above is not None else p
            children.setdefault(root if above is None else number[above], []).append((number[p], rest, above is None or bool(rest)))
        depth = max(depth, *(sum(p[: len(q)] == q for q in lists) for p in lists), 0) if lists else depth
        roots.append(F.struct(F.lit(root).alias("tbl"), F.lit(column).alias("node"), F.lit(column).alias("parent"), F.lit(0).alias("ordinal"), F.lit(True).alias("open"), F.col(f"d{i}").alias("v")).cast(row))

    none = F.array().cast(f"array<{row}>")
    rows = docs.select("key", F.explode(F.array(*roots)).alias("r")).where("r.v is not null").select("key", "r.*")

    def below(number: int) -> Column:
        parts = []
        for child, rest, lone in children[number]:
            at = "$" + "".join(f"[{_quoted(s)}]" for s in rest)
            items = F.try_variant_get("v", at, "array<variant>")
            if lone:
                items = F.coalesce(items, F.when(F.try_variant_get("v", at, "map<string,variant>").isNotNull(), F.array(F.try_variant_get("v", at, "variant"))))
            stem = "".join(f".{s}" for s in rest) + "["
            enclosing = F.col("node") if number in top else F.when(_object(F.col("v")), F.col("node")).otherwise(F.col("parent"))
            made = F.transform(items, lambda x, i: F.struct(F.lit(child).alias("tbl"), F.concat("node", F.lit(stem), i.cast("string"), F.lit("]")).alias("node"), enclosing.alias("parent"), i.alias("ordinal"), F.lit(True).alias("open"), x.alias("v")).cast(row))
            parts.append(F.coalesce(F.filter(made, lambda s: _object(s["v"]) | _array(s["v"]).isNotNull()), none))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    for _ in range(depth + 1):
        value = F.col("v") if keep_values else F.lit(None).cast("variant")
        itself = F.array(F.struct("tbl", "node", "parent", "ordinal", F.lit(False).alias("open"), value.alias("v")).cast(row))
        itself = F.when(~F.col("open") | (~F.col("tbl").isin(top) & _object(F.col("v"))), itself).otherwise(none)
        inner = reduce(lambda acc, n: F.when(F.col("open") & (F.col("tbl") == n), below(n)).otherwise(acc), children, none)
        rows = rows.select("key", F.explode(F.concat(itself, inner)).alias("r")).select("key", "r.*")
    rows = rows.where("not open")
    label = F.element_at(F.array(*map(F.lit, names)), F.col("tbl") + 1)
    return rows.select(F.col("key").alias(key), label.alias("table"), "node", "parent", "ordinal", *["v"] * keep_values)


def child_table(nodes: DataFrame, key: str, name: str, fields: dict[str, str]) -> DataFrame:
    """One child table of `flatten(..., keep_values=True)`: key, node, parent, ordinal and the given fields {path in the object: type}; values of another type are null."""
    return nodes.where(F.col("table") == name).select(key, "node", "parent", "ordinal", *[F.try_variant_get("v", f"$.{p}", t).alias(p.replace(".", "_")) for p, t in fields.items()])


NESTED = ["openalex_metadata", "search_hits_openalex"]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(table(spark, sf_dir, "raw_bundles").select("id", *NESTED), "id", NESTED).select("id", "node", "parent")


def p7_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The institutions of authors as a flat table that points at its authorship."""
    nodes = flatten(table(spark, sf_dir, "raw_bundles").select("id", *NESTED), "id", NESTED[:1], keep_values=True)
    return child_table(nodes, "id", "openalex_metadata.authors[].institutions", {"display_name": "string", "country_code": "string"})


def p7_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = flatten(table(spark, sf_dir, "raw_bundles").select("id", *NESTED), "id", NESTED[:1], keep_values=True)
    return child_table(nodes, "id", "openalex_metadata.authors", {"author_position": "string", "author.display_name": "string"})
