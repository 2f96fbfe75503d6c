"""Readers for BibTeX, TEI and maze XML, graph text, JSON trees and binary files."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate
from xml.etree.ElementTree import XML, Element, ParseError, TreeBuilder, XMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from lectern.functions.text import canonical_doi, file_doi, strip, truthy

#: The bundle table: sources' metadata as JSON text.
RAW_BUNDLES = "id BIGINT, work_id STRING NOT NULL, doi STRING, arxiv_id STRING, retrieval_timestamp STRING, pdf_metadata STRING, crossref_metadata STRING, openalex_metadata STRING, search_hits_crossref STRING, search_hits_openalex STRING, errors STRING, source_query STRING, source_pdf_path STRING"
NORMALIZED_WORKS = "id BIGINT, work_id STRING, doi STRING, title STRING, authors STRING, year INT, alternate_dois STRING, source_bundle_ids STRING, provenance STRING, confidence DOUBLE, created_at STRING, updated_at STRING, pdf_metadata STRING, crossref_metadata STRING, openalex_metadata STRING"
EMBEDDINGS = "work_id STRING, vector ARRAY<FLOAT>"


def bibtex_entries(text: Column) -> Column:
    """map<string,string> per entry of a BibTeX text: its fields in lower case, with ID and ENTRYTYPE; fields in braces (two levels) or
    quotes or bare numbers. Unbalanced entries are left out."""
    entry = r"@(\w+)\s*\{\s*([^,\s]+)\s*,((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
    field = r'(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|"([^"]*)"|(\d+))'

    def one(e: Column) -> Column:
        body = F.regexp_extract(e, entry, 3)
        found = F.regexp_extract_all(body, F.lit(field), F.lit(0))
        pair = lambda f: F.struct(F.lower(F.regexp_extract(f, field, 1)).alias("k"), strip(F.concat(F.regexp_extract(f, field, 2), F.regexp_extract(f, field, 3), F.regexp_extract(f, field, 4))).alias("v"))
        known = F.transform(found, pair)
        # of a field given twice the first counts
        kept = F.filter(known, lambda p, i: F.array_position(F.transform(known, lambda q: q["k"]), p["k"]) == i + 1)
        head = F.array(F.struct(F.lit("ID").alias("k"), F.regexp_extract(e, entry, 2).alias("v")), F.struct(F.lit("ENTRYTYPE").alias("k"), F.lower(F.regexp_extract(e, entry, 1)).alias("v")))
        return F.map_from_entries(F.concat(head, kept))

    return F.transform(F.regexp_extract_all(text, F.lit(entry), F.lit(0)), one)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, authors, year, doi, arxiv, entry) of every entry of the files at `path`."""
    e = spark.read.text(path, wholetext=True).select(F.explode(bibtex_entries(F.col("value"))).alias("entry"))
    at = lambda k: F.try_element_at("entry", F.lit(k))
    names = F.filter(F.transform(F.split(at("author"), r"\s+and\s+"), strip), lambda n: n != "")
    arxiv = F.when(F.lower(at("archiveprefix")) == "arxiv", at("eprint"))
    return e.select(at("ID").alias("id"), at("title").alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), at("year").alias("year"), truthy(canonical_doi(at("doi"))).alias("doi"), arxiv.alias("arxiv"), "entry")


_TEXT = pa.string()
_PERSON = pa.struct([(x, _TEXT) for x in ("given", "family", "email", "orcid", "affiliation")])
_TEI = pa.struct([*[(x, _TEXT) for x in ("title", "abstract", "venue", "year", "doi")], ("references", pa.list_(_TEXT)), ("authors", pa.list_(_PERSON))])
_ABSTRACT = str.maketrans("ABSTRC", "abstrc")
_YEAR = re.compile(r"\d{4}", re.A)


@lru_cache(10_000)
def _local(tag: object) -> str:
    """A tag without its name space; comments and instructions have none."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _pieces(e: Element) -> list[str]:
    """The texts that stand directly in an element."""
    return [t for t in (e.text, *(c.tail for c in e)) if t]


def _whole(e: Element | None) -> str:
    """All text in an element."""
    return "" if e is None else "".join(e.itertext()) if len(e) else e.text or ""


def _inside(e: Element, name: str) -> list[Element]:
    return [x for x in e.iter() if _local(x.tag) == name and x is not e]


def _person(author: Element) -> tuple[str | None, ...]:
    given: list[str] = []
    found: dict[str, str] = {}
    for x in author.iter():
        name = _local(x.tag)
        if name == "forename":
            given.append(_whole(x).strip())
        elif name in ("surname", "email", "orgName", "idno"):
            found.setdefault(name, text := _whole(x).strip())
            if name[0] in "oi" and (kind := x.get("type")):
                found.setdefault(f"{name} {kind}", text)
    said = found.get
    return " ".join(given) or None, said("surname") or None, said("email") or None, said("idno ORCID") or None, said("orgName institution") or said("orgName") or None


def _record(xml: str | None) -> tuple:
    """The fields of `_TEI`."""
    try:
        # comments split the texts around them
        root = XML(xml, XMLParser(target=TreeBuilder(insert_comments=True, insert_pis=True))) if xml is not None else None
    except ParseError:
        root = None
    if root is None:
        return (None,) * len(_TEI)
    at: dict[str, list[Element]] = {}
    for e in root.iter():
        at.setdefault(name := _local(e.tag), []).append(e)
        if not name:
            e.text = None
    child = lambda parent, name: next((x for e in at.get(parent, ()) for x in e if _local(x.tag) == name), None)
    once = lambda found: list({id(e): e for e in found}.values())
    joined = lambda found: " ".join(t for p in found for t in _pieces(p)).strip() or None
    headed = lambda div: any(_local(h.tag) == "head" and " ".join(_whole(h).split()).translate(_ABSTRACT) == "abstract" for h in div)
    abstract = joined(once(p for e in at.get("abstract", ()) for p in _inside(e, "p"))) or joined(p for e in at.get("div", ()) if headed(e) for p in e if _local(p.tag) == "p")
    year = _YEAR.match(next((w for e in at.get("date", ()) if (w := e.get("when")) is not None), ""))
    source = at.get("sourceDesc", ())
    doi = next((x for e in source for x in _inside(e, "idno") if x.get("type") == "DOI"), None)
    titles = once(t for e in at.get("listBibl", ()) for b in e if _local(b.tag) == "biblStruct" for t in _inside(b, "title"))
    authors = [_person(a) for a in _inside(source[0], "author")] if source else []
    return _whole(child("titleStmt", "title")) or None, abstract, _whole(child("monogr", "title")) or None, year and year[0], _whole(doi) or None, [t for e in titles for t in _pieces(e)], authors


def _persons(lists: list[list[tuple] | None]) -> pa.Array:
    """Lists of people, column by column, as Arrow takes long to read them one by one."""
    people = [p for x in lists if x for p in x]
    columns = zip(*people) if people else [()] * len(_PERSON)
    ends = list(accumulate((len(x or ()) for x in lists), initial=0))
    offsets = pa.array([None if x is None else n for x, n in zip(lists, ends)] + ends[-1:], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, _TEXT) for c in columns], fields=list(_PERSON)), type=pa.list_(_PERSON))


def tei_record(xml: Column) -> Column:
    """struct(title, abstract, venue, year, doi, references, authors) of a TEI document, whatever its name spaces.

    The abstract's paragraphs are joined by blanks; without one, the division headed "abstract" counts. An author's given name is the
    joined forenames, the affiliation the institution, else any organisation. Each document is parsed once; unreadable XML gives a
    struct of nulls."""

    @F.arrow_udf(from_arrow_type(_TEI))
    def read(documents: pa.Array) -> pa.Array:
        *plain, authors = zip(*map(_record, documents.to_pylist())) if len(documents) else [()] * len(_TEI)
        return pa.StructArray.from_arrays([*(pa.array(x, f.type) for x, f in zip(plain, _TEI)), _persons(authors)], fields=list(_TEI))

    return read(xml)


MAZE = "struct<dimensions:struct<Width:int,Height:int>,HorizontalWalls:struct<Wall:array<struct<x:int,y:int>>>,VerticalWalls:struct<Wall:array<struct<x:int,y:int>>>,Unreachable:struct<Cell:array<struct<x:int,y:int>>>,Reward:struct<Cell:array<struct<x:int,y:int,reward:double>>>,Punishment:struct<Cell:array<struct<x:int,y:int,reward:double>>>,Terminal:struct<Cell:array<struct<x:int,y:int>>>>"


def maze(xml: Column) -> Column:
    """A maze document as a struct of cell lists; unreadable XML gives a struct of nulls."""
    return F.from_xml(xml, MAZE)


def maze_cells(parsed: Column) -> Column:
    """array<struct(kind, x, y, reward)> of all listed cells."""
    plain = lambda kind: F.transform(parsed[kind]["Cell"], lambda c: F.struct(F.lit(kind).alias("kind"), c["x"].alias("x"), c["y"].alias("y"), F.lit(None).cast("double").alias("reward")))
    paid = lambda kind: F.transform(parsed[kind]["Cell"], lambda c: F.struct(F.lit(kind).alias("kind"), c["x"].alias("x"), c["y"].alias("y"), c["reward"].alias("reward")))
    none = F.array().cast("array<struct<kind:string,x:int,y:int,reward:double>>")
    return F.concat(*[F.coalesce(c, none) for c in (plain("Unreachable"), paid("Reward"), paid("Punishment"), plain("Terminal"))])


def maze_rows(parsed: Column) -> Column:
    """The maze as text, one line per row: `#` unreachable, `T` terminal, `+` and `-` reward and punishment, `.` free; the first that holds."""
    at = lambda kind, x, y: F.exists(F.coalesce(parsed[kind]["Cell"], F.array().cast("array<struct<x:int,y:int,reward:double>>") if kind in ("Reward", "Punishment") else F.array().cast("array<struct<x:int,y:int>>")), lambda c: (c["x"] == x) & (c["y"] == y))
    sign = lambda x, y: F.when(at("Unreachable", x, y), "#").when(at("Terminal", x, y), "T").when(at("Reward", x, y), "+").when(at("Punishment", x, y), "-").otherwise(".")
    width, height = parsed["dimensions"]["Width"], parsed["dimensions"]["Height"]
    return F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: sign(x, y)), ""))


def graph_edges(text: Column) -> Column:
    """array<struct(src, dst, ord)> of the `n -> m` arrows of a graph text."""
    a, b = (F.regexp_extract_all(text, F.lit(r"(\d+)\s*->\s*(\d+)"), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.struct(p["a"].cast("long").alias("src"), p["b"].cast("long").alias("dst"), i.alias("ord")))


def tensor_shape(text: Column) -> Column:
    """The sizes after the first of a shape like (1, 3, 572, 572)."""
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")), 2, 3)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, parent) edges of JSON trees {id, name, children[]}: nesting is unfolded level by level while it lasts, however deep."""
    level = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    top = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    level = level.select(F.explode(top).alias("v"), F.lit(None).cast("string").alias("parent"))
    out = None
    while True:
        rows = level.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.name", "string").alias("name"), "parent")
        out = rows if out is None else out.unionByName(rows)
        level = level.select(F.try_variant_get("v", "$.id", "string").alias("parent"), F.explode(F.try_variant_get("v", "$.children", "array<variant>")).alias("v"))
        if level.isEmpty():
            return out


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content_doi) of the files below `path`, each with the stand-in DOI of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", file_doi(F.col("content")).alias("content_doi"))


def file_for_doi(files: DataFrame, doi: str) -> DataFrame:
    return files.where(F.col("content_doi") == doi).orderBy("path").limit(1)
