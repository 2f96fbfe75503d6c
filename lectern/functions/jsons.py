"""Tolerant JSON: metadata that may be null, misshapen or unreadable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVERTED = "map<string,array<int>>"


def document(c: Column) -> Column:
    """Text as a VARIANT; a JSON string that itself holds a document is read as that document; unreadable text is null."""
    v = F.try_parse_json(c)
    return F.when(c.rlike(r'^\s*"'), F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)).otherwise(v)


def text_at(c: Column, path: str) -> Column:
    """The value at a path as text; null where it is missing, empty or 0."""
    v = F.try_variant_get(document(c), path, "string")
    return F.when(~v.isin("", "0", "[]", "{}", "false"), v)


def concepts(c: Column) -> Column:
    """array<struct<id, score>> of a metadata document; concepts without id are dropped, a missing score is 0."""
    made = F.transform(F.try_variant_get(document(c), "$.concepts", "array<struct<id:string,score:double>>"), lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["score"], F.lit(0.0)).alias("score")))
    return F.coalesce(F.filter(made, lambda x: x["id"].isNotNull() & (x["id"] != "")), F.array().cast("array<struct<id:string,score:double>>"))


def inverted_abstract(c: Column) -> Column:
    return F.try_variant_get(document(c), "$.abstract_inverted_index", INVERTED)


def display_names(v: Column) -> Column:
    """The authors' display names of a catalogue document (VARIANT), those without one left out; empty without authors."""
    people = F.try_variant_get(v, "$.authorships", "array<struct<author:struct<display_name:string>>>")
    names = F.filter(F.transform(people, lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    return F.coalesce(names, F.array().cast("array<string>"))


def value_or(c: Column, path: str, default: Column, kind: str = "string") -> Column:
    """The value at a path of a document, the default where there is none."""
    return F.coalesce(F.try_variant_get(document(c), path, kind), default)


def transposed(rows: Column) -> Column:
    """Rows as columns, cut to the shortest row; null rows and no rows give none."""
    width = F.array_min(F.transform(rows, F.size))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))).otherwise(F.slice(rows, 1, 0))


def _places(index: Column) -> Column:
    one = lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))
    return F.array_sort(F.filter(F.flatten(F.transform(F.map_entries(index), lambda e: F.coalesce(one(e), F.array().cast("array<struct<pos:int,word:string>>")))), lambda s: s["pos"].isNotNull()))


def abstract_text(index: Column) -> Column:
    """The text of an inverted index, words by (position, word), several at one position kept; null for null and empty ones."""
    return F.when(F.size(index) > 0, F.array_join(F.transform(_places(index), lambda s: s["word"]), " "))


def abstract_text_single(index: Column) -> Column:
    """As `abstract_text` with one word per position, the last in the index's order; gaps are skipped; empty for null."""
    entries = F.transform(F.map_entries(index), lambda e, i: F.struct(e["key"].alias("word"), e["value"].alias("at"), i.alias("no")))
    places = F.flatten(F.transform(entries, lambda e: F.transform(e["at"], lambda p: F.struct(p.alias("pos"), (-e["no"]).alias("no"), e["word"].alias("word")))))
    ordered = F.array_sort(places)
    kept = F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, i - 1)["pos"] != s["pos"]))
    return F.coalesce(F.array_join(F.transform(kept, lambda s: s["word"]), " "), F.lit(""))


def first_object(c: Column) -> Column:
    """The first balanced `{...}` of a text by counting braces (also those in strings), cleaned of a comma before a closing brace; null
    if there is none or it is no JSON."""
    start = F.instr(c, "{")
    tail = F.when(start > 0, F.substr(c, start))
    step = lambda s, ch: F.when(s["done"], s).otherwise(F.struct((s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"), (s["length"] + 1).alias("length"), (s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0) == 0).alias("done")))
    end = F.aggregate(F.split(tail, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done")), step)
    body = F.when(end["done"], F.substr(tail, F.lit(1), end["length"]))
    clean = F.regexp_replace(F.regexp_replace(body, "[\n\t]", " "), ", }", "}")
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(clean).isNotNull(), clean)


def pdf_url(c: Column) -> Column:
    """The primary location's PDF address, else the first of the locations that has one."""
    v = document(c)
    urls = F.filter(F.transform(F.try_variant_get(v, "$.locations", "array<struct<pdf_url:string>>"), lambda x: x["pdf_url"]), lambda u: u != "")
    return F.coalesce(F.nullif(F.try_variant_get(v, "$.primary_location.pdf_url", "string"), F.lit("")), F.get(urls, F.lit(0)))


def pdf_candidates(oa: Column, arxiv: Column, doi: Column) -> Column:
    """All addresses under which a paper's PDF may be found, in order of preference, each once."""
    made = [oa, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf")), F.concat(F.lit("https://doi.org/"), doi)]
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(m, F.lit("")) for m in made])))
