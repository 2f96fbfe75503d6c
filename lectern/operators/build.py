"""Bundles from what sources know about a DOI, a BibTeX entry or a file; missing and failed parts become errors, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import canonical_doi, truthy, work_identifier

def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of several the last by `order`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def looked_up(keys: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """`keys(doi, ...)` with crossref_metadata and openalex_metadata from lookup tables (doi, title, authors, year[, id, concepts]) as
    JSON text and an error for each source without a record. DOIs are compared in canonical form; a null DOI looks nothing up."""
    out = keys.withColumn("_doi", canonical_doi(F.col("doi")))
    errors = []
    for name, source in (("crossref", crossref), ("openalex", openalex)):
        record = F.to_json(F.struct(*[F.col(c) for c in source.columns]), {"ignoreNullFields": "false"})
        found = source.select(canonical_doi(F.col("doi")).alias("_doi"), record.alias(f"{name}_metadata")).groupBy("_doi").agg(F.min(f"{name}_metadata").alias(f"{name}_metadata"))
        out = out.join(found, "_doi", "left")
        errors.append(F.when(F.col("_doi").isNotNull() & F.col(f"{name}_metadata").isNull(), F.lit(f"{name}: no record")))
    empty = ["crossref_metadata", "openalex_metadata"]
    out = out.withColumn("errors", F.to_json(F.array_compact(F.array(*errors))))
    return out.select("*", *[F.coalesce(c, F.lit("{}")).alias(f"_{c}") for c in empty]).drop("_doi", *empty).withColumnsRenamed({f"_{c}": c for c in empty})


def from_dois(dois: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """(work_id, doi, crossref_metadata, openalex_metadata, errors), one bundle per distinct DOI."""
    keys = dois.select(canonical_doi(F.col("doi")).alias("doi")).where("doi <> ''").distinct()
    return looked_up(keys, crossref, openalex).withColumn("work_id", F.concat(F.lit("doi:"), "doi"))


def from_bibtex(entries: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """Bundles of BibTeX entries (id, title, authors, year, doi, arxiv); an entry without title and identifiers is an `error:` bundle."""
    c = F.col
    bad = truthy(c("title")).isNull() & c("doi").isNull() & c("arxiv").isNull()
    out = looked_up(entries, crossref, openalex)
    work = F.when(bad, F.concat(F.lit("error:"), c("id"))).otherwise(work_identifier(c("doi"), c("arxiv"), c("title"), c("authors"), c("year")))
    return out.withColumn("work_id", work).withColumn("errors", F.when(bad, F.lit('["nothing to identify the entry by"]')).otherwise(c("errors")))


def from_files(files: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """Bundles of files (path, content_doi, title, authors, year, doi): without any metadata the bytes' stand-in DOI identifies the work."""
    c = F.col
    known = truthy(c("doi")).isNotNull() | truthy(c("title")).isNotNull()
    work = F.when(known, work_identifier(c("doi"), F.lit(None).cast("string"), c("title"), c("authors"), c("year"))).otherwise(c("content_doi"))
    return looked_up(files, crossref, openalex).withColumn("work_id", work)


def from_searches(one: DataFrame, two: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """Bundles of all DOIs that two searches (doi, position, item) found, each with the hits of both as JSON lists in order."""
    out = from_dois(one.select("doi").unionByName(two.select("doi")), crossref, openalex)
    for name, hits in (("search_hits_crossref", one), ("search_hits_openalex", two)):
        lists = hits.groupBy(canonical_doi(F.col("doi")).alias("doi")).agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("_h"))
        out = out.join(lists, "doi", "left").withColumn(name, F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("_h", lambda h: h["item"]), ", "), F.lit("")), F.lit("]"))).drop("_h")
    return out


def summary_fields(text: Column) -> Column:
    """struct(summary, contributions, methods, limitations) of a JSON answer, missing fields empty; other text is the summary."""
    v = F.try_parse_json(text)
    lists = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    said = F.when(is_object, F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(""))).otherwise(F.coalesce(text, F.lit("")))
    return F.struct(said.alias("summary"), *[lists(k).alias(k) for k in ("contributions", "methods", "limitations")])


def type_fields(kind: Column, container: Column) -> Column:
    """Where a publication's container title goes by its type: map with one entry, empty for other types."""
    # The field of each type.
    fields = {"journalArticle": "publicationTitle", "conferencePaper": "proceedingsTitle", "bookSection": "bookTitle"}
    return F.filter(F.array(*[F.when(kind == k, F.struct(F.lit(f).alias("field"), container.alias("value"))) for k, f in fields.items()]), lambda x: x.isNotNull())
