"""A Spark data source for services that answer in pages.

The transport is a picklable callable `fetch(query, cursor, size) -> (items, next cursor or None)` that is given; without one, pages are read
from files, which is how offline runs work. Each query is a partition, so queries are fetched in parallel and a lost executor only repeats
its own. Retries with growing pauses, after lost connections and the answers 429 and 5xx, stay inside the partition. Credentials come from
the transport's own configuration, never from here.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lectern.functions.text import canonical_doi
from lectern.operators.records import BIBLIOGRAPHIC, first_hit


class Answer(Exception):
    """What a transport raises for an answer that is no page, with its status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


class QueryPartition(InputPartition):
    def __init__(self, query: str):
        self.query = query


def file_transport(folder: str) -> Callable:
    """Pages kept as <folder>/<query>.json: a list of pages, each a list of items. They are served in the size asked for."""

    def fetch(query: str, cursor: str | None, size: int) -> tuple[list, str | None]:
        with open(f"{folder}/{query}.json") as f:
            items = [item for page in json.load(f) for item in page]
        at = int(cursor or 0)
        return items[at : at + size], str(at + size) if at + size < len(items) else None

    return fetch


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [QueryPartition(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: QueryPartition) -> Iterator[tuple]:
        given = self.options.get("transport")
        fetch = cloudpickle.loads(base64.b64decode(given)) if given else file_transport(self.options["folder"])
        size, target = int(self.options.get("size", 200)), int(self.options.get("target", 1000))
        retries, pause = int(self.options.get("retries", 5)), float(self.options.get("pause", 1.5))
        cursor, got = None, 0
        while got < target:
            for attempt in range(retries):
                try:
                    items, cursor = fetch(partition.query, cursor, size)
                    break
                except (OSError, Answer) as e:
                    again = not isinstance(e, Answer) or e.status == 429 or e.status >= 500
                    if not again or attempt + 1 == retries:
                        raise
                    time.sleep(pause**attempt)
            for item in items[: target - got]:
                yield partition.query, got, json.dumps(item)
                got += 1
            if cursor is None or not items:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, position int, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


def search(spark: SparkSession, queries: list[str], folder: str = "", target: int = 1000, size: int = 200, transport: Callable | None = None, **options: object) -> DataFrame:
    """(query, position, item): the first `target` hits of each query; options are `retries` and `pause`."""
    spark.dataSource.register(PagedSource)
    said = {"queries": json.dumps(queries), "folder": folder, "target": str(target), "size": str(size), **{k: str(v) for k, v in options.items()}}
    if transport is not None:
        said["transport"] = base64.b64encode(cloudpickle.dumps(transport)).decode()
    return spark.read.format("paged").options(**said).load()


def search_years(spark: SparkSession, query: str, years: range, written: Callable[[str, int], str] = "{} {}".format, **how: object) -> DataFrame:
    """(year, position, doi, item): the hits of every year, each year's by itself, with the DOI in canonical form; `written` puts a year into a query."""
    parts = [search(spark, [written(query, y)], **how).withColumn("year", F.lit(y)) for y in years]
    hits = reduce(DataFrame.unionByName, parts)
    return hits.select("year", "position", canonical_doi(F.try_variant_get(F.try_parse_json("item"), "$.doi", "string")).alias("doi"), "item")


#: What a registry's search and a catalogue's lookup are projected to: {name: path}.
REGISTRY = {"doi": "DOI", "title": "title[0]", "container_title": "container-title[0]", "published_year": "issued.date-parts[0][0]", "volume": "volume", "issue": "issue", "page": "page"}
CATALOGUE = {"id": "id", "doi": "doi", "title": "title", "year": "publication_year", "cited_by_count": "cited_by_count"}
SCHOLAR = {"id": "paperId", "title": "title", "abstract": "abstract", "year": "year", "url": "openAccessPdf.url"}


def projected(hits: DataFrame, fields: dict[str, str]) -> DataFrame:
    """As `project`, with the DOI in canonical form."""
    return project(hits, fields).withColumn("doi", canonical_doi(F.col("doi")))


def looked_up(keys: DataFrame, hits: DataFrame, fields: dict[str, str], key: str = "query") -> DataFrame:
    """Every key of `keys(query)` with the projection of its first hit, nulls without any."""
    return keys.join(first_hit(project(hits, fields), key, "position"), key, "left")


def publications(hits: DataFrame, most: int | None = None, types: list[str] | None = None) -> DataFrame:
    """(query, position, item) of a listing's items whose itemType is a publication's; `most` caps a listing before the types are looked at."""
    kind = F.try_variant_get(F.try_parse_json("item"), "$.data.itemType", "string")
    rows = hits if most is None else hits.where(F.col("position") < most)
    return rows.where(kind.isin(*(BIBLIOGRAPHIC if types is None else types)))


def atom_entries(feed: Column) -> Column:
    """array<struct(id, title, summary, published, authors)> of an Atom feed; empty for what is none."""
    entries = F.regexp_extract_all(F.coalesce(feed, F.lit("")), F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))
    one = lambda e, tag: F.nullif(plain(F.regexp_extract(e, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    names = lambda e: F.transform(F.regexp_extract_all(e, F.lit(r"(?s)<author\b[^>]*>(.*?)</author>"), F.lit(1)), lambda a: one(a, "name"))
    return F.transform(entries, lambda e: F.struct(one(e, "id").alias("id"), one(e, "title").alias("title"), one(e, "summary").alias("summary"), one(e, "published").alias("published"), names(e).alias("authors")))


def project(hits: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(query, position, fields...): {name: path} of each hit as text."""
    v = F.try_parse_json("item")
    return hits.select("query", "position", *[F.try_variant_get(v, f"$.{p}", "string").alias(n) for n, p in fields.items()])


def crossref_record(item: str) -> list:
    """Columns of a registry record: first title, authors "given family", first issued year."""
    v = F.try_parse_json(item)
    people = F.try_variant_get(v, "$.author", "array<struct<given:string,family:string>>")
    name = F.transform(people, lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return [F.lower(F.try_variant_get(v, "$.DOI", "string")).alias("doi"), F.try_variant_get(v, "$.title[0]", "string").alias("title"), F.coalesce(name, F.array().cast("array<string>")).alias("authors"), F.try_variant_get(v, "$.issued.date-parts[0][0]", "int").alias("year")]


def matches(hits: DataFrame, concepts: list[str] | None = None, years: tuple[int, int] | None = None, with_abstract: bool = False) -> DataFrame:
    """The hits that have any of the concepts, a year in the range, an abstract: what a search service would filter on its side."""
    v = F.try_parse_json("item")
    keep = F.lit(True)
    if concepts:
        ids = F.transform(F.try_variant_get(v, "$.concepts", "array<struct<id:string>>"), lambda c: c["id"])
        keep &= F.arrays_overlap(ids, F.array(*map(F.lit, concepts)))
    if years:
        keep &= F.try_variant_get(v, "$.publication_year", "int").between(*years)
    if with_abstract:
        keep &= F.try_variant_get(v, "$.abstract_inverted_index", "map<string,variant>").isNotNull()
    return hits.where(keep)
