"""Single tables of records: views, lookups, deletes, filling of missing fields by type, enrichment by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dates import list_date
from lectern.functions.text import truthy

# The item types that count as publications.
BIBLIOGRAPHIC = ["journalArticle", "conferencePaper", "bookSection", "report", "Report", "thesis", "preprint", "manuscript"]
# The field in which a container's title goes, by item type.
CONTAINER = {"journalArticle": "publicationTitle", "conferencePaper": "proceedingsTitle", "bookSection": "bookTitle"}
# The types that have volume, issue and pages, and the fields' names in what was found.
SERIAL = ["journalArticle", "conferencePaper"]
SERIAL_FIELDS = {"volume": "volume", "issue": "issue", "pages": "page"}


def list_view(rows: DataFrame, key: str, date: str, columns: list[str]) -> DataFrame:
    """The named columns with the date as a list shows it, ordered by key."""
    return rows.select(key, *[list_date(F.col(c)).alias(c) if c == date else F.col(c) for c in columns]).orderBy(key)


def record(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with that key; none for null."""
    return rows.where(F.col(key) == F.lit(value))


def delete(rows: DataFrame, key: str, value: object) -> DataFrame:
    """All rows but those with that key; rows with a null key stay."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(value)))


def blob_marker(c: Column) -> Column:
    """`A` where there is content, empty otherwise."""
    return F.when(F.length(c) > 0, "A").otherwise("")


def all_equal(c: Column) -> Column:
    """An aggregate: are all values of the group equal? A null equals only nulls."""
    return (F.count(c) == 0) | (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))


def titles(ids: DataFrame, works: DataFrame, key: str, title: str) -> DataFrame:
    """Every id with its title (the smallest of several), empty where there is none."""
    one = works.groupBy(key).agg(F.min(title).alias(title))
    return ids.join(one, key, "left").withColumn(title, F.coalesce(title, F.lit("")))


def of_types(items: DataFrame, kind: str, types: list[str] | None = None) -> DataFrame:
    return items.where(F.col(kind).isin(*(BIBLIOGRAPHIC if types is None else types)))


def lacking(items: DataFrame, title: str, doi: str) -> DataFrame:
    """The items that have a title but no DOI: those worth a lookup."""
    return items.where(truthy(F.col(title)).isNotNull() & truthy(F.col(doi)).isNull())


def first_hit(hits: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: its hit of the lowest position."""
    rest = [c for c in hits.columns if c not in (key, position)]
    return hits.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("_h")).select(key, "_h.*")


def most_cited(hits: DataFrame, citations: str, key: str, k: int) -> DataFrame:
    """The k most cited rows, by key on ties; unknown counts come last."""
    return hits.orderBy(F.col(citations).desc_nulls_last(), key).limit(k)


def fill_by_type(items: DataFrame, kind: str = "itemType", found: str = "found") -> DataFrame:
    """`items(itemType, DOI, date, publicationTitle, ..., found)` with what is missing (null or empty) taken from the struct
    `found(DOI, container_title, published_year, volume, issue, page)`: DOI and date for all types, the container's title in the
    field of the type, volume, issue and pages for articles and conference papers. Without `found` nothing changes."""
    f = lambda name: truthy(F.col(found)[name].cast("string"))

    def filled(c: str, new: Column) -> Column:
        return F.when(truthy(F.col(c)).isNull(), F.coalesce(new, F.col(c))).otherwise(F.col(c)).alias(c)

    new = {"DOI": f("DOI"), "date": f("published_year")}
    new |= {field: F.when(F.col(kind) == t, f("container_title")) for t, field in CONTAINER.items()}
    new |= {field: F.when(F.col(kind).isin(*SERIAL), f(name)) for field, name in SERIAL_FIELDS.items()}
    return items.select(*[filled(c, new[c]) if c in new else F.col(c) for c in items.columns if c != found])


def enriched(items: DataFrame, hits: DataFrame, key: str, title: str = "title", doi: str = "DOI", kind: str = "itemType") -> DataFrame:
    """All items, those with a title and no DOI filled from the first hit of their title in
    `hits(title, position, DOI, container_title, published_year, volume, issue, page)`."""
    best = first_hit(hits, title, "position").select(F.col(title).alias("_t"), F.struct("DOI", "container_title", "published_year", "volume", "issue", "page").alias("found"))
    wanted = truthy(F.col(title)).isNotNull() & truthy(F.col(doi)).isNull()
    out = items.join(best, F.when(wanted, F.col(title)) == F.col("_t"), "left").drop("_t")
    return fill_by_type(out, kind)
