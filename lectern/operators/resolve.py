"""Bundles of several sources into one record per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.jsons import document

SOURCES = {"pdf": "pdf_metadata", "crossref": "crossref_metadata", "openalex": "openalex_metadata"}
# Which source is asked first for what.
PRIORITY = {
    "doi": ["crossref", "openalex", "pdf"],
    "title": ["openalex", "crossref", "pdf"],
    "authors": ["openalex", "crossref", "pdf"],
    "year": ["crossref", "openalex", "pdf"],
}
# What a record's confidence adds up from, in this order.
WEIGHTS = [("doi", 0.4), ("work_id", 0.3), ("title", 0.2), ("authors", 0.1)]


def _value(source: str, field: str) -> Column:
    v = F.try_variant_get(F.col(f"_{source}"), f"$.{field}", "string")
    return F.when(~v.isin("", "0", "[]", "{}", "false"), v)


def parsed(bundles: DataFrame) -> DataFrame:
    """With the metadata parsed once and, for each field, the best value and its source; unreadable metadata count as empty."""
    out = bundles.select("id", "work_id", *[document(F.col(c)).alias(f"_{s}") for s, c in SOURCES.items()], *[F.col(c).alias(f"_{s}_text") for s, c in SOURCES.items()])
    for field, order in PRIORITY.items():
        best = F.coalesce(*[F.when(_value(s, field).isNotNull(), F.struct(_value(s, field).alias("value"), F.lit(s).alias("source"))) for s in order])
        out = out.withColumn(field, best)
    raw = [F.when(~F.try_variant_get(F.col(f"_{s}"), "$", "string").isin("", "0", "[]", "{}", "false"), F.col(f"_{s}_text")).alias(c) for s, c in SOURCES.items()]
    return out.withColumn("catalogue", _value("openalex", "id")).select("*", *raw)


def identity(bundles: DataFrame) -> DataFrame:
    """(id, key_type, key_value): what groups a bundle: the catalogue's id, else the best DOI, else itself."""
    kind = F.when(F.col("catalogue").isNotNull(), "work_id").when(F.col("doi").isNotNull(), "doi").otherwise("unresolved")
    return parsed(bundles).select("id", kind.alias("key_type"), F.coalesce("catalogue", "doi.value", F.col("id").cast("string")).alias("key_value"))


def merge(bundles: DataFrame) -> DataFrame:
    """One record per identity: of each field and of each source's metadata the first bundle's value (by id) that isn't missing, and where
    the fields came from.

    One shuffle by identity. The DOI that a bundle without any other identifier lends its work_id may come from an earlier bundle,
    therefore the running DOI. Fields are picked by minimum, not by collecting: only the ids and distinct DOIs of a group become lists,
    which are part of the record.
    """
    rows = parsed(bundles)
    key = [F.when(F.col("catalogue").isNotNull(), "work_id").when(F.col("doi").isNotNull(), "doi").otherwise("unresolved").alias("key_type"), F.coalesce("catalogue", "doi.value", F.col("id").cast("string")).alias("key_value")]
    rows = rows.select("*", *key)
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("id", c.alias("v"))))["v"]
    # within a group of kind doi all bundles have that DOI; in the others the first DOI is the running one from its bundle on
    named = F.coalesce("catalogue", F.nullif("work_id", F.lit("")))
    fallback = F.min(F.when(F.col("doi").isNotNull(), F.struct("id", F.concat(F.lit("doi:"), F.col("doi.value")).alias("v"))))
    own = F.min(F.when(named.isNotNull(), F.struct("id", named.alias("v"))))
    made = rows.groupBy("key_type", "key_value").agg(
        F.when(own.isNull() | (fallback["id"] < own["id"]), fallback["v"]).otherwise(own["v"]).alias("work_id"),
        *[first(F.col(f)).alias(f) for f in [*PRIORITY, *SOURCES.values()]],
        F.array_sort(F.collect_set("doi.value")).alias("alternate_dois"),
        F.array_sort(F.collect_list("id")).alias("source_bundle_ids"),
    )
    sure = lambda f: F.col(f).isNotNull() if f == "work_id" else F.col(f"{f}.value").isNotNull()
    score = sum((F.when(sure(f), w).otherwise(0.0) for f, w in WEIGHTS), F.lit(0.0))
    return made.select("key_type", "key_value", "work_id", *[F.col(f"{f}.value").alias(f) for f in PRIORITY], *[F.col(f"{f}.source").alias(f"{f}_source") for f in PRIORITY], "alternate_dois", "source_bundle_ids", score.alias("confidence"), *SOURCES.values())


def attach_hits(bundles: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Each bundle with the search hits of its key as a list in the hits' order; without hits the list is empty."""
    grouped = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "hit"))).alias("_hits"))
    empty = F.array().cast("array<string>")
    return bundles.join(grouped, key, "left").withColumn("hits", F.coalesce(F.transform("_hits", lambda h: h["hit"]), empty)).drop("_hits")


def keyed_union(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both sides, missing ones left out."""
    return one.select(key).union(two.select(key)).where(F.nullif(key, F.lit("")).isNotNull()).distinct()


def last_by(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the values of its last row, with the position of its first."""
    rest = [c for c in df.columns if c not in (key, position)]
    return df.groupBy(key).agg(F.min(position).alias(position), F.max_by(F.struct(*rest), position).alias("_r")).select(key, position, "_r.*")


def running_first(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """With the first value of the group that isn't null, up to each row."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.first(value, ignorenulls=True).over(w))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows without those that `new` replaces, and the new rows."""
    return old.join(new, key, "left_anti").unionByName(new.select(old.columns))


def fill_missing(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The old rows with null and empty fields taken from `new`, where it has any."""
    there = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = old.join(there, key, "left")
    return out.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])
