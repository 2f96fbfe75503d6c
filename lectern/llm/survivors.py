"""Problem 5: the surviving value of each field of a group of duplicate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import json_list, strip
from lectern.llm.components import connected_components, star
from lectern.plans.runtime import table

#: The project's order of sources, best first.
ORDER = {
    "doi": ["crossref", "openalex", "pdf"],
    "title": ["openalex", "crossref", "pdf"],
    "authors": ["openalex", "crossref", "pdf"],
    "year": ["crossref", "openalex", "pdf"],
}


def has_value(field: str) -> Column:
    """Null, empty text, an empty list and JSON null are no values."""
    c = F.col(field).cast("string")
    if field != "authors":
        return c.isNotNull() & (c != "")
    return c.isNotNull() & ~strip(c).isin("", "null") & ~c.rlike(r"^\s*\[\s*\]\s*$")


def work_groups(works: DataFrame) -> DataFrame:
    """(id, group_id) of the rows that share source bundles, directly or through others; rows alone are left out.

    Bundle ids are read as numbers, whether written as JSON numbers or texts; items that are none tie nothing.
    """
    pairs = works.select("id", F.explode(json_list(F.col("source_bundle_ids"))).alias("b")).select("id", F.expr("try_cast(trim(b) as bigint)").alias("b"))
    label = connected_components(star(pairs, "b", "id"))
    low = label.groupBy("component").agg(F.min("v").alias("group_id"))
    return label.join(low, "component").select(F.col("v").alias("id"), "group_id")


def latest_retrieval(works: DataFrame, bundles: DataFrame) -> DataFrame:
    """(id, at): the latest retrieval_timestamp, as an instant, among the source bundles of each row that has one."""
    pairs = works.select("id", F.explode(json_list(F.col("source_bundle_ids"))).alias("b")).select("id", F.expr("try_cast(trim(b) as bigint)").alias("b")).where("b is not null")
    times = bundles.where("id is not null").select(F.col("id").alias("b"), F.try_to_timestamp("retrieval_timestamp").cast("timestamp").alias("at")).where("at is not null")
    return pairs.join(times, "b").groupBy("id").agg(F.max("at").alias("at"))


def survivors(works: DataFrame, bundles: DataFrame, fields: dict[str, list[str]] = ORDER) -> DataFrame:
    """(group_id, field, survivor_id, value): one aggregation that takes, for every field at once, the maximum of the struct
    (has a value, source rank, latest retrieval, confidence, smaller id, value).

    Partial maxima are combined before the shuffle, so a group of any size is never gathered. Nulls in timestamp or confidence rank
    lowest, an unreadable provenance ranks as no source, ties go to the smallest id; a field without any value gives no row.
    Rows with a null id are left out; repeated rows change nothing; empty tables give no rows.
    """
    works = works.where("id is not null").select("id", "source_bundle_ids", "provenance", "confidence", *fields)
    grouped = works.join(work_groups(works), "id").join(latest_retrieval(works, bundles), "id", "left")
    source = F.from_json("provenance", "map<string,string>")

    def best(field: str, order: list[str]) -> Column:
        said = F.lower(strip(F.try_element_at(source, F.lit(field))))
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, len(order) - i)]), said), F.lit(0))
        # Spark orders NaN above all numbers: as a confidence it counts as null
        sure = F.when(~F.isnan("confidence"), F.col("confidence"))
        return F.max(F.when(has_value(field), F.struct(rank.alias("rank"), F.col("at"), sure.alias("sure"), (-F.col("id")).alias("low"), F.col(field).cast("string").alias("value")))).alias(field)

    wide = grouped.groupBy("group_id").agg(*[best(f, o) for f, o in fields.items()])
    long = wide.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("b")) for f in fields])).alias("x"))
    return long.where("x.b is not null").select("group_id", "x.field", (-F.col("x.b.low")).alias("survivor_id"), F.col("x.b.value").alias("value"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "normalized_works"), table(spark, sf_dir, "raw_bundles")).select("group_id", "field", "survivor_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per group, its fields side by side."""
    s = survivors(table(spark, sf_dir, "normalized_works"), table(spark, sf_dir, "raw_bundles"))
    return s.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ORDER])
