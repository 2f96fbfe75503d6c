"""Problem 1: one group identifier for all bundles of a work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import doi_key, json_list
from lectern.llm.components import connected_components, star
from lectern.plans.runtime import table


def bundle_groups(bundles: DataFrame, works: DataFrame) -> DataFrame:
    """(id, group_id, n) for every bundle; group_id is the smallest id of its group and n the group's size.

    All bundles of one work_id are one vertex from the start, named by their smallest id, so a hot work_id costs no edges. The lists
    of alternate_dois are vertices with negative ids. Every DOI ties the vertices that hold it to the smallest of them.
    Bundles with a null id are left out, a null work_id ties nothing, repeated rows count once, unreadable lists count as empty,
    other columns are ignored; empty tables give no rows.
    """
    b = bundles.where("id is not null").select("id", F.coalesce("work_id", F.concat(F.lit("\0"), F.col("id").cast("string"))).alias("work"), "doi").distinct()
    vertex = b.groupBy("work").agg(F.min("id").alias("v"), F.countDistinct("id").alias("m"))
    named = F.when(F.col("work").startswith("doi:"), doi_key(F.substring("work", 5, 1 << 30)))
    held = b.select("work", F.explode(F.array(doi_key(F.col("doi")), named)).alias("doi")).where("doi is not null").distinct()
    held = held.join(vertex, "work").select("doi", "v")
    number = F.coalesce(F.col("id"), F.pmod(F.xxhash64("alternate_dois"), F.lit(1 << 62)))
    listed = works.select((-number - 1).alias("v"), F.explode(F.transform(json_list(F.col("alternate_dois")), doi_key)).alias("doi")).where("doi is not null")
    label = connected_components(star(held.unionByName(listed), "doi", "v"))
    placed = vertex.join(label, "v", "left").select("work", "v", "m", F.coalesce("component", "v").alias("component"))
    group = placed.groupBy("component").agg(F.min("v").alias("group_id"), F.sum("m").alias("n"))
    return b.select("id", "work").distinct().join(placed.join(group, "component").select("work", "group_id", "n"), "work").select("id", "group_id", "n")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle whose group has at least two bundles."""
    return bundle_groups(table(spark, sf_dir, "raw_bundles"), table(spark, sf_dir, "normalized_works")).where("n > 1").select("id", "group_id")
