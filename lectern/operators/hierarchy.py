"""Trees as edge lists: roots, codes in pre-order, paths.

Spark has no recursive types; a tree stays relational and is walked with a recursive CTE that carries the path, which also guards
against cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import child_code, compact_code, leading_digits, name_code, name_description


def active(nodes: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return nodes.join(deleted, key, "left_anti")


def with_parents(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """`parent` set to null where it is 0, missing among the nodes, or the node itself: such nodes are roots."""
    known = nodes.select(F.col(key).alias("_p")).distinct()
    out = nodes.join(known, nodes[parent] == known["_p"], "left")
    return out.withColumn(parent, F.when((F.col(parent) != 0) & (F.col(parent) != F.col(key)), F.col("_p"))).drop("_p")


def walk(nodes: DataFrame, key: str, parent: str, name: str, max_depth: int = 100) -> DataFrame:
    """(key, root, depth, path): every node that a root reaches; path holds the keys from the root on, sorted paths are pre-order.
    Nodes of a cycle without a root are in no row."""
    spark = nodes.sparkSession
    rows = with_parents(nodes, key, parent).select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).alias("name"))
    return spark.sql(
        f"""WITH RECURSIVE t(k, root, depth, path) MAX RECURSION LEVEL {max_depth} AS (
              SELECT k, k, 0, array(k) FROM {{n}} WHERE p IS NULL
              UNION ALL
              SELECT n.k, t.root, t.depth + 1, array_append(t.path, n.k) FROM t JOIN {{n}} n ON n.p = t.k WHERE NOT array_contains(t.path, n.k))
            SELECT k AS {key}, root, depth, path FROM t""",
        n=rows,
    )


def codes(nodes: DataFrame, key: str, parent: str, name: str, skipped: str = "papers") -> DataFrame:
    """(key, path, code, description) in pre-order by path: each node's class code from its own number and its parent's code.
    A node that is nameless or called `skipped` gives no row and hands its parent's code on."""
    rows = with_parents(nodes, key, parent).select(F.col(key).alias("k"), F.col(parent).alias("p"), F.coalesce(F.col(name), F.lit("")).alias("name"))
    shown = (F.col("name") != "") & (F.col("name") != skipped)
    named = rows.withColumn("num", F.when(shown, name_code(F.col("name")))).withColumn("descr", name_description(F.col("name")))
    found = walk(nodes, key, parent, name)
    # codes level by level along the path: fold over the numbers of the path's nodes
    steps = found.select(F.col(key).alias("k"), "path", F.posexplode("path").alias("at", "node")).join(named.select(F.col("k").alias("node"), "num"), "node")
    nums = steps.groupBy("k", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "num"))), lambda s: s["num"]).alias("nums"))
    fold = F.aggregate("nums", F.lit(None).cast("string"), lambda code, num: F.when(num.isNull(), code).otherwise(compact_code(child_code(code, num))))
    out = nums.withColumn("code", fold).join(named.select("k", "num", "descr"), "k").where("num is not null")
    return out.select(F.col("k").alias(key), "path", "code", F.col("descr").alias("description"))


def number_path(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, code): the leading numbers of the names from the root on, joined by points; nodes without a number hand the code on."""
    found = walk(nodes, key, parent, name).select(key, F.posexplode("path").alias("at", "node"))
    named = nodes.select(F.col(key).alias("node"), leading_digits(F.col(name)).alias("num"))
    nums = found.join(named, "node").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "num"))).alias("n"))
    return nums.select(key, F.array_join(F.filter(F.transform("n", lambda s: s["num"]), lambda x: x.isNotNull()), ".").alias("code"))


def items_by_node(nodes: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """Every node with its items as a sorted list, empty without any; items of unknown nodes are dropped."""
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(items.dtypes)[item]
    return nodes.join(lists, key, "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{kind}>")))


def with_attachments(items: DataFrame, attachments: DataFrame, key: str, node: str) -> DataFrame:
    """(node, items): the items of each node as a JSON list by key, every item with its attachments as a list, empty without any."""
    files = attachments.groupBy(key).agg(F.array_sort(F.collect_list("attachment")).alias("attachments"))
    rows = items.join(files, key, "left").select(node, key, F.struct(F.col(key).alias("id"), "title", F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments")).alias("i"))
    return rows.groupBy(node).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "i"))), lambda x: x["i"]), {"ignoreNullFields": "false"}).alias("items"))


def export(nodes: DataFrame, key: str, parent: str, name: str, items: DataFrame, root: object = None) -> DataFrame:
    """(key, json): the trees of all roots or of one, the nodes with their items as `with_attachments` gives them. The filter looks at roots only:
    a node below a root is no tree of its own."""
    made = nested_json(nodes, key, parent, name, items)
    return made if root is None else made.where(F.col(key) == F.lit(root))


def nested_json(nodes: DataFrame, key: str, parent: str, name: str, items: DataFrame | None = None) -> DataFrame:
    """(key, json): every root as a JSON tree {id, name[, items[]], children[]}, children by key. Levels are nested from the deepest up, one
    aggregation each; the tree of a root must fit into a row."""
    depth = walk(nodes, key, parent, name).select(key, "depth")
    rows = with_parents(nodes, key, parent).select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).alias("name")).join(depth.withColumnRenamed(key, "k"), "k")
    if items is None:
        rows = rows.withColumn("said", F.lit(""))
    else:
        rows = rows.join(items.select(F.col(key).alias("k"), "items"), "k", "left").withColumn("said", F.concat(F.lit('"items": '), F.coalesce("items", F.lit("[]")), F.lit(", "))).drop("items")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    open_ = lambda children: F.concat(F.lit('{"id": '), F.col("k").cast("string"), F.lit(', "name": '), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(", "), F.col("said"), F.lit('"children": ['), children, F.lit("]}"))
    made = rows.where(F.col("depth") == deepest).select("k", "p", open_(F.lit("")).alias("json"))
    for d in range(deepest - 1, -1, -1):
        below = made.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "json"))).alias("c")).withColumnRenamed("p", "k")
        level = rows.where(F.col("depth") == d).join(below, "k", "left")
        made = level.select("k", "p", open_(F.coalesce(F.array_join(F.transform("c", lambda x: x["json"]), ", "), F.lit(""))).alias("json"))
    return made.select(F.col("k").alias(key), "json")
